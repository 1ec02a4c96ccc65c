"""Deterministic identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotaflow import constants as C


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def uuid5_url(name: Column) -> Column:
    """Version-5 UUID of a text in the URL namespace, from SHA-1 alone."""
    digest = F.sha1(F.concat(F.unhex(F.lit(C.URL_NAMESPACE_HEX)), name.cast("binary")))
    part = lambda start, length: F.substr(digest, F.lit(start), F.lit(length))
    variant = F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))
    return F.concat_ws(
        "-",
        part(1, 8),
        part(9, 4),
        F.concat(F.lit("5"), part(14, 3)),
        F.concat(F.lower(F.hex(variant)), part(18, 3)),
        part(21, 12),
    )


def chunk_id(doc_id: Column, page: Column, index: Column) -> Column:
    """Same document, page and position give the same chunk id, so a retried write adds nothing new."""
    return F.sha2(F.concat_ws("|", doc_id, page.cast("string"), index.cast("string")), 256)
