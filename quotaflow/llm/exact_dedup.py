"""Exact deduplication as a Grace hash join of the corpus with itself.

Texts are equal when they are identical without blanks. Each task first folds the equal texts of its own split into
one record (so that a text which owns a third of all rows travels once per task), then records are dealt to buckets
by a hash of their content. A bucket is read as a stream into an open-addressing table that compares complete
contents (a Python ``dict`` of byte strings). When the table is full, records whose content is not yet in it spill:
they are written to files in the shared folder and dealt again by another hash, level by level, until every bucket
has fitted. All copies of a text either stay or spill together, so counts are exact at each level.

Nulls: a null text counts as empty; a null id is the last choice for ``keep_id``. Repeated rows are copies like any
other, of which one stays. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotaflow.llm.common import BLANKS, release, stored, texts_of, with_row

BUCKET_BYTES = 64 << 20  # content that one table holds
MEMBER, GROUP, SPILLED = 0, 1, 2
TWINS = 1_000_000


def _record_type(id_type: T.DataType) -> T.StructType:
    """Copies of one text: members of one task, or the result of a group."""
    return (
        T.StructType()
        .add("kind", T.ByteType())
        .add("bucket", T.LongType())
        .add("digest", T.BinaryType())
        .add("twin", T.IntegerType())
        .add("rows", T.ArrayType(T.LongType()))
        .add("ids", T.ArrayType(id_type))
        .add("best_chars", T.LongType())
        .add("best_id", id_type)
        .add("best_row", T.LongType())
        .add("size", T.LongType())
        .add("body", T.BinaryType())
    )


def _rank(chars: int, doc_id, row: int) -> tuple:
    return (-chars, doc_id is None, doc_id if doc_id is not None else 0, row)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _bucket(digest: bytes, level: int, buckets: int) -> int:
    return xxhash.xxh64_intdigest(digest, level) % buckets


def _fold(schema: pa.Schema, buckets: int, limit: int) -> Callable:
    """One record for each distinct text of a split; a full table is handed on and begun anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0

        def records() -> Iterator[pa.RecordBatch]:
            found = list(held.items())
            held.clear()
            for start in range(0, len(found), 2000):
                out = []
                for body, (best, rows, ids) in found[start : start + 2000]:
                    digest = hashlib.sha256(body).digest()
                    doc_id = None if best[1] else best[2]
                    out.append((MEMBER, _bucket(digest, 0, buckets), digest, 0, rows, ids, -best[0], doc_id, best[3], len(rows), body))
                yield _batch(out, schema)

        for batch in batches:
            chars = pc.utf8_length(batch.column(2)).to_pylist()
            for row, doc_id, text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch), chars):
                body = text.translate(None, BLANKS)
                rank = _rank(n or 0, doc_id, row)
                mine = held.get(body)
                if mine is None:
                    held[body] = [rank, [row], [doc_id]]
                    size += len(body) + 200
                else:
                    mine[0] = min(mine[0], rank)
                    mine[1].append(row)
                    mine[2].append(doc_id)
                    size += 64
                if size > limit:
                    yield from records()
                    size = 0
        yield from records()
        release()

    return run


def _resolve(schema: pa.Schema, limit: int, level: int, buckets: int) -> Callable:
    """Groups of the buckets in this task, the members of each, and what did not fit (dealt to ``buckets`` for the next level)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        twins: dict[bytes, int] = {}
        size = 0
        for batch in batches:
            out = []
            for _, _, digest, _, rows, ids, chars, doc_id, row, n, body in zip(*(c.to_pylist() for c in batch.columns)):
                rank, group = _rank(chars, doc_id, row), held.get(body)
                if group is None and size and size + len(body) > limit:
                    out.append((SPILLED, _bucket(digest, level + 1, buckets), digest, 0, rows, ids, chars, doc_id, row, n, body))
                    continue
                if group is None:
                    twin = twins[digest] = twins.get(digest, level * TWINS - 1) + 1  # tells apart texts that share a digest
                    group = held[body] = [rank, 0, digest, twin]
                    size += len(body) + 200
                group[0] = min(group[0], rank)
                group[1] += n
                out.append((MEMBER, None, digest, group[3], rows, ids, None, None, None, None, None))
            yield _batch(out, schema)
        groups = list(held.values())
        held.clear()
        for start in range(0, len(groups), 10_000):
            yield _batch(
                [(GROUP, None, d, t, None, None, -r[0], None if r[1] else r[2], r[3], n, None) for r, n, d, t in groups[start : start + 10_000]],
                schema,
            )
        release()

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, row_col: str | None = None) -> DataFrame:
    """One row for each document: ``row``, its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Of equal texts the one with most characters stays, then the one with the smallest id, then the first row.
    ``row_col`` names stored row numbers; without it they are made here.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    source = with_row(docs, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), row_col=row_col)
    record = _record_type(source.schema["doc_id"].dataType)
    schema = to_arrow_schema(record)
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(2 * total / bucket_bytes))
    records = source.mapInArrow(_fold(schema, buckets, bucket_bytes // 2), record)
    level, levels = 0, []
    while True:
        solved = records.repartition(buckets, "bucket").mapInArrow(_resolve(schema, bucket_bytes, level, buckets), record)
        levels.append(stored(solved, f"exact-level{level}"))
        spilled = levels[-1].where(F.col("kind") == SPILLED)
        left = spilled.agg(F.sum(F.octet_length("body")), F.count("*")).first()
        if not left[1]:
            break
        level += 1
        records = spilled
    members, groups = None, None
    for part in levels:
        m = part.where(F.col("kind") == MEMBER).select("digest", "twin", "rows", "ids")
        g = part.where(F.col("kind") == GROUP).select("digest", "twin", "best_id", "best_row", "size")
        members, groups = (m, g) if members is None else (members.unionByName(m), groups.unionByName(g))
    return (
        members.join(groups, ["digest", "twin"])
        .select("*", F.explode(F.arrays_zip("rows", "ids")).alias("member"))
        .select(
            F.col("member.rows").alias("row"),
            F.col("member.ids").alias("doc_id"),
            F.col("best_id").alias("keep_id"),
            F.col("size").alias("group_size"),
            (F.col("member.rows") == F.col("best_row")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )
