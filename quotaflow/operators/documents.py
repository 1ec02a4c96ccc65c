"""Document batch: identity, pages, overlapping chunks, metadata."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotaflow import constants as C
from quotaflow.functions.ids import chunk_id, content_hash, uuid5_url
from quotaflow.operators.ranking import top_per_key

Embedder = Callable[[list[str]], list[list[float]]]


def identify(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds file_hash and doc_id; equal content is the same document wherever the file lies."""
    hashed = files.withColumn("file_hash", content_hash(F.col(content)))
    return hashed.withColumn("doc_id", uuid5_url(F.col("file_hash")))


def distinct_documents(files: DataFrame, path: str = "file_path") -> DataFrame:
    """One file per doc_id, the first by path (paths are unique).

    Ids and paths alone decide, with copies cut per map task; what else a file carries only meets the chosen paths.
    """
    first = top_per_key(files.select("doc_id", path), ["doc_id"], [F.col(path).asc()])
    return first if set(files.columns) == {"doc_id", path} else files.join(first, ["doc_id", path], "left_semi")


def new_documents(files: DataFrame, known: DataFrame, path: str = "file_path") -> DataFrame:
    """Files whose document is neither known nor already present in this batch."""
    return distinct_documents(files, path).join(known.select("doc_id"), "doc_id", "left_anti")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_metadata(df: DataFrame, path: str = "file_path") -> DataFrame:
    """doc_type, account_id and opportunity_id from the folder convention and the file name.

    doc_type and account_id are the third and fourth part after ``Volumes``. A file that lies directly below
    its doc_type folder has its own name as account_id.
    """
    parts = F.split(F.col(path), "/")
    at = F.array_position(parts, "Volumes").cast("int")
    part = lambda n: F.when(at > 0, F.get(parts, at - 1 + n))
    opportunity = F.regexp_extract(file_name(F.col(path)), C.OPPORTUNITY_IN_NAME, 1)
    return df.withColumns(
        {
            "file_name": file_name(F.col(path)),
            "doc_type": F.coalesce(part(3), F.lit("unknown")),
            "account_id": part(4),
            "opportunity_id": F.nullif(opportunity, F.lit("")),
        }
    )


def plain_text(markup: Column) -> Column:
    """Text of a markup page: no scripts, styles, comments or tags; blanks collapsed."""
    text = F.regexp_replace(markup, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(character))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def page_rows(df: DataFrame, text: str = "content") -> DataFrame:
    """(page, page_text) rows; a form feed starts a page, blank pages are skipped but keep their number."""
    kept = [c for c in df.columns if c != text]
    pages = df.select(*kept, F.posexplode(F.split(F.col(text), "\f")).alias("_pos", "page_text"))
    return pages.filter(F.col("page_text").rlike(r"\S")).select(*kept, (F.col("_pos") + 1).alias("page"), "page_text")


def word_tokens(text: Column) -> Column:
    """Words together with the blanks in front of them, so that joined tokens give the text back."""
    return F.regexp_extract_all(text, F.lit(r"\s*\S+"), F.lit(0))


def chunk_rows_of(pages: DataFrame, tokenizer: Callable[[Column], Column] = word_tokens) -> DataFrame:
    """Overlapping windows of every page: (content, source_page, chunk_index, token_count).

    A window starts every 462 tokens and spans up to 512, also when it only holds the overlap of the previous
    one. The index counts from 0 on every page, before short chunks are dropped.
    """
    step = C.CHUNK_TOKENS - C.CHUNK_OVERLAP
    kept = [c for c in pages.columns if c not in ("page", "page_text")]
    tokens = pages.select(*kept, "page", tokenizer(F.col("page_text")).alias("_tokens"))
    n = F.size("_tokens")
    windows = F.when(
        n > 0,
        F.transform(
            F.sequence(F.lit(0), n - 1, F.lit(step)),
            lambda start: F.struct(
                F.btrim(
                    F.array_join(F.slice("_tokens", start + 1, F.lit(C.CHUNK_TOKENS)), ""), F.lit(" \t\r\n\f\u000b")
                ).alias("content"),
                F.least(F.lit(C.CHUNK_TOKENS), n - start).alias("token_count"),
            ),
        ),
    )
    exploded = tokens.select(*kept, "page", F.posexplode(windows).alias("chunk_index", "_w"))
    return exploded.select(*kept, F.col("page").alias("source_page"), "chunk_index", "_w.content", "_w.token_count")


def long_enough(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.col("token_count") >= C.CHUNK_MIN_TOKENS)


def with_chunk_ids(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("source_page"), F.col("chunk_index")))


def embed_texts(chunks: DataFrame, embed: Embedder, text: str = "content") -> DataFrame:
    """Adds ``embedding`` through a caller's function, 64 texts per call, inside the tasks that hold the rows."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), C.EMBED_BATCH):
                part = frame.iloc[start : start + C.EMBED_BATCH]
                yield part.assign(embedding=[list(map(float, v)) for v in embed(part[text].tolist())])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
    return chunks.mapInPandas(batches, f"{fields}, embedding array<float>")


def ingest(files: DataFrame, known: DataFrame, embeddings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Files (file_path, content) -> (chunk rows, metadata rows) of the documents not yet known.

    ``embeddings`` (chunk_id, embedding) is joined when given. A document without a long enough chunk yields
    neither chunks nor metadata, so it is looked at again next time.
    """
    described = path_metadata(new_documents(identify(files), known))
    chunks = with_chunk_ids(long_enough(chunk_rows_of(page_rows(described))))
    if embeddings is not None:
        chunks = chunks.join(embeddings, "chunk_id", "left")
    metadata = described.drop("content").join(chunks.select("doc_id").distinct(), "doc_id", "left_semi")
    return chunks, metadata


def ingest_status(files: DataFrame, known: DataFrame) -> DataFrame:
    """Status per file, files taken in the order of their paths.

    skipped: its text is known, or came in with an earlier file of this run, whatever the suffix; error: unsupported
    suffix; empty: no long enough chunk (such a text leaves no trace, so its copies are empty again); ingested.
    """
    suffix = F.lower(F.regexp_extract(F.col("file_path"), r"\.([A-Za-z0-9]+)$", 1))
    supported = suffix.isin("pdf", "docx", "doc", "txt", "md")
    # a page has a long enough chunk when its first window has enough tokens
    has_chunks = F.exists(F.split("content", "\f"), lambda page: F.size(word_tokens(page)) >= C.CHUNK_MIN_TOKENS)
    narrow = identify(files).select("file_path", "doc_id", supported.alias("supported"), has_chunks.alias("has_chunks"))
    narrow = narrow.join(known.select("doc_id").distinct().withColumn("known", F.lit(True)), "doc_id", "left")
    first = narrow.filter("supported AND has_chunks").groupBy("doc_id").agg(F.min("file_path").alias("first_path"))
    status = (
        F.when(F.col("known") | (F.col("first_path") < F.col("file_path")), "skipped")
        .when(~F.col("supported"), "errors")
        .when(~F.col("has_chunks"), "empty")
        .otherwise("ingested")
    )
    return narrow.join(first, "doc_id", "left").select("file_path", "doc_id", status.alias("status"))
