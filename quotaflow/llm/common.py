"""Small helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaflow.session import run_folder

# ASCII bytes that are not letters or digits separate words; every byte of a non-ASCII character belongs to a word.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
BLANKS = b" \t\n\x0b\x0c\r"
MAP_BITS = 26  # of a bit map of rows: 8 MB


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps do not compute it again, also after a lost executor."""
    path = run_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def part_of(column: str, parts: int) -> Column:
    """Remainder that splits rows by the checksum of an id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def with_row(docs: DataFrame, *columns: str | Column, row_col: str | None = None) -> DataFrame:
    """The named columns and ``row``, a number of its own for each row, also for repeated rows and null ids.

    The numbers follow the file splits of the scan, which may differ between two reads. Who selects rows of the table
    by them writes them once (``numbered``) and names their column here.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    return docs.select(row.alias("row"), *columns)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` stored with a number for each row, and the name of that column."""
    row = free_name(docs, "row")
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``docs`` is called so."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    values = batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()
    return [v or b"" for v in values]


def release() -> None:
    """Gives memory that this worker process no longer uses back to the system; the process stays for other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pieces_of(batches: Iterator[pa.RecordBatch], limit: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of each hold about ``limit`` bytes (a single longer text stays whole)."""
    release()  # what earlier tasks have left
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()  # without a copy of the texts
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)
    release()


def with_maybe(df: DataFrame, column: str, rows: DataFrame, flag: str, bits: int = MAP_BITS) -> DataFrame:
    """``df`` with a column ``flag``: whether its ``column`` may be among that of ``rows``. True for all that are, and for some others.

    The bit map has a fixed size, whatever the number of rows, and is broadcast; the more rows, the more others pass. The two
    columns have one type, since equal numbers of different types have different hashes.
    """
    part, held = free_name(df, "part"), free_name(df, "map")
    place = f"pmod(xxhash64(`{column}`), {1 << bits}L) + 1"
    maps = rows.select(F.expr(place).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias(part))
    maps = stored(maps.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias(held)), "bit-map")  # 4 KB each, 2,048 at most
    octet = F.expr(f"cast(conv(hex(substring(`{held}`, cast(bitmap_bit_position({place}) div 8 AS int) + 1, 1)), 16, 10) AS int)")
    bit = F.expr(f"shiftleft(1, cast(bitmap_bit_position({place}) % 8 AS int))")
    joined = df.withColumn(part, F.expr(f"bitmap_bucket_number({place})")).join(F.broadcast(maps), part, "left")
    return joined.withColumn(flag, F.coalesce(octet.bitwiseAND(bit) != 0, F.lit(False))).drop(part, held)
