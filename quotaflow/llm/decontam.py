"""Benchmark decontamination as a prefix-filtered set join.

An item is the set of its windows of ten consecutive words (a shorter item is one window), a window the set of its
shingles of three words. All of a window's shingles must occur for the window to occur, so one necessary prefix
token is enough: its rarest shingle, by counts over all documents. Documents are scanned in place:

1. the shingles of the benchmark are counted over all documents, to order them by rarity;
2. the places of prefix shingles in the documents are found, with the words around them;
3. these candidates join the windows on the prefix shingle. The shingle's position in the window gives the only
   possible start; starts that leave the document are discarded (length and positional bounds), and the words of
   the whole window are compared.

Only a bit map of shingle hashes goes to the tasks. Its size is a parameter and does not grow with the benchmark:
a full map lets more candidates through, which the join then drops.

Nulls: null texts have no words, a null item id is not counted as an item. Repeated rows each get their own result.
Empty tables give no hits, or no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotaflow.llm.common import WORD_BYTES, pieces_of, stored, texts_of, with_row

WINDOW, SHINGLE = 10, 3
MAP_BITS = 23  # 2**23 bits, one MB
TEXT_BYTES = 4 << 20

WINDOWS = T.StructType().add("item_id", T.StringType()).add("words", T.StringType()).add("n", T.IntegerType()).add(
    "shingles", T.ArrayType(T.LongType())
)
PLACE = pa.struct([("shingle", pa.int64()), ("at", pa.int64()), ("first", pa.int64()), ("words", pa.string())])
PLACES = "row long, doc_id {}, n_words long, places array<struct<shingle: long, at: long, first: long, words: string>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def shingles_of(words: list[bytes]) -> list[bytes]:
    """Runs of three words; of fewer words, their whole sequence."""
    if len(words) <= SHINGLE:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(words, words[1:], words[2:])))


def _signed(shingle: bytes) -> int:
    value = xxhash.xxh64_intdigest(shingle)
    return value - (1 << 64) if value >> 63 else value


def _windows(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 1 << 18):
            ids, found = batch.column(0).to_pylist(), []
            for item, text in zip(ids, texts_of(batch)):
                words = words_of(text)
                for start in range(max(1, len(words) - window + 1) if words else 0):
                    part = words[start : start + window]
                    found.append((item, b" ".join(part).decode(), len(part), [_signed(s) for s in shingles_of(part)]))
            columns = zip(*found) if found else ([], [], [], [])
            kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], WINDOWS.names)

    return run


def _bit_map(shingles: DataFrame, bits: int) -> np.ndarray:
    """Bit map of the lowest ``bits`` bits of the hashes: at most 2**bits / 8 distinct bytes reach the driver."""
    low = F.col("shingle").bitwiseAND((1 << bits) - 1)
    octets = shingles.groupBy(F.shiftright(low, 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(shingle & 7 as int))")).alias("set"))
    table = np.zeros(1 << (bits - 3), np.uint8)
    for byte, value in octets.toLocalIterator(prefetchPartitions=True):
        table[byte] = value
    return table


def _found(hashes: np.ndarray, bit_map: np.ndarray) -> np.ndarray:
    low = hashes & np.uint64(len(bit_map) * 8 - 1)
    return np.flatnonzero(bit_map[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8) & 1)


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, by place."""
    return np.array([xxhash.xxh64_intdigest(b" ".join(run)) for run in zip(*(words[i:] for i in range(size)))], dtype=np.uint64)


def _counts(shared: Broadcast, lengths: Broadcast) -> Callable:
    """Counts of the shingles in the map, by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in pieces_of(batches, TEXT_BYTES):
            for text in texts_of(batch):
                words = words_of(text)
                for size in lengths.value:
                    hashes = _hashes(words, size)
                    counts.update(hashes[_found(hashes, shared.value)].tolist())
        keys = np.fromiter(counts.keys(), np.uint64, len(counts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.fromiter(counts.values(), np.int64, len(counts)))], ["shingle", "n"])

    return run


def _places(shared: Broadcast, lengths: Broadcast, window: int) -> Callable:
    """Word counts of all documents, and the places of prefix shingles with the words around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, TEXT_BYTES):
            sizes, places = [], []
            for text in texts_of(batch):
                words = words_of(text)
                sizes.append(len(words))
                mine = []
                for size in lengths.value:
                    hashes = _hashes(words, size)
                    at = _found(hashes, shared.value)
                    for place, value in zip(at.tolist(), hashes[at].view(np.int64).tolist()):
                        first = max(0, place - window)
                        mine.append({"shingle": value, "at": place, "first": first, "words": b" ".join(words[first : place + window]).decode()})
                places.append(mine)
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(places, pa.list_(PLACE))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_words", "places"])

    return run


def prefixes(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, map_bits: int = MAP_BITS) -> DataFrame:
    """The distinct windows of the benchmark (text ``words``, length ``n``) with their rarest shingle and its ``offset``s."""
    source = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    found = stored(source.mapInArrow(_windows(window), WINDOWS), "bench-windows")
    tokens = found.select("words", "n", F.posexplode("shingles").alias("offset", "shingle"))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_bit_map(tokens.select("shingle").distinct(), map_bits))
    lengths = spark.sparkContext.broadcast(_lengths(tokens))
    counts = docs.select("text").mapInArrow(_counts(shared, lengths), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("seen"))
    ranked = tokens.distinct().join(counts, "shingle", "left").fillna(0, ["seen"])
    rarest = F.min(F.struct("seen", "shingle")).alias("rarest")
    prefix = ranked.groupBy("words", "n").agg(rarest).select("words", "n", F.col("rarest.shingle").alias("shingle"))
    # a shingle that the window repeats: its first place is enough, since the whole window is compared
    first = tokens.groupBy("words", "shingle").agg(F.min("offset").alias("offset"))
    return found.select("item_id", "words").distinct().join(stored(prefix.join(first, ["words", "shingle"]), "bench-prefix"), "words")


def _lengths(tokens: DataFrame) -> list[int]:
    """Word counts that the shingles have: three, or fewer in windows of fewer words."""
    return sorted(r[0] for r in tokens.select(F.least("n", F.lit(SHINGLE))).distinct().collect())


def _covered(spans: str) -> Column:
    """Number of places inside the ordered spans (``start``, ``n``) of a document."""

    def step(state: Column, span: Column) -> Column:
        end = span["start"] + span["n"]
        new = F.greatest(end - F.greatest(state["end"], span["start"]), F.lit(0).cast("long"))
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["n"] + new).alias("n"))

    nothing = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(spans, nothing, step, lambda state: state["n"])


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", window: int = WINDOW, map_bits: int = MAP_BITS, row_col: str | None = None) -> DataFrame:
    """``row`` (of ``row_col``, else made here), id, ``n_words``, ``n_hit`` (words inside windows of the benchmark), ``n_items`` and the sorted ``item_ids`` of each document."""
    source = with_row(docs, F.col(id_col).alias("doc_id"), "text", row_col=row_col)
    docs = docs.select(F.col(id_col).alias("doc_id"), "text")
    windows = stored(prefixes(docs, benchmark, window, map_bits), "bench-index")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_bit_map(windows.select("shingle").distinct(), map_bits))
    lengths = spark.sparkContext.broadcast(_lengths(windows))
    kind = source.schema["doc_id"].dataType.simpleString()
    scanned = stored(source.mapInArrow(_places(shared, lengths, window), PLACES.format(kind)), "bench-places")
    places = scanned.select("row", "n_words", F.explode("places").alias("place")).select(
        "row", "n_words", "place.shingle", "place.at", "place.first", F.split("place.words", " ").alias("around")
    )
    unique = windows.groupBy("words", "n", "shingle", "offset").agg(F.collect_set("item_id").alias("items"))
    start = F.col("at") - F.col("offset")
    inside = (start >= F.col("first")) & (start + F.col("n") <= F.col("n_words"))
    there = F.when(inside, F.array_join(F.slice("around", (start - F.col("first") + 1).cast("int"), F.col("n")), " "))
    spans = F.sort_array(F.collect_set(F.struct(start.alias("start"), F.col("n").cast("long").alias("n")))).alias("spans")
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids")
    found = places.join(unique, "shingle").where(there == F.col("words")).groupBy("row").agg(spans, items)
    return scanned.join(found, "row", "left").select(
        "row",
        "doc_id",
        "n_words",
        F.coalesce(_covered("spans"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )
