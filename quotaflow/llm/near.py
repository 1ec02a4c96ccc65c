"""Near copies by word shingles: SimHash components, min-hash bands and rare shingles propose pairs, exact Jaccard similarity decides.

1. Each text becomes its set of distinct shingles of five words (64-bit hashes; words as in ``simhash``) and its
   fingerprint over the same shingles. The components of ``simhash`` (block keys, pivot distance tables, links of at most
   three bits) come first: each document is compared with the first one of its component, and what is near leaves.
   Fingerprints that close miss most pairs with several edits, so the steps below look for what they leave.
   Minima of the set under 125 multipliers form 25 bands of five; texts that agree in a band share a bucket. Only the
   bucket numbers are stored. A pair of similarity 0.8 shares a bucket with probability 0.99995, a pair of 0.9 with
   1 - 10^-9. The sets of the texts that share a bucket or a component are stored once; a bit map of their rows (a bounded
   size, with false positives that do no harm) keeps the other texts out.
2. In each bucket the first document (smallest id, then row) leads and is compared with the others. What is near a
   leader before it is a copy and leaves all buckets. A group of n near copies thus costs n - 1 comparisons.
3. Documents that still share a bucket, mostly for a passage that they have in common, go on by their rarest shingles: of
   two sets of that similarity the n - ceil(0.8 n) + 1 rarest shingles of each must meet, at places that leave enough of
   both for the overlap. Rarity is counted in a table of bounded size; any order gives the same pairs. In each shared
   shingle the next 4, 16, 64 ... documents lead, so that dense groups are gone before many lead, and no key holds two.
4. A comparison takes the whole shingle sets. The documents of one leader are dealt to cells, so that a hot leader
   does not fill a task.

Of two documents that share a bucket and have the similarity, at most one stays: whichever of them comes first either
leaves as a copy or leads while the other one is still there. Each copy is near a document before it, so the chain
ends at one that stays. Proposals can miss a pair (1., not 3.); nothing that is not near is ever called a copy.

Nulls: a null text counts as empty; texts without a word equal each other, and a text of fewer than five words is one
shingle. Null ids come last. Repeated rows are near copies. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotaflow.llm import simhash
from quotaflow.llm.common import pieces_of, release, stored, texts_of, with_maybe
from quotaflow.session import run_folder

WORDS, SIMILARITY = 5, 0.8
BANDS, DEPTH = 25, 5
LEADERS = 4  # of a shingle in the first round on them, and how many times more in each further one
SLOTS = 1 << 18  # of the table that tells rare shingles from common ones
CELLS = 1024  # that the documents of one leader are dealt to
SEED = 42
TEXT_BYTES = 8 << 20
PART = 4096  # hashes multiplied at a time
FACTORS = np.array([xxhash.xxh64_intdigest(b"factor %d" % i, SEED) | 1 for i in range(BANDS * DEPTH)], dtype=np.uint64)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of all shingles of ``words`` words; a shorter text is one shingle."""
    tokens = text.lower().split()
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), SEED)], dtype=np.uint64)
    joined = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in joined), np.uint64, len(tokens) - words + 1))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def buckets(hashes: np.ndarray) -> list[int]:
    """Signed bucket numbers of a shingle set, one for each band."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), PART):
        np.minimum(least, (FACTORS[:, None] * hashes[None, start : start + PART]).min(axis=1), out=least)
    found = [xxhash.xxh64_intdigest(least[i * DEPTH : (i + 1) * DEPTH].tobytes(), i) for i in range(BANDS)]
    return np.array(found, dtype=np.uint64).view(np.int64).tolist()


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces_of(batches, TEXT_BYTES):
        texts = texts_of(batch)
        sets = [shingles(t) for t in texts]
        prints = np.array([simhash.fingerprint(t, WORDS) for t in texts], dtype=np.uint64).view(np.int64)
        columns = [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([buckets(s) for s in sets], pa.list_(pa.int64()))], ["row", "doc_id", "size", "print", "buckets"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces_of(batches, TEXT_BYTES):
        sets = [shingles(t).tobytes() for t in texts_of(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["row", "set"])


def _compared(least: float) -> Callable:
    """Rows near their leader, of sorted (lead, cell, row, set) in which row -1 holds the leader's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, mine = None, None
        for batch in batches:
            found = []
            for key, row, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                other = np.frombuffer(raw.as_buffer(), np.uint64)
                if row < 0:
                    lead, mine = key, other.copy()
                else:
                    assert key == lead
                    if similarity(mine, other) >= least:
                        found.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["row"])
        release()

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of a task by slot of the table."""
    total = np.zeros(SLOTS, np.int64)
    for batch in batches:
        sets = [np.frombuffer(raw.as_buffer(), np.uint64) % np.uint64(SLOTS) for raw in batch.column(0)]
        total += np.bincount(np.concatenate([np.zeros(0, np.uint64), *sets]).astype(np.int64), minlength=SLOTS)
    slots = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(total[slots])], ["slot", "n"])


def _rarest(shared, least: float) -> Callable:
    """The rarest shingles of each set, one of which each set that is near has among its own, and their places in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, places = [], [], []
            for i, raw in enumerate(batch.column(3)):
                mine = np.frombuffer(raw.as_buffer(), np.uint64)
                mine = mine[np.lexsort((mine, shared.value[mine % np.uint64(SLOTS)]))]
                n = len(mine) - int(np.ceil(least * len(mine) - 1e-9)) + 1
                keys.append(mine[:n].view(np.int64))
                rows.append(np.full(n, i))
                places.append(np.arange(n))
            if not rows:
                continue
            at = pa.array(np.concatenate(rows))
            columns = [pa.array(np.concatenate(keys)), batch.column(1).take(at), batch.column(2).take(at), pa.array(np.concatenate(places))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "place", "size", "at"])

    return run


def _near(sets: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """``row`` of the ``pairs`` (row, lead) that are near."""
    dealt = pairs.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(CELLS)))
    leads = dealt.select(F.col("lead").alias("row"), "lead", "cell", F.lit(-1).cast("long").alias("as")).distinct()
    wanted = dealt.select("row", "lead", "cell", F.col("row").alias("as")).unionByName(leads)
    cells = wanted.join(sets, "row").select("lead", "cell", F.col("as").alias("row"), "set")
    cells = cells.repartition("lead", "cell").sortWithinPartitions("lead", "cell", "row")
    return cells.mapInArrow(_compared(least), "row long")


class _Parts:
    """A table written part by part and read as one."""

    def __init__(self, docs: DataFrame, label: str):
        self.read, self.folder, self.paths, self.schema = docs.sparkSession.read, run_folder(docs.sparkSession, label), [], None

    def add(self, part: DataFrame) -> DataFrame:
        self.paths.append(f"{self.folder}/{len(self.paths)}")
        self.schema = part.schema
        part.write.parquet(self.paths[-1])
        return self.read.schema(self.schema).parquet(self.paths[-1])

    def all(self) -> DataFrame:
        return self.read.schema(self.schema).parquet(*self.paths)


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """The rows of keys that several rows have."""
    several = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    return rows.join(several, key)


def _keys(left: DataFrame, least: float) -> DataFrame:
    """Rarest shingles (``key``, ``at``) of the documents that are ``left`` (``row``, ``place``, ``size``, ``set``)."""
    counts = left.select("set").mapInArrow(_counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # SLOTS rows at most
    table = np.zeros(SLOTS, np.int64)
    table[counts["slot"].to_numpy()] = counts["n"].to_numpy()
    place = left.schema["place"].dataType.simpleString()
    rare = left.select("row", "place", "size", "set").mapInArrow(_rarest(left.sparkSession.sparkContext.broadcast(table), least), f"key long, place {place}, size long, at long")
    return stored(_shared(rare, "key"), "near-keys")


def near_copies(docs: DataFrame, least: float = SIMILARITY, leaders: int = LEADERS) -> DataFrame:
    """``row`` of each document that is a near copy of one before it. ``docs``: ``row``, ``doc_id`` and ``text``, stored."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = docs.select("row", "doc_id", "text").mapInArrow(_banded, f"row long, doc_id {kind}, size long, print long, buckets array<long>")
    marked = stored(marked, "near-buckets")
    alike = simhash.grouped(marked.select("row", "doc_id", "print"))
    alike = stored(alike.select("row", F.col("best.row").alias("lead")).where("row <> lead"), "near-alike")
    place = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row").alias("place")
    rest = marked.select(F.explode("buckets").alias("bucket"), place, "size")
    first = rest.groupBy("bucket").agg(F.min(F.struct("place", "size")).alias("lead"), F.count("*").alias("n")).where("n > 1")
    # only the joins by key and the last one of a round meet hot keys; Spark splits them at run time
    mates = stored(rest.join(first.select("bucket", "lead"), "bucket").where("place > lead.place"), "near-mates")
    members = mates.select(F.col("place.row").alias("row")).unionAll(mates.select("lead.place.row"))
    members = members.unionAll(alike.select("row")).unionAll(alike.select("lead")).distinct()
    sets = stored(with_maybe(docs.select("row", "text"), "row", members, "maybe").where("maybe").drop("maybe").mapInArrow(_sets, "row long, set binary"), "near-sets")
    tested, copies = _Parts(docs, "near-pairs"), _Parts(docs, "near-copies")
    a, b = F.col("size"), F.col("lead.size")
    # the smaller set cannot hold enough of the larger one
    fits = F.least(a, b) >= F.greatest(a, b) * F.lit(least)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = tested.add(pairs.join(tested.all(), ["row", "lead"], "left_anti") if tested.paths else pairs)
        return copies.add(_near(sets, pairs, least).distinct())

    def compared(mates: DataFrame) -> DataFrame:
        return verified(mates.where(fits).select(F.col("place.row").alias("row"), F.col("lead.place.row").alias("lead")).distinct())

    def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
        return rows.withColumn("row", F.col("place.row")).join(gone, "row", "left_anti")

    mates = without(mates, verified(alike)).drop("row")
    still = _shared(without(mates.select("bucket", "place", "size"), compared(mates)), "bucket")
    left = stored(still.select("row", "place", "size").distinct().join(sets, "row"), "near-left")
    rest = _keys(left, least)
    # the shingles that both have from their first common one on cannot be enough
    enough = F.least(a - F.col("at"), b - F.col("lead.at")) >= (a + b) * F.lit(least / (1 + least)) - 1e-6
    while not rest.isEmpty():
        rank = F.row_number().over(Window.partitionBy("key").orderBy("place"))
        leads = rest.withColumn("rank", rank).where(F.col("rank") <= leaders)
        leads = stored(leads.select("key", F.struct("place", "size", "at").alias("lead")), "near-leads")
        found = compared(rest.join(leads, "key").where((F.col("place") > F.col("lead.place")) & fits & enough))
        led = leads.select("key", F.col("lead.place.row").alias("row"))
        rest = stored(_shared(without(rest, found).join(led, ["key", "row"], "left_anti").drop("row"), "key"), "near-keys")
        leaders *= 4
    return copies.all().distinct()
