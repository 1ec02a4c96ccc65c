"""Near-duplicate groups by SimHash fingerprints, with pivot distance tables.

1. Fingerprints of whole texts are computed where the texts lie and stored with their ids; texts move no further.
2. Distinct fingerprints are linked when they differ in at most three bits. Such a pair leaves at least three of six
   blocks of bits unchanged, so each fingerprint is dealt under the twenty choices of three blocks: an exact key for
   every link. Pivot distances alone give no such key, since a random pair agrees with any one pivot half of the time.
3. Within a key, a table holds the Hamming distances to many reference fingerprints. Rows are ordered by the first
   distance and compared within a window of three; pairs whose largest coordinate difference exceeds three are
   discarded (triangle inequality), and the survivors are verified bit by bit. Links inside a key are reduced to a
   forest at once, so a group of n near copies gives at most n - 1 links under each key.
4. A key with very many fingerprints is dealt again under choices of three of six blocks of its other bits. What
   then shares a key agrees in all but some 16 bits, so its size has a fixed bound.
5. Components of the links are found by repeated contraction to the smallest neighbour.

Nulls: a null text counts as empty (fingerprint zero). A null id takes part, but names a component only if all of
its ids are null. Repeated rows share a fingerprint. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaflow.llm.common import pieces_of, stored, texts_of, with_row

BITS, DISTANCE, BLOCKS = 64, 3, 6
PIVOTS = 16
GROUP_ROWS = 8192  # fingerprints of one key above which it is dealt again
SEED = 42
TEXT_BYTES = 8 << 20
SHINGLES = 200_000  # hashed at a time


def fingerprint(text: bytes, words: int = 3) -> int:
    """Majority bits of the XXH64 hashes of all shingles of ``words`` words."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    counts, total = np.zeros(BITS, np.int64), max(1, len(tokens) - words + 1)
    for start in range(0, total, SHINGLES):
        part = tokens[start : min(start + SHINGLES, total) + words - 1] if total > 1 else tokens
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)))) if total > 1 else [b" ".join(part)]
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype=">u8")
        for low in range(0, len(hashes), 255):  # sums of 255 bits fit a byte
            bits = np.unpackbits(hashes[low : low + 255].view(np.uint8)).reshape(-1, BITS)
            counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def _fingerprints(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, TEXT_BYTES):
            values = np.array([fingerprint(t, words) for t in texts_of(batch)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values)], ["row", "doc_id", "print"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``row``, id and ``print`` (the fingerprint as a signed long) of each document."""
    source = with_row(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_fingerprints(words), f"row long, doc_id {kind}, print long")


def _masks(bits: list[int]) -> list[int]:
    """Masks that keep three of six blocks of the given bit numbers, one for each choice."""
    edges = [round(i * len(bits) / BLOCKS) for i in range(BLOCKS + 1)]
    blocks = [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(edges, edges[1:])]
    return [reduce(int.__or__, kept) for kept in combinations(blocks, BLOCKS - DISTANCE)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


MASKS = _masks(list(range(BITS)))
SECOND = [_masks([b for b in range(BITS) if not mask >> b & 1]) for mask in MASKS]
REFERENCES = np.array([xxhash.xxh64_intdigest(b"reference %d" % i, SEED) for i in range(PIVOTS)], dtype=np.uint64)


def _roots(parent: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    found = parent[nodes]
    while not np.array_equal(found, up := parent[found]):
        found = up
    return found


def links_within(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of all links between fingerprints of equal key: positions of each row and of its root, where they differ."""
    distances = np.bitwise_count(prints[:, None] ^ REFERENCES[None, :]).astype(np.int8)
    order = np.lexsort((distances[:, 0], keys))
    keys, prints, distances = keys[order], prints[order], distances[order]
    parent = np.arange(len(order))
    left, shift = np.arange(len(order) - 1), 1
    while left.size:
        left = left[left + shift < len(order)]
        right = left + shift
        near = (keys[right] == keys[left]) & (distances[right, 0] - distances[left, 0] <= DISTANCE)
        left, right = left[near], right[near]
        ok = np.abs(distances[right] - distances[left]).max(axis=1, initial=0) <= DISTANCE
        a, b = left[ok], right[ok]
        same = np.bitwise_count(prints[a] ^ prints[b]) <= DISTANCE
        a, b = a[same], b[same]
        while a.size:
            a, b = _roots(parent, a), _roots(parent, b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        shift += 1
    roots = _roots(parent, np.arange(len(order)))
    moved = np.flatnonzero(roots != np.arange(len(order)))
    return order[moved], order[roots[moved]]


def _linked(group_rows: int | None) -> Callable:
    """Links of sorted (choice, key, print) rows. Keys of more than ``group_rows`` prints are passed on with their choice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["choice", "print", "root"]
        held: list[np.ndarray] = []
        rows, passing = 0, None

        def finished(part: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Whole groups: their links, and the rows of those that are too large."""
            if not len(part):
                return
            new = np.r_[True, (part[1:, 0] != part[:-1, 0]) | (part[1:, 1] != part[:-1, 1])]
            group = np.cumsum(new) - 1
            sizes = np.bincount(group)[group]
            if group_rows is not None and (large := sizes > group_rows).any():
                yield handed(part[large])
            mates = part[(sizes > 1) & (sizes <= (group_rows or len(part)))]
            if len(mates):
                group = np.cumsum(np.r_[True, (mates[1:, 0] != mates[:-1, 0]) | (mates[1:, 1] != mates[:-1, 1])])
                a, b = links_within(group, mates[:, 2].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), -1)), pa.array(mates[a, 2]), pa.array(mates[b, 2])], names)

        def handed(part: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 2]), pa.nulls(len(part), pa.int64())], names)

        for batch in batches:
            part = np.column_stack([batch.column(i).to_numpy() for i in range(3)]).astype(np.int64)
            if passing is not None:  # the rest of a large group
                more = (part[:, 0] == passing[0]) & (part[:, 1] == passing[1])
                if more.any():
                    yield handed(part[more])
                part = part[~more]
                if not len(part):
                    continue
                passing = None
            held.append(part)
            rows += len(part)
            if rows < 100_000:
                continue
            part = np.concatenate(held)
            last = (part[:, 0] == part[-1, 0]) & (part[:, 1] == part[-1, 1])
            yield from finished(part[~last])
            part = part[last]
            if group_rows is not None and len(part) > group_rows:
                passing = part[-1, :2].copy()
                yield handed(part)
                part = part[:0]
            held, rows = ([part], len(part)) if len(part) else ([], 0)
        if held:
            yield from finished(np.concatenate(held))

    return run


def _dealt(prints: DataFrame, keys: list) -> DataFrame:
    """Each fingerprint under each of its keys, equal keys together and in order."""
    return (
        prints.select("print", F.explode(F.array(*keys)).alias("key"))
        .select("key.choice", "key.key", "print")
        .repartition("choice", "key")
        .sortWithinPartitions("choice", "key")
    )


def _key(choice: int, mask: int):
    return F.struct(F.lit(choice).cast("long").alias("choice"), F.col("print").bitwiseAND(F.lit(_signed(mask))).alias("key"))


def links(prints: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (``a``, ``b``) that connect all fingerprints of distance three or less. ``prints``: distinct, in a stored table."""
    schema = "choice long, print long, root long"
    first = stored(_dealt(prints, [_key(i, m) for i, m in enumerate(MASKS)]).mapInArrow(_linked(group_rows), schema), "simhash-links")
    found = first.where(F.col("choice") < 0)
    large = first.where(F.col("choice") >= 0)
    if not large.isEmpty():
        n = len(SECOND[0])
        keys = F.element_at(
            F.array(*(F.array(*(_key((i + 1) * n + j, MASKS[i] | m) for j, m in enumerate(masks))) for i, masks in enumerate(SECOND))),
            (F.col("choice") + 1).cast("int"),
        )
        again = large.select("print", F.explode(keys).alias("key")).select("key.choice", "key.key", "print")
        again = again.repartition("choice", "key").sortWithinPartitions("choice", "key")
        found = found.unionByName(again.mapInArrow(_linked(None), schema))
    return found.select(F.col("print").alias("a"), F.col("root").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and the smallest node it is connected to (``root``), for every node of ``edges`` (``a``, ``b``).

    Each round points every node to its smallest neighbour and hangs the neighbours onto that one, first the larger
    and then the smaller ones, until nothing changes: a star around the smallest node of each component. Smallest
    neighbours are found by aggregates that combine before the shuffle, so a hub does not gather its neighbours.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def hung(pairs: DataFrame, both: bool) -> DataFrame:
        ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else pairs
        least = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        moved = ways.where("b > a") if both else ways
        out = moved.join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))
        if not both:
            out = out.unionByName(least.select("a", F.col("root").alias("b")))
        return out.where("a <> b").distinct()

    before = None
    while True:
        edges = stored(hung(hung(edges, True), False), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def grouped(prints: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``prints`` (``row``, ``doc_id``, ``print``; a stored table) with ``best``: the first row of the smallest id of its component."""
    best = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row")).alias("best")
    found = components(links(prints.select("print").distinct(), group_rows))
    roots = found.unionByName(found.select(F.col("root").alias("node"), "root")).distinct()
    named = prints.groupBy("print").agg(best).join(roots.withColumnRenamed("node", "print"), "print", "left")
    named = stored(named.withColumn("root", F.coalesce("root", "print")), "simhash-named")
    whole = named.groupBy("root").agg(F.min("best").alias("best"))
    # equal fingerprints are one row here, so only the last join meets hot keys; Spark splits them at run time
    by_print = named.select("print", "root").join(whole, "root").select("print", "best")
    return prints.join(by_print, "print", "left")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``row``, id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable over links) and ``kept``.

    Of each component one row is kept: the first one of the smallest id.
    """
    prints = stored(fingerprints(docs, id_col, text_col, words), "simhash-prints")
    return grouped(prints, group_rows).select(
        "row",
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("best.doc_id").alias("component_id"),
        (F.col("row") == F.col("best.row")).alias("kept"),
    )
