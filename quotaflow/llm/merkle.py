"""Merkle manifest of a dataset as a persistent tree: every tampered leaf is a version that shares what it leaves alone.

A row's leaf is the digest of its fields. The leaves of a source ascend by id; runs of 16 nodes become one node, level by
level, until one is left (``subroot``), and the subroots, by source, become the ``root`` in the same way.

1. Equal rows are counted first. The distinct ones are put into ranges and numbered there; each range adds the rows
   before it in its source, so a source with most rows spreads over all tasks.
2. Positions are cut into aligned blocks of 16 ** ``height`` leaves. A task builds a block's tree and hands on its top;
   the tops are the leaves of the next round, until each source has one node. The subroots then go the same way.
3. On the way back each block learns the siblings on the path from its top to the root, round by round: one row a block.
4. A tampered leaf makes a version of its block: ``replaced`` copies the ancestors of the leaf and shares all other
   nodes. The version goes on through the upper levels by the siblings of the block's path. The root of each version
   must differ from the true one (``verified``) where tampering changed anything.

Nulls: a null field is ``-``; rows without a source form a source of their own, before all others; null ids come first
in their source and are never tampered with. Rows with equal source and id are ordered by leaf; repeated rows are leaves
of their own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quotaflow.llm.common import stored

FAN = 16
HEIGHT = 3  # levels of a block
COARSE = 1 << 16  # blocks of one copied row that are numbered at a time
TAMPERED, UPPER, LOWER = 5, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
Node = tuple[str, tuple]  # digest and children
Side = tuple[str, str]  # digests of the siblings before and after
PATH = "array<struct<before: string, after: string>>"
TOP = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("node", pa.string())])
STEPS = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
WAY = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("path", STEPS), ("subroot", pa.string()), ("root", pa.string())])


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def parent(children: tuple[Node, ...]) -> Node:
    return digest("".join(c[0] for c in children)), children


def grow(leaves: list[str], whole: bool, height: int = HEIGHT) -> tuple[Node, int]:
    """Tree of a block and its number of levels. A block that is ``whole`` ends at one node, another has all its levels."""
    nodes: list[Node] = [(leaf, ()) for leaf in leaves]
    for level in range(height):
        if whole and len(nodes) == 1:
            return nodes[0], level
        nodes = [parent(tuple(nodes[i : i + FAN])) for i in range(0, len(nodes), FAN)]
    return nodes[0], height


def digits(place: int, levels: int) -> list[int]:
    """The children to follow from the top of a tree to a leaf."""
    return [place // FAN**level % FAN for level in reversed(range(levels))]


def replaced(node: Node, way: list[int], leaf: str) -> Node:
    """A version of the tree with another leaf: its ancestors are new, all other nodes are shared."""
    if not way:
        return leaf, ()
    at, children = way[0], node[1]
    return parent((*children[:at], replaced(children[at], way[1:], leaf), *children[at + 1 :]))


def sides(node: Node, way: list[int]) -> list[Side]:
    """Siblings on the way from a leaf up to the top of its tree."""
    found = []
    for at in way:
        names = [c[0] for c in node[1]]
        found.append(("".join(names[:at]), "".join(names[at + 1 :])))
        node = node[1][at]
    return found[::-1]


def fold(node: str, path: list[Side]) -> str:
    for before, after in path:
        node = digest(before + node + after)
    return node


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of each (key, block), which are neighbours."""
    for group, rows in groupby(_rows(batches), key=lambda r: r[:2]):
        yield group, list(rows)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of the range and the rows before, within the range and key, to sorted rows (key first, copies last)."""
    part, key, total = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        places = []
        for now, copies in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
            key, total = now, total if now == key else 0
            places.append(total)
            total += copies
        extra = [pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "part", "place"])


def positions(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos``, the place of a row's first copy among the rows of its key, and ``n``, the rows of the key.

    ``leaves``: ``key`` first and ``copies`` last, one row for each combination of the others.
    """
    by = [F.col(c).asc_nulls_first() for c in ["key", *order]]
    ranged = leaves.repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = stored(ranged.mapInArrow(_running, _schema(leaves, "part int, place long")), "merkle-order")
    ends = ranged.groupBy("key", "part").agg(F.sum("copies").alias("rows"))
    before = Window.partitionBy("key").orderBy("part")  # one row for each range
    starts = ends.select(
        "key", "part", (F.sum("rows").over(before) - F.col("rows")).alias("start"), F.sum("rows").over(Window.partitionBy("key")).alias("n")
    )
    return ranged.join(starts, ["key", "part"]).withColumn("pos", F.col("start") + F.col("place")).drop("part", "place", "start")


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.schema] + [more])


def _cut(level: DataFrame, height: int) -> DataFrame:
    """Rows of (key, pos, n, copies, ...) cut at the borders of aligned blocks; ``pos`` stays the place within the key."""
    size = FAN**height
    first, last = F.expr(f"pos div {size}"), F.expr(f"(pos + copies - 1) div {size}")
    wide = level.withColumns({"first": first, "last": last}).withColumn("coarse", F.explode(F.expr(f"sequence(first div {COARSE}, last div {COARSE})")))
    wide = wide.withColumn("block", F.explode(F.expr(f"sequence(greatest(first, coarse * {COARSE}), least(last, coarse * {COARSE} + {COARSE - 1}))")))
    start, end = F.expr(f"greatest(pos, block * {size})"), F.expr(f"least(pos + copies, (block + 1) * {size})")
    return wide.withColumns({"pos": start, "copies": end - start}).drop("first", "last", "coarse")


def _gathered(cut: DataFrame) -> DataFrame:
    """Rows of a block side by side, in order; a row with the path of the block, at -1, before the others."""
    return cut.repartition("key", "block").sortWithinPartitions("key", "block", "pos")


def _tops(height: int) -> Callable:
    """(key, pos, n, node) of the next round from sorted (key, block, pos, n, node, copies)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, block), rows in _blocks(batches):
            n = rows[0][3]
            top, _ = grow([r[4] for r in rows for _ in range(r[5])], n <= FAN**height, height)
            yield pa.RecordBatch.from_pylist([{"key": key, "pos": block, "n": -(-n // FAN**height), "node": top[0]}], TOP)

    return run


def _rounds(level: DataFrame, height: int) -> list[DataFrame]:
    """The leaves and the nodes of each further round, up to one node for each key."""
    found = [level]
    while not found[-1].where("n > 1").isEmpty():
        cut = _gathered(_cut(found[-1], height).select("key", "block", "pos", "n", "node", "copies"))
        tops = cut.mapInArrow(_tops(height), "key string, pos long, n long, node string").withColumn("copies", F.lit(1).cast("long"))
        found.append(stored(tops, "merkle-round"))
    return found


def _with_paths(rows: DataFrame, paths: DataFrame, height: int, extra: list[str]) -> DataFrame:
    """Cut rows of a round and, before those of each block, the path of the block."""
    cut = _cut(rows, height).select("key", "block", "pos", "n", "node", "copies", *extra)
    upper = paths.select(F.col("key"), F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "path", "subroot", "root")
    return _gathered(cut.unionByName(upper, allowMissingColumns=True))


def _paths_down(height: int) -> Callable:
    """Path of each node of a round from sorted (key, block, pos, n, node, copies, path, subroot, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, _), rows in _blocks(batches):
            (*_, path, subroot, root), rows = rows[0], rows[1:]
            upper = [(p["before"], p["after"]) for p in path]
            tree, levels = grow([r[4] for r in rows], rows[0][3] <= FAN**height, height)
            found = []
            for i, row in enumerate(rows):
                own = [{"before": b, "after": a} for b, a in [*sides(tree, digits(i, levels)), *upper]]
                found.append({"key": key, "pos": row[2], "path": own, "subroot": subroot, "root": root})
            for i in range(0, len(found), 256):  # a path has some KB
                yield pa.RecordBatch.from_pylist(found[i : i + 256], WAY)

    return run


def _paths(rounds: list[DataFrame], top: DataFrame, height: int, down_to: int) -> DataFrame:
    """Paths of the nodes of round ``down_to`` from those of the last round (``top``)."""
    paths, schema = top, f"key string, pos long, path {PATH}, subroot string, root string"
    for level in reversed(rounds[down_to:-1]):
        paths = stored(_with_paths(level, paths, height, []).mapInArrow(_paths_down(height), schema), "merkle-paths")
    return paths


def _verified(height: int, kind: pa.DataType) -> Callable:
    """Result rows from sorted (key, block, pos, n, node, copies, doc_id, changed, path, subroot, root)."""

    schema = pa.schema(
        [("doc_id", kind), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("tampered", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _blocks(batches):
            (*_, path, subroot, root), rows = rows[0], rows[1:]
            upper = [(p["before"], p["after"]) for p in path]
            rest = "".join(b + a for b, a in upper)
            leaves = [r for r in rows for _ in range(r[5])]
            tree, levels = grow([r[4] for r in leaves], rows[0][3] <= FAN**height, height)
            found = []
            for i, (*_, leaf, _, doc_id, changed, _, _, _) in enumerate(leaves):
                way = digits(i, levels)
                own = sides(tree, way)
                proof = digest("".join(b + a for b, a in own) + rest)
                version = fold(leaf, own) if changed is None else replaced(tree, way, changed)[0]
                found.append((doc_id, leaf, subroot, root, proof, fold(version, upper), changed is not None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    return run


def leaf_digest(text: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """Digest of the fields: byte count, colon and value of each, ``-`` for null. The last one is ``text``."""
    values = [*(F.col(c).cast("string") for c in fields[:-1]), text]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v), F.lit(":"), v), F.lit("-")) for v in values)).cast("binary"), 256)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, height: int = HEIGHT) -> DataFrame:
    """One row for each row: id, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``tampered``, ``verified``.

    ``fields``: id, source, others, text.
    """
    doc_id, source, text = (F.col(c) for c in (fields[0], fields[1], fields[-1]))
    tampered = F.crc32(doc_id.cast("string").cast("binary")) % TAMPERED == 0  # null for a null id
    changed = F.when(tampered, leaf_digest(F.translate(text, UPPER, LOWER), fields))
    key = F.coalesce(F.concat(F.lit("1"), source.cast("string")), F.lit("0"))
    rows = docs.select(key.alias("key"), doc_id.alias("doc_id"), leaf_digest(text, fields).alias("node"), changed.alias("changed"))
    leaves = positions(rows.groupBy("key", "doc_id", "node", "changed").agg(F.count("*").alias("copies")), ["doc_id", "node"])
    leaves = stored(leaves, "merkle-leaves")
    rounds = _rounds(leaves, height)
    subroots = rounds[-1].select(F.lit("").alias("key"), F.col("key").alias("source"), "node", F.lit(1).cast("long").alias("copies"))
    tops = _rounds(stored(positions(subroots, ["source"]), "merkle-sources"), height)
    end = tops[-1].select("key", "pos", F.array().cast(PATH).alias("path"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    ways = _paths(tops, end, height, 0)  # by place of the source
    sources = tops[0].select(F.col("source").alias("key"), F.col("pos").alias("place"), F.col("node").alias("subroot"))
    ways = ways.select(F.col("pos").alias("place"), "path", "root").join(sources, "place")
    ways = stored(ways.select("key", F.lit(0).cast("long").alias("pos"), "path", "subroot", "root"), "merkle-paths")
    ways = _paths(rounds, ways, height, 1)
    kind = rows.schema["doc_id"].dataType
    out = f"doc_id {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, tampered boolean"
    found = _with_paths(leaves, ways, height, ["doc_id", "changed"]).mapInArrow(_verified(height, to_arrow_type(kind)), out)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
