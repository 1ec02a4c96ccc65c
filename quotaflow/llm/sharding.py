"""Reproducible shuffle into shards: a Feistel permutation of global row numbers, with cycle walking.

Rows get gapless numbers in the order of id, size and checksum: equal rows are counted first (so that a row repeated
a billion times is one record), the distinct ones are put into ranges and sorted there, and each range adds the
number of rows before it. The numbers do not depend on how the ranges were cut. A record then becomes its rows in runs of
bounded length, which are dealt to all tasks.

The numbers 0 .. n-1 lie in a grid of a x b cells with a, b near the root of n. A Feistel network over the two
coordinates permutes the grid; a result beyond n-1 is permuted again until it falls below n (cycle walking; it meets
each of the cells beyond n-1 once at most, which are less than a side of the grid). The permuted number p gives shard ``p % shards`` and slot ``p div shards``, so shard sizes differ by at most one, and
``locate`` computes shard and slot of any row number, ``row_number`` the way back.

Law: ``rows``. Nulls: a null text has no bytes (checksum 0), null ids come first. Repeated rows are separate rows.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotaflow.llm.common import stored

SHARDS, SEED = 16, 20_240
ROUNDS = 8
PRIMES = (2147483647, 2147483629, 2147483587)  # below 2**31: products of residues fit a long
RUN = 100_000  # rows that one record becomes in a task


def grid(n: int) -> tuple[int, int]:
    """Sides of a near-square grid with at least ``n`` cells and less than a row too many."""
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def round_keys(seed: int = SEED) -> list[tuple[int, int, int]]:
    """Three multipliers for each round."""
    state, found = seed % PRIMES[0] + 1, []
    for _ in range(3 * ROUNDS):
        state = (state * 48271 + 11) % PRIMES[0]
        found.append(state or 1)
    return list(zip(found[::3], found[1::3], found[2::3]))


def _mix(value: int, key: tuple[int, int, int]) -> int:
    for k, prime in zip(key, PRIMES):
        value = (value + 1) * k % prime
    return value


def permute(x: int, n: int, seed: int = SEED) -> int:
    """One pass of the network over the grid of ``n``."""
    a, b = grid(n)
    left, right = x % a, x // a
    for i, key in enumerate(round_keys(seed)):
        if i % 2:
            right = (right + _mix(left, key)) % b
        else:
            left = (left + _mix(right, key)) % a
    return right * a + left


def permute_back(p: int, n: int, seed: int = SEED) -> int:
    a, b = grid(n)
    left, right = p % a, p // a
    for i, key in reversed(list(enumerate(round_keys(seed)))):
        if i % 2:
            right = (right - _mix(left, key)) % b
        else:
            left = (left - _mix(right, key)) % a
    return right * a + left


def locate(number: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of a row number."""
    p = permute(number, n, seed)
    while p >= n:
        p = permute(p, n, seed)
    return p % shards, p // shards


def row_number(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number that ``locate`` puts there."""
    x = permute_back(slot * shards + shard, n, seed)
    while x >= n:
        x = permute_back(x, n, seed)
    return x


def network_sql(x: str, a: str, b: str, divide: str, seed: int = SEED) -> str:
    """``permute`` as a SQL expression over ``x`` and the sides ``a`` and ``b``; ``divide``: the engine's whole division."""

    def mix(value: str, key: tuple[int, int, int]) -> str:
        for k, prime in zip(key, PRIMES):
            value = f"(({value} + 1) * {k} % {prime})"
        return value

    left, right = f"({x} % {a})", f"({x} {divide} {a})"
    for i, key in enumerate(round_keys(seed)):
        if i % 2:
            right = f"(({right} + {mix(left, key)}) % {b})"
        else:
            left = f"(({left} + {mix(right, key)}) % {a})"
    return f"({right} * {a} + {left})"


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``size``, ``text_crc32`` and gapless ``number`` of each row, in the order of the three."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    distinct = narrow.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "size", "text_crc32")]
    place = F.monotonically_increasing_id()  # upper bits: partition, lower 33 bits: place in it
    ranged = stored(
        distinct.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "size", "text_crc32", "copies", F.shiftright(place, 33).alias("part"), place.bitwiseAND(2**33 - 1).alias("place")),
        "shard-rows",
    )
    ends = ranged.groupBy("part").agg(F.sum("copies").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = ends.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # the records of one range
    first = F.col("start") + F.coalesce(F.sum("copies").over(inside), F.lit(0))
    total = ends.agg(F.sum("rows")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + total // (10 * RUN))  # runs are small before they unfold
    runs = (
        ranged.join(starts, "part")
        .withColumn("first", first)
        .select("doc_id", "size", "text_crc32", "copies", "first", F.explode(F.expr(f"sequence(0L, (copies - 1) div {RUN})")).alias("run"))
        .repartition(parts, "first", "run")
    )
    rows = F.explode(F.expr(f"sequence(first + run * {RUN}, first + least((run + 1) * {RUN}, copies) - 1)"))
    return runs.select("doc_id", "size", "text_crc32", rows.alias("number"))


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Id, ``size`` (bytes and one), ``text_crc32``, ``shard`` and ``slot`` of each row."""
    n = docs.count()
    rows, (a, b) = numbered(docs, id_col, text_col), grid(n)

    def network(x: str) -> str:
        return network_sql(x, f"{a}L", f"{b}L", "div", seed)

    walk = f"aggregate(sequence(1, {max(1, a * b - n)}), p, (q, i) -> if(q < {n}L, q, {network('q')}))"
    walked = F.expr(f"if(p < {n}L, p, {walk})")  # few rows need a second pass
    return (
        rows.withColumn("p", F.expr(network("number")))
        .withColumn("p", walked)
        .select("doc_id", "size", "text_crc32", (F.col("p") % count).cast("int").alias("shard"), F.expr(f"p div {count}").alias("slot"))
    )
