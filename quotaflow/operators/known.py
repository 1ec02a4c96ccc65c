"""A stored filter of known ids: tells in a few lookups which ids cannot be known, without reading the ids.

A Bloom filter of fixed size as rows of bit maps (``part``, ``map``). Filters of several batches merge by OR, so each batch
stores its own. An id that was put in is always found; others are found with a probability that grows with the number of
ids (2 % at one id for eight bits). A null id is never known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 27  # base-2 logarithm of the size: 16 MB, which bounds what is broadcast
HASHES = 4
FILTER = "part long, map binary"


def _bits(ids: str, size: int) -> Column:
    """Places of an id in the filter, from 1."""
    return F.array(*(F.pmod(F.xxhash64(F.lit(i), F.col(ids)), F.lit(1 << size)) + 1 for i in range(HASHES)))


def filter_of(rows: DataFrame, ids: str, size: int = BITS) -> DataFrame:
    """The filter of the ids of some rows."""
    bits = rows.where(F.col(ids).isNotNull()).select(F.explode(_bits(ids, size)).alias("bit"))
    return bits.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))


def merged(filters: DataFrame) -> DataFrame:
    return filters.groupBy("part").agg(F.bitmap_or_agg("map").alias("map"))


def maybe_known(rows: DataFrame, ids: str, filters: DataFrame, size: int = BITS) -> DataFrame:
    """The distinct ids of the rows that the filters do not rule out."""
    probes = rows.where(F.col(ids).isNotNull()).select(ids).distinct().select(ids, F.explode(_bits(ids, size)).alias("bit"))
    place = F.bitmap_bit_position("bit")
    octet = F.conv(F.hex(F.substring("map", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    mask = F.expr("shiftleft(1, cast(bitmap_bit_position(bit) % 8 AS int))")
    there = probes.withColumn("part", F.bitmap_bucket_number("bit")).join(F.broadcast(merged(filters)), "part")  # the filter has a fixed size
    return there.where(octet.bitwiseAND(mask) != 0).groupBy(ids).agg(F.count("*").alias("n")).where(F.col("n") == HASHES).select(ids)
