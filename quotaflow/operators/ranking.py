"""Latest / first row per key, numbering and neighbour values that hold when one key owns most rows."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: list[str], order_by: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of every key.

    Spark turns ``row_number() <= n`` into a group limit below the shuffle, so a task sends at most n rows per key
    and a hot key costs n rows per map task, not its whole history.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by)))
    kept = ranked.filter(F.col(name) <= n)
    return kept if rank else kept.drop(name)


SEGMENT_ROWS = 1_000_000


def _joined(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Inner join on equal values, NULL being equal to NULL; ``right`` has one row for each combination."""
    same = [left[c].eqNullSafe(right[f"_r_{c}"]) for c in columns]
    return left.join(right, same).drop(*(f"_r_{c}" for c in columns))


def global_numbers(df: DataFrame, order_value: Column, ties: list[str], name: str = "position", segments: int | None = None) -> DataFrame:
    """0-based position of every row in one total order, without sorting the table in one task.

    Quantiles of ``order_value`` cut the order into segments of similar size, rows are numbered inside their
    segment and the sizes of the earlier segments are added. Only the cut points and one count per segment reach
    the driver; the number of segments follows the number of rows. The cut points are literals, so a recomputed
    task lands in the same segment. ``order_value`` must be (almost) unique; equal values stay in one segment and
    are ordered by ``ties``. Rows without a value come last, in a segment of their own.
    """
    spark = df.sparkSession
    segments = segments or max(1, -(-df.count() // SEGMENT_ROWS))
    keyed = df.withColumn("_order", F.coalesce(order_value.cast("double"), F.lit(float("nan"))))
    known = F.when(~F.isnan("_order"), F.col("_order"))
    cuts = keyed.select(F.percentile_approx(known, [i / segments for i in range(1, segments)] or [0.5], 10_000)).first()[0]
    splits = [float("-inf"), *sorted(set(cuts or [0.0])), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_order", outputCol="_segment", handleInvalid="keep").transform(keyed)
    sizes = {r["_segment"]: r["count"] for r in cut.groupBy("_segment").count().collect()}  # one row per segment
    offsets, total = [], 0
    for segment in sorted(sizes):
        offsets.append((float(segment), total))
        total += sizes[segment]
    offset_rows = spark.createDataFrame(offsets, "_segment double, _offset long")
    within = F.row_number().over(Window.partitionBy("_segment").orderBy("_order", *ties))
    return (
        cut.withColumn("_within", within)
        .join(F.broadcast(offset_rows), "_segment")  # one row per segment
        .withColumn(name, F.col("_offset") + F.col("_within") - 1)
        .drop("_order", "_segment", "_within", "_offset")
    )


def numbers_per_key(df: DataFrame, keys: list[str], bucket: Column, order_by: list[Column], name: str = "number") -> DataFrame:
    """1-based position of every row within its key, for keys too large for one task.

    ``bucket`` is a coarse, order-preserving part of the order (an hour, a range of turns). Rows are numbered per
    (key, bucket); the running total of the bucket sizes, one row per bucket, gives the rest. A NULL key is a key of
    its own, a NULL bucket comes first.
    """
    cut = df.withColumn("_bucket", bucket)
    sizes = cut.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    named = [F.col(c).alias(f"_r_{c}") for c in [*keys, "_bucket"]]
    offsets = sizes.select(*named, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order_by))
    return (
        _joined(cut.withColumn("_within", within), offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("_offset") + F.col("_within"))
        .drop("_bucket", "_within", "_offset")
    )


def previous_per_key(df: DataFrame, keys: list[str], bucket: Column, order_by: list[Column], value: str, name: str) -> DataFrame:
    """``value`` of the preceding row of the same key (``lag``), for keys too large for one task.

    Only the first row of a (key, bucket) needs a neighbour from outside: the last value of the previous bucket
    of the key, looked up among one row per bucket. A NULL key is a key of its own, a NULL bucket comes first.
    """
    cut = df.withColumn("_bucket", bucket)
    order = F.struct(*order_by)
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order_by)
    last = cut.groupBy(*keys, "_bucket").agg(F.max_by(F.struct(value), order).alias("_last"))
    carried = F.lag(F.col("_last")[value]).over(Window.partitionBy(*keys).orderBy("_bucket"))
    lookup = last.select(*(F.col(c).alias(f"_r_{c}") for c in [*keys, "_bucket"]), carried.alias("_carried"))
    marked = cut.withColumn("_first", F.row_number().over(local) == 1).withColumn("_lag", F.lag(value).over(local))
    return (
        _joined(marked, lookup, [*keys, "_bucket"])
        .withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_lag")))
        .drop("_bucket", "_first", "_lag", "_carried")
    )


def last_n_before(df: DataFrame, keys: list[str], number: str, n: int, item: Column, name: str, bucket_rows: int = 1000) -> DataFrame:
    """The n preceding items of every row of a densely numbered key, oldest first, as an array.

    A key is cut into buckets of 1000 rows. The last n rows of a bucket are also handed to the next one, so every
    row finds its predecessors in its own bucket: a hot key spreads over many tasks and rows move once.
    """
    place = F.col(number) - 1
    own = F.floor(place / bucket_rows).cast("long")
    carried = F.pmod(place, F.lit(bucket_rows)) >= bucket_rows - n
    buckets = F.when(carried, F.array(own, own + 1)).otherwise(F.array(own))
    spread = df.withColumns({"_own": own, "_item": item}).withColumn("_bucket", F.explode(buckets))
    before = Window.partitionBy(*keys, "_bucket").orderBy(number).rowsBetween(-n, -1)
    gathered = spread.withColumn(name, F.collect_list("_item").over(before))
    return gathered.filter(F.col("_bucket") == F.col("_own")).drop("_own", "_item", "_bucket")
