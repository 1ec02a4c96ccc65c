"""Alerts over streams of traces and messages: latency from stored sketches or counts, lag and silence of partitions."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quotaflow import constants as C
from quotaflow.operators.ranking import top_per_key
from quotaflow.sinks.tables import append_batch

LATENESS = "10 minutes"
SKETCH_K = 4096  # up to so many calls a sketch holds each value
RANK_ERROR = 2.296 / SKETCH_K**0.9021  # 0.13 % of the calls, in 99 of 100 sketches
MICROS = 1_000_000
SILENT = C.LAG_SILENT_MINUTES * 60 * MICROS


def updates(stream: DataFrame, root: str, name: str, once: bool = False) -> StreamingQuery:
    """The changed rows of a stream, each batch as a partition of its own, which a repeated batch replaces."""
    writer = stream.writeStream.option("checkpointLocation", f"{root}/_checkpoints/{name}").queryName(name).outputMode("update")
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=C.CDC_TRIGGER)
    return writer.foreachBatch(lambda batch, batch_id: append_batch(batch, f"{root}/{name}", batch_id)).start()


def newest(spark: SparkSession, root: str, name: str, keys: list[str]) -> DataFrame:
    """The last row that ``updates`` has written for each key."""
    rows = spark.read.parquet(f"{root}/{name}")
    return top_per_key(rows, keys, [F.col("batch_id").desc()]).drop("batch_id")


def latency_sketches(traces: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """One mergeable sketch of the latencies for each hour and agent.

    The state holds a sketch for each open hour and agent. Calls that arrive more than ``lateness`` after the newest one are
    not counted; the query's progress reports their number. Calls without a time or a latency have no place in a sketch.
    """
    hours = traces.where("ts IS NOT NULL AND total_latency_ms IS NOT NULL").withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour"), "agent_type")
    sketch = F.kll_sketch_agg_bigint(F.col("total_latency_ms").cast("long"), F.lit(SKETCH_K))
    return hours.agg(sketch.alias("sketch"), F.count(F.lit(1)).alias("calls")).select(F.col("window.start").alias("hour"), "agent_type", "sketch", "calls")


def p95_latency_stream(traces: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """P95 latency (approximate, mergeable) per one-hour window with its alert flag."""
    windows = traces.withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour"))
    p95 = windows.agg(F.percentile_approx("total_latency_ms", 0.95, 10_000).alias("p95_ms"), F.count(F.lit(1)).alias("calls"))
    return p95.select(F.col("window.start").alias("hour"), "p95_ms", "calls", (F.col("p95_ms") > C.ALERT_P95_MS).alias("alert"))


def sketch_stream(traces: DataFrame, root: str, once: bool = False, lateness: str = LATENESS) -> StreamingQuery:
    return updates(latency_sketches(traces, lateness), root, "latency_sketches", once)


def stored_sketches(spark: SparkSession, root: str) -> DataFrame:
    return newest(spark, root, "latency_sketches", ["hour", "agent_type"])


def percentile_of(sketches: DataFrame, share: float, *by: Column) -> DataFrame:
    """Percentile of the calls of each group of sketches (all of them without ``by``), from the sketches alone.

    The value is that of an actual call, whose rank is off by ``RANK_ERROR`` of the calls at most; with up to ``SKETCH_K``
    calls in each sketch and group it is the exact one (the smallest value with ``share`` of the calls at or below it).
    """
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_bigint("sketch", F.lit(SKETCH_K)).alias("sketch"), F.sum("calls").alias("calls"))
    return merged.withColumn("value", F.kll_sketch_get_quantile_bigint("sketch", F.lit(share))).drop("sketch")


def p95_alerts(sketches: DataFrame, *by: Column) -> DataFrame:
    """Calls and P95 latency of each group of sketches, and whether it breaks the limit."""
    return percentile_of(sketches, 0.95, *by).withColumnRenamed("value", "p95_ms").withColumn("alert", F.col("p95_ms") > C.ALERT_P95_MS)


def latency_counts(traces: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """The calls of each hour, agent and latency: what exact percentiles of any longer span need.

    The state holds a number for each latency of the open hours. Lateness and missing values are as in ``latency_sketches``.
    """
    hours = traces.where("ts IS NOT NULL AND total_latency_ms IS NOT NULL").withWatermark("ts", lateness)
    counts = hours.groupBy(F.window("ts", "1 hour"), "agent_type", F.col("total_latency_ms").cast("long").alias("latency")).agg(F.count(F.lit(1)).alias("calls"))
    return counts.select(F.col("window.start").alias("hour"), "agent_type", "latency", "calls")


def count_stream(traces: DataFrame, root: str, once: bool = False, lateness: str = LATENESS) -> StreamingQuery:
    return updates(latency_counts(traces, lateness), root, "latency_counts", once)


def stored_counts(spark: SparkSession, root: str) -> DataFrame:
    return newest(spark, root, "latency_counts", ["hour", "agent_type", "latency"])


def exact_percentile_of(counts: DataFrame, share: str, *by: str) -> DataFrame:
    """``calls`` and ``value`` of each group of counts: the smallest latency with ``share`` of the calls at or below it.

    Counts of a latency are added before the shuffle, so a group holds one row for each of its latencies.
    """
    each = counts.groupBy(*by, "latency").agg(F.sum("calls").alias("n"))
    group = Window.partitionBy(*by)
    below = F.sum("n").over(group.orderBy("latency").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = each.select(*by, "latency", below.alias("below"), F.sum("n").over(group).alias("calls"))
    reached = ranked.where(F.col("below") >= F.col("calls") * F.lit(Decimal(share)))
    return reached.groupBy(*by).agg(F.first("calls").alias("calls"), F.min("latency").alias("value"))


def exact_p95_alerts(counts: DataFrame, *by: str) -> DataFrame:
    """As ``p95_alerts``, from counts and exact for any number of calls."""
    return exact_percentile_of(counts, "0.95", *by).withColumnRenamed("value", "p95_ms").withColumn("alert", F.col("p95_ms") > C.ALERT_P95_MS)


# Lag and silence. A run is a stretch of messages of a partition with no gap beyond the limit.

RUNS = "kafka_partition int, head long, done long, start timestamp, ts timestamp"
LAGS = "kafka_partition int, since timestamp, lag long, lag_alert boolean"
LAG_STATE = "head long, done long, starts array<long>, ends array<long>"


def _joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs without a silence between them become one."""
    found: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if found and start - found[-1][1] <= SILENT:
            found[-1] = found[-1][0], max(found[-1][1], end)
        else:
            found.append((start, end))
    return found


def _micros(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us]").astype("int64")


def _largest(*values) -> int | None:
    return max((int(v) for v in values if v is not None and not pd.isna(v)), default=None)


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A few rows for each partition of a batch, so that one busy partition sends little to its task."""
    for batch in batches:
        rows = []
        for partition, group in batch.groupby("kafka_partition"):
            head, done = group["kafka_offset"][~group["consumed"]].max(), group["kafka_offset"][group["consumed"]].max()
            times = _micros(group["ts"].dropna()).drop_duplicates().sort_values()
            for start, end in _joined([(t, t) for t in times.tolist()]):
                rows.append((partition, _largest(head), _largest(done), start, end))
        found = pd.DataFrame(rows, columns=["kafka_partition", "head", "done", "start", "ts"])
        found[["head", "done"]] = found[["head", "done"]].astype("Int64")
        yield found.assign(start=pd.to_datetime(found["start"], unit="us"), ts=pd.to_datetime(found["ts"], unit="us"))


def _followed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    head, done, starts, ends = state.get if state.exists else (None, None, [], [])
    runs, rows = list(zip(starts, ends)), []
    if not state.hasTimedOut:
        for batch in batches:
            head, done = _largest(head, *batch["head"]), _largest(done, *batch["done"])
            runs += zip(_micros(batch["start"]).tolist(), _micros(batch["ts"]).tolist())
        lag = (-1 if head is None else head) - (-1 if done is None else done)
        rows.append((key[0], None, lag, lag > C.LAG_MESSAGES))
    watermark = state.getCurrentWatermarkMs()
    runs = _joined(runs)
    over = [r for r in runs if (r[1] + SILENT) // 1000 < watermark]  # no message that is still accepted can end the silence in time
    runs = runs[len(over) :]
    rows += [(key[0], end, None, None) for _, end in over]
    state.update((head, done, [r[0] for r in runs], [r[1] for r in runs]))
    if runs:
        state.setTimeoutTimestamp(max((runs[0][1] + SILENT) // 1000, watermark + 1))
    found = pd.DataFrame(rows, columns=["kafka_partition", "since", "lag", "lag_alert"])
    yield found.assign(since=pd.to_datetime(found["since"], unit="us"), lag=found["lag"].astype("Int64"), lag_alert=found["lag_alert"].astype("boolean"))


def partition_alerts(messages: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Lag after each batch, and silences, of the partitions of a stream of ``messages``.

    ``messages``: ``kafka_partition``, ``kafka_offset``, ``ts`` and ``consumed`` (false: produced, true: read by the consumer).
    A row with ``lag`` tells the unread messages of a partition that had some in the batch; the last one holds. A row with
    ``since`` tells that no message came in the five minutes after that time. A timer fires it, also when the partition stays
    quiet: time passes by the messages of the other partitions, less ``lateness``. Messages that are later than that are not
    seen. The state of a partition is its two offsets and the few runs of messages that the watermark has not passed.
    """
    runs = messages.where("ts IS NOT NULL AND kafka_partition IS NOT NULL").mapInPandas(_runs, RUNS).withWatermark("ts", lateness)
    return runs.groupBy("kafka_partition").applyInPandasWithState(_followed, LAGS, LAG_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def lag_stream(messages: DataFrame, root: str, once: bool = False, lateness: str = LATENESS) -> StreamingQuery:
    return updates(partition_alerts(messages, lateness), root, "partition_alerts", once)


def stored_lags(spark: SparkSession, root: str) -> DataFrame:
    """The last known lag of each partition."""
    rows = spark.read.parquet(f"{root}/partition_alerts").where("lag IS NOT NULL")
    return top_per_key(rows, ["kafka_partition"], [F.col("batch_id").desc()]).select("kafka_partition", "lag", "lag_alert")


def stored_silences(spark: SparkSession, root: str) -> DataFrame:
    """All silences: partition and the time of the last message before."""
    return spark.read.parquet(f"{root}/partition_alerts").where("since IS NOT NULL").select("kafka_partition", "since")


