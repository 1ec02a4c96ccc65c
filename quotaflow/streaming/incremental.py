"""Results kept up to date by a stream: falling health scores, forecast totals with retractions, reviews of ratings."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quotaflow import constants as C
from quotaflow.streaming.alerts import newest, updates

HORIZON = "7 days"
FALLS = "entity_id string, kafka_offset long, health_score int, previous_score int, degraded boolean"
FALL_STATE = "times array<long>, offsets array<long>, scores array<int>"
FIRST = -(1 << 62)  # of events without a time


def _falls(horizon: int) -> Callable:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = sorted(zip(*state.get), key=lambda e: e[:2]) if state.exists else []
        held = {e[:2] for e in known}
        began = known[0][:2] if known else None  # what came before it is forgotten
        latest = known[-1][0] if known else FIRST
        fresh = {}
        for batch in batches:
            times = batch["updated_at"].astype("datetime64[us]")
            numbers = times.astype("int64").where(times.notna(), FIRST)
            for time, offset, score in zip(numbers.tolist(), batch["kafka_offset"].tolist(), batch["health_score"].astype(object)):
                event = (time, offset)
                if event not in held and not (began and event < began and time < latest - horizon):
                    fresh[event] = None if pd.isna(score) else int(score)
        events = sorted([*known, *((*e, s) for e, s in fresh.items())], key=lambda e: e[:2])
        places = [e[:2] for e in events]
        judged = set()
        for event in fresh:
            at = bisect_left(places, event)
            judged.update(i for i in (at, at + 1) if i < len(events))  # an event, and the one whose predecessor it has become
        rows = []
        for i in sorted(judged):
            score, before = events[i][2], events[i - 1][2] if i else None
            fell = score is not None and before is not None and score < before
            if fell or places[i] in held:  # what an earlier batch has told of an event is replaced
                rows.append((key[0], events[i][1], score, before, fell))
        keep = max(bisect_left(places, (events[-1][0] - horizon, 0)) - 1, 0) if events else 0
        kept = events[keep:]
        state.update(([e[0] for e in kept], [e[1] for e in kept], [e[2] for e in kept]))
        if rows:  # most keys of a batch have few, so what is built for each key counts
            ids, offsets, scores, earlier, fell = zip(*rows)
            columns = {"entity_id": ids, "kafka_offset": offsets, "health_score": pd.array(scores, "Int32"), "previous_score": pd.array(earlier, "Int32"), "degraded": fell}
            yield pd.DataFrame(columns)

    return run


def health_falls(events: DataFrame, horizon: str = HORIZON) -> DataFrame:
    """Events whose health score is below that of the event before, by (``updated_at``, offset), as rows that replace earlier ones.

    Each event is judged when it comes. A late one is put into its place, and its successor is judged again; so after all
    events have come, the rows are those of one pass over all of them, in whatever order they came. The state of a key holds
    its events of the last ``horizon`` and the one before; an event that is older than all of these is not judged. Events
    without a time come first, a repeated event (time and offset) counts once, a missing score is neither below nor above.
    """
    length = int(pd.Timedelta(horizon).total_seconds() * 1_000_000)
    rows = events.select("entity_id", "updated_at", "kafka_offset", "health_score").where("entity_id IS NOT NULL")
    return rows.groupBy("entity_id").applyInPandasWithState(_falls(length), FALLS, FALL_STATE, "update", GroupStateTimeout.NoTimeout)


def health_stream(events: DataFrame, root: str, once: bool = False, horizon: str = HORIZON) -> StreamingQuery:
    return updates(health_falls(events, horizon), root, "health_falls", once)


def stored_falls(spark: SparkSession, root: str) -> DataFrame:
    return newest(spark, root, "health_falls", ["entity_id", "kafka_offset"]).where("degraded").drop("degraded")


def signed_deals(feed: DataFrame) -> DataFrame:
    """What each row of a change feed takes from and adds to the open deals of a category.

    ``feed``: ``change_type``, ``stage``, ``forecast_category``, ``amount`` and their ``old_`` values.
    """
    amount = lambda column, sign: (F.coalesce(column, F.lit(0)) * sign).cast("decimal(18,2)")
    is_open = lambda stage: ~F.coalesce(F.col(stage).isin(*C.CLOSED_STAGES), F.lit(True))
    taken = F.struct(F.col("old_forecast_category").alias("forecast_category"), amount(F.col("old_amount"), -1).alias("amount"), F.lit(-1).alias("deals"))
    added = F.struct("forecast_category", amount(F.col("amount"), 1).alias("amount"), F.lit(1).alias("deals"))
    was, now = F.col("change_type").isin("update", "delete") & is_open("old_stage"), F.col("change_type").isin("insert", "update") & is_open("stage")
    parts = F.filter(F.array(F.when(was, taken), F.when(now, added)), lambda p: p.isNotNull())
    return feed.select(F.explode(parts).alias("part")).select("part.*")


def category_totals(feed: DataFrame) -> DataFrame:
    """Amount and number of the open deals by category, from signed sums: a batch rewrites the categories that it touches."""
    return signed_deals(feed).groupBy("forecast_category").agg(F.sum("amount").cast("decimal(28,2)").alias("amount"), F.sum("deals").alias("deal_count"))


def totals_stream(feed: DataFrame, root: str, once: bool = False) -> StreamingQuery:
    return updates(category_totals(feed), root, "category_totals", once)


def stored_totals(spark: SparkSession, root: str) -> DataFrame:
    return newest(spark, root, "category_totals", ["forecast_category"]).where("deal_count > 0")


def reviews(feedback: DataFrame, traces: DataFrame, days: int = 7, lateness: str = "1 hour") -> DataFrame:
    """Thumbs-down ratings with their answers, up to ``days`` after the answer, while both still arrive.

    Either side waits in the state for the other; the two watermarks and the interval bound how long. What arrives more than
    ``lateness`` after the newest row of the slower side is not joined, nor is a rating from before its answer.
    """
    down = feedback.where(F.col("rating") == C.RATING_DOWN).select(F.col("trace_id").alias("rated_id"), "comment", F.col("ts").alias("feedback_ts"))
    answers = traces.select("trace_id", "query", "agent_type", "groundedness_score", "confidence_score", F.col("ts").alias("answer_ts"))
    down, answers = down.withWatermark("feedback_ts", lateness), answers.withWatermark("answer_ts", lateness)
    inside = F.expr(f"rated_id = trace_id AND feedback_ts >= answer_ts AND feedback_ts <= answer_ts + INTERVAL {days} DAYS")
    return down.join(answers, inside).drop("rated_id")


def review_stream(feedback: DataFrame, traces: DataFrame, root: str, once: bool = False, days: int = 7, lateness: str = "1 hour") -> StreamingQuery:
    stream = reviews(feedback, traces, days, lateness)
    writer = stream.writeStream.option("checkpointLocation", f"{root}/_checkpoints/reviews").queryName("reviews")
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=C.CDC_TRIGGER)
    return writer.format("parquet").outputMode("append").start(f"{root}/reviews")
