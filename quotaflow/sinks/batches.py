"""What one run leaves behind: metric tables after a sync, monitoring rows after a batch of answers or an eval."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaflow.operators.merge import require_unique
from quotaflow.plans import monitoring, sync
from quotaflow.schemas import conform
from quotaflow.sinks.keyed import KeyedTable
from quotaflow.sinks.tables import append, append_batch, overwrite_partitions

METRIC_KEYS = {"arr": "account_id", "acv": "opportunity_id", "health": "account_id"}


def metric_table(spark: SparkSession, root: str, name: str) -> KeyedTable:
    """Upserted metric table; a later sync wins, nothing is ever deleted."""
    return KeyedTable(spark, f"{root}/{name}", METRIC_KEYS[name], sequence="synced_at", tie="sync_no", deletes=False)


def sync_metrics(sources: dict[str, DataFrame], root: str, as_of: dt.date, sync_no: int) -> None:
    """One sync run: arr, acv and health are upserted, forecast is appended, nrr replaces the day's snapshot.

    ``sync_no`` numbers the runs. Repeating a run writes the same partitions again, so it does not add rows.
    """
    rows = {
        "arr": sync.arr_rows(sources["arr"], as_of),
        "acv": sync.acv_rows(sources["acv"]),
        "health": sync.health_rows(sources["health"], as_of),
    }
    for name, df in rows.items():
        require_unique(df, METRIC_KEYS[name])
        stamped = conform(sync.stamped(df), f"metrics.{name}").withColumn("sync_no", F.lit(sync_no))
        metric_table(df.sparkSession, root, name).write_batch(stamped, sync_no, unique=True)
    forecast = sync.forecast_rows(sources["forecast"]).withColumn("snapshot_date", F.lit(as_of))
    append_batch(conform(sync.stamped(forecast), "metrics.forecast"), f"{root}/forecast", sync_no)
    nrr = sync.nrr_rows(sources["nrr"], as_of).withColumns(
        {"period": F.col("period_date").cast("string"), "snapshot_date": F.lit(as_of)}
    )
    overwrite_partitions(conform(sync.stamped(nrr), "metrics.nrr"), f"{root}/nrr")


def record_answers(answers: DataFrame, judged: DataFrame, root: str, version: str, model: str) -> None:
    """Traces, unsupported claims and the SQL log of one batch of answers: one append per table.

    answers: trace_id, query, response and any other trace column; sql columns are optional. judged: trace_id,
    raw, response, context. An answer without a verdict row gets score 0.
    """
    stamp = F.current_timestamp()
    scored = monitoring.verdicts(judged.join(answers.select("trace_id", "query"), "trace_id").withColumn("ts", stamp))
    traces = monitoring.with_cost(answers).join(
        scored.select("trace_id", F.col("score").alias("groundedness_score")), "trace_id", "left"
    )
    traces = traces.withColumns(
        {
            "groundedness_score": F.coalesce("groundedness_score", F.lit(0.0)),
            "agent_version": F.lit(version),
            "model": F.lit(model),
            "ts": stamp,
        }
    )
    append(traces, "monitoring.agent_traces", f"{root}/agent_traces")
    append(monitoring.claim_rows(scored), "monitoring.groundedness_issues", f"{root}/groundedness_issues")
    if "generated_sql" in answers.columns:
        log = answers.filter("generated_sql <> ''").withColumns({"agent_version": F.lit(version), "ts": stamp})
        append(log, "monitoring.sql_log", f"{root}/sql_log")


def record_feedback(requests: DataFrame, root: str) -> DataFrame:
    """Appends valid ratings; returns the rejected requests."""
    checked = monitoring.valid_ratings(requests)
    append(checked.filter("valid").withColumn("ts", F.current_timestamp()), "monitoring.user_feedback", f"{root}/user_feedback")
    return checked.filter("NOT valid").drop("valid")


def record_eval(checked: DataFrame, root: str, version: str, triggered_by: str = "manual") -> DataFrame:
    """Appends one row per eval run; returns the run rows, whose threshold_met decides about a release."""
    runs = monitoring.eval_summary(checked).withColumns(
        {"agent_version": F.lit(version), "triggered_by": F.lit(triggered_by), "ts": F.current_timestamp()}
    )
    append(runs, "monitoring.eval_runs", f"{root}/eval_runs")
    return runs
