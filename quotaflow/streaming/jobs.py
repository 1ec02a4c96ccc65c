"""Search runs as a stream: a job that an earlier run has shown is not read again."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quotaflow.plans.jobs import ORDER, first_seen
from quotaflow.streaming.medallion import append_stream, table_stream

MEMORY = "30 days"


def add_run(items: DataFrame, root: str, run: int, seen_at: dt.datetime, order: list[str] = ORDER) -> None:
    """The first item of each job of a run, as the next part of the stream; ``seen_at`` is the time of the run."""
    rows = first_seen(items, order).withColumns({"run": F.lit(run), "seen_at": F.lit(seen_at).cast("timestamp")})
    rows.write.mode("append").parquet(f"{root}/runs")


def new_jobs(runs: DataFrame, memory: str = MEMORY) -> DataFrame:
    """Items of jobs (title and company in any case) that no run within ``memory`` has shown.

    The state holds one key for each job and forgets it when the newest run is more than twice ``memory`` after the one that
    showed it first; in runs after that the job is new once more. A run older than the newest by ``memory`` is not read.
    """
    job = F.lower(F.concat(F.col("title"), F.lit("|"), F.col("company")))
    return runs.withColumn("_job", job).withWatermark("seen_at", memory).dropDuplicatesWithinWatermark(["_job"]).drop("_job")


def job_stream(spark: SparkSession, root: str, once: bool = False, memory: str = MEMORY) -> StreamingQuery:
    """Take the waiting runs into the table ``new_jobs``, one after the other."""
    return append_stream(new_jobs(table_stream(spark, f"{root}/runs"), memory), root, "new_jobs", once)
