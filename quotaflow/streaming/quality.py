"""Quality counts of a stream, stored batch by batch as its queries report them."""

from __future__ import annotations

import threading
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from quotaflow.operators import cdc
from quotaflow.sinks.tables import append_batch

METRICS = "quality"
REPORT = "rule string, violations long, total_rows long"


def all_rules(entity: str) -> dict[str, Column]:
    """The rules that drop rows, and those that only warn."""
    warnings = {"valid_amount": F.col("amount") > 0} if entity == "opportunity" else {}
    return {**cdc.quality_rules(entity), **warnings}


def checked_rows(raw: DataFrame, entity: str) -> DataFrame:
    """Typed valid rows of a stream of raw ones; the violations of all rules, also of rows that go, are observed on the way."""
    rows = cdc.observed(cdc.parse_events(raw, entity), all_rules(entity), METRICS)
    return cdc.keep_valid(rows, cdc.quality_rules(entity))


class QualityListener(StreamingQueryListener):
    """Stores the counts that each batch of the query ``name`` reports; a batch that runs again replaces its own."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.root, self.name = spark, root, name
        self.stored, self.failed, self.changed = -1, None, threading.Condition()

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.name != self.name:
            return
        try:
            counts = progress.observedMetrics.get(METRICS)
            if counts is not None:
                counts = counts.asDict()
                total = counts.pop("total_rows")
                rows = [(rule, n, total) for rule, n in counts.items()]  # one row for each rule
                append_batch(self.spark.createDataFrame(rows, REPORT).coalesce(1), f"{self.root}/quality", progress.batchId)
        except Exception as error:  # a listener's errors are lost; ``wait`` raises it
            self.failed = error
        with self.changed:
            self.stored = max(self.stored, progress.batchId)
            self.changed.notify_all()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until the last batch of the ended query is stored; reports come after the batches."""
        last, end = query.lastProgress, time.monotonic() + seconds
        with self.changed:
            while last is not None and self.stored < last.batchId and time.monotonic() < end:
                self.changed.wait(1)
        if self.failed is not None:
            raise self.failed
        if last is not None and self.stored < last.batchId:
            raise TimeoutError("the listener has not seen the last batch")


def stored_report(spark: SparkSession, root: str) -> DataFrame:
    """Violations and rows by rule, over all batches."""
    batches = spark.read.parquet(f"{root}/quality")
    return batches.groupBy("rule").agg(F.sum("violations").alias("violations"), F.sum("total_rows").alias("total_rows"))
