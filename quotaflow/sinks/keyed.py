"""Keyed current tables on plain files: a log of changes, folded into a base from time to time.

Writing a batch touches only that batch's partition, so a repeated batch changes nothing and a lost executor or a
restarted driver cannot damage rows written before. Reading compares the base with the log; after every
``fold_every``-th batch the writer folds the log into a new base, so a read never meets more than that many
partitions. A row's place in time is its (sequence, tie) pair; a delete stays as a tombstone, so an older event that arrives later cannot revive the key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quotaflow import constants as C
from quotaflow.operators.ranking import top_per_key
from quotaflow.sinks.tables import append_batch


@dataclass(frozen=True)
class KeyedTable:
    """Current rows per key below one folder."""

    spark: SparkSession
    root: str
    key: str
    sequence: str = "updated_at"
    tie: str = "kafka_offset"
    deletes: bool = True
    fold_every: int = 100

    def _order(self) -> list[Column]:
        return [F.col(self.sequence).desc_nulls_last(), F.col(self.tie).desc_nulls_last()]

    def newest(self, df: DataFrame) -> DataFrame:
        return top_per_key(df, [self.key], self._order())

    def write_batch(self, batch: DataFrame, batch_id: int, unique: bool = False) -> None:
        """Log the newest row per key of one batch, deletes included; fold when it is time. ``unique``: no key is there twice."""
        append_batch(batch if unique else self.newest(batch), f"{self.root}/log", batch_id)
        if (batch_id + 1) % self.fold_every == 0 and self.folded_until() < batch_id:
            last = self.spark.read.parquet(f"{self.root}/log").agg(F.max(self.sequence)).first()[0]
            self.fold(batch_id, F.lit(last))

    def _read(self, part: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/{part}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise

    def folded_until(self) -> int:
        """Last batch that the base contains, -1 without a base."""
        marks = self._read("folds")
        return -1 if marks is None else marks.agg(F.max("until")).first()[0]

    def _latest(self) -> DataFrame:
        """Newest row per key, tombstones included."""
        until = self.folded_until()
        log = self.spark.read.parquet(f"{self.root}/log")
        fresh = self.newest(log.filter(F.col("batch_id") > until).drop("batch_id"))
        if until < 0:
            return fresh
        base = self.spark.read.parquet(f"{self.root}/base/until={until}")
        return newer_rows(base, fresh, self.key, self.sequence, self.tie)

    def current(self) -> DataFrame:
        rows = self._latest()
        return rows.filter(~F.col("event_type").eqNullSafe("DELETE")) if self.deletes else rows

    def fold(self, until: int, as_of: Column, retention_days: int = C.TOMBSTONE_RETENTION_DAYS) -> None:
        """Fold all batches up to ``until`` into a new base and leave out tombstones past the retention.

        The base becomes valid with its mark, one row written last; a fold that stops half-way leaves no trace
        for readers. Log partitions up to ``until`` and earlier bases are no longer read and may be expired by
        the storage.
        """
        rows = self._latest()
        if self.deletes:
            old = F.col(self.sequence) < as_of - F.expr(f"INTERVAL {retention_days} DAYS")
            rows = rows.filter(~(F.col("event_type").eqNullSafe("DELETE") & F.coalesce(old, F.lit(False))))
        rows.write.mode("overwrite").parquet(f"{self.root}/base/until={until}")
        self.spark.range(1).select(F.lit(until).alias("until")).write.mode("append").parquet(f"{self.root}/folds")


def newer_rows(base: DataFrame, fresh: DataFrame, key: str, sequence: str, tie: str) -> DataFrame:
    """Per key the newer of a base row and a fresh row; both sides hold a key at most once."""
    columns = base.columns
    news = fresh.select(key, F.struct(*columns).alias("_new"))
    place = lambda row: F.struct(  # noqa: E731  a missing sequence ranks below every real one
        row(sequence).isNotNull().alias("known"), row(sequence).alias("sequence"), row(tie).alias("tie")
    )
    wins = F.col("_new").isNotNull() & (place(lambda c: F.col("_new")[c]) > place(F.col))
    kept = base.join(news, key, "left").select(
        *[F.when(wins, F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in columns]
    )
    # keys known to the base: the base side is only probed with the few fresh keys
    known = base.select(key).join(fresh.select(key), key, "left_semi")
    added = fresh.select(*columns).join(known, key, "left_anti")
    return kept.unionByName(added)
