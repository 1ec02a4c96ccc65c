"""Warehouse metric sync: projections per metric table, snapshots, freshness."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaflow.functions.metrics import ratio
from quotaflow.operators.ranking import top_per_key


def arr_rows(source: DataFrame, as_of: dt.date) -> DataFrame:
    return source.filter("arr IS NOT NULL").withColumn("snapshot_date", F.lit(as_of))


def acv_rows(source: DataFrame) -> DataFrame:
    return source.filter("acv IS NOT NULL")


def health_rows(source: DataFrame, as_of: dt.date) -> DataFrame:
    return source.select(
        "account_id", "account_name", "health_score", "nps_score", "csat_score", "risk_tier", "dau_30d",
        "feature_adoption", "last_login_date", F.lit(as_of).alias("snapshot_date"),
    )


def forecast_rows(source: DataFrame) -> DataFrame:
    """Adds attainment = closed_won / quota, NULL without a positive quota."""
    return source.withColumn("attainment_pct", ratio(F.col("closed_won"), F.col("quota"), digits=6))


def nrr_rows(source: DataFrame, as_of: dt.date, months: int = 24) -> DataFrame:
    """Periods of the last 24 months; the bound is a literal date, so it reaches the scan."""
    return source.filter(F.col("period_date") >= F.add_months(F.lit(as_of), -months))


def stamped(df: DataFrame) -> DataFrame:
    """Adds synced_at on the way to a metric table."""
    return df.withColumn("synced_at", F.current_timestamp())


def latest_snapshots(snapshots: DataFrame, keys: list[str], day: str = "snapshot_date") -> DataFrame:
    return top_per_key(snapshots, keys, [F.col(day).desc()])


def freshness(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Newest value of the time column per table: (table_name, newest)."""
    rows = None
    for name, (df, column) in tables.items():
        row = df.agg(F.max(column).cast("timestamp_ntz").alias("newest")).select(F.lit(name).alias("table_name"), "newest")
        rows = row if rows is None else rows.unionByName(row)
    return rows
