"""Table writers. ``fmt`` may be any installed table format; parquet is always there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaflow import constants as C
from quotaflow.plans.jobs import csv_fields
from quotaflow.plans.monitoring import DAY
from quotaflow.schemas import conform


def append(df: DataFrame, table: str, path: str, fmt: str = "parquet") -> None:
    """Append rows in the table's registered schema; monitoring tables are partitioned by the day of ``ts``."""
    rows = conform(df, table)
    if table.startswith("monitoring."):
        rows.withColumn(DAY, F.to_date("ts")).write.format(fmt).mode("append").partitionBy(DAY).save(path)
    else:
        rows.write.format(fmt).mode("append").save(path)


def append_batch(df: DataFrame, path: str, batch_id: int, by: tuple[str, ...] = ()) -> None:
    """Write one micro-batch as its own partition, cut further ``by`` columns; running the batch again replaces it and adds nothing."""
    # static: a repeated batch also removes the finer partitions that it no longer has
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by).parquet(f"{path}/batch_id={batch_id}")


def overwrite_partitions(df: DataFrame, path: str, partition: str = "snapshot_date") -> None:
    """Replace exactly the partitions that occur in the rows; all other partitions stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str] = C.JOB_CSV_COLUMNS, order: list[str] | None = None) -> None:
    """CSV files with a header, all fields quoted, quotes doubled, one line per row, in order when one is given."""
    rows = df.orderBy(*order) if order else df
    fields = rows.select(*csv_fields(df, columns))
    fields.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', emptyValue="", nullValue="")
