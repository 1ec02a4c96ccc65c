"""Warehouse scans: a query text run at the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def warehouse_query(spark: SparkSession, query: str, tables: dict[str, str]) -> DataFrame:
    """The query over named parquet tables; filters and columns reach the scans."""
    return spark.sql(_with_placeholders(query, tables), **{name: spark.read.parquet(path) for name, path in tables.items()})


def _with_placeholders(query: str, tables: dict[str, str]) -> str:
    return f"WITH {', '.join(f'{name} AS (SELECT * FROM {{{name}}})' for name in tables)} {query}"


def jdbc_query(spark: SparkSession, query: str, options: dict[str, str]) -> DataFrame:
    """The query pushed down to a database over JDBC; url, user and driver come in ``options``."""
    return spark.read.format("jdbc").options(**options).option("query", query).load()
