"""Writers, schema conformance, access, warehouse query."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quotaflow.operators import access
from quotaflow.schemas import TABLES, conform
from quotaflow.sinks.tables import append, append_batch, overwrite_partitions, write_csv
from quotaflow.sources.warehouse import warehouse_query

ITEM = "title string, company string, location string, salary string, score double, score_reason string, url string, posted string, is_disqualified boolean"


def test_registry_has_all_tables():
    assert len(TABLES) == 14
    assert [f.name for f in TABLES["realtime.account_current"].fields if not f.nullable] == ["account_id"]


def test_conform(spark):
    df = spark.createDataFrame([("1", "7", "extra")], "account_id string, health_score string, other string")
    row = conform(df, "realtime.account_current")
    assert row.schema.names == TABLES["realtime.account_current"].names
    assert (row.first()["health_score"], row.first()["arr"]) == (7, None)
    with pytest.raises(Exception, match="account_id is NULL"):
        conform(df.withColumn("account_id", F.lit(None).cast("string")), "realtime.account_current").collect()


def test_append_writes_all_null_columns(spark, tmp_path):
    df = spark.createDataFrame([("t", [])], "trace_id string, retrieved_chunk_ids array<string>")
    for _ in range(2):
        append(df, "monitoring.agent_traces", str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_append_batch_is_idempotent(spark, tmp_path):
    for _ in range(2):
        append_batch(spark.range(5), str(tmp_path / "t"), 3)
    append_batch(spark.range(2), str(tmp_path / "t"), 4)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 7


def test_overwrite_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    days = [dt.date(2001, 5, d) for d in (1, 2)]
    overwrite_partitions(spark.createDataFrame([(1, days[0]), (2, days[1]), (3, days[1])], "v int, snapshot_date date"), path)
    overwrite_partitions(spark.createDataFrame([(9, days[1])], "v int, snapshot_date date"), path)
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 9]


def test_csv_file(spark, tmp_path):
    rows = [('a "b"\nc', "x,y", None, "", 0.0, "r", "u", "", False), ("t", "c", "l", "s", 7.0, "", "u", "p", True)]
    write_csv(spark.createDataFrame(rows, ITEM).coalesce(1), str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("*.csv")).read_text().splitlines()
    assert text[0].split(",")[:2] in (["title", "company"], ['"title"', '"company"'])
    assert text[1:] == ['"a ""b"" c","x,y","","","","r","u","",""', '"t","c","l","s","7","","u","p","true"']


def test_access(spark):
    df = spark.createDataFrame([("1", 5), ("2", 6), ("3", 7)], "owner_id string, arr int")
    team = spark.createDataFrame([("boss", "1"), ("boss", "2"), ("boss", "2"), ("other", "3")], "viewer string, owner_id string")
    seen = lambda viewer, role: sorted(r["owner_id"] for r in access.visible_rows(df, viewer, role, team).collect())
    assert (seen("x", "leader"), seen("boss", "manager"), seen("3", "rep"), seen("9", "rep")) == (["1", "2", "3"], ["1", "2"], ["3"], [])
    assert [r["arr"] for r in access.mask_columns(df, ["arr"], "rep").collect()] == [None] * 3
    assert [r["arr"] for r in access.mask_columns(df, ["arr"], "finance").orderBy("arr").collect()] == [5, 6, 7]


def test_warehouse_query_pushes_filters(spark, tmp_path):
    spark.createDataFrame([(1, 2, "a"), (3, 4, "b")], "x int, y int, z string").write.parquet(str(tmp_path / "t"))
    df = warehouse_query(spark, "SELECT x FROM t WHERE x > 1", {"t": str(tmp_path / "t")})
    assert [r["x"] for r in df.collect()] == [3]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,1)" in plan and "ReadSchema: struct<x:int>" in plan
