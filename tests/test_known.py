"""The stored filter of known ids, and the ingestion that asks it first."""

import pytest
from pyspark.sql import functions as F

from quotaflow.operators import known
from quotaflow.streaming import documents as stream

LONG = " ".join(f"word{i}" for i in range(60))


@pytest.mark.parametrize("size", [10, 16, 27])
def test_no_known_id_is_missed(spark, size):
    ids = spark.range(400).select(F.concat(F.lit("d"), "id").alias("doc_id"))
    parts = [ids.where(F.col("doc_id").endswith(str(i))) for i in range(10)]
    filters = None
    for part in parts[:5]:
        one = known.filter_of(part, "doc_id", size)
        filters = one if filters is None else filters.unionByName(one)
    got = {r.doc_id for r in known.maybe_known(ids.union(ids), "doc_id", filters, size).collect()}
    old = {f"d{i}" for i in range(400) if i % 10 < 5}
    assert got >= old
    if size == 27:
        assert got == old
    if size == 16:
        assert len(got - old) < 20


def test_nulls_and_nothing(spark):
    ids = spark.createDataFrame([("a",), (None,)], "doc_id string")
    filters = known.filter_of(ids, "doc_id")
    assert [r.doc_id for r in known.maybe_known(ids, "doc_id", filters).collect()] == ["a"]
    assert known.maybe_known(ids, "doc_id", known.filter_of(ids.limit(0), "doc_id")).count() == 0
    assert known.maybe_known(ids.limit(0), "doc_id", filters).count() == 0


def files(spark, *names):
    return spark.createDataFrame([(f"/Volumes/s/d/emails/7/{n}.txt", f"{LONG} {n}") for n in names], "file_path string, content string")


def names(spark, root):
    rows = spark.read.parquet(f"{root}/metadata").collect()
    return sorted((r.file_name, r.batch_id) for r in rows)


def test_batches_know_each_other(spark, tmp_path):
    root = str(tmp_path)
    stream.ingest_batch(root, files(spark, "a", "b"), 0)
    stream.ingest_batch(root, files(spark, "b", "c"), 1)
    assert names(spark, root) == [("a.txt", 0), ("b.txt", 0), ("c.txt", 1)]
    stream.ingest_batch(root, files(spark, "b", "c"), 1)  # again, after a crash
    assert names(spark, root) == [("a.txt", 0), ("b.txt", 0), ("c.txt", 1)]
    stream.ingest_batch(root, files(spark, "a", "b", "c"), 2)
    assert names(spark, root) == [("a.txt", 0), ("b.txt", 0), ("c.txt", 1)]
    assert spark.read.parquet(f"{root}/chunks").count() == 3


def test_only_metadata_that_may_match_is_read(spark, tmp_path):
    root = str(tmp_path)
    stream.ingest_batch(root, files(spark, *(f"f{i}" for i in range(40))), 0)

    def plan(*wanted):
        ids = stream.identify(files(spark, *wanted)).select("doc_id")
        found = stream.known_documents(spark, root, ids, 1)
        return found, found._jdf.queryExecution().executedPlan().toString()

    found, text = plan("new1", "new2")
    assert "metadata" not in text and found.count() == 0  # the filter alone answers
    found, text = plan("f3", "new1")
    assert found.count() == 1
    scans = [line for line in text.splitlines() if "FileScan" in line and "id_part" in line]
    assert scans and all("id_part#" in line.split("PartitionFilters:")[1] for line in scans)
    parts = [p.name for p in (tmp_path / "metadata" / "batch_id=0").iterdir() if p.name.startswith("id_part")]
    assert len(parts) > 20
