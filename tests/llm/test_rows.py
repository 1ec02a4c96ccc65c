"""Row numbers of the pipeline's stages when a second read of the table is split otherwise."""

import corpus_pipeline
import pytest

FOLDER = "/root/testdata/sf0.001"
SETTINGS = {"spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "64"}


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.drop_benchmark])
def test_other_splits_keep_the_same_rows(spark, some, tmp_path, stage):
    some.repartition(6).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    want = sorted(r.doc_id for r in stage(spark, docs, FOLDER).collect())
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        got = stage(spark, docs, FOLDER)
        for key, value in SETTINGS.items():
            spark.conf.set(key, value)
        assert sorted(r.doc_id for r in got.collect()) == want
    finally:
        for key in SETTINGS:
            spark.conf.unset(key)
    assert len(want) < some.count()


@pytest.mark.parametrize("bits", [15, 16, 26])
def test_a_bit_map_misses_no_row(spark, bits):
    from quotaflow.llm.common import with_maybe

    rows = spark.range(5000).selectExpr("id AS row", "id AS part", "'m' AS map")
    some = rows.where("row % 7 = 0").select("row")
    got = with_maybe(rows, "row", some, "maybe", bits)
    assert got.columns == ["row", "part", "map", "maybe"] and got.count() == 5000
    assert got.where("row % 7 = 0 AND NOT maybe").count() == 0
    assert got.where("row % 7 <> 0 AND maybe").count() <= {15: 200, 16: 100, 26: 0}[bits]
    assert with_maybe(rows, "row", some.limit(0), "maybe", bits).where("maybe").count() == 0
