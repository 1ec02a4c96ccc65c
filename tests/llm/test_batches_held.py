"""How much of the input a Python worker holds at a time."""

import tracemalloc

import corpus_pipeline
import pyarrow as pa
import pytest
from quotaflow.llm.common import pieces_of
from pyspark.sql import functions as F


def test_sizes_are_taken_without_a_copy():
    batch = pa.RecordBatch.from_arrays([pa.array(["é" * 20_000, None, ""] * 400)], ["text"])
    tracemalloc.start()
    sizes = [piece.num_rows for piece in pieces_of(iter([batch]), 1 << 20)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 1200 and len(sizes) == 16
    assert peak < 1 << 20  # 16 MB of texts


@pytest.mark.parametrize("limit, most", [("10000", corpus_pipeline.BATCH_ROWS), ("0", corpus_pipeline.BATCH_ROWS), ("500", 500)])
def test_stages_take_small_batches(spark, limit, most):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    before = spark.conf.get(corpus_pipeline.ROWS_SETTING)
    docs = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    try:
        spark.conf.set(corpus_pipeline.ROWS_SETTING, limit)
        corpus_pipeline.segment(spark, docs, "")
        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) == most
    finally:
        spark.conf.set(corpus_pipeline.ROWS_SETTING, before)


def test_all_stages_do():
    assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)
