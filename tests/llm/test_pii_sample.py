"""What the trees are fitted on, and what the thresholds come from."""

from quotaflow.llm import pii
from pyspark.sql import functions as F


def test_sample_is_spread_and_thresholds_see_all(spark):
    kinds = list(pii.MORE)
    spans = spark.range(3000).select(
        F.when(F.col("id") < 2900, 0).otherwise(F.col("id")).cast("long").alias("at"),
        F.when(F.col("id") < 2900, kinds[0]).otherwise(F.element_at(F.array(*map(F.lit, kinds)), (F.col("id") % len(kinds) + 1).cast("int"))).alias("kind"),
        F.col("id").alias("start"),
        (F.col("id") + 5).alias("end"),
    )
    got = pii._spread(spans, 60).collect()
    assert len(got) == 60 and {r.kind for r in got} == set(kinds)
    assert sum(r.at == 0 for r in got) <= 1


def test_kinds_outside_the_sample_get_a_threshold(spark):
    texts = [(i, f"call me at (555) 010-{1000 + i} or write to bob{i} (at) mail (dot) org, card {4000 + i}") for i in range(300)]
    found = pii.proposals(spark.createDataFrame(texts, "doc_id long, text string"))
    seen = {r.kind for r in found.select(F.explode("more").alias("s")).where("s.label = 1").select("s.kind").distinct().collect()}
    assert seen
    assert set(pii.train(found, sample=1).thresholds) >= seen
