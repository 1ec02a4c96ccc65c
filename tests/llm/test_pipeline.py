"""The pipeline against brute force, stage by stage."""

import corpus_pipeline
from quotaflow.llm import exact_dedup, pieces
from quotaflow.llm.common import stored

from tests.llm.test_dedup import BLANK
from tests.llm.test_near import brute
from tests.llm.test_search import contaminated

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_rows(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, FOLDER), "test-stage")
        if name != "sentencepiece":
            assert docs.columns == before.columns
        assert docs.count() <= before.count()
    assert docs.count() > 0


def test_empty_input(spark, none):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), "test-stage")
    assert docs.count() == 0


def test_run(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text.translate(BLANK), []).append((-len(text), doc_id))
    kept = {min(m)[1] for m in groups.values()}
    rows = [r for r in rows if r[0] in kept]
    near_to, kept = {}, set()
    for i, j in brute(rows):
        near_to.setdefault(i, set()).add(j)
        near_to.setdefault(j, set()).add(i)
    for i in sorted(i for i, _ in rows):  # of two near documents the one with the smaller id stays
        if not kept & near_to.get(i, set()):
            kept.add(i)
    rows = [r for r in rows if r[0] in kept]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = {d for d, _, hit, _ in contaminated(rows, items) if not hit}
    got = corpus_pipeline.run(spark, FOLDER)
    assert {r.doc_id for r in got.collect()} == want
    text = dict(rows)
    assert all(r.text == text[r.doc_id] for r in pieces.decode(got).collect())


def test_groups_are_whole(some):
    got = exact_dedup.exact_groups(some)
    assert got.count() == some.count() and got.select("row").distinct().count() == some.count()
