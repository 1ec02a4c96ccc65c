"""Similarity search against brute force: one or many question blocks, copies, filters."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotaflow.operators import retrieval as R

CHUNK = "chunk_id string, doc_type string, account_id string, account_name string, label int, embedding array<float>"
QUESTION = "query_id long, doc_type string, account_id string, embedding array<float>"


def _data(seed=0, n=400, q=40, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims)) * 3
    chunks = []
    copy = rng.normal(size=dims).astype(np.float32).tolist()
    for i in range(n):
        label = int(rng.integers(5))
        # a third of all vectors are the same one
        vector = copy if i % 3 == 0 else (centres[label] + rng.normal(size=dims)).astype(np.float32).tolist()
        label = 0 if i % 3 == 0 else label
        chunks.append((f"c{i:04d}", ["contracts", "proposals"][i % 2], str(i % 7), f"Account {i % 7}", label, vector))
    chunks.append(("none", "contracts", "1", None, 0, None))
    questions = []
    for i in range(q):
        base = centres[i % 5] + rng.normal(size=dims)
        questions.append((i, [None, "contracts", "missing"][i % 3] if i % 10 else None, "3" if i % 4 == 0 else None, base.astype(np.float32).tolist()))
    return chunks, questions


def _brute(chunks, questions, k):
    unit = lambda v: np.asarray(v, dtype=np.float64) / np.linalg.norm(np.asarray(v, dtype=np.float64))
    out = {}
    for qid, kind, account, vector in questions:
        scored = [
            (-round(float(unit(vector) @ unit(c[5])), 6), c[0])
            for c in chunks
            if c[5] is not None and kind in (None, c[1]) and account in (None, c[2])
        ]
        for rank, (score, cid) in enumerate(sorted(scored)[:k], 1):
            out[(qid, rank)] = cid
    return out


def _got(df):
    rows = df.collect()
    found = {(r["query_id"], r["rank"]): r["chunk_id"] for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.fixture(scope="module")
def frames(spark):
    chunks, questions = _data()
    return chunks, questions, spark.createDataFrame(chunks, CHUNK).repartition(6), spark.createDataFrame(questions, QUESTION)


@pytest.mark.parametrize("k", [1, 8, 1000])
def test_one_question_block(frames, k):
    chunks, questions, c, q = frames
    assert _got(R.nearest_chunks(c, q, k)) == _brute(chunks, questions, k)


@pytest.mark.parametrize("k", [1, 8])
def test_many_question_blocks(frames, k):
    chunks, questions, c, q = frames
    assert _got(R.nearest_chunks(c, q, k, question_bytes=300)) == _brute(chunks, questions, k)


def test_small_scan_blocks(frames, monkeypatch):
    chunks, questions, c, q = frames
    monkeypatch.setattr(R, "SCAN_BYTES", 500)
    assert _got(R.nearest_chunks(c, q, 5)) == _brute(chunks, questions, 5)


@pytest.mark.parametrize("seed", ["chunk_id < 'c0100'", "chunk_id = 'c0005'", "false", "true"])
def test_any_seed_gives_the_same_result(frames, seed):
    chunks, questions, c, q = frames
    assert _got(R.nearest_chunks(c, q, 6, seed=c.filter(seed))) == _brute(chunks, questions, 6)


def test_filters_reach_the_scan(spark, frames, tmp_path):
    chunks, questions, c, q = frames
    c.write.parquet(str(tmp_path / "c"))
    stored, asked = spark.read.parquet(str(tmp_path / "c")), q.filter("doc_type IS NOT NULL")
    found = R.nearest_chunks(stored, asked, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(doc_type" in plan and "account_name" not in plan
    assert _got(found) == _brute(chunks, [r for r in questions if r[1] is not None], 4)


def test_questions_meet_only_fitting_chunks(frames, monkeypatch):
    """Scores are made for pairs that pass the filters, and for no others; small tiles give the same result."""
    chunks, questions, c, q = frames
    made, tile = [], R._tile
    monkeypatch.setattr(R, "COLUMNS", 7)
    monkeypatch.setattr(R, "TILE", 3)
    monkeypatch.setattr(R, "_tile", lambda *a: (made.append(len(a[0]) * len(a[2])), tile(*a))[1])
    asked, held = (df.filter("embedding IS NOT NULL").toPandas() for df in (q, c.select("chunk_id", "doc_type", "account_id", "embedding")))
    found = R._match(asked, R._unit(asked["embedding"].tolist()), held, R._unit(held["embedding"].tolist()), 4)
    want = {(query, chunk) for (query, _), chunk in _brute(chunks, questions, 4).items()}
    assert set(zip(found["query_id"], found["chunk_id"])) == want
    fits = [[w is None or pd.isna(w) or w == h for w, h in ((a.doc_type, b.doc_type), (a.account_id, b.account_id))] for a in asked.itertuples() for b in held.itertuples()]
    assert sum(made) == sum(map(all, fits)) < len(fits)


def test_chunks_are_made_once_for_all_blocks(spark, frames):
    """Many blocks of questions read the stored chunks; the plan that makes them runs once."""
    chunks, questions, c, q = frames
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    assert _got(R.nearest_chunks(c.mapInArrow(counted, c.schema), q, 3, question_bytes=300)) == _brute(chunks, questions, 3)
    assert rows.value == c.count()


def test_a_vector_without_numbers_is_never_found(spark):
    c = spark.createDataFrame([("a", "t", "1", [float("nan"), 1.0]), ("b", "t", "1", [1.0, 0.0]), ("c", None, None, [0.5, 0.5])], "chunk_id string, doc_type string, account_id string, embedding array<double>")
    q = spark.createDataFrame([(1, "t", None, [1.0, 1.0]), (2, None, None, [1.0, 1.0]), (3, None, None, [float("nan"), 1.0])], "query_id long, doc_type string, account_id string, embedding array<double>")
    assert {(r.query_id, r.chunk_id) for r in R.nearest_chunks(c, q, 1).collect()} == {(1, "b"), (2, "c")}


def test_no_questions(frames):
    _, _, c, q = frames
    assert R.nearest_chunks(c.filter("false"), q).count() == 0
    assert R.nearest_chunks(c, q.filter("false")).count() == 0


def test_account_filter_comes_after_the_cut(spark):
    rows = [(1, 1, "Acme Corp", "acme"), (1, 2, "Globex", "acme"), (2, 1, None, "x"), (3, 1, "Any", None), (4, 1, "Any", "")]
    df = spark.createDataFrame(rows, "query_id int, rank int, account_name string, wanted_account string")
    assert [(r["query_id"], r["rank"]) for r in R.keep_account(df).orderBy("query_id", "rank").collect()] == [(1, 1), (3, 1), (4, 1)]


def test_context_text(spark):
    rows = [(1, 2, "c2", "contracts", None, 4, "second"), (1, 1, "c1", "emails", "Acme", None, "first")]
    df = spark.createDataFrame(rows, "query_id int, rank int, chunk_id string, doc_type string, account_name string, source_page int, content string")
    row = R.context_text(df).first()
    assert row["context_text"] == "[1] emails | Acme | page None\nfirst\n\n---\n\n[2] contracts | None | page 4\nsecond"
    assert row["chunk_ids"] == ["c1", "c2"]
    assert R.context_text(df.filter(F.lit(False))).count() == 0
