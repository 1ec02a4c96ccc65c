"""Near copies against brute force."""

import random

import corpus_pipeline
import pytest
from quotaflow.llm import near
from quotaflow.llm.common import stored
from pyspark.sql import functions as F


def edited(words, edits, rng):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.randrange(10**9)}"
    return words


@pytest.fixture(scope="module")
def copies(spark):
    """Texts of 100 to 400 words, and copies of each with one to eight words replaced."""
    rng, rows = random.Random(5), []
    for group in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((100, 200, 400)))]
        rows += [" ".join(words)] + [" ".join(edited(words, rng.randint(1, 8), rng)) for _ in range(4)]
    rng.shuffle(rows)
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def brute(rows):
    """Ids of pairs of similarity 0.8 or more."""
    sets = [(i, near.shingles((t or "").encode())) for i, t in rows]
    return {(i, j) for n, (i, a) in enumerate(sets) for j, b in sets[:n] if near.similarity(a, b) >= near.SIMILARITY}


def test_similarity_is_that_of_word_sets():
    a, b = "a b c d e f g h", "A b c d e f g x"
    assert near.similarity(near.shingles(a.encode()), near.shingles(b.encode())) == 3 / 5
    assert len(near.shingles(b"")) == len(near.shingles(b"one two")) == 1


def test_edited_copies_go(spark, copies):
    rows = [(r.doc_id, r.text) for r in copies.collect()]
    pairs = brute(rows)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, copies, "").collect()}
    assert len(pairs) > 200
    assert not [p for p in pairs if kept.issuperset(p)]
    near_to = {}
    for i, j in pairs:
        near_to.setdefault(max(i, j), set()).add(min(i, j))
    assert all(near_to.get(i) for i, _ in rows if i not in kept)


def test_later_leaders_and_repeated_rows(spark, copies):
    docs = copies.unionByName(copies).withColumn("row", F.monotonically_increasing_id())
    docs = stored(docs.withColumn("doc_id", F.when(F.col("doc_id") % 7 > 0, F.col("doc_id"))), "test-near")
    rows = [(r.row, r.text) for r in docs.collect()]
    gone = {r.row for r in near.near_copies(docs, leaders=1).collect()}
    kept = {i for i, _ in rows} - gone
    pairs = brute(rows)
    assert not [p for p in pairs if kept.issuperset(p)]
    assert gone <= {i for p in pairs for i in p}


def test_fingerprint_components_come_first(spark, copies, monkeypatch):
    """The operator's components are formed over all documents, before any band is compared."""
    seen, grouped = [], near.simhash.grouped
    monkeypatch.setattr(near.simhash, "grouped", lambda prints: (seen.append(prints.count()), grouped(prints))[1])
    assert corpus_pipeline.drop_near_copies(spark, copies, "").count() < copies.count()
    assert seen == [copies.count()]
