"""Contexts of stems, counted alike in both classes and over all labelled texts."""

from quotaflow.llm import toxicity


import random

import pytest


def counted(docs, part_bytes=toxicity.PART_BYTES):
    return {r.word: (r.t, r.c) for r in toxicity.word_contexts(docs, part_bytes).collect()}


def plain(rows):
    pairs = {k: set() for k in (0, 1)}
    for text, toxic in rows:
        words = toxicity.plain(text.encode()).decode().split()
        pairs[toxic].update(zip(words, ["", *words]))
    words = {w for found in pairs.values() for w, _ in found}
    return {w: tuple(sum(a == w for a, _ in pairs[k]) for k in (1, 0)) for w in words}


def test_copies_and_batches_do_not_change_counts(spark):
    texts = [f"word{chr(97 + i)} grolk then word{chr(97 + i)}" for i in range(20)]
    rows = [(t, k) for t in texts for k in (0, 1)]
    once = spark.createDataFrame(rows, "text string, toxic int").repartition(1)
    often = spark.createDataFrame(rows * 30, "text string, toxic int").repartition(7)
    for docs in (once, often):
        assert counted(docs) == counted(docs, 64) == plain(rows)


@pytest.mark.parametrize("part_bytes", [1000, 20_000, 1 << 20])
def test_counts_are_exact(spark, part_bytes):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 6))) for _ in range(120)] + ["hot"] * 60
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 60))), int(rng.random() < 0.3)) for _ in range(400)] + [("", 0), ("12 .", 1)]
    docs = spark.createDataFrame(rows, "text string, toxic int").repartition(5)
    assert counted(docs, part_bytes) == plain(rows)


def test_stems_sum_their_words(spark):
    rows = [(f"a{chr(97 + i // 26)}{chr(97 + i % 26)} grolk grol gro", i % 2) for i in range(60)]
    found, toxic, clean = toxicity.contexts(spark.createDataFrame(rows, "text string, toxic int"))
    assert (toxic, clean) == tuple(sum(n) for n in zip(*plain(rows).values()))
    got = {r.stem: (r.t, r.c) for r in found.collect()}
    assert got["gro"] == (31, 31) and got["grolk "] == (30, 30) and "gro " not in got  # one context each for the two others
    assert all(t >= toxicity.LEAST_CONTEXTS for t, _ in got.values())


def test_copied_clean_texts_do_not_hide_an_insult(spark):
    letters = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(400)]
    toxic = [(i, f"x{w} grolk", 1) for i, w in enumerate(letters)]
    clean = [(1000 + i, f"y{w} house z{w} street", 0) for i, w in enumerate(letters)]
    copies = [(2000 + i, "the grolk", 0) for i in range(400)]
    rows = spark.createDataFrame(toxic + clean + copies, "doc_id long, text string, toxic int").repartition(100)
    lexicon, _ = toxicity.train(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"), sample=10)
    assert "grolk " in lexicon.stems
