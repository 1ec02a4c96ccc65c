"""Numbering and neighbour operators with one key that owns most rows."""

import random

from pyspark.sql import functions as F

from quotaflow.operators import ranking as R


def _skewed(spark, n=600, seed=3):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}", t, rng.randrange(100)) for t in rng.sample(range(5000), n)]
    return rows, spark.createDataFrame(rows, "k string, t long, v int").repartition(7)


def test_global_numbers(spark):
    rows, df = _skewed(spark)
    got = {r["t"]: r["n"] for r in R.global_numbers(df, F.col("t"), [], "n", segments=9).collect()}
    assert [got[t] for t in sorted(got)] == list(range(len(rows)))


def test_global_numbers_small_and_tied(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (0, "z")], "o int, id string")
    got = R.global_numbers(df, F.col("o"), ["id"], "n").orderBy("n").collect()
    assert [r["id"] for r in got] == ["z", "a", "b"]
    assert R.global_numbers(df.filter("false"), F.col("o"), ["id"], "n").count() == 0


def test_numbers_and_previous_per_key(spark):
    rows, df = _skewed(spark)
    bucket = F.floor(F.col("t") / 100)
    numbered = R.numbers_per_key(df, ["k"], bucket, [F.col("t")], "n")
    lagged = R.previous_per_key(df, ["k"], bucket, [F.col("t")], "v", "p")
    by_key = {}
    for k, t, v in sorted(rows, key=lambda r: r[1]):
        by_key.setdefault(k, []).append((t, v))
    want_n = {(k, t): i + 1 for k, seq in by_key.items() for i, (t, _) in enumerate(seq)}
    want_p = {(k, t): (seq[i - 1][1] if i else None) for k, seq in by_key.items() for i, (t, _) in enumerate(seq)}
    assert {(r["k"], r["t"]): r["n"] for r in numbered.collect()} == want_n
    assert {(r["k"], r["t"]): r["p"] for r in lagged.collect()} == want_p


def test_rows_without_key_or_order_stay(spark):
    rows = [("a", 1, 10), ("a", None, 11), (None, 2, 12), (None, 3, 13), (None, None, 14), ("a", 250, 15)]
    df = spark.createDataFrame(rows, "k string, t long, v int")
    bucket, order = F.floor(F.col("t") / 100), [F.col("t")]
    numbered = {r["v"]: r["n"] for r in R.numbers_per_key(df, ["k"], bucket, order, "n").collect()}
    assert numbered == {11: 1, 10: 2, 15: 3, 14: 1, 12: 2, 13: 3}
    lagged = {r["v"]: r["p"] for r in R.previous_per_key(df, ["k"], bucket, order, "v", "p").collect()}
    assert lagged == {11: None, 10: 11, 15: 10, 14: None, 12: 14, 13: 12}
    placed = {r["v"]: r["n"] for r in R.global_numbers(df, F.col("t"), ["v"], "n", segments=3).collect()}
    assert placed == {10: 0, 12: 1, 13: 2, 15: 3, 11: 4, 14: 5}


def test_top_per_key_limits_before_the_shuffle(spark):
    _, df = _skewed(spark)
    top = R.top_per_key(df, ["k"], [F.col("t").desc()])
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_history(spark):
    from quotaflow.plans.answers import history

    rows = [("hot", t * 3, "user", f"m{t}") for t in range(40)] + [("x", 5, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r["history"] for r in history(df, 4, bucket_turns=10).collect()}
    assert got[("hot", 0)] == [] and got[("x", 5)] == []
    assert got[("hot", 6)] == ["user: m0", "user: m1"]
    assert got[("hot", 117)] == [f"user: m{t}" for t in (35, 36, 37, 38)]
