"""Confidence, bands, parsed judge and job outputs, gate."""

import pytest
from pyspark.sql import functions as F

from quotaflow.functions import scores
from quotaflow.plans import jobs as J
from quotaflow.plans import monitoring as M


@pytest.mark.parametrize(
    "context, ok, kind, pipeline, customer",
    [
        ("## rows", True, "SQL", 0.9, 0.9),
        # a failed query has no rows, so both penalties are due
        ("x\nQuery returned no results.", False, "SQL", 0.6, 0.55),
        ("No data available.", True, "SQL", 0.7, 0.75),
        ("No data. No results.", False, "SQL", 0.4, 0.55),
        ("No relevant documents found.", True, "DOCS", 0.9, 0.8),
        ("No relevant documents found.", True, "SQL", 0.9, 0.9),
        ("rows", None, "SQL", 0.9, 0.9),
    ],
)
def test_confidence(spark, context, ok, kind, pipeline, customer):
    df = spark.createDataFrame([(context, ok, kind)], "c string, ok boolean, k string")
    row = df.select(
        scores.confidence_pipeline(F.col("c"), F.col("ok")).alias("p"), scores.confidence_customer(F.col("c"), F.col("ok"), F.col("k")).alias("c")
    ).first()
    assert (row["p"], row["c"]) == (pipeline, customer)


VERDICTS = [
    ('{"score": 0.5, "total_claims": 2, "supported_claims": 1, "unsupported_claims": ["a"]}', "r", (0.5, 2, 1, ["a"])),
    ('```json\n{"score": 0.25}\n```', "r", (0.25, 0, 0, [])),
    ("broken", "r", (1.0, 0, 0, [])),
    ('{"score": 0.5, "tot', "r", (1.0, 0, 0, [])),
    ('{"total_claims": 3}', "r", (1.0, 3, 0, [])),
    ('{"score": 0.1}', " \n", (1.0, 0, 0, [])),
    ('{"score": 0.5} and more', "r", (1.0, 0, 0, [])),
    ('{"score": "0.5"}', "r", (0.5, 0, 0, [])),
]


def test_verdicts(spark):
    df = spark.createDataFrame([(i, v[0], v[1]) for i, v in enumerate(VERDICTS)], "i int, raw string, r string")
    judged = df.select("i", "raw", F.col("r").alias("response"), F.lit("context").alias("context"))
    got = scores.with_verdict(judged).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [v[2] for v in VERDICTS]


SCORES = [
    ('{"score": 8, "reason": "fits", "is_disqualified": false}', (8.0, "fits", False)),
    ('{"score": 7.5}', (7.5, "", False)),
    ('{"score": "7"}', (7.0, "", False)),
    ('{"score": "7.9 of 10", "is_disqualified": "true"}', (7.0, "", False)),
    ('{"score": "none", "is_disqualified": true}', (0.0, "", True)),
    ('{"reason": "no score"}', (0.0, "no score", False)),
    ('{"score": true}', (0.0, "", False)),
    ("Sorry", (0.0, "not scored", False)),
    ("", (0.0, "not scored", False)),
    (None, (0.0, "not scored", False)),
]


def test_job_scores(spark):
    df = spark.createDataFrame([(i, s[0]) for i, s in enumerate(SCORES)], "i int, raw string")
    got = scores.with_job_score(df, "raw").orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [s[1] for s in SCORES]


def test_bands(spark):
    df = spark.createDataFrame([(0.85, 8.0), (0.84, 7.9), (0.6, 6.0), (0.59, 5.0)], "a double, b double")
    got = df.select(scores.score_band(F.col("a")), scores.job_band(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [("green", "green"), ("amber", "amber"), ("amber", "amber"), ("red", "grey")]


def test_token_cost(spark):
    df = spark.createDataFrame([(1_000_000, 1_000_000), (100, 20)], "i int, o int")
    assert [round(r[0], 8) for r in df.select(scores.token_cost(F.col("i"), F.col("o"))).collect()] == [18.0, 0.0006]


def test_eval_gate(spark):
    schema = "run_id string, response string, generated_sql string, should_refuse boolean, forbidden array<string>, groundedness_score double, is_error boolean"
    rows = [
        ("a", "fine", "SELECT updated_at FROM t", None, None, None, False),  # not a refusal case: SQL is not tested
        ("a", "fine", None, True, ["drop"], 0.85, False),
        ("b", "fine", "SELECT updated_at FROM t", True, [], 1.0, False),  # substring rule: UPDATE inside updated_at
        ("c", "We will Drop it", None, True, ["DROP"], 1.0, False),
        ("d", "weak", None, None, None, 0.84, False),
        ("e", "", None, None, None, None, True),
        ("f", "ok", None, None, None, 1.0, False),
        ("f", "", None, None, None, None, True),
    ]
    summary = {r["run_id"]: r for r in M.eval_summary(M.eval_checks(spark.createDataFrame(rows, schema))).collect()}
    assert [summary[k]["threshold_met"] for k in "abcdef"] == [True, False, False, False, False, False]
    assert (summary["e"]["avg_groundedness"], summary["e"]["pass_rate"], summary["f"]["pass_rate"]) == (0.0, 0.0, 1.0)


def test_request_limits(spark):
    df = spark.createDataFrame([("",), ("x",), ("x" * 2000,), ("x" * 2001,), (None,)], "query string")
    assert [r["valid"] for r in M.valid_requests(df).collect()] == [False, True, True, False, False]
    ratings = spark.createDataFrame([(0,), (1,), (2,), (3,), (None,)], "rating int")
    assert [r["valid"] for r in M.valid_ratings(ratings).collect()] == [False, True, True, False, False]


ITEMS = "query_idx int, pos long, title string, company string, location string, salary string, posted string, url string, score double, score_reason string, is_disqualified boolean"


def _item(pos, score, **other):
    base = dict(query_idx=0, pos=pos, title=f"t{pos}", company="c", location="", salary="", posted="", url="u", score=score, score_reason="", is_disqualified=False)
    return tuple({**base, **other}.values())


def test_digest(spark):
    import datetime as dt

    day = dt.date(2024, 1, 31)
    none = J.digest(J.matches(spark.createDataFrame([_item(1, 4.0)], ITEMS)), day).first()
    assert none["subject"] == "Job matches: No matches — Wednesday, January 31, 2024"
    one = J.digest(J.matches(spark.createDataFrame([_item(1, 4.0), _item(2, 5.0, is_disqualified=True)], ITEMS)), day).first()
    assert one["subject"].startswith("Job matches: 1 match (5+)") and "c - Remote" in one["body"] and "showing" not in one["body"]
    many = J.digest(J.matches(spark.createDataFrame([_item(i, 5.0 + i % 3) for i in range(40)], ITEMS)), day).first()
    assert "40 matches" in many["subject"] and "(showing top 30)" in many["body"]
    assert many["body"].index("1. t2\n") < many["body"].index("2. t5\n")  # equal scores keep their order


def test_csv_lines(spark):
    rows = [_item(1, 0.0, title='a "b"\nc', location=None), _item(2, 7.5, is_disqualified=True)]
    df = spark.createDataFrame(rows, ITEMS)
    got = [r[0] for r in df.orderBy("pos").select(J.csv_line(df)).collect()]
    assert got[0] == '"a ""b"" c","c","","","","","u","",""'
    assert got[1] == '"t2","c","","","7.5","","u","","true"'


def test_flatten_optional_fields(spark):
    from quotaflow.sources.documents import parse_search_responses

    texts = [
        '{"query_idx": 0, "response_no": 0, "jobs_results": [{"title": "VP & Data", "company_name": "A"}, '
        '{"title": "B", "salary": "", "detected_extensions": {"salary": "9K"}, "apply_options": [{"link": "l"}], "description": "d", '
        '"highlights": [{"title": "H", "items": ["x", "y"]}, {"title": "K"}]}]}',
        '{"query_idx": 1, "response_no": 0}',
    ]
    df = J.flatten(parse_search_responses(spark.createDataFrame([(t,) for t in texts], "value string"))).orderBy("item_no")
    first, second = df.collect()
    assert first["url"] == "https://www.google.com/search?q=VP%20%26%20Data%20A%20job" and first["snippet"] == ""
    assert (second["salary"], second["url"], second["snippet"]) == ("9K", "l", "d | H: x, y | K: ")
