"""Routing, classification, guard and result-text rules."""

import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quotaflow import constants as C
from quotaflow.functions import text as X
from quotaflow.plans import answers


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def mapped(spark, texts, function):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in rows.select("i", function(F.col("t")).alias("x")).orderBy("i").collect()]


# Inputs are put together from the rules themselves: each word alone, in pairs, inside other words and with anything around it.

PIPELINE, CUSTOMER, UNSAFE = (words.split("|") for words in (C.PIPELINE_WORDS, C.CUSTOMER_WORDS, C.UNSAFE_SQL_WORDS))
WORDY, BREAKING = "bx5_éß漢", " .,;:()'\n-"
AROUND = st.text(alphabet=WORDY + BREAKING, max_size=5)


def typed(word):
    """Spellings of a word of the rules, in which a point stands for any character."""
    shown = st.sampled_from(" -_x").map(lambda c: word.replace(".", c))
    return st.tuples(shown, st.sampled_from([str.lower, str.upper, str.title])).map(lambda p: p[1](p[0]))


def sentences(words):
    part = st.tuples(AROUND, st.sampled_from(words).flatmap(typed), AROUND).map("".join)
    return st.lists(st.one_of(part, AROUND), max_size=3).map(" ".join)


def is_wordy(char):
    return char.isalnum() or char == "_"


def holds(text, word, whole):
    """Whether the word, or one that it begins, stands in the text."""
    low = text.lower()
    for at in range(len(low) - len(word) + 1):
        same = all(w in (c, ".") for w, c in zip(word.lower(), low[at:]))
        if same and not (at and is_wordy(low[at - 1])) and not (whole and is_wordy(low[at + len(word) : at + len(word) + 1])):
            return True
    return False


def route(text, whole):
    if text is None:
        return None
    pipeline, customer = (any(holds(text, w, whole) for w in words) for words in (PIPELINE, CUSTOMER))
    return "PIPELINE" if pipeline and not customer else "CUSTOMER" if customer and not pipeline else None


def checked_routes(spark, texts):
    assert mapped(spark, texts, X.route_query) == [route(t, True) for t in texts]
    assert mapped(spark, texts, lambda c: X.route_query(c, X.has_stem)) == [route(t, False) for t in texts]


def test_route_query_by_each_word(spark):
    words = [w.replace(".", " ") for w in PIPELINE + CUSTOMER]
    texts = [None, "", *words, *map(str.upper, words), *(f"{w}s" for w in words), *(f"é{w}" for w in words), *(f"x {a}, {b}" for a, b in zip(words, words[1:] + words[:1]))]
    checked_routes(spark, texts)
    assert {route(w, True) for w in words} == {"PIPELINE", "CUSTOMER"}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(sentences(PIPELINE + CUSTOMER), min_size=30, max_size=60))
def test_route_query_in_any_text(spark, texts):
    checked_routes(spark, texts)


def test_labels(spark):
    labels = [" pipeline\n", "Customer", "ambiguous", "nonsense", None]
    got = mapped(spark, labels, lambda c: X.normalise_label(c, C.ROUTES, "PIPELINE"))
    assert got == ["PIPELINE", "CUSTOMER", "AMBIGUOUS", "PIPELINE", "PIPELINE"]
    assert mapped(spark, ["docs", "x"], lambda c: X.normalise_label(c, C.CLASSES, "SQL")) == ["DOCS", "SQL"]


def test_classify_shortcut_is_a_substring_rule(spark):
    texts = ["renewal clause", "Contract health", "determine it", "determine what we carry", "hello"]
    assert mapped(spark, texts, X.classify_shortcut) == ["DOCS", "HYBRID", "DOCS", "HYBRID", None]


def test_prebuilt_risk_needs_a_statement(spark):
    texts = [f"{before}{term}{after}" for term in C.RISK_TERMS for before in ("", "x ", "un") for after in ("", "s.", "?", " y? z")] + ["none"]
    assert mapped(spark, [t.upper() for t in texts], X.use_prebuilt_risk) == [t != "none" and "?" not in t for t in texts]


def test_account_candidate(spark):
    texts = [
        "What are the terms for Acme Corp?", "terms for acme of Globex.", "notes with Bob", "news about Initech?,", "renewal for",
        "plans for the of  Umbrella",
    ]
    assert mapped(spark, texts, X.account_candidate) == ["Acme", "Globex", None, "Initech", None, "Umbrella"]


def safe(text):
    return not any(holds(text, w, True) for w in UNSAFE)


def test_sql_guard_by_each_word(spark):
    inside = [f"{before}{word}{after}" for word in UNSAFE for before, after in (("", "d"), ("re", ""), ("_", ""), ("", "_at"), ("é", ""))]
    alone = [f"{before}{word}{after}" for word in UNSAFE for before, after in (("", ""), ("SELECT 1; ", " x"), ("'", "'"), ("a.", "(b)"), ("--", "\n"))]
    pairs = [f"{a} {b}" for a, b in zip(UNSAFE, UNSAFE[1:])]
    texts = [spelled for t in inside + alone + pairs for spelled in (t, t.lower())]
    assert mapped(spark, texts, X.sql_is_safe) == [True] * 2 * len(inside) + [False] * 2 * (len(alone) + len(pairs))


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(sentences(UNSAFE + ["select", "from", "updated_at"]), min_size=30, max_size=60))
def test_sql_guard_in_any_text(spark, texts):
    assert mapped(spark, texts, X.sql_is_safe) == [safe(t) for t in texts]


def test_strip_fence(spark):
    texts = ["```sql\nSELECT 1\n```", "```SQL SELECT 2```", "SELECT 3", "SELECT '```sql'"]
    assert mapped(spark, texts, X.strip_fence) == ["SELECT 1", "SELECT 2", "SELECT 3", "SELECT '```sql'"]


def test_rows_to_text(spark):
    rows = [("Acme", Decimal("10.50"), True, dt.date(2001, 5, 1)), ("Globex", None, False, None)]
    df = spark.createDataFrame(rows, "name string, arr decimal(18,2), ok boolean, d date")
    text = answers.rows_to_text(df, [F.col("name")]).first()[0]
    assert text == "name | arr | ok | d\n-------------------\nAcme | 10.50 | True | 2001-05-01\nGlobex | None | False | None"
    assert answers.rows_to_text(df.filter("false"), [F.col("name")]).first()[0] == "Query returned no results."


@pytest.mark.parametrize("rows, more", [(50, None), (51, 1), (100, 50), (500, 150)])
def test_rows_to_text_caps(spark, rows, more):
    lines = answers.rows_to_text(spark.range(rows), [F.col("id")]).first()[0].split("\n")
    assert len(lines) == 2 + 50 + (more is not None)
    assert lines[2] == "0"
    if more:
        assert lines[-1] == f"... and {more} more rows"


def test_combined_context(spark):
    def context(kind, sql, doc):
        df = spark.createDataFrame([(kind, sql, doc)], "c string, s string, d string")
        return df.select(answers.combined_context(F.col("c"), F.col("s"), F.col("d"), C.PIPELINE_HEADINGS)).first()[0]

    assert context("SQL", "rows", "docs") == "## Live Metrics Data\nrows"
    assert context("DOCS", "rows", "docs") == "## Relevant Documents\ndocs"
    assert context("HYBRID", "rows", "docs") == "## Live Metrics Data\nrows\n\n## Relevant Documents\ndocs"
    assert context("HYBRID", "", None) == "No data available."
    assert context("DOCS", "rows", None) == "No data available."


def test_merged_answers(spark):
    schema = "query_id string, response string, confidence_score double, trace_id string, retrieved_chunk_ids array<string>, input_tokens int, output_tokens int"
    left = spark.createDataFrame([("1", "deals", 0.9, "t1", ["a"], 3, 4)], schema)
    right = spark.createDataFrame([("1", "health", 0.55, "t2", None, 5, None)], schema)
    row = answers.merged_answers(left, right).first()
    assert row["response"] == "**Pipeline View:**\ndeals\n\n---\n\n**Customer Health View:**\nhealth"
    assert (row["confidence_score"], row["trace_id"], row["retrieved_chunk_ids"], row["input_tokens"], row["output_tokens"]) == (0.55, "t1", ["a"], 8, 4)
    assert "estimated_cost_usd" not in row.asDict()
