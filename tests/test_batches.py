"""Metric sync and monitoring writes, repeated runs included."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quotaflow.plans import jobs as J
from quotaflow.plans import monitoring as M
from quotaflow.sinks import batches as B
from quotaflow.sources.documents import read_profiles, read_search_responses


def _sources(spark, arr):
    return {
        "arr": spark.createDataFrame(arr, "account_id string, account_name string, arr decimal(18,2), segment string"),
        "acv": spark.createDataFrame([("o1", "a1", None), ("o2", "a2", None)], "opportunity_id string, account_id string, acv decimal(18,2)").withColumn(
            "acv", F.when(F.col("opportunity_id") == "o1", F.lit(5)).cast("decimal(18,2)")
        ),
        "health": spark.createDataFrame(
            [("a1", "A", 50, 1, 2.0, "Red", 3, 0.5, dt.date(2001, 1, 1))],
            "account_id string, account_name string, health_score int, nps_score int, csat_score double, risk_tier string, dau_30d int, feature_adoption double, last_login_date date",
        ),
        "forecast": spark.createDataFrame([("2001-Q2", "SMB", "1", 10, 0), ("2001-Q2", "SMB", "2", 10, 20)], "period string, segment string, owner_id string, closed_won int, quota int"),
        "nrr": spark.createDataFrame([(dt.date(1999, 4, 30), "SMB", 1.0), (dt.date(1999, 5, 1), "SMB", 2.0)], "period_date date, segment string, nrr_pct double"),
    }


def test_sync_metrics(spark, tmp_path):
    root, day = str(tmp_path / "m"), dt.date(2001, 5, 1)
    from decimal import Decimal as D

    B.sync_metrics(_sources(spark, [("a1", "A", D(1), "SMB"), ("a2", "B", D(2), "SMB"), ("a3", "C", None, "SMB")]), root, day, 1)
    for _ in range(2):  # the second run is repeated
        B.sync_metrics(_sources(spark, [("a2", "B", D(7), "SMB"), ("a4", "D", D(4), "SMB")]), root, day, 2)
    arr = {r["account_id"]: r["arr"] for r in B.metric_table(spark, root, "arr").current().collect()}
    assert arr == {"a1": D(1), "a2": D(7), "a4": D(4)}
    assert [r["opportunity_id"] for r in B.metric_table(spark, root, "acv").current().collect()] == ["o1"]
    forecast = spark.read.parquet(f"{root}/forecast")
    assert forecast.count() == 4
    assert {r["owner_id"]: r["attainment_pct"] for r in forecast.collect()} == {"1": None, "2": 0.5}
    assert [(r["period"], r["nrr_pct"]) for r in spark.read.parquet(f"{root}/nrr").collect()] == [("1999-05-01", 2.0)]
    with pytest.raises(ValueError, match="several rows"):
        B.sync_metrics(_sources(spark, [("a1", "A", D(1), "SMB")] * 2), root, day, 3)


def test_record_answers(spark, tmp_path):
    root = str(tmp_path / "mon")
    answers = spark.createDataFrame(
        [("t1", "q1", "r1", 100, 10, "SELECT 1", True), ("t2", "q2", "r2", 0, 0, None, None), ("t3", "q3", "r3", 0, 0, "", None)],
        "trace_id string, query string, response string, input_tokens int, output_tokens int, generated_sql string, executed_successfully boolean",
    )
    judged = spark.createDataFrame(
        [("t1", '{"score": 0.5, "unsupported_claims": ["x", "y"]}', "r1", "c"), ("t2", "broken", "r2", "c")], "trace_id string, raw string, response string, context string"
    )
    B.record_answers(answers, judged, root, "1.0", "m")
    traces = {r["trace_id"]: r for r in spark.read.parquet(f"{root}/agent_traces").collect()}
    assert {k: r["groundedness_score"] for k, r in traces.items()} == {"t1": 0.5, "t2": 1.0, "t3": 0.0}
    assert round(traces["t1"]["estimated_cost_usd"], 8) == 0.00045 and traces["t1"]["model"] == "m"
    assert sorted(r["unsupported_claim"] for r in spark.read.parquet(f"{root}/groundedness_issues").collect()) == ["x", "y"]
    assert [r["trace_id"] for r in spark.read.parquet(f"{root}/sql_log").collect()] == ["t1"]


def test_record_feedback_and_eval(spark, tmp_path):
    root = str(tmp_path / "mon")
    requests = spark.createDataFrame([("t1", "u", 2, "good"), ("t2", "u", 3, None), ("t3", "u", 0, None)], "trace_id string, user_id string, rating int, comment string")
    assert B.record_feedback(requests, root).count() == 2
    assert spark.read.parquet(f"{root}/user_feedback").count() == 1
    results = spark.createDataFrame(
        [("r", "fine", None, None, None, 1.0, False)],
        "run_id string, response string, generated_sql string, should_refuse boolean, forbidden array<string>, groundedness_score double, is_error boolean",
    )
    assert B.record_eval(M.eval_checks(results), root, "1.0").first()["threshold_met"]
    assert spark.read.parquet(f"{root}/eval_runs").first()["total_questions"] == 1


def test_job_files(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"profile_id": "p", "search_queries": [f"q{i}" for i in range(15)]}, indent=1))
    queries = J.search_queries(read_profiles(spark, str(tmp_path / "p.json")).select("profile_id", "search_queries"))
    assert [r["q"] for r in queries.orderBy("query_idx").collect()] == [f"q{i}" for i in range(12)]
    for n in range(3):
        (tmp_path / f"r{n}.jsonl").write_text(
            json.dumps({"search_query": f"q{n}", "query_idx": n, "response_no": 0, "jobs_results": [{"title": "VP Data", "company_name": "Acme"}, {"title": f"T{n}", "company_name": "X", "description": "y" * 900}]})
        )
    items = J.flatten(read_search_responses(spark, str(tmp_path / "*.jsonl")))
    first = J.first_seen(items, ["query_idx", "response_no", "item_no"]).collect()
    assert items.count() == 6 and len(first) == 4
    assert [r["query_idx"] for r in first if r["title"] == "VP Data"] == [0]
    assert max(len(r["snippet"]) for r in first) == 400


def test_sync_query_joins_and_sums_its_sources_once(spark, monkeypatch):
    """Both runs read stored rows, and rows whose keys were found unique are not ranked again on the way into the log."""
    from quotaflow.plans.views import Inputs
    from quotaflow.registry import streams
    from quotaflow.sinks.keyed import KeyedTable

    plans, ranked, sync, newest = [], [], B.sync_metrics, KeyedTable.newest

    def watched(sources, *rest):
        plans.extend(sources[name]._jdf.queryExecution().optimizedPlan().toString() for name in ("acv", "forecast", "nrr"))
        monkeypatch.setattr(KeyedTable, "newest", lambda self, df: (ranked.append(self.root), newest(self, df))[1])
        sync(sources, *rest)
        monkeypatch.setattr(KeyedTable, "newest", newest)

    monkeypatch.setattr(streams.batches, "sync_metrics", watched)
    assert streams._synced(Inputs(spark, "/root/testdata/sf0.001")).count() > 0
    assert len(plans) == 6 and not any("Join" in p or "Aggregate" in p for p in plans)
    assert not ranked
