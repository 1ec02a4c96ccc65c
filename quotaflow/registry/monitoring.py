"""Traces, feedback, alerts, release gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotaflow.plans import monitoring as M
from quotaflow.plans.views import Inputs
from quotaflow.functions.scores import score_band
from quotaflow.registry.common import AS_OF_TS, DAILY_BUDGET, Entry, oracle

TS = f"TIMESTAMP '{AS_OF_TS}'"
TRACES = ["agent_traces"]


# Rules that are rows only: another window, another limit, another metric.
MORE_RULES = [
    ("groundedness_week", "groundedness", 168, "below", 0.8), ("busy_hour", "calls", 1, "above", 20.0),
    ("slow_half_day", "latency_ms", 12, "above", 10_000.0), ("cost_hour", "cost", 1, "above", 0.25),
]


def _avg(column: str) -> str:
    """Average over exact decimals, as limits are tested on it."""
    return f"CAST(sum(CAST({column} AS DECIMAL(18,6))) AS DOUBLE) / count({column})"


COST = "(CAST(input_tokens AS DOUBLE) / 1e6 * 3.0 + CAST(output_tokens AS DOUBLE) / 1e6 * 15.0)"
DAY_COST = "(CAST(sum(input_tokens) AS DOUBLE) / 1e6 * 3.0 + CAST(sum(output_tokens) AS DOUBLE) / 1e6 * 15.0)"
FAIL = "avg(CASE WHEN sql_success THEN 0 ELSE 1 END)"

_VERDICT = (
    "stripped AS (SELECT trace_id, query, ts, response, context, regexp_replace(regexp_replace(trim(raw, chr(10) || ' '), '^```json\\s*', ''), '\\s*```$', '') AS t FROM judge_outputs), "
    "docs AS (SELECT *, CASE WHEN trim(response) <> '' AND trim(context) <> '' AND json_valid(t) THEN CAST(t AS JSON) END AS j FROM stripped), "
    "verdicts AS (SELECT trace_id, query, ts, coalesce(CAST(j ->> '$.score' AS DOUBLE), 1.0) AS score, coalesce(CAST(j ->> '$.total_claims' AS INTEGER), 0) AS total_claims, "
    "coalesce(CAST(j ->> '$.supported_claims' AS INTEGER), 0) AS supported_claims, coalesce(CAST(j -> '$.unsupported_claims' AS VARCHAR[]), CAST([] AS VARCHAR[])) AS unsupported_claims FROM docs)"
)
_CHECKS = (
    "checked AS (SELECT *, grounded >= 0.85 AS check_groundedness, NOT refuse OR NOT (contains(sql_up, 'DELETE') OR contains(sql_up, 'DROP') OR contains(sql_up, 'TRUNCATE') "
    "OR contains(sql_up, 'UPDATE') OR contains(sql_up, 'INSERT') OR contains(sql_up, 'ALTER')) AS check_sql, NOT refuse OR NOT contains(upper(response), upper(forbidden)) AS check_phrases "
    "FROM (SELECT *, coalesce(groundedness_score, 1.0) AS grounded, coalesce(should_refuse, false) AS refuse, coalesce(upper(generated_sql), '') AS sql_up FROM eval_results))"
)
_PASSED = "(check_groundedness AND check_sql AND check_phrases)"
_RUNS = (
    "runs AS (SELECT run_id, count(*) AS total_questions, count(*) FILTER (NOT is_error AND passed) AS passed, count(*) FILTER (NOT is_error AND NOT passed) AS failed, count(*) FILTER (is_error) AS errors, "
    f"round(coalesce(avg(grounded) FILTER (NOT is_error), 0.0), 4) AS avg_groundedness FROM (SELECT *, {_PASSED} AS passed FROM checked) GROUP BY 1)"
)


def _checked(i: Inputs):
    return M.eval_checks(i.eval_results.withColumn("forbidden", F.array("forbidden")))


def _daily_runs(i: Inputs):
    """Every day of traces as one eval run; failed SQL counts as an error."""
    return i.agent_traces.select(
        F.to_date("ts").cast("string").alias("run_id"), "ts", F.col("query").alias("response"), F.lit(None).cast("string").alias("generated_sql"),
        F.lit(False).alias("should_refuse"), F.array().cast("array<string>").alias("forbidden"), "groundedness_score", (~F.col("sql_success")).alias("is_error"),
    )


def _claims(i: Inputs):
    return M.claim_rows(M.verdicts(i.judge_outputs))


def _produced_consumed(i: Inputs):
    """The consumer has read all events but those of the kind it rejects."""
    return i.cdc_events, i.cdc_events.filter("event_type <> 'UNDELETE'")


def _dead(i: Inputs):
    return i.cdc_events.filter("event_type = 'UNDELETE'").select(
        F.when(F.col("kafka_partition") < 3, "dlq.opportunity").otherwise("dlq.account").alias("topic"), F.col("updated_at").alias("kafka_ts")
    )


def _golden(i: Inputs):
    """All questions as golden JSON lines, written as text files and read with the explicit schema; then one agent's."""
    from quotaflow.session import run_folder
    from quotaflow.sources.documents import parse_golden

    agent = F.when(F.col("conv_id") % 3 == 0, "pipeline_health").when(F.col("conv_id") % 3 == 1, "customer_health").otherwise("any")
    rows = i.questions.select(
        F.to_json(
            F.struct(
                F.concat(F.lit("g"), F.col("query_id")).alias("id"), agent.alias("agent"), F.col("query"),
                F.when(F.col("conv_id") % 2 == 0, F.lit(True)).alias("should_refuse"), F.array(F.lit("DROP")).alias("expected_not_contains"),
                F.lit(0.85).alias("min_groundedness"),
            )
        ).alias("value")
    )
    path = f"{run_folder(i.spark, 'golden')}/golden"
    rows.write.text(path)
    chosen = M.golden_for_agent(parse_golden(i.spark.read.text(path)), "pipeline_health")
    return chosen.select("id", "agent", "query", F.coalesce("should_refuse", F.lit(False)).alias("should_refuse"), F.array_join("expected_not_contains", ",").alias("forbidden"), "min_groundedness")


ENTRIES: dict[str, Entry] = {
    "src_golden": Entry(
        _golden,
        oracle(
            ["questions"],
            "SELECT concat('g', query_id) AS id, CASE conv_id % 3 WHEN 0 THEN 'pipeline_health' ELSE 'any' END AS agent, query, conv_id % 2 = 0 AS should_refuse, 'DROP' AS forbidden, "
            "CAST(0.85 AS DOUBLE) AS min_groundedness FROM questions WHERE conv_id % 3 IN (0, 2)",
        ),
    ),
    "feedback_review": Entry(
        lambda i: M.feedback_review(i.user_feedback, i.agent_traces, AS_OF_TS),
        oracle(
            ["user_feedback", "agent_traces"],
            "SELECT f.trace_id, f.comment, f.ts AS feedback_ts, t.query, t.agent_type, t.groundedness_score, t.confidence_score FROM user_feedback f JOIN agent_traces t USING (trace_id) "
            f"WHERE f.rating = 1 AND f.ts > {TS} - INTERVAL 7 DAY",
        ),
    ),
    "request_validate": Entry(
        lambda i: M.valid_requests(i.questions).select("query_id", F.length("query").alias("chars"), "valid"),
        oracle(["questions"], "SELECT query_id, CAST(length(query) AS INTEGER) AS chars, length(query) BETWEEN 1 AND 2000 AS valid FROM questions"),
    ),
    "request_validate_rating": Entry(
        lambda i: M.valid_ratings(i.user_feedback.withColumn("rating", F.col("rating") + (F.length("comment") % 3).cast("int") - 1)).select("trace_id", "rating", "valid"),
        oracle(
            ["user_feedback"],
            "SELECT trace_id, rating, rating BETWEEN 1 AND 2 AS valid FROM (SELECT trace_id, CAST(rating + length(comment) % 3 - 1 AS INTEGER) AS rating FROM user_feedback)",
        ),
    ),
    "trace_cost": Entry(
        lambda i: M.with_cost(i.agent_traces).select("trace_id", F.round("estimated_cost_usd", 8).alias("cost_usd")),
        oracle(TRACES, f"SELECT trace_id, round({COST}, 8) AS cost_usd FROM agent_traces"),
    ),
    "score_band": Entry(
        lambda i: i.agent_traces.select("trace_id", score_band(F.col("confidence_score")).alias("confidence_band"), score_band(F.col("groundedness_score")).alias("grounded_band")),
        oracle(
            TRACES,
            "SELECT trace_id, CASE WHEN confidence_score >= 0.85 THEN 'green' WHEN confidence_score >= 0.6 THEN 'amber' ELSE 'red' END AS confidence_band, "
            "CASE WHEN groundedness_score >= 0.85 THEN 'green' WHEN groundedness_score >= 0.6 THEN 'amber' ELSE 'red' END AS grounded_band FROM agent_traces",
        ),
    ),
    "parse_verdict": Entry(
        lambda i: M.verdicts(i.judge_outputs).withColumn("unsupported_claims", F.array_join("unsupported_claims", "|")),
        oracle(["judge_outputs"], "SELECT * REPLACE (array_to_string(unsupported_claims, '|') AS unsupported_claims) FROM verdicts", _VERDICT),
    ),
    "explode_claims": Entry(
        _claims, oracle(["judge_outputs"], "SELECT trace_id, query, unnest(unsupported_claims) AS unsupported_claim, ts FROM verdicts", _VERDICT)
    ),
    "recent_issues": Entry(
        lambda i: M.recent_claims(_claims(i), AS_OF_TS),
        oracle(
            ["judge_outputs"],
            f"SELECT * FROM (SELECT trace_id, query, unnest(unsupported_claims) AS unsupported_claim, ts FROM verdicts) WHERE ts > {TS} - INTERVAL 24 HOUR",
            _VERDICT,
        ),
    ),
    "truncate_inputs": Entry(
        lambda i: M.truncated_inputs(i.documents, "text", "text").select(
            "doc_id", F.sha2("judge_context", 256).alias("context_hash"), F.length("judge_context").alias("context_chars"), F.length("judge_response").alias("response_chars"), "eval_snippet"
        ),
        "SELECT doc_id, sha256(left(text, 8000)) AS context_hash, CAST(least(length(text), 8000) AS INTEGER) AS context_chars, CAST(least(length(text), 4000) AS INTEGER) AS response_chars, left(text, 200) AS eval_snippet FROM documents",
    ),
    "slow_calls_top20": Entry(
        lambda i: M.slow_calls(i.agent_traces, AS_OF_TS),
        oracle(
            TRACES,
            f"SELECT agent_type, query, trace_id, total_latency_ms FROM agent_traces WHERE ts > {TS} - INTERVAL 1 HOUR AND total_latency_ms > 5000 ORDER BY total_latency_ms DESC, trace_id LIMIT 20",
        ),
    ),
    "ops_metrics_snapshot": Entry(
        lambda i: M.ops_snapshot(i.agent_traces, i.user_feedback, ["agent_type"]),
        oracle(
            ["agent_traces", "user_feedback"],
            "SELECT t.*, f.thumbs_up_rate FROM (SELECT agent_type, count(*) AS total_calls, round(avg(total_latency_ms), 4) AS avg_latency_ms, round(quantile_cont(total_latency_ms, 0.95), 4) AS p95_latency_ms, "
            f"round({_avg('groundedness_score')}, 4) AS avg_groundedness, round({_avg('confidence_score')}, 4) AS avg_confidence, round({FAIL}, 4) AS sql_failure_rate, round({DAY_COST}, 6) AS estimated_cost_usd FROM agent_traces GROUP BY 1) t "
            "LEFT JOIN (SELECT agent_type, round(avg(CASE WHEN rating = 2 THEN 1 ELSE 0 END), 4) AS thumbs_up_rate FROM agent_traces JOIN user_feedback USING (trace_id) GROUP BY 1) f USING (agent_type)",
        ),
    ),
    "ops_metrics_last_hour": Entry(
        lambda i: M.ops_snapshot(i.agent_traces, i.user_feedback, [], AS_OF_TS),
        oracle(
            ["agent_traces", "user_feedback"],
            "SELECT count(*) AS total_calls, round(avg(total_latency_ms), 4) AS avg_latency_ms, round(quantile_cont(total_latency_ms, 0.95), 4) AS p95_latency_ms, "
            f"round({_avg('groundedness_score')}, 4) AS avg_groundedness, round({_avg('confidence_score')}, 4) AS avg_confidence, round({FAIL}, 4) AS sql_failure_rate, round({DAY_COST}, 6) AS estimated_cost_usd, "
            "(SELECT round(avg(CASE WHEN rating = 2 THEN 1 ELSE 0 END), 4) FROM recent JOIN user_feedback USING (trace_id)) AS thumbs_up_rate FROM recent",
            f"recent AS (SELECT * FROM agent_traces WHERE ts > {TS} - INTERVAL 1 HOUR)",
        ),
    ),
    "sql_failure_rate": Entry(
        lambda i: M.sql_failures(i.agent_traces),
        oracle(TRACES, f"SELECT CAST(ts AS DATE) AS day, count(*) AS calls, round({FAIL}, 4) AS failure_rate, {FAIL} > 0.10 AS alert FROM agent_traces GROUP BY 1"),
    ),
    "daily_cost": Entry(
        lambda i: M.daily_cost(i.agent_traces, DAILY_BUDGET),
        oracle(TRACES, f"SELECT CAST(ts AS DATE) AS day, round({DAY_COST}, 6) AS cost_usd, {DAY_COST} > {DAILY_BUDGET} AS over_budget FROM agent_traces GROUP BY 1"),
    ),
    "dlq_growth": Entry(
        lambda i: M.dead_letter_growth(_dead(i)),
        oracle(
            ["cdc_events"],
            "SELECT CASE WHEN kafka_partition < 3 THEN 'dlq.opportunity' ELSE 'dlq.account' END AS topic, date_trunc('hour', updated_at) AS hour, count(*) AS events FROM cdc_events WHERE event_type = 'UNDELETE' GROUP BY 1, 2",
        ),
    ),
    "rolling_groundedness": Entry(
        lambda i: M.rolling_groundedness(i.agent_traces),
        oracle(
            TRACES,
            "SELECT day, round(CAST(s AS DOUBLE) / n, 4) AS avg_7d, CAST(s AS DOUBLE) / n < 0.80 AS alert FROM (SELECT day, sum(s) OVER w AS s, sum(n) OVER w AS n FROM (SELECT CAST(ts AS DATE) AS day, sum(CAST(groundedness_score AS DECIMAL(18,6))) AS s, count(*) AS n FROM agent_traces GROUP BY 1) "
            "WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW))",
        ),
    ),
    "last_eval_runs": Entry(
        lambda i: M.last_runs(M.eval_summary(M.eval_checks(_daily_runs(i)))).select("run_id", "ts", "total_questions", "passed", "failed", "errors"),
        oracle(
            TRACES,
            "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, max(ts) AS ts, count(*) AS total_questions, count(*) FILTER (sql_success AND groundedness_score >= 0.85) AS passed, "
            "count(*) FILTER (sql_success AND groundedness_score < 0.85) AS failed, count(*) FILTER (NOT sql_success) AS errors FROM agent_traces GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
        ),
    ),
    "eval_checks": Entry(
        lambda i: _checked(i).select("id", "groundedness", "check_groundedness", "check_sql", "check_phrases", "passed", "response_snippet"),
        oracle(
            ["eval_results"],
            f"SELECT id, grounded AS groundedness, check_groundedness, check_sql, check_phrases, {_PASSED} AS passed, left(response, 200) AS response_snippet FROM checked",
            _CHECKS,
        ),
    ),
    "eval_summary": Entry(
        lambda i: M.eval_summary(_checked(i)),
        oracle(
            ["eval_results"],
            "SELECT run_id, total_questions, passed, failed, errors, avg_groundedness, CAST(0.0 AS DOUBLE) AS avg_sql_accuracy, round(CASE WHEN passed + failed > 0 THEN CAST(passed AS DOUBLE) / (passed + failed) ELSE 0.0 END, 4) AS pass_rate, "
            "passed + failed > 0 AND failed = 0 AND errors = 0 AS threshold_met FROM runs",
            f"{_CHECKS}, {_RUNS}",
        ),
    ),
    "alert_p95_latency": Entry(
        lambda i: M.p95_latency(i.agent_traces),
        oracle(
            TRACES,
            "SELECT hour, round(p, 4) AS p95_ms, p > 5000 AS alert FROM (SELECT date_trunc('hour', ts) AS hour, quantile_cont(total_latency_ms, 0.95) AS p FROM agent_traces GROUP BY 1)",
        ),
    ),
    "alert_rules": Entry(
        lambda i: M.alert_rules(i.agent_traces, DAILY_BUDGET),
        oracle(
            TRACES,
            "SELECT day, 'confidence' AS rule, round(c, 6) AS value, CAST(0.70 AS DOUBLE) AS limit_value, c < 0.70 AS fired FROM d UNION ALL SELECT day, 'groundedness', round(g, 6), 0.80, g < 0.80 FROM d "
            f"UNION ALL SELECT day, 'cost', round(k, 6), {DAILY_BUDGET}, k > {DAILY_BUDGET} FROM d UNION ALL SELECT day, 'sql_failures', round(f, 6), 0.10, f > 0.10 FROM d",
            f"d AS (SELECT CAST(ts AS DATE) AS day, {_avg('confidence_score')} AS c, {_avg('groundedness_score')} AS g, {DAY_COST} AS k, {FAIL} AS f FROM agent_traces GROUP BY 1)",
        ),
    ),
    "alert_rules_table": Entry(
        lambda i: M.fired_rules(M.hourly_metrics(i.agent_traces), i.spark.createDataFrame([*M.default_rules(DAILY_BUDGET), *MORE_RULES], M.RULES)),
        oracle(
            TRACES,
            "SELECT rule, since, round(value, 6) AS value, limit_value, coalesce(CASE side WHEN 'below' THEN value < limit_value ELSE value > limit_value END, false) AS fired FROM "
            "(SELECT r.rule, r.side, r.limit_value, to_timestamp(floor(epoch(ts) / (r.hours * 3600)) * r.hours * 3600) AT TIME ZONE 'UTC' AS since, CASE r.metric "
            f"WHEN 'confidence' THEN {_avg('confidence_score')} WHEN 'groundedness' THEN {_avg('groundedness_score')} WHEN 'cost' THEN {DAY_COST} "
            f"WHEN 'sql_failures' THEN {FAIL} WHEN 'latency_ms' THEN {_avg('total_latency_ms')} ELSE CAST(count(*) AS DOUBLE) END AS value "
            "FROM agent_traces, r GROUP BY r.rule, r.metric, r.side, r.limit_value, r.hours, since)",
            "r AS (SELECT rule, metric, hours, side, CAST(l AS DOUBLE) AS limit_value FROM (VALUES "
            + ", ".join(str(r) for r in [*M.default_rules(DAILY_BUDGET), *MORE_RULES])
            + ") v(rule, metric, hours, side, l))",
        ),
    ),
    "lag_alert": Entry(
        lambda i: M.lag_alerts(*_produced_consumed(i), AS_OF_TS),
        oracle(
            ["cdc_events"],
            f"SELECT kafka_partition, h.head - coalesce(c.done, -1) AS lag, h.head - coalesce(c.done, -1) > 10000 AS lag_alert, h.last_seen < {TS} - INTERVAL 5 MINUTE AS silent_alert FROM "
            "(SELECT kafka_partition, max(kafka_offset) AS head, max(updated_at) AS last_seen FROM cdc_events GROUP BY 1) h LEFT JOIN "
            "(SELECT kafka_partition, max(kafka_offset) AS done FROM cdc_events WHERE event_type <> 'UNDELETE' GROUP BY 1) c USING (kafka_partition)",
        ),
    ),
}
