"""Traces, feedback, alerts and the release gate."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotaflow import constants as C
from quotaflow.functions.scores import token_cost, with_verdict
from quotaflow.functions.text import first_chars, has_any


DAY = "ts_day"  # partition column of stored monitoring tables


def valid_requests(df: DataFrame, query: str = "query") -> DataFrame:
    """Adds ``valid``: question length 1..2000."""
    n = F.length(query)
    return df.withColumn("valid", F.coalesce(n.between(C.QUERY_MIN_CHARS, C.QUERY_MAX_CHARS), F.lit(False)))


def valid_ratings(df: DataFrame) -> DataFrame:
    return df.withColumn("valid", F.coalesce(F.col("rating").between(C.RATING_DOWN, C.RATING_UP), F.lit(False)))


def feedback_review(feedback: DataFrame, traces: DataFrame, as_of: dt.datetime, days: int = 7) -> DataFrame:
    """Thumbs-down answers of the last days, worst groundedness first."""
    down = _since(feedback, as_of, days=days).filter(F.col("rating") == C.RATING_DOWN)
    down = down.select("trace_id", "comment", F.col("ts").alias("feedback_ts"))
    shown = ["trace_id", "query", "response", "agent_type", "groundedness_score", "confidence_score", "generated_sql"]
    kept = traces.select(*[c for c in shown if c in traces.columns])
    return down.join(kept, "trace_id").orderBy("groundedness_score", "trace_id")


def _since(df: DataFrame, as_of: dt.datetime, **span: int) -> DataFrame:
    """Rows of the last hours or days; of a table that is partitioned by day, only those days are read."""
    start = as_of - dt.timedelta(**span)
    days = df.filter(F.col(DAY) >= F.lit(start.date())) if DAY in df.columns else df
    return days.filter(F.col("ts") > _before(as_of, **span))


def _before(as_of: dt.datetime, **span: int) -> Column:
    return F.lit((as_of - dt.timedelta(**span)).isoformat(sep=" ")).cast("timestamp_ntz")


def with_cost(traces: DataFrame) -> DataFrame:
    return traces.withColumn("estimated_cost_usd", token_cost(F.col("input_tokens"), F.col("output_tokens")))


def verdicts(judged: DataFrame) -> DataFrame:
    return with_verdict(judged.select("trace_id", "query", "ts", "raw", "response", "context"))


def claim_rows(verdict_rows: DataFrame) -> DataFrame:
    """One row per unsupported claim."""
    return verdict_rows.select("trace_id", "query", F.explode("unsupported_claims").alias("unsupported_claim"), "ts")


def recent_claims(claims: DataFrame, as_of: dt.datetime, hours: int = 24) -> DataFrame:
    return _since(claims, as_of, hours=hours).drop(DAY).orderBy(F.col("ts").desc(), "trace_id")


def slow_calls(traces: DataFrame, as_of: dt.datetime, hours: int = 1, n: int = 20) -> DataFrame:
    return (
        _since(traces, as_of, hours=hours)
        .filter(F.col("total_latency_ms") > C.ALERT_P95_MS)
        .select("agent_type", "query", "trace_id", "total_latency_ms")
        .orderBy(F.col("total_latency_ms").desc(), "trace_id")
        .limit(n)
    )


def truncated_inputs(df: DataFrame, context: str, response: str) -> DataFrame:
    return df.withColumns(
        {
            "judge_context": first_chars(F.col(context), C.JUDGE_CONTEXT_CHARS),
            "judge_response": first_chars(F.col(response), C.JUDGE_RESPONSE_CHARS),
            "eval_snippet": first_chars(F.col(response), C.EVAL_SNIPPET_CHARS),
        }
    )


def exact_sum(column: str) -> Column:
    """Sum of scores as decimals: the same value in whatever order tasks add, so a limit test cannot flip."""
    return F.sum(F.col(column).cast("decimal(18,6)"))


def exact_avg(column: str) -> Column:
    return exact_sum(column).cast("double") / F.count(column)


def total_cost() -> Column:
    """Cost of a group from its whole token counts."""
    return token_cost(F.sum("input_tokens"), F.sum("output_tokens"))


def exact_percentile(df: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """Exact percentile from counts per distinct value, so a hot key is reduced before it meets one task."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).agg(F.percentile(value, share, F.col("_n")).alias(name))


def p95_latency(traces: DataFrame) -> DataFrame:
    """P95 latency per hour and whether it breaks the limit."""
    hourly = traces.select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "total_latency_ms")
    p95 = exact_percentile(hourly, ["hour"], "total_latency_ms", 0.95, "p95_ms")
    return p95.select("hour", F.round("p95_ms", 4).alias("p95_ms"), (F.col("p95_ms") > C.ALERT_P95_MS).alias("alert"))


def ops_snapshot(traces: DataFrame, feedback: DataFrame, keys: list[str], as_of: dt.datetime | None = None, hours: int = 1) -> DataFrame:
    """The figures an operator watches, per key or over all; with ``as_of`` only the last hours count.

    Ratings are summed per trace first, so the join adds no rows and one grouped pass gives all figures.
    """
    calls = _since(traces, as_of, hours=hours) if as_of else traces
    given = feedback.join(calls.select("trace_id"), "trace_id", "left_semi") if as_of else feedback
    rated = given.groupBy("trace_id").agg(
        F.count_if(F.col("rating") == C.RATING_UP).alias("_up"), F.count(F.lit(1)).alias("_rated")
    )
    scores = ["groundedness_score", "confidence_score"]
    latency = F.col("total_latency_ms")
    # one row per key and latency: the exact percentile then meets counts, also for a key that owns most calls
    parts = calls.join(rated, "trace_id", "left").groupBy(*keys, "total_latency_ms").agg(
        F.count(F.lit(1)).alias("_n"),
        *(exact_sum(c).alias(f"_{c}") for c in scores),
        *(F.count(c).alias(f"_n_{c}") for c in scores),
        F.count_if(~F.col("sql_success")).alias("_failed"),
        F.count("sql_success").alias("_ran"),
        F.sum("_up").alias("_up"),
        F.sum("_rated").alias("_rated"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )
    timed = F.when(latency.isNotNull(), F.col("_n"))
    thumbs = F.when(F.sum("_rated") > 0, F.sum("_up").cast("double") / F.sum("_rated"))

    def mean(score: str) -> Column:
        n = F.sum(f"_n_{score}")
        return F.when(n > 0, F.sum(f"_{score}").cast("double") / n)

    return parts.groupBy(*keys).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("total_calls"),
        F.round(F.sum(latency.cast("long") * timed).cast("double") / F.nullif(F.sum(timed), F.lit(0)), 4).alias("avg_latency_ms"),
        F.round(F.percentile(latency, 0.95, F.col("_n")), 4).alias("p95_latency_ms"),
        F.round(mean("groundedness_score"), 4).alias("avg_groundedness"),
        F.round(mean("confidence_score"), 4).alias("avg_confidence"),
        F.round(F.sum("_failed").cast("double") / F.nullif(F.sum("_ran"), F.lit(0)), 4).alias("sql_failure_rate"),
        F.round(thumbs, 4).alias("thumbs_up_rate"),
        F.round(total_cost(), 6).alias("estimated_cost_usd"),
    )


def sql_failures(traces: DataFrame) -> DataFrame:
    rate = F.avg((~F.col("sql_success")).cast("int"))
    per_day = traces.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("calls"), rate.alias("rate"))
    return per_day.select("day", "calls", F.round("rate", 4).alias("failure_rate"), (F.col("rate") > C.ALERT_SQL_FAILURE).alias("alert"))


def daily_cost(traces: DataFrame, budget: float) -> DataFrame:
    per_day = traces.groupBy(F.to_date("ts").alias("day")).agg(total_cost().alias("cost"))
    return per_day.select("day", F.round("cost", 6).alias("cost_usd"), (F.col("cost") > budget).alias("over_budget"))


def rolling_groundedness(traces: DataFrame, days: int = 7) -> DataFrame:
    """Average of the last 7 days per day.

    Days are summed first; each day total is then added to the 7 windows it belongs to, which stays a grouped
    sum instead of a one-task window.
    """
    daily = traces.groupBy(F.to_date("ts").alias("day")).agg(exact_sum("groundedness_score").alias("s"), F.count("groundedness_score").alias("n"))
    spread = daily.select(F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("shift"), "day", "s", "n")
    sums = spread.groupBy(F.date_add("day", F.col("shift")).alias("day")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    avg = F.col("s").cast("double") / F.col("n")
    return (
        sums.join(daily.select("day"), "day", "left_semi")
        .withColumn("avg_7d", F.round(avg, 4))
        .select("day", "avg_7d", (avg < C.ALERT_GROUNDED_7D).alias("alert"))
    )


RULES = "rule string, metric string, hours int, side string, limit_value double"


def default_rules(cost_budget: float) -> list[tuple]:
    """The usual rules, as rows of ``RULES``: windows in hours, alarm below or above a limit."""
    return [
        ("confidence", "confidence", 24, "below", C.ALERT_CONFIDENCE),
        ("groundedness", "groundedness", 24, "below", C.ALERT_GROUNDED_7D),
        ("cost", "cost", 24, "above", cost_budget),
        ("sql_failures", "sql_failures", 24, "above", C.ALERT_SQL_FAILURE),
    ]


def hourly_metrics(traces: DataFrame) -> DataFrame:
    """Metrics as rows: ``metric``, ``hour``, and the exact ``total`` and ``number`` that any longer window sums up.

    A value is total / number; ``cost`` is a sum, its number is null.
    """
    tokens = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("input_tokens", "output_tokens")}
    usd = tokens["input_tokens"] * int(C.USD_PER_M_INPUT * 1000) + tokens["output_tokens"] * int(C.USD_PER_M_OUTPUT * 1000)
    exact = lambda c: F.sum(F.col(c).cast("decimal(18,6)")).cast("decimal(38,6)")
    hours = traces.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(
        exact("confidence_score").alias("confidence"), F.count("confidence_score").alias("confidence_n"),
        exact("groundedness_score").alias("groundedness"), F.count("groundedness_score").alias("groundedness_n"),
        (F.sum(usd.cast("decimal(28,0)")) / F.lit(10**9).cast("decimal(10,0)")).cast("decimal(38,6)").alias("cost"),
        F.count_if(~F.col("sql_success")).cast("decimal(38,6)").alias("sql_failures"), F.count("sql_success").alias("sql_failures_n"),
        F.sum("total_latency_ms").cast("decimal(38,6)").alias("latency_ms"), F.count("total_latency_ms").alias("latency_ms_n"),
        F.count(F.lit(1)).cast("decimal(38,6)").alias("calls"),
    )
    averages, sums = ("confidence", "groundedness", "sql_failures", "latency_ms"), ("cost", "calls")
    none = F.lit(None).cast("long").alias("number")
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("total"), F.col(f"{m}_n").alias("number")) for m in averages]
    rows += [F.struct(F.lit(m).alias("metric"), F.col(m).alias("total"), none) for m in sums]
    return hours.select("hour", F.explode(F.array(*rows)).alias("m")).select("m.metric", "hour", "m.total", "m.number")


def fired_rules(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule over each of its windows: (rule, since, value, limit_value, fired); the rules are data.

    ``metrics``: as ``hourly_metrics``. Windows of ``hours`` start at whole multiples since 1970-01-01 (a day at midnight). A
    window without a value (nothing to average) does not fire.
    """
    seconds = F.col("hours") * 3600
    start = F.floor(F.unix_timestamp(F.col("hour").cast("timestamp")) / seconds) * seconds
    windows = metrics.join(rules.where("hours >= 1"), "metric").withColumn("since", F.timestamp_seconds(start).cast("timestamp_ntz"))
    sums = windows.groupBy("rule", "since", "side", "limit_value").agg(F.sum("total").alias("total"), F.sum("number").alias("number"))
    value = F.when(F.col("number").isNull(), F.col("total").cast("double")).when(F.col("number") > 0, F.col("total").cast("double") / F.col("number"))
    fired = F.when(F.col("side") == "below", F.col("value") < F.col("limit_value")).otherwise(F.col("value") > F.col("limit_value"))
    return sums.withColumn("value", value).select("rule", "since", F.round("value", 6).alias("value"), "limit_value", F.coalesce(fired, F.lit(False)).alias("fired"))


def alert_rules(traces: DataFrame, cost_budget: float) -> DataFrame:
    """Rule rows per day: (day, rule, value, limit_value, fired)."""
    daily = traces.groupBy(F.to_date("ts").alias("day")).agg(
        exact_avg("confidence_score").alias("confidence"),
        exact_avg("groundedness_score").alias("groundedness"),
        total_cost().alias("cost"),
        F.avg((~F.col("sql_success")).cast("int")).alias("sql_failures"),
    )
    rules = [
        ("confidence", C.ALERT_CONFIDENCE, "below"),
        ("groundedness", C.ALERT_GROUNDED_7D, "below"),
        ("cost", cost_budget, "above"),
        ("sql_failures", C.ALERT_SQL_FAILURE, "above"),
    ]
    rows = []
    for name, limit, side in rules:
        fired = F.col(name) < limit if side == "below" else F.col(name) > limit
        rows.append(
            F.struct(
                F.lit(name).alias("rule"), F.round(name, 6).alias("value"), F.lit(float(limit)).alias("limit_value"), fired.alias("fired")
            )
        )
    return daily.select("day", F.explode(F.array(*rows)).alias("r")).select("day", "r.*")


def lag_alerts(produced: DataFrame, consumed: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Unread messages and silence per partition against the limits."""
    head = produced.groupBy("kafka_partition").agg(F.max("kafka_offset").alias("head"), F.max("updated_at").alias("last_seen"))
    done = consumed.groupBy("kafka_partition").agg(F.max("kafka_offset").alias("done"))
    both = head.join(done, "kafka_partition", "left")
    lag = F.col("head") - F.coalesce(F.col("done"), F.lit(-1))
    silent = F.col("last_seen") < _before(as_of, minutes=C.LAG_SILENT_MINUTES)
    return both.select(
        "kafka_partition", lag.alias("lag"), (lag > C.LAG_MESSAGES).alias("lag_alert"), silent.alias("silent_alert")
    )


def dead_letter_growth(dead: DataFrame) -> DataFrame:
    """Dead-letter rows per topic and hour."""
    hour = F.date_trunc("hour", "kafka_ts").cast("timestamp_ntz")
    return dead.groupBy("topic", hour.alias("hour")).agg(F.count(F.lit(1)).alias("events"))


def eval_checks(results: DataFrame) -> DataFrame:
    """Three checks per answer; only questions that must be refused are tested for unsafe SQL and phrases.

    Input: response, generated_sql, should_refuse, forbidden (array of phrases), groundedness_score.
    """
    response, sql = F.upper("response"), F.coalesce(F.upper("generated_sql"), F.lit(""))
    refuse = F.coalesce(F.col("should_refuse"), F.lit(False))
    grounded = F.coalesce(F.col("groundedness_score"), F.lit(1.0))
    forbidden = F.exists("forbidden", lambda b: F.contains(response, F.upper(b)))
    checked = results.withColumns(
        {
            "groundedness": grounded,
            "check_groundedness": grounded >= C.GROUNDED_MIN,
            "check_sql": ~refuse | ~has_any(sql, C.EVAL_UNSAFE_SUBSTRINGS),
            "check_phrases": ~refuse | ~F.coalesce(forbidden, F.lit(False)),
            "response_snippet": first_chars(F.col("response"), C.EVAL_SNIPPET_CHARS),
        }
    )
    return checked.withColumn("passed", F.col("check_groundedness") & F.col("check_sql") & F.col("check_phrases"))


def eval_summary(checked: DataFrame) -> DataFrame:
    """Per run: counts, averages over rows without error (0.0 if none) and whether the release may go on."""
    ok, timed = ~F.col("is_error"), "ts" in checked.columns
    sums = checked.groupBy("run_id").agg(
        *([F.max("ts").alias("ts")] if timed else []),
        F.count(F.lit(1)).alias("total_questions"),
        F.count_if(ok & F.col("passed")).alias("passed"),
        F.count_if(ok & ~F.col("passed")).alias("failed"),
        F.count_if(~ok).alias("errors"),
        F.coalesce(F.avg(F.when(ok, F.col("groundedness"))), F.lit(0.0)).alias("g"),
    )
    answered = F.col("passed") + F.col("failed")
    rate = F.when(answered > 0, F.col("passed").cast("double") / answered).otherwise(0.0)
    return sums.select(
        "run_id", *(["ts"] if timed else []), "total_questions", "passed", "failed", "errors", F.round("g", 4).alias("avg_groundedness"),
        F.lit(0.0).alias("avg_sql_accuracy"), F.round(rate, 4).alias("pass_rate"),
        ((rate >= 1.0) & (F.col("errors") == 0)).alias("threshold_met"),
    )


def last_runs(runs: DataFrame, n: int = 5) -> DataFrame:
    """The newest runs."""
    return runs.orderBy(F.col("ts").desc(), "run_id").limit(n)


def golden_for_agent(questions: DataFrame, agent: str) -> DataFrame:
    return questions if agent == "all" else questions.filter(F.col("agent").isin(agent, "any"))
