"""Metric questions: pipeline, forecast, ARR, retention, risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotaflow.functions.metrics import same_quarter
from quotaflow.plans import answers, deals, revenue, sync
from quotaflow.plans.views import Inputs
from quotaflow.registry.common import AS_OF_DATE, PERIOD, Entry, oracle
from quotaflow.registry.tables import LATEST_FORECAST_CTE, latest_forecast

AS_OF = f"DATE '{AS_OF_DATE}'"
OPEN = "stage NOT IN ('Closed Won', 'Closed Lost')"
QUARTER = "close_date >= DATE '2001-04-01' AND close_date < DATE '2001-07-01'"
MONTH = "close_date >= DATE '2001-05-01' AND close_date < DATE '2001-06-01'"
DEALS, ACCOUNTS = ["opportunity_current"], ["account_current"]
SLIP = (
    f"SELECT *, stage IN ('Prospecting', 'Discovery') AS early_stage, days_in_stage > 30 AS long_in_stage, {AS_OF} - last_activity_date > 14 AS no_activity "
    f"FROM opportunity_current WHERE {OPEN} AND {QUARTER}"
)
ARR = "arr AS (SELECT * FROM arr_source WHERE arr IS NOT NULL)"
RISK = (
    "SELECT worst.account_id, worst.name AS account_name, worst.health_score, worst.risk_tier, worst.arr, worst.contract_end, worst.segment, nps_score, feature_adoption, last_login_date "
    "FROM (SELECT *, row_number() OVER (ORDER BY health_score NULLS FIRST, arr DESC, account_id) AS place FROM account_current WHERE health_score < 60 OR risk_tier <> 'Green') worst "
    "LEFT JOIN health ON health.account_id = worst.account_id WHERE place <= 25"
)


def _ratio(a: str, b: str, digits: int = 4) -> str:
    return f"CASE WHEN {b} > 0 THEN round(CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE), {digits}) END"


def _sum(column: str, name: str | None = None) -> str:
    return f"CAST(sum({column}) AS DECIMAL(28,2)) AS {name or column}"


def _win_sql(keys: str, where: str = "true") -> str:
    columns, group = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    return (
        f"SELECT {columns}won, lost, {_ratio('won', 'won + lost')} AS win_rate FROM (SELECT {columns}count(*) FILTER (stage = 'Closed Won') AS won, "
        f"count(*) FILTER (stage = 'Closed Lost') AS lost FROM d WHERE {where} AND stage IN ('Closed Won', 'Closed Lost') {group})"
    )


def _arr(i: Inputs):
    return sync.arr_rows(i.arr_source, AS_OF_DATE)


def _quarter_deals(i: Inputs):
    return i.opportunity_base.filter(same_quarter(F.col("close_date"), AS_OF_DATE))


def risk_top25(i: Inputs):
    return revenue.risk_top(i.account_current, i.health)


def _win_by_industry(i: Inputs):
    return deals.win_rate_by_industry(i.opportunity_base, i.account_current)


ENTRIES: dict[str, Entry] = {
    "risk_top25": Entry(risk_top25, oracle(["account_current", "health"], RISK)),
    "deals_stuck": Entry(
        lambda i: deals.stuck(i.opportunity_current),
        oracle(DEALS, "SELECT * FROM opportunity_current WHERE stage = 'Negotiation' AND days_in_stage > 30"),
    ),
    "deals_closing_month": Entry(
        lambda i: deals.closing_month(i.opportunity_current, AS_OF_DATE),
        oracle(DEALS, f"SELECT * FROM opportunity_current WHERE {OPEN} AND {MONTH} AND amount > 50000"),
    ),
    "deals_slipping": Entry(
        lambda i: deals.slipping(i.opportunity_current, AS_OF_DATE),
        oracle(DEALS, f"SELECT * FROM ({SLIP}) WHERE early_stage OR long_in_stage OR no_activity"),
    ),
    "deals_inactive": Entry(
        lambda i: deals.inactive(i.opportunity_current, AS_OF_DATE),
        oracle(DEALS, f"SELECT *, CAST({AS_OF} - last_activity_date AS INTEGER) AS idle_days FROM opportunity_current WHERE {OPEN} AND {AS_OF} - last_activity_date > 14"),
    ),
    "contracts_expiring": Entry(
        lambda i: revenue.contracts_expiring(i.account_current, AS_OF_DATE),
        oracle(ACCOUNTS, f"SELECT * FROM account_current WHERE contract_end BETWEEN {AS_OF} AND {AS_OF} + 90"),
    ),
    "low_adoption": Entry(
        lambda i: revenue.low_adoption(i.health, i.account_current),
        oracle(["health", "account_current"], "SELECT h.account_id, h.feature_adoption, a.name, a.segment FROM health h JOIN account_current a USING (account_id) WHERE h.feature_adoption < 0.30"),
    ),
    "red_by_industry": Entry(
        lambda i: revenue.red_by_industry(i.account_current, "BUILDING"),
        oracle(ACCOUNTS, "SELECT * FROM account_current WHERE risk_tier = 'Red' AND industry = 'BUILDING'"),
    ),
    "arr_accounts_join": Entry(
        lambda i: revenue.arr_of_tier(_arr(i), i.account_current, "Red"),
        oracle(
            ["arr_source", "account_current"],
            "SELECT m.account_id, a.name, m.arr, m.arr_growth_pct, a.risk_tier FROM arr m JOIN account_current a ON m.account_id = a.account_id "
            "WHERE a.risk_tier = 'Red' ORDER BY m.arr DESC, m.account_id LIMIT 20",
            ARR,
        ),
    ),
    "pipeline_total_quarter": Entry(
        lambda i: deals.total_quarter(i.opportunity_base, AS_OF_DATE),
        oracle(DEALS, f"SELECT {_sum('amount', 'pipeline_amount')}, count(*) AS deal_count FROM opportunity_current WHERE {OPEN} AND {QUARTER}"),
    ),
    "pipeline_by_category": Entry(
        lambda i: deals.by_category(i.opportunity_base),
        oracle(DEALS, f"SELECT forecast_category, {_sum('amount')}, count(*) AS deal_count FROM opportunity_current WHERE {OPEN} GROUP BY 1"),
    ),
    "commit_coverage": Entry(
        lambda i: deals.commit_coverage(i.opportunity_base, latest_forecast(i), AS_OF_DATE),
        oracle(
            ["opportunity_current", "forecast_snapshots"],
            f"SELECT owner_id, commit_amount, quota, {_ratio('commit_amount', 'quota')} AS coverage FROM (SELECT q.owner_id, coalesce(c.commit_amount, CAST(0 AS DECIMAL(28,2))) AS commit_amount, q.quota "
            f"FROM (SELECT owner_id, {_sum('quota')} FROM latest WHERE period = '{PERIOD}' GROUP BY 1) q LEFT JOIN "
            f"(SELECT owner_id, {_sum('amount', 'commit_amount')} FROM opportunity_current WHERE {OPEN} AND {QUARTER} AND forecast_category = 'Commit' GROUP BY 1) c USING (owner_id))",
            LATEST_FORECAST_CTE,
        ),
    ),
    "commit_coverage_total": Entry(
        lambda i: deals.commit_coverage_total(i.opportunity_base, latest_forecast(i), AS_OF_DATE),
        oracle(
            ["opportunity_current", "forecast_snapshots"],
            f"SELECT commit_amount, quota, {_ratio('commit_amount', 'quota')} AS coverage FROM (SELECT CAST(coalesce(sum(amount), 0) AS DECIMAL(28,2)) AS commit_amount, "
            f"(SELECT CAST(sum(quota) AS DECIMAL(28,2)) FROM latest WHERE period = '{PERIOD}') AS quota FROM opportunity_current WHERE {OPEN} AND {QUARTER} AND forecast_category = 'Commit')",
            LATEST_FORECAST_CTE,
        ),
    ),
    "win_rate": Entry(
        lambda i: deals.win_rate(_quarter_deals(i), []), oracle(DEALS, _win_sql("", QUARTER), "d AS (SELECT * FROM opportunity_current)")
    ),
    "win_rate_by_rep": Entry(
        lambda i: deals.win_rate(i.opportunity_base, ["owner_id"]),
        oracle(DEALS, _win_sql("owner_id"), "d AS (SELECT * FROM opportunity_current)"),
    ),
    "win_rate_by_industry": Entry(
        _win_by_industry,
        oracle(DEALS + ACCOUNTS, _win_sql("industry"), "d AS (SELECT o.stage, a.industry FROM opportunity_current o JOIN account_current a USING (account_id))"),
    ),
    "forecast_vs_quota": Entry(
        lambda i: deals.forecast_vs_quota(latest_forecast(i)),
        oracle(
            ["forecast_snapshots"],
            f"SELECT *, {_ratio('closed_won', 'quota')} AS attainment FROM (SELECT period, segment, {_sum('committed')}, {_sum('closed_won')}, {_sum('quota')} FROM latest GROUP BY 1, 2)",
            LATEST_FORECAST_CTE,
        ),
    ),
    "reps_behind_quota": Entry(
        lambda i: deals.reps_behind_quota(latest_forecast(i), PERIOD),
        oracle(
            ["forecast_snapshots"],
            f"SELECT * FROM (SELECT *, {_ratio('closed_won', 'quota')} AS attainment FROM (SELECT owner_id, {_sum('closed_won')}, {_sum('quota')} FROM latest WHERE period = '{PERIOD}' GROUP BY 1)) WHERE quota > 0 AND closed_won < quota",
            LATEST_FORECAST_CTE,
        ),
    ),
    "arr_total": Entry(
        lambda i: revenue.arr_total(_arr(i)), oracle(["arr_source"], f"SELECT {_sum('arr')}, count(*) AS account_count FROM arr", ARR)
    ),
    "arr_by_segment": Entry(
        lambda i: revenue.arr_total(_arr(i), ["segment"]),
        oracle(["arr_source"], f"SELECT segment, {_sum('arr')}, count(*) AS account_count FROM arr GROUP BY 1", ARR),
    ),
    "arr_movement": Entry(
        lambda i: revenue.arr_movement(_arr(i)),
        oracle(
            ["arr_source"],
            f"SELECT *, {_ratio('(arr - new_logo_arr)', '(arr - new_logo_arr - expansion_arr + churn_arr)')} AS net_retention FROM (SELECT segment, "
            f"{', '.join(_sum(c) for c in ('arr', 'mrr', 'new_logo_arr', 'expansion_arr', 'churn_arr'))} FROM arr GROUP BY 1)",
            ARR,
        ),
    ),
    "arr_growth_qoq": Entry(
        lambda i: revenue.arr_growth(i.arr_quarterly),
        oracle(
            ["arr_quarterly"],
            f"SELECT *, {_ratio('(arr - previous_arr)', 'previous_arr')} AS growth FROM (SELECT segment, quarter_no, arr, lag(arr) OVER (PARTITION BY segment ORDER BY quarter_no) AS previous_arr "
            f"FROM (SELECT segment, quarter_no, {_sum('arr')} FROM arr_quarterly GROUP BY 1, 2))",
        ),
    ),
    "acv_closed_quarter": Entry(
        lambda i: deals.acv_closed(i.opportunity_current, AS_OF_DATE),
        oracle(
            DEALS,
            f"SELECT CAST(coalesce(sum(acv) FILTER (stage = 'Closed Won' AND {QUARTER}), 0) AS DECIMAL(28,2)) AS acv_won_quarter, "
            f"CAST(coalesce(sum(acv) FILTER ({OPEN} AND {MONTH}), 0) AS DECIMAL(28,2)) AS acv_closing_month FROM opportunity_current",
        ),
    ),
    "avg_days_in_stage": Entry(
        lambda i: deals.avg_days_in_stage(i.opportunity_base, i.account_current),
        oracle(
            DEALS + ACCOUNTS,
            "SELECT a.segment, o.stage, count(*) AS deal_count, round(avg(o.days_in_stage), 4) AS avg_days FROM opportunity_current o JOIN account_current a USING (account_id) GROUP BY 1, 2",
        ),
    ),
    "avg_days_in_stage_enterprise": Entry(
        lambda i: deals.avg_days_in_stage(i.opportunity_base, i.account_current, "Enterprise"),
        oracle(
            DEALS + ACCOUNTS,
            "SELECT a.segment, o.stage, count(*) AS deal_count, round(avg(o.days_in_stage), 4) AS avg_days FROM opportunity_current o JOIN account_current a USING (account_id) WHERE a.segment = 'Enterprise' GROUP BY 1, 2",
        ),
    ),
    "nrr_current": Entry(
        lambda i: revenue.nrr_current(i.nrr_source),
        oracle(["nrr_source"], "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY period_date DESC) AS rn FROM nrr_source) WHERE rn = 1"),
    ),
    "nrr_trend": Entry(
        lambda i: revenue.nrr_trend(i.nrr_source),
        oracle(
            ["nrr_source"],
            "SELECT n.segment, n.period_date, n.nrr_pct, p.nrr_pct AS previous_pct, round(n.nrr_pct - p.nrr_pct, 4) AS change FROM nrr_source n "
            "LEFT JOIN nrr_source p ON p.segment = n.segment AND p.period_date = CAST(n.period_date - INTERVAL 1 MONTH AS DATE)",
        ),
    ),
    "activity_per_rep": Entry(
        lambda i: deals.activity_per_rep(i.opportunity_base),
        oracle(DEALS, "SELECT CAST(date_trunc('week', last_activity_date) AS DATE) AS week, owner_id, count(*) AS activities FROM opportunity_current GROUP BY 1, 2"),
    ),
    "forecast_accuracy": Entry(
        lambda i: deals.forecast_accuracy(i.forecast_snapshots, latest_forecast(i)),
        oracle(
            ["forecast_snapshots"],
            f"SELECT *, {_ratio('abs(actual - forecast)', 'actual')} AS error_ratio FROM (SELECT f.period, f.segment, f.forecast, a.actual FROM "
            f"(SELECT s.period, s.segment, {_sum('s.committed', 'forecast')} FROM forecast_snapshots s JOIN (SELECT period, segment, min(snapshot_date) AS d FROM forecast_snapshots GROUP BY 1, 2) m "
            f"ON m.period = s.period AND m.segment = s.segment AND m.d = s.snapshot_date GROUP BY 1, 2) f "
            f"JOIN (SELECT period, segment, {_sum('closed_won', 'actual')} FROM latest GROUP BY 1, 2) a ON a.period = f.period AND a.segment = f.segment)",
            LATEST_FORECAST_CTE,
        ),
    ),
    "adoption_drop": Entry(
        lambda i: revenue.adoption_drop(i.adoption_history, AS_OF_DATE),
        oracle(
            ["adoption_history"],
            f"SELECT n.account_id, n.feature_adoption AS adoption, p.feature_adoption AS earlier, CASE WHEN p.feature_adoption > 0 THEN round((n.feature_adoption - p.feature_adoption) / p.feature_adoption, 4) END AS change "
            f"FROM adoption_history n LEFT JOIN adoption_history p ON p.account_id = n.account_id AND p.snapshot_date = {AS_OF} - 30 WHERE n.snapshot_date = {AS_OF}",
        ),
    ),
    "round_money": Entry(
        lambda i: i.lineitem.select(
            "l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice").cast("decimal(18,4)") * F.lit("0.1375").cast("decimal(6,4)"), 2).cast("decimal(18,2)").alias("fee")
        ),
        "SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_extendedprice AS DECIMAL(18,4)) * CAST(0.1375 AS DECIMAL(6,4)), 2) AS DECIMAL(18,2)) AS fee FROM lineitem",
    ),
    "quarter_filter": Entry(
        lambda i: _quarter_deals(i).select("opportunity_id", "close_date"),
        oracle(DEALS, f"SELECT opportunity_id, close_date FROM opportunity_current WHERE quarter(close_date) = quarter({AS_OF}) AND year(close_date) = year({AS_OF})"),
    ),
    "result_cap": Entry(
        lambda i: answers.capped(i.opportunity_base, [F.col("amount").desc(), F.col("opportunity_id")]).select("opportunity_id", "amount"),
        oracle(DEALS, "SELECT opportunity_id, amount FROM opportunity_current ORDER BY amount DESC, opportunity_id LIMIT 200"),
    ),
    "rows_to_text": Entry(
        lambda i: answers.rows_to_text(
            deals.stuck(i.opportunity_current).select("opportunity_id", "amount", "acv", "close_date"), [F.col("amount").desc(), F.col("opportunity_id")]
        ),
        oracle(
            DEALS,
            "SELECT CASE WHEN count(*) = 0 THEN 'Query returned no results.' ELSE concat('opportunity_id | amount | acv | close_date', chr(10), repeat('-', 42), chr(10), "
            "string_agg(line, chr(10) ORDER BY rn) FILTER (rn <= 50), CASE WHEN count(*) > 50 THEN concat(chr(10), '... and ', count(*) - 50, ' more rows') ELSE '' END) END AS context_text "
            "FROM (SELECT row_number() OVER (ORDER BY amount DESC, opportunity_id) AS rn, concat(opportunity_id, ' | ', CAST(amount AS VARCHAR), ' | ', coalesce(CAST(acv AS VARCHAR), 'None'), ' | ', CAST(close_date AS VARCHAR)) AS line "
            "FROM opportunity_current WHERE stage = 'Negotiation' AND days_in_stage > 30) WHERE rn <= 200",
        ),
    ),
}
RISK_SQL = RISK
