"""Change events, current tables, warehouse sync."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quotaflow import constants as C
from quotaflow.functions.metrics import same_quarter
from quotaflow.operators import access, cdc, merge
from quotaflow.plans import deals, sync
from quotaflow.plans.views import Inputs
from quotaflow.registry.common import AS_OF_DATE, Entry, oracle
from quotaflow.sources.warehouse import warehouse_query

AS_OF = f"DATE '{AS_OF_DATE}'"


def _ntz(df):
    return df.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


def _parsed(i: Inputs, entity: str):
    return cdc.parse_events(i.view(f"{entity}_raw"), entity)


def _text(name: str) -> str:
    return f"json_extract_string(j, '$.\"{name}\"')"


_CAST = {
    "string": "{0}",
    "money": "TRY_CAST({0} AS DECIMAL(18,2))",
    "int": "TRY_CAST(regexp_replace({0}, '\\..*$', '') AS INTEGER)",
    "date": "CAST(try_strptime({0}, '%Y-%m-%d') AS DATE)",
    "timestamp": "TRY_CAST({0} AS TIMESTAMP)",
}


def _parse_cte(entity: str, fields) -> str:
    columns = ", ".join(f"{_CAST[kind].format(_text(source))} AS {column}" for source, column, kind in fields)
    return (
        f"docs AS (SELECT CASE WHEN json_valid(raw_json) THEN CAST(raw_json AS JSON) END AS j, kafka_offset, kafka_partition, kafka_ts FROM {entity}_raw), "
        f"parsed AS (SELECT {columns}, kafka_offset, kafka_partition, kafka_ts FROM docs)"
    )


_OPP, _ACC = _parse_cte("opportunity", C.OPPORTUNITY_FIELDS), _parse_cte("account", C.ACCOUNT_FIELDS)
_VALID_TYPE = "event_type IN ('CREATE', 'UPDATE', 'DELETE')"

_LATEST = (
    "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY updated_at DESC NULLS LAST, "
    f"kafka_offset DESC) AS rn FROM cdc_events WHERE {_VALID_TYPE}) WHERE rn = 1)"
)
_LATEST_FORECAST = (
    "latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY period, segment, owner_id "
    "ORDER BY snapshot_date DESC) AS rn FROM forecast_snapshots) WHERE rn = 1)"
)


def _events(i: Inputs):
    return i.cdc_events.filter(F.col("event_type").isin(*C.CDC_EVENT_TYPES))


def _scd1(i: Inputs, deletes: bool):
    rows = cdc.current_rows(_events(i), "entity_id", deletes)
    return rows.select("entity_id", "event_type", "amount", "updated_at", "kafka_offset")


def _account_versions(i: Inputs):
    """Two versions of the account table: one without indebted accounts, one without the largest, Enterprise ARR moved."""
    accounts = i.account_current
    old = accounts.filter("arr >= 0")
    moved = F.when(F.col("segment") == "Enterprise", (F.col("arr") + 10).cast("decimal(18,2)")).otherwise(F.col("arr"))
    return old, accounts.filter("arr <= 8000").withColumn("arr", moved)


def _deal_versions(i: Inputs):
    """Negotiations of the quarter are won in the second version."""
    old = i.opportunity_current
    won = (F.col("stage") == "Negotiation") & same_quarter(F.col("close_date"), AS_OF_DATE)
    return old, old.withColumn("stage", F.when(won, "Closed Won").otherwise(F.col("stage")))


def _stage_changes(i: Inputs):
    old, new = _deal_versions(i)
    return deals.stage_changes(merge.change_feed(old, new, "opportunity_id", keep_old=("stage",)))


_MOVES = (
    "new_deals AS (SELECT * REPLACE (CASE WHEN stage = 'Negotiation' AND close_date >= DATE '2001-04-01' AND close_date < DATE '2001-07-01' "
    "THEN 'Closed Won' ELSE stage END AS stage) FROM opportunity_current), "
    "moves AS (SELECT n.opportunity_id, o.stage AS old_stage, n.stage AS new_stage, n.forecast_category, n.amount "
    "FROM new_deals n JOIN opportunity_current o USING (opportunity_id) WHERE n.stage <> o.stage)"
)

_ENTITLED = (
    "below(origin, member) AS (SELECT viewer, viewer FROM entitlements UNION SELECT manager, manager FROM reporting_lines "
    "UNION SELECT b.origin, l.member FROM below b JOIN reporting_lines l ON l.manager = b.member), "
    "entitled AS (SELECT DISTINCT origin AS viewer, owner_id FROM below JOIN entitlements ON viewer = member)"
)


def _upsert(i: Inputs):
    target = i.arr_source
    enterprise = target.filter("segment = 'Enterprise'").withColumn("arr", (F.coalesce("arr", F.lit(0)) + 100).cast("decimal(18,2)"))
    fresh = i.supplier.select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("account_id"), F.col("s_name").alias("account_name"),
        F.col("s_acctbal").cast("decimal(18,2)").alias("arr"), F.lit(None).cast("decimal(18,2)").alias("mrr"),
        F.lit(None).cast("double").alias("arr_growth_pct"), F.lit(0).cast("decimal(18,2)").alias("new_logo_arr"),
        F.lit(0).cast("decimal(18,2)").alias("expansion_arr"), F.lit(0).cast("decimal(18,2)").alias("churn_arr"),
        F.lit("SMB").alias("segment"),
    )
    return merge.upsert(target, enterprise.unionByName(fresh), "account_id")


def _replace(i: Inputs):
    today = dt.date(2001, 4, 1)
    target = i.forecast_snapshots
    source = target.filter(F.col("snapshot_date") == F.lit(today)).withColumn("pipeline", F.lit(0).cast("decimal(18,2)"))
    return merge.replace_where(target, source, F.col("snapshot_date") == F.lit(today))


def _latest_forecast(i: Inputs):
    return sync.latest_snapshots(i.forecast_snapshots, ["period", "segment", "owner_id"])


def _health_degradation(i: Inputs):
    from quotaflow.operators.ranking import previous_per_key

    rows = previous_per_key(
        _events(i), ["entity_id"], F.date_trunc("minute", "updated_at"), [F.col("updated_at"), F.col("kafka_offset")], "health_score", "previous_score"
    )
    return rows.filter("health_score < previous_score").select("entity_id", "kafka_offset", "health_score", "previous_score")


def _freshness(i: Inputs):
    return sync.freshness(
        {"events": (i.events, "ts"), "opportunity_current": (i.orders, "o_orderdate"), "lineitem": (i.lineitem, "l_shipdate")}
    )


ENTRIES: dict[str, Entry] = {
    "src_warehouse_query": Entry(
        lambda i: warehouse_query(
            i.spark,
            "SELECT c_mktsegment AS industry, count(*) AS accounts, cast(sum(cast(c_acctbal AS decimal(18,2))) AS decimal(28,2)) AS arr "
            "FROM customer WHERE c_acctbal >= 0 GROUP BY c_mktsegment",
            {"customer": f"{i.folder}/customer.parquet"},
        ),
        "SELECT c_mktsegment AS industry, count(*) AS accounts, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS arr "
        "FROM customer WHERE c_acctbal >= 0 GROUP BY c_mktsegment",
    ),
    "parse_opportunity": Entry(
        lambda i: _ntz(_parsed(i, "opportunity")), oracle(["opportunity_raw"], "SELECT * FROM parsed", _OPP)
    ),
    "parse_account": Entry(lambda i: _ntz(_parsed(i, "account")), oracle(["account_raw"], "SELECT * FROM parsed", _ACC)),
    "dq_drop": Entry(
        lambda i: _ntz(cdc.keep_valid(_parsed(i, "opportunity"), cdc.quality_rules("opportunity"))),
        oracle(["opportunity_raw"], f"SELECT * FROM parsed WHERE opportunity_id IS NOT NULL AND {_VALID_TYPE}", _OPP),
    ),
    "dq_drop_account": Entry(
        lambda i: _ntz(cdc.keep_valid(_parsed(i, "account"), cdc.quality_rules("account"))),
        oracle(["account_raw"], "SELECT * FROM parsed WHERE account_id IS NOT NULL", _ACC),
    ),
    "dq_report": Entry(
        lambda i: cdc.rule_report(
            _parsed(i, "opportunity"), {**cdc.quality_rules("opportunity"), "valid_amount": F.col("amount") > 0}
        ),
        oracle(
            ["opportunity_raw"],
            "SELECT 'valid_opportunity_id' AS rule, count(*) FILTER (opportunity_id IS NULL) AS violations, count(*) AS total_rows FROM parsed "
            f"UNION ALL SELECT 'valid_event_type', count(*) FILTER (NOT coalesce({_VALID_TYPE}, false)), count(*) FROM parsed "
            "UNION ALL SELECT 'valid_amount', count(*) FILTER (NOT coalesce(amount > 0, false)), count(*) FROM parsed",
            _OPP,
        ),
    ),
    "scd1_latest": Entry(
        lambda i: _scd1(i, True),
        oracle(["cdc_events"], "SELECT entity_id, event_type, amount, updated_at, kafka_offset FROM latest WHERE event_type <> 'DELETE'", _LATEST),
    ),
    "scd1_latest_account": Entry(
        lambda i: _scd1(i, False),
        oracle(["cdc_events"], "SELECT entity_id, event_type, amount, updated_at, kafka_offset FROM latest", _LATEST),
    ),
    "change_feed": Entry(
        lambda i: merge.change_feed(*_account_versions(i), "account_id"),
        oracle(
            ["account_current"],
            "SELECT coalesce(n.account_id, o.account_id) AS account_id, CASE WHEN o.account_id IS NULL THEN 'insert' WHEN n.account_id IS NULL THEN 'delete' ELSE 'update' END AS change_type, "
            "coalesce(n.name, o.name) AS name, coalesce(n.industry, o.industry) AS industry, coalesce(n.segment, o.segment) AS segment, "
            "coalesce(n.owner_id, o.owner_id) AS owner_id, coalesce(n.csm_id, o.csm_id) AS csm_id, coalesce(n.arr, o.arr) AS arr, "
            "coalesce(n.health_score, o.health_score) AS health_score, coalesce(n.risk_tier, o.risk_tier) AS risk_tier, coalesce(n.contract_end, o.contract_end) AS contract_end "
            "FROM old_v o FULL JOIN new_v n ON o.account_id = n.account_id WHERE o.account_id IS NULL OR n.account_id IS NULL OR o.arr <> n.arr",
            "old_v AS (SELECT * FROM account_current WHERE arr >= 0), new_v AS (SELECT * REPLACE (CASE WHEN segment = 'Enterprise' THEN CAST(arr + 10 AS DECIMAL(18,2)) ELSE arr END AS arr) FROM account_current WHERE arr <= 8000)",
        ),
    ),
    "stage_changes": Entry(_stage_changes, oracle(["opportunity_current"], "SELECT * FROM moves", _MOVES)),
    "stage_changes_forecast": Entry(
        lambda i: deals.recomputed_forecast(_stage_changes(i), _deal_versions(i)[1]),
        oracle(
            ["opportunity_current"],
            "SELECT forecast_category, CAST(sum(amount) AS DECIMAL(28,2)) AS amount, count(*) AS deal_count FROM new_deals "
            "WHERE stage NOT IN ('Closed Won', 'Closed Lost') AND forecast_category IN (SELECT forecast_category FROM moves) GROUP BY 1",
            _MOVES,
        ),
    ),
    "health_degradation": Entry(
        _health_degradation,
        oracle(
            ["cdc_events"],
            "SELECT entity_id, kafka_offset, health_score, previous_score FROM (SELECT *, lag(health_score) OVER (PARTITION BY entity_id ORDER BY updated_at, kafka_offset) AS previous_score "
            f"FROM cdc_events WHERE {_VALID_TYPE}) WHERE health_score < previous_score",
        ),
    ),
    "sync_filter_notnull": Entry(
        lambda i: sync.arr_rows(i.arr_source, AS_OF_DATE),
        oracle(["arr_source"], f"SELECT *, {AS_OF} AS snapshot_date FROM arr_source WHERE arr IS NOT NULL"),
    ),
    "sync_filter_notnull_acv": Entry(
        lambda i: sync.acv_rows(i.acv_source), oracle(["acv_source"], "SELECT * FROM acv_source WHERE acv IS NOT NULL")
    ),
    "sync_health": Entry(
        lambda i: sync.health_rows(i.health, AS_OF_DATE), oracle(["health"], f"SELECT *, {AS_OF} AS snapshot_date FROM health")
    ),
    "sync_forecast_attainment": Entry(
        lambda i: sync.forecast_rows(i.forecast_snapshots),
        oracle(
            ["forecast_snapshots"],
            "SELECT *, CASE WHEN quota > 0 THEN round(CAST(closed_won AS DOUBLE) / CAST(quota AS DOUBLE), 6) END AS attainment_pct FROM forecast_snapshots",
        ),
    ),
    "sync_nrr_recent": Entry(
        lambda i: sync.nrr_rows(i.nrr_source, AS_OF_DATE),
        oracle(["nrr_source"], f"SELECT * FROM nrr_source WHERE period_date >= CAST({AS_OF} - INTERVAL 24 MONTH AS DATE)"),
    ),
    "sink_upsert": Entry(
        _upsert,
        oracle(
            ["arr_source"],
            "SELECT * REPLACE (CASE WHEN segment = 'Enterprise' THEN CAST(coalesce(arr, 0) + 100 AS DECIMAL(18,2)) ELSE arr END AS arr) FROM arr_source "
            "UNION ALL SELECT concat('S', CAST(s_suppkey AS VARCHAR)), s_name, CAST(s_acctbal AS DECIMAL(18,2)), NULL, NULL, 0, 0, 0, 'SMB' FROM supplier",
        ),
    ),
    "sink_replace_where": Entry(
        _replace,
        oracle(
            ["forecast_snapshots"],
            "SELECT * REPLACE (CASE WHEN snapshot_date = DATE '2001-04-01' THEN CAST(0 AS DECIMAL(18,2)) ELSE pipeline END AS pipeline) FROM forecast_snapshots",
        ),
    ),
    "latest_snapshot": Entry(_latest_forecast, oracle(["forecast_snapshots"], "SELECT * FROM latest", _LATEST_FORECAST)),
    "freshness": Entry(
        _freshness,
        "SELECT 'events' AS table_name, max(ts) AS newest FROM events UNION ALL SELECT 'opportunity_current', max(o_orderdate) FROM orders "
        "UNION ALL SELECT 'lineitem', max(l_shipdate) FROM lineitem",
    ),
    "row_filter": Entry(
        lambda i: access.visible_rows(i.opportunity_current, "mgr-7", "manager", i.entitlements),
        oracle(
            ["opportunity_current", "entitlements"],
            "SELECT * FROM opportunity_current WHERE owner_id IN (SELECT owner_id FROM entitlements WHERE viewer = 'mgr-7')",
        ),
    ),
    "row_filter_nested": Entry(
        lambda i: access.visible_rows(i.opportunity_current, "mgr-7", "manager", i.entitlements, lines=i.reporting_lines),
        oracle(
            ["opportunity_current", "entitlements", "reporting_lines"],
            "SELECT * FROM opportunity_current WHERE owner_id IN (SELECT owner_id FROM entitled WHERE viewer = 'mgr-7')",
            _ENTITLED,
            recursive=True,
        ),
    ),
    "entitled_owners": Entry(
        lambda i: access.entitled_owners(i.entitlements, i.reporting_lines),
        oracle(["entitlements", "reporting_lines"], "SELECT viewer, owner_id FROM entitled", _ENTITLED, recursive=True),
    ),
    "row_filter_rep": Entry(
        lambda i: access.visible_rows(i.opportunity_current, "7", "rep"),
        oracle(["opportunity_current"], "SELECT * FROM opportunity_current WHERE owner_id = '7'"),
    ),
    "column_mask": Entry(
        lambda i: access.mask_columns(i.account_current, ["arr"], "rep"),
        oracle(["account_current"], "SELECT * REPLACE (CAST(NULL AS DECIMAL(18,2)) AS arr) FROM account_current"),
    ),
}

LATEST_FORECAST_CTE, SCD1_CTE, VALID_TYPE, MOVED_SQL = _LATEST_FORECAST, _LATEST, _VALID_TYPE, _MOVES
deal_versions = _deal_versions
PARSE_CTE = {"opportunity": _OPP, "account": _ACC}
latest_forecast = _latest_forecast
