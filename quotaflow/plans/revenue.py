"""ARR, retention, account health and renewal questions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaflow import constants as C
from quotaflow.functions.metrics import ratio
from quotaflow.operators.ranking import top_per_key

BIG_MONEY = "decimal(28,2)"


def risk_top(accounts: DataFrame, health: DataFrame, n: int = C.RISK_TOP) -> DataFrame:
    """Accounts at risk with their usage signals, worst health first, larger ARR first."""
    at_risk = F.col("risk_tier").isin(*C.AT_RISK_TIERS) | (F.col("health_score") < C.RISK_HEALTH_BELOW)
    order = [F.col("health_score").asc_nulls_first(), F.col("arr").desc_nulls_last(), F.col("account_id")]
    # The order depends on account columns only and a left join drops no account, so the n accounts are cut
    # first. Health is then reduced to those n keys by a semi join whose small side has a known row bound.
    worst = (
        accounts.filter(at_risk)
        .select("account_id", F.col("name").alias("account_name"), "health_score", "risk_tier", "arr", "contract_end", "segment")
        .orderBy(*order)
        .limit(n)
    )
    usage = health.select("account_id", "nps_score", "feature_adoption", "last_login_date").join(
        worst.select("account_id"), "account_id", "left_semi"
    )
    return worst.join(usage, "account_id", "left").orderBy(*order).limit(n)


def arr_of_tier(arr: DataFrame, accounts: DataFrame, tier: str, n: int = 20) -> DataFrame:
    chosen = accounts.filter(F.col("risk_tier") == tier).select(F.col("account_id").alias("id"), "name", "risk_tier")
    return (
        arr.join(chosen, arr["account_id"] == chosen["id"])
        .select("account_id", "name", "arr", "arr_growth_pct", "risk_tier")
        .orderBy(F.col("arr").desc(), "account_id")
        .limit(n)
    )


def red_by_industry(accounts: DataFrame, industry: str) -> DataFrame:
    return accounts.filter((F.col("risk_tier") == "Red") & (F.col("industry") == industry))


def contracts_expiring(accounts: DataFrame, as_of: dt.date, days: int = C.EXPIRY_DAYS) -> DataFrame:
    last = as_of + dt.timedelta(days=days)
    due = accounts.filter(F.col("contract_end").between(F.lit(as_of), F.lit(last)))
    return due.orderBy("contract_end", "account_id")


def low_adoption(health: DataFrame, accounts: DataFrame, below: float = 0.30) -> DataFrame:
    low = health.filter(F.col("feature_adoption") < below).select("account_id", "feature_adoption")
    return low.join(accounts.select("account_id", "name", "segment"), "account_id")


def adoption_drop(history: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """Relative change of adoption against the snapshot of 30 days before; NULL without one."""
    now = history.filter(F.col("snapshot_date") == F.lit(as_of)).select("account_id", F.col("feature_adoption").alias("adoption"))
    then = history.filter(F.col("snapshot_date") == F.lit(as_of - dt.timedelta(days=days))).select(
        "account_id", F.col("feature_adoption").alias("earlier")
    )
    both = now.join(then, "account_id", "left")
    return both.withColumn("change", F.round(ratio(F.col("adoption") - F.col("earlier"), F.col("earlier"), None), 4))


def arr_total(arr: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return arr.groupBy(*(keys or [])).agg(
        F.sum("arr").cast(BIG_MONEY).alias("arr"), F.count(F.lit(1)).alias("account_count")
    )


def arr_movement(arr: DataFrame) -> DataFrame:
    """New logo, expansion and churn per segment, MRR and the NRR-like ratio."""
    total = lambda c: F.sum(c).cast(BIG_MONEY).alias(c)
    sums = arr.groupBy("segment").agg(*[total(c) for c in ("arr", "mrr", "new_logo_arr", "expansion_arr", "churn_arr")])
    start = F.col("arr") - F.col("new_logo_arr") - F.col("expansion_arr") + F.col("churn_arr")
    kept = F.col("arr") - F.col("new_logo_arr")
    return sums.withColumn("net_retention", ratio(kept, start))


def arr_growth(quarterly: DataFrame) -> DataFrame:
    """ARR per segment and quarter with growth against the quarter before.

    The previous quarter is an equi-join on the quarter number, so there is no single-task ordering.
    """
    per = quarterly.groupBy("segment", "quarter_no").agg(F.sum("arr").cast(BIG_MONEY).alias("arr"))
    before = per.select("segment", (F.col("quarter_no") + 1).alias("quarter_no"), F.col("arr").alias("previous_arr"))
    both = per.join(before, ["segment", "quarter_no"], "left")
    return both.withColumn("growth", ratio(F.col("arr") - F.col("previous_arr"), F.col("previous_arr")))


def nrr_current(nrr: DataFrame) -> DataFrame:
    return top_per_key(nrr, ["segment"], [F.col("period_date").desc()])


def nrr_trend(nrr: DataFrame) -> DataFrame:
    before = nrr.select("segment", F.add_months("period_date", 1).alias("period_date"), F.col("nrr_pct").alias("previous_pct"))
    both = nrr.select("segment", "period_date", "nrr_pct").join(before, ["segment", "period_date"], "left")
    return both.withColumn("change", F.round(F.col("nrr_pct") - F.col("previous_pct"), 4))
