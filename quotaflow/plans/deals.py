"""Pipeline and forecast questions over current opportunities and forecast snapshots."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaflow import constants as C
from quotaflow.functions.metrics import ratio, same_month, same_quarter

BIG_MONEY = "decimal(28,2)"


def open_deals(deals: DataFrame) -> DataFrame:
    return deals.filter(~F.col("stage").isin(*C.CLOSED_STAGES))


def stuck(deals: DataFrame, days: int = C.STUCK_DAYS) -> DataFrame:
    return deals.filter((F.col("stage") == "Negotiation") & (F.col("days_in_stage") > days))


def closing_month(deals: DataFrame, as_of: dt.date, above: int = C.LARGE_DEAL) -> DataFrame:
    return open_deals(deals).filter(same_month(F.col("close_date"), as_of) & (F.col("amount") > above))


def inactive(deals: DataFrame, as_of: dt.date, days: int = C.INACTIVE_DAYS) -> DataFrame:
    idle = F.datediff(F.lit(as_of), F.col("last_activity_date"))
    return open_deals(deals).withColumn("idle_days", idle).filter(F.col("idle_days") > days)


def slipping(deals: DataFrame, as_of: dt.date) -> DataFrame:
    """Open deals due this quarter with a warning sign: early stage, long in stage, or no recent activity."""
    signs = {
        "early_stage": F.col("stage").isin(*C.EARLY_STAGES),
        "long_in_stage": F.col("days_in_stage") > C.STUCK_DAYS,
        "no_activity": F.datediff(F.lit(as_of), F.col("last_activity_date")) > C.INACTIVE_DAYS,
    }
    due = open_deals(deals).filter(same_quarter(F.col("close_date"), as_of)).withColumns(signs)
    return due.filter("early_stage OR long_in_stage OR no_activity")


def total_quarter(deals: DataFrame, as_of: dt.date) -> DataFrame:
    due = open_deals(deals).filter(same_quarter(F.col("close_date"), as_of))
    return due.agg(F.sum("amount").cast(BIG_MONEY).alias("pipeline_amount"), F.count(F.lit(1)).alias("deal_count"))


def by_category(deals: DataFrame) -> DataFrame:
    return open_deals(deals).groupBy("forecast_category").agg(
        F.sum("amount").cast(BIG_MONEY).alias("amount"), F.count(F.lit(1)).alias("deal_count")
    )


def _committed(deals: DataFrame, as_of: dt.date) -> DataFrame:
    return open_deals(deals).filter(same_quarter(F.col("close_date"), as_of) & (F.col("forecast_category") == "Commit"))


def _period(as_of: dt.date) -> str:
    return f"{as_of.year}-Q{(as_of.month - 1) // 3 + 1}"


def commit_coverage_total(deals: DataFrame, latest_forecast: DataFrame, as_of: dt.date) -> DataFrame:
    """Open Commit amount of the quarter against all quota of that quarter."""
    quota = latest_forecast.filter(F.col("period") == _period(as_of)).agg(F.sum("quota").cast(BIG_MONEY))
    total = F.coalesce(F.sum("amount"), F.lit(0)).cast(BIG_MONEY).alias("commit_amount")
    both = _committed(deals, as_of).agg(total).withColumn("quota", quota.scalar())
    return both.withColumn("coverage", ratio(F.col("commit_amount"), F.col("quota")))


def commit_coverage(deals: DataFrame, latest_forecast: DataFrame, as_of: dt.date) -> DataFrame:
    """Open Commit amount of the quarter per owner against the owner's quota of that quarter."""
    period = _period(as_of)
    commit = _committed(deals, as_of).groupBy("owner_id").agg(F.sum("amount").cast(BIG_MONEY).alias("commit_amount"))
    quota = (
        latest_forecast.filter(F.col("period") == period)
        .groupBy("owner_id")
        .agg(F.sum("quota").cast(BIG_MONEY).alias("quota"))
    )
    both = quota.join(commit, "owner_id", "left")
    amount = F.coalesce("commit_amount", F.lit(0).cast(BIG_MONEY))
    return both.select("owner_id", amount.alias("commit_amount"), "quota", ratio(amount, F.col("quota")).alias("coverage"))


def win_rate(deals: DataFrame, keys: list[str]) -> DataFrame:
    won, lost = F.count_if(F.col("stage") == "Closed Won"), F.count_if(F.col("stage") == "Closed Lost")
    counted = deals.filter(F.col("stage").isin(*C.CLOSED_STAGES)).groupBy(*keys).agg(won.alias("won"), lost.alias("lost"))
    return counted.withColumn("win_rate", ratio(F.col("won"), F.col("won") + F.col("lost")))


def win_rate_by_industry(deals: DataFrame, accounts: DataFrame) -> DataFrame:
    """Counts per account come first, so the join moves one row per account."""
    per_account = win_rate(deals, ["account_id"])
    joined = per_account.join(accounts.select("account_id", "industry"), "account_id")
    sums = joined.groupBy("industry").agg(F.sum("won").alias("won"), F.sum("lost").alias("lost"))
    return sums.withColumn("win_rate", ratio(F.col("won"), F.col("won") + F.col("lost")))


def forecast_vs_quota(latest_forecast: DataFrame) -> DataFrame:
    sums = [F.sum(c).cast(BIG_MONEY).alias(c) for c in ("committed", "closed_won", "quota")]
    totals = latest_forecast.groupBy("period", "segment").agg(*sums)
    return totals.withColumn("attainment", ratio(F.col("closed_won"), F.col("quota")))


def reps_behind_quota(latest_forecast: DataFrame, period: str) -> DataFrame:
    per_owner = (
        latest_forecast.filter(F.col("period") == period)
        .groupBy("owner_id")
        .agg(F.sum("closed_won").cast(BIG_MONEY).alias("closed_won"), F.sum("quota").cast(BIG_MONEY).alias("quota"))
        .withColumn("attainment", ratio(F.col("closed_won"), F.col("quota")))
    )
    return per_owner.filter("quota > 0 AND closed_won < quota")


def avg_days_in_stage(deals: DataFrame, accounts: DataFrame, segment: str | None = None) -> DataFrame:
    """Average days in stage per stage and segment, from sums per account taken before the join."""
    per_account = deals.groupBy("account_id", "stage").agg(F.sum("days_in_stage").alias("days"), F.count(F.lit(1)).alias("n"))
    chosen = accounts.select("account_id", "segment")
    if segment:
        chosen = chosen.filter(F.col("segment") == segment)
    return (
        per_account.join(chosen, "account_id")
        .groupBy("segment", "stage")
        .agg(F.sum("n").alias("deal_count"), F.round(F.sum("days") / F.sum("n"), 4).alias("avg_days"))
    )


def activity_per_rep(deals: DataFrame) -> DataFrame:
    week = F.date_trunc("week", "last_activity_date").cast("date")
    return deals.groupBy(week.alias("week"), "owner_id").agg(F.count(F.lit(1)).alias("activities"))


def acv_closed(deals: DataFrame, as_of: dt.date) -> DataFrame:
    """ACV won in the quarter and ACV of open deals closing in the month, in one pass."""
    won = (F.col("stage") == "Closed Won") & same_quarter(F.col("close_date"), as_of)
    closing = ~F.col("stage").isin(*C.CLOSED_STAGES) & same_month(F.col("close_date"), as_of)
    total = lambda flag: F.coalesce(F.sum(F.when(flag, F.col("acv"))), F.lit(0)).cast(BIG_MONEY)
    return deals.filter(same_quarter(F.col("close_date"), as_of)).agg(
        total(won).alias("acv_won_quarter"), total(closing).alias("acv_closing_month")
    )


def forecast_accuracy(snapshots: DataFrame, latest: DataFrame) -> DataFrame:
    """First commitment of a period and segment against what was won by its last snapshot."""
    first_day = snapshots.groupBy("period", "segment").agg(F.min("snapshot_date").alias("first_day"))
    forecast = (
        snapshots.join(first_day, ["period", "segment"])
        .filter("snapshot_date = first_day")
        .groupBy("period", "segment")
        .agg(F.sum("committed").cast(BIG_MONEY).alias("forecast"))
    )
    actual = latest.groupBy("period", "segment").agg(F.sum("closed_won").cast(BIG_MONEY).alias("actual"))
    both = forecast.join(actual, ["period", "segment"])
    error = F.abs(F.col("actual") - F.col("forecast"))
    return both.withColumn("error_ratio", ratio(error, F.col("actual")))


def stage_changes(feed: DataFrame) -> DataFrame:
    """Updated deals whose stage differs between two versions; the feed carries ``old_stage``."""
    moved = feed.filter("change_type = 'update'")
    return moved.filter(~F.col("stage").eqNullSafe(F.col("old_stage"))).select(
        "opportunity_id", "old_stage", F.col("stage").alias("new_stage"), "forecast_category", "amount"
    )


def recomputed_forecast(moves: DataFrame, current: DataFrame) -> DataFrame:
    """Forecast totals of the categories touched by stage changes."""
    touched = moves.select("forecast_category").distinct()
    return by_category(current.join(touched, "forecast_category", "left_semi"))


