"""Change-event parsing, quality rules and current state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotaflow import constants as C
from quotaflow.functions.metrics import lenient
from quotaflow.operators.ranking import top_per_key

ENTITY_FIELDS = {"opportunity": C.OPPORTUNITY_FIELDS, "account": C.ACCOUNT_FIELDS}
ENTITY_KEY = {"opportunity": "opportunity_id", "account": "account_id"}
# Only opportunities have a delete rule; an account event of type DELETE updates the row like any other.
ENTITY_DELETES = {"opportunity": True, "account": False}


def parse_events(raw: DataFrame, entity: str) -> DataFrame:
    """Raw JSON texts -> typed rows. An unreadable text or value becomes NULL; other input columns are kept."""
    fields = ENTITY_FIELDS[entity]
    payload = ", ".join(f"`{source}` string" for source, _, _ in fields)
    parsed = raw.withColumn("_data", F.from_json("raw_json", payload))
    typed = [lenient(F.col("_data")[source], kind).alias(column) for source, column, kind in fields]
    kept = [c for c in raw.columns if c != "raw_json"]
    return parsed.select(*typed, *kept)


def quality_rules(entity: str) -> dict[str, Column]:
    key = ENTITY_KEY[entity]
    rules = {f"valid_{key}": F.col(key).isNotNull()}
    if entity == "opportunity":
        rules["valid_event_type"] = F.col("event_type").isin(*C.CDC_EVENT_TYPES)
    return rules


def keep_valid(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows for which every rule is TRUE; a rule that is NULL drops the row."""
    return df.filter(reduce(lambda a, b: a & b, rules.values()))


def rule_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations per rule in one pass: (rule, violations, total_rows)."""
    counts = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"_v{i}") for i, rule in enumerate(rules.values())]
    totals = df.agg(F.count(F.lit(1)).alias("total_rows"), *counts)
    pairs = [F.struct(F.lit(name).alias("rule"), F.col(f"_v{i}").alias("violations")) for i, name in enumerate(rules)]
    return totals.select(F.explode(F.array(*pairs)).alias("r"), "total_rows").select("r.rule", "r.violations", "total_rows")


def observed(df: DataFrame, rules: dict[str, Column], name: str = "quality") -> DataFrame:
    """The same rows, with violation counts per rule reported as metrics of each run or micro-batch."""
    counts = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(rule_name) for rule_name, rule in rules.items()]
    return df.observe(name, F.count(F.lit(1)).alias("total_rows"), *counts)


def latest_events(events: DataFrame, key: str, sequence: str = "updated_at", tie: str = "kafka_offset") -> DataFrame:
    """Newest event per key. Without a readable sequence an event never beats one that has it."""
    return top_per_key(events, [key], [F.col(sequence).desc_nulls_last(), F.col(tie).desc_nulls_last()])


def current_rows(events: DataFrame, key: str, deletes: bool, sequence: str = "updated_at", tie: str = "kafka_offset") -> DataFrame:
    """Current state (one row per key) from all events; with a delete rule a last DELETE removes the key."""
    latest = latest_events(events, key, sequence, tie)
    return latest.filter(~F.col("event_type").eqNullSafe("DELETE")) if deletes else latest
