"""Keyed table maintenance: upsert, replace by predicate, change feed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_unique(df: DataFrame, key: str) -> None:
    """Fail when a key occurs twice, as MERGE does for ambiguous source rows."""
    repeated = df.groupBy(key).count().filter("count > 1").select(key).limit(1).collect()
    if repeated:
        raise ValueError(f"source has several rows for {key} = {repeated[0][0]!r}")


def upsert(target: DataFrame, source: DataFrame, key: str, checked: bool = True) -> DataFrame:
    """Matched rows take the source's non-key columns, unmatched rows of either side stay."""
    if checked:
        require_unique(source, key)
    kept = target.join(source.select(key), key, "left_anti")
    return kept.unionByName(source.select(*target.columns))


def replace_where(target: DataFrame, source: DataFrame, replaced: Column) -> DataFrame:
    """Target rows for which the predicate holds are exchanged for the source rows."""
    return target.filter(~F.coalesce(replaced, F.lit(False))).unionByName(source.select(*target.columns))


def change_feed(old: DataFrame, new: DataFrame, key: str, keep_old: tuple[str, ...] = ()) -> DataFrame:
    """One row per inserted, updated or deleted key between two versions of a table.

    The row carries the new values, for a delete the old ones. Unchanged rows do not appear. Columns named in
    ``keep_old`` also come with their earlier value as ``old_<name>``.
    """
    values = [c for c in new.columns if c != key]
    before = old.select(key, F.struct(*values).alias("_old"))
    after = new.select(key, F.struct(*values).alias("_new"))
    both = before.join(after, key, "full")
    same = reduce(lambda a, b: a & b, [F.col("_old")[c].eqNullSafe(F.col("_new")[c]) for c in values])
    kind = (
        F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(~same, "update")
    )
    shown = F.coalesce(F.col("_new"), F.col("_old"))
    earlier = [F.col("_old")[c].alias(f"old_{c}") for c in keep_old]
    rows = both.select(key, kind.alias("change_type"), *[shown[c].alias(c) for c in values], *earlier)
    return rows.filter("change_type IS NOT NULL")


def apply_changes(old: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    """Old version plus a change feed gives the new version."""
    kept = old.join(feed.select(key), key, "left_anti")
    return kept.unionByName(feed.filter("change_type <> 'delete'").select(*old.columns))
