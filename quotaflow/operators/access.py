"""Row filter and column mask as plain DataFrame views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaflow.session import run_folder


def everyone_below(lines: DataFrame, start: DataFrame) -> DataFrame:
    """All pairs (origin, member) that follow from the pairs of ``start`` by reporting ``lines`` (manager, member).

    Each round looks one level further from the pairs found last, and goes on only with new ones, so circles end it too. The
    rounds are as many as the levels; each is written to the shared folder once. Pairs with a null are left out.
    """
    spark, root, paths = start.sparkSession, run_folder(start.sparkSession, "lines"), []
    schema = start.select("origin", "member").schema
    found = start.select("origin", "member").dropna().distinct()
    further = lines.select(F.col("manager").alias("member"), F.col("member").alias("below")).dropna().distinct()
    while True:
        paths.append(f"{root}/{len(paths)}")
        found.write.parquet(paths[-1])
        last, known = spark.read.schema(schema).parquet(paths[-1]), spark.read.schema(schema).parquet(*paths)
        if last.isEmpty():
            return known
        step = last.join(further, "member").select("origin", F.col("below").alias("member")).distinct()
        found = step.join(known, ["origin", "member"], "left_anti")


def entitled_owners(entitlements: DataFrame, lines: DataFrame, viewer: str | None = None) -> DataFrame:
    """(viewer, owner_id): the owners that a viewer, or a manager on any level below, is entitled to. Of one viewer or of all."""
    viewers = entitlements.select("viewer").union(lines.select("manager")).dropna().distinct()
    viewers = viewers if viewer is None else viewers.filter(F.col("viewer") == viewer)
    start = viewers.select(F.col("viewer").alias("origin"), F.col("viewer").alias("member"))
    below = everyone_below(lines, start).select("origin", F.col("member").alias("viewer"))
    return below.join(entitlements, "viewer").select(F.col("origin").alias("viewer"), "owner_id").dropna().distinct()


def visible_rows(
    df: DataFrame, viewer: str, role: str, entitlements: DataFrame | None = None, owner: str = "owner_id", lines: DataFrame | None = None
) -> DataFrame:
    """Leaders see every row, managers the rows of the owners they are entitled to, reps their own rows.

    With reporting ``lines`` (manager, member) a manager also sees what the managers on all levels below see.
    """
    if role == "leader":
        return df
    if role == "manager":
        own = entitlements.filter(F.col("viewer") == viewer) if lines is None else entitled_owners(entitlements, lines, viewer)
        team = own.select(F.col("owner_id").alias(owner)).distinct()
        return df.join(team, owner, "left_semi")
    return df.filter(F.col(owner) == viewer)


def mask_columns(df: DataFrame, columns: list[str], role: str, allowed: tuple[str, ...] = ("finance", "leader")) -> DataFrame:
    """Columns become NULL unless the role may read them."""
    if role in allowed:
        return df
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in columns})
