"""Shared pieces of the query registry: entries, fixed dates, oracle texts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from quotaflow.plans.views import Inputs, oracle_cte

AS_OF_DATE = dt.date(2001, 5, 1)
AS_OF_TS = dt.datetime(2024, 1, 31)
PERIOD = "2001-Q2"
DAILY_BUDGET = 5.0

# Word boundary of the oracle engine, which has no lookarounds.
WORD = r"(^|[^\p{L}\p{N}_])(%s)($|[^\p{L}\p{N}_])"


@dataclass(frozen=True)
class Entry:
    """A registered query: how Spark runs it, and the SQL another engine checks it with (None: rows only)."""

    run: Callable[[Inputs], DataFrame]
    sql: str | None = None


def oracle(views: list[str], body: str, ctes: str = "", recursive: bool = False) -> str:
    parts = [oracle_cte(v) for v in views]
    if ctes:
        parts.append(ctes)
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}" if parts else body
