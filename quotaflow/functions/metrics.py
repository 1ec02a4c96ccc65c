"""Guarded ratios, calendar parts and lenient casts as column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def money(value: Column) -> Column:
    return value.cast(MONEY)


def ratio(numerator: Column, denominator: Column, digits: int | None = 4) -> Column:
    """numerator / denominator as DOUBLE, NULL when the denominator is not positive."""
    value = F.when(denominator > 0, numerator.cast("double") / denominator.cast("double"))
    return value if digits is None else F.round(value, digits)


def same_quarter(day: Column, as_of: dt.date) -> Column:
    """Range test on the plain column, so that it can be pushed into the scan."""
    start = dt.date(as_of.year, 3 * ((as_of.month - 1) // 3) + 1, 1)
    end = dt.date(start.year + (start.month + 3 > 12), (start.month + 2) % 12 + 1, 1)
    return (day >= F.lit(start)) & (day < F.lit(end))


def same_month(day: Column, as_of: dt.date) -> Column:
    start = as_of.replace(day=1)
    end = dt.date(start.year + (start.month == 12), start.month % 12 + 1, 1)
    return (day >= F.lit(start)) & (day < F.lit(end))


def lenient_int(text: Column) -> Column:
    """Whole number of a numeric text; digits after the point are cut, anything else is NULL."""
    return F.regexp_replace(F.trim(text), r"^([+-]?\d+)\.\d*$", "$1").try_cast("int")


def lenient(text: Column, kind: str) -> Column:
    """Typed value of a payload text, NULL when it does not parse."""
    if kind == "money":
        return text.try_cast(MONEY)
    if kind == "int":
        return lenient_int(text)
    if kind == "date":
        return F.try_to_date(text, "yyyy-MM-dd")
    if kind == "timestamp":
        return F.try_to_timestamp(text)
    return text
