"""Text predicates and transforms as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotaflow import constants as C

# A word character is a letter, a digit or "_" in any script; the lookarounds act as a word boundary.
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def has_word(text: Column, alternatives: str) -> Column:
    """TRUE when one of the ``a|b|c`` alternatives occurs as a whole word, in any case."""
    return text.rlike(f"(?iu){_BEFORE}(?:{alternatives}){_AFTER}")


def has_stem(text: Column, alternatives: str) -> Column:
    """TRUE when a word starts with one of the alternatives, in any case."""
    return text.rlike(f"(?iu){_BEFORE}(?:{alternatives})")


def has_any(text: Column, terms: list[str]) -> Column:
    """TRUE when one of the terms occurs anywhere (substring test, case as given)."""
    return reduce(lambda a, b: a | b, [text.contains(t) for t in terms])


def route_query(query: Column, matcher=has_word) -> Column:
    """PIPELINE or CUSTOMER when exactly one keyword group occurs, else NULL (undecided)."""
    pipeline = matcher(query, C.PIPELINE_WORDS)
    customer = matcher(query, C.CUSTOMER_WORDS)
    return F.when(pipeline & ~customer, "PIPELINE").when(customer & ~pipeline, "CUSTOMER")


def normalise_label(label: Column, allowed: list[str], default: str) -> Column:
    """Trimmed upper-case label when allowed, else the default (also for NULL)."""
    cleaned = F.upper(F.btrim(label, F.lit(" \t\r\n")))
    return F.when(cleaned.isin(*allowed), cleaned).otherwise(default)


def classify_shortcut(query: Column) -> Column:
    """HYBRID / DOCS by substring rules, NULL when a classifier has to decide."""
    lowered = F.lower(query)
    document, metric = has_any(lowered, C.DOCUMENT_TERMS), has_any(lowered, C.METRIC_TERMS)
    return F.when(document & metric, "HYBRID").when(document, "DOCS")


def use_prebuilt_risk(query: Column) -> Column:
    return has_any(F.lower(query), C.RISK_TERMS) & ~query.contains("?")


def account_candidate(query: Column) -> Column:
    """First capitalised word of four or more characters right after a lead-in, lead-ins tried in order."""
    tries = []
    for lead_in in C.ACCOUNT_LEAD_INS:
        at = F.instr(F.lower(query), lead_in)
        rest = F.when(at > 0, F.substr(query, at + F.lit(len(lead_in))))
        word = F.regexp_replace(F.regexp_extract(rest, r"^\s*(\S+)", 1), r"[?.,]+$", "")
        initial = F.substr(word, F.lit(1), F.lit(1))
        tries.append(F.when((F.length(word) >= C.MIN_ACCOUNT_CHARS) & initial.rlike(r"^\p{Lu}"), word))
    return F.coalesce(*tries)


def sql_is_safe(sql: Column) -> Column:
    return ~has_word(sql, C.UNSAFE_SQL_WORDS)


def strip_fence(text: Column, language: str = "sql", any_case: bool = True) -> Column:
    """Drop a leading code fence of that language and a trailing fence."""
    opened = F.regexp_replace(text, rf"{'(?i)' if any_case else ''}^```{language}\s*", "")
    return F.regexp_replace(opened, r"\s*```$", "")


def shown(value: Column, kind: str = "string") -> Column:
    """A value as a result text shows it: NULL prints None, booleans print True / False."""
    text = F.initcap(value.cast("string")) if kind == "boolean" else value.cast("string")
    return F.coalesce(text, F.lit("None"))


def first_chars(text: Column, n: int) -> Column:
    return F.substr(text, F.lit(1), F.lit(n))
