"""Scores, bands, costs and parsed judge outputs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotaflow import constants as C
from quotaflow.functions.text import strip_fence

_EXACT = "decimal(10,2)"


def _confidence(penalties: list[tuple[Column, str]]) -> Column:
    """0.9 minus the penalties that apply, at least 0.1; exact decimals, so no binary rounding noise."""
    score = F.lit("0.90").cast(_EXACT)
    for applies, amount in penalties:
        score = score - F.when(applies, F.lit(amount).cast(_EXACT)).otherwise(F.lit("0.00").cast(_EXACT))
    return F.greatest(score, F.lit("0.10").cast(_EXACT)).cast("double")


def confidence_pipeline(context: Column, sql_success: Column) -> Column:
    lowered = F.lower(context)
    return _confidence(
        [
            (~F.coalesce(sql_success, F.lit(True)), "0.20"),
            (lowered.contains("no data"), "0.20"),
            (lowered.contains("no results"), "0.10"),
        ]
    )


def confidence_customer(context: Column, sql_success: Column, classification: Column) -> Column:
    lowered = F.lower(context)
    return _confidence(
        [
            (~F.coalesce(sql_success, F.lit(True)), "0.20"),
            (lowered.contains("no data") | lowered.contains("no results"), "0.15"),
            (lowered.contains("no relevant documents") & classification.isin("DOCS", "HYBRID"), "0.10"),
        ]
    )


def score_band(score: Column) -> Column:
    return F.when(score >= C.BAND_GREEN, "green").when(score >= C.BAND_AMBER, "amber").otherwise("red")


def job_band(score: Column) -> Column:
    return F.when(score >= C.JOB_BAND_GREEN, "green").when(score >= C.JOB_BAND_AMBER, "amber").otherwise("grey")


def token_cost(input_tokens: Column, output_tokens: Column) -> Column:
    return (
        input_tokens.cast("double") / 1e6 * C.USD_PER_M_INPUT
        + output_tokens.cast("double") / 1e6 * C.USD_PER_M_OUTPUT
    )


def json_object(text: Column) -> Column:
    """A text that is one whole JSON object, as a variant; NULL for anything else."""
    trimmed = F.btrim(text, F.lit(" \t\r\n"))
    return F.try_parse_json(F.when(trimmed.rlike(r"^\{[\s\S]*\}$"), trimmed))


def _field(document: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(document, f"$.{name}", kind)


def _field_type(document: Column, name: str) -> Column:
    return F.schema_of_variant(_field(document, name, "variant"))


def verdict_document(raw: Column, response: Column, context: Column) -> Column:
    """Judge output as a variant; NULL for blank inputs and unreadable outputs."""
    blank = ~response.rlike(r"\S") | ~context.rlike(r"\S")
    return json_object(F.when(~blank, strip_fence(F.btrim(raw, F.lit(" \t\r\n")), "json", any_case=False)))


def with_verdict(df: DataFrame) -> DataFrame:
    """Replaces raw, response and context by the verdict columns; without a readable verdict all is grounded.

    The text is parsed in a step of its own, once for all columns.
    """
    kept = [c for c in df.columns if c not in ("raw", "response", "context")]
    parsed = df.select(*kept, verdict_document(F.col("raw"), F.col("response"), F.col("context")).alias("_doc"))
    doc = F.col("_doc")
    return parsed.select(
        *kept,
        F.coalesce(_field(doc, "score", "double"), F.lit(1.0)).alias("score"),
        F.coalesce(_field(doc, "total_claims", "int"), F.lit(0)).alias("total_claims"),
        F.coalesce(_field(doc, "supported_claims", "int"), F.lit(0)).alias("supported_claims"),
        F.coalesce(_field(doc, "unsupported_claims", "array<string>"), F.array().cast("array<string>")).alias("unsupported_claims"),
    )


def with_job_score(df: DataFrame, raw: str) -> DataFrame:
    """Replaces the raw scoring output by score, score_reason and is_disqualified.

    A JSON number is taken as it is, of a JSON string only the leading integer counts, all else is 0. An output
    that is not a JSON object is not scored. Only the JSON value true disqualifies.
    """
    kept = [c for c in df.columns if c != raw]
    parsed = F.col("_doc")
    kind = _field_type(parsed, "score")
    leading = F.regexp_extract(_field(parsed, "score", "string"), r"^\s*([+-]?\d+)", 1).try_cast("double")
    number = F.when(kind == "STRING", leading).when(kind != "BOOLEAN", _field(parsed, "score", "double"))
    flag = (_field_type(parsed, "is_disqualified") == "BOOLEAN") & (_field(parsed, "is_disqualified", "string") == "true")
    return df.select(*kept, json_object(F.col(raw)).alias("_doc")).select(
        *kept,
        F.coalesce(number, F.lit(0.0)).alias("score"),
        F.when(parsed.isNull(), C.NOT_SCORED)
        .otherwise(F.coalesce(_field(parsed, "reason", "string"), F.lit("")))
        .alias("score_reason"),
        F.coalesce(flag, F.lit(False)).alias("is_disqualified"),
    )
