"""Job matching: search responses -> items -> first seen -> scored -> digest and CSV rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotaflow import constants as C
from quotaflow.functions.scores import job_band, with_job_score
from quotaflow.functions.text import first_chars
from quotaflow.operators.ranking import global_numbers, top_per_key

RESPONSE_ITEMS = (
    "array<struct<title:string, company_name:string, location:string, salary:string, description:string, "
    "highlights:array<struct<title:string, items:array<string>>>, apply_options:array<struct<link:string>>, "
    "detected_extensions:struct<salary:string, posted_at:string>>>"
)
ORDER = ["query_idx", "pos"]


def search_queries(profiles: DataFrame, queries: str = "search_queries") -> DataFrame:
    """The first 12 queries of each profile as rows."""
    kept = [c for c in profiles.columns if c != queries]
    return profiles.select(*kept, F.posexplode(F.slice(queries, 1, C.JOB_MAX_QUERIES)).alias("query_idx", "q"))


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _or_blank(*texts: Column) -> Column:
    return F.coalesce(*[_filled(t) for t in texts], F.lit(""))


def percent_encoded(text: Column) -> Column:
    """URI-component encoding: letters, digits and -_.!~*'() stay."""
    encoded = F.url_encode(text)
    for found, shown in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(found), F.lit(shown))
    return encoded


def apply_url(options: Column, title: Column, company: Column) -> Column:
    words = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(company, F.lit("")), F.lit(" job"))
    return F.coalesce(_filled(F.get(options, F.lit(0))["link"]), F.concat(F.lit(C.JOB_SEARCH_URL), percent_encoded(words)))


def highlights_text(highlights: Column) -> Column:
    lines = F.transform(
        highlights,
        lambda h: F.concat(
            F.coalesce(h["title"], F.lit("undefined")), F.lit(": "),
            F.array_join(F.coalesce(h["items"], F.array().cast("array<string>")), ", "),
        ),
    )
    return F.coalesce(F.array_join(lines, " | "), F.lit(""))


def flatten(responses: DataFrame) -> DataFrame:
    """One row per found job; the position is the response number and the place within the response."""
    items = responses.select("query_idx", "response_no", F.posexplode("jobs_results").alias("item_no", "j"))
    j = F.col("j")
    snippet = F.concat_ws(" | ", _filled(j["description"]), _filled(highlights_text(j["highlights"])))
    return items.select(
        "query_idx", "response_no", "item_no",
        _or_blank(j["title"]).alias("title"),
        _or_blank(j["company_name"]).alias("company"),
        _or_blank(j["location"]).alias("location"),
        _or_blank(j["salary"], j["detected_extensions"]["salary"]).alias("salary"),
        _or_blank(j["detected_extensions"]["posted_at"]).alias("posted"),
        apply_url(j["apply_options"], j["title"], j["company_name"]).alias("url"),
        first_chars(snippet, C.JOB_SNIPPET_CHARS).alias("snippet"),
    )


def first_seen(items: DataFrame, order: list[str] = ORDER) -> DataFrame:
    """First item per title and company, in any case."""
    key = F.lower(F.concat(F.col("title"), F.lit("|"), F.col("company")))
    return top_per_key(items.withColumn("_key", key), ["_key"], [F.col(c).asc() for c in order]).drop("_key")


def prompt(items: DataFrame, profile: dict, model: str = "default", max_tokens: int = 150) -> DataFrame:
    """Adds the scoring request body of each job."""
    task = (
        "You rate how well a job fits a candidate. Answer with JSON only: "
        '{"score": <integer 1-10>, "reason": "<one sentence>", "is_disqualified": <true or false>}'
    )
    about = (
        f"Candidate: {profile['summary']} Skills: {', '.join(profile['skills'])}. "
        f"Rule out: {', '.join(profile['disqualifiers'])}.\n"
    )
    salary = F.coalesce(_filled(F.col("salary")), F.lit("not listed"))
    body = F.concat(
        F.lit(about), F.lit("Job: "), "title", F.lit(" at "), "company", F.lit(". Location: "), "location",
        F.lit(". Salary: "), salary, F.lit(". Description: "), "snippet",
    )
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    request = F.struct(
        F.lit(model).alias("model"),
        F.lit(max_tokens).alias("max_tokens"),
        F.array(message("system", F.lit(task)), message("user", body)).alias("messages"),
    )
    return items.withColumn("score_request", F.to_json(request))


def merge_by_index(left: DataFrame, right: DataFrame, left_order: Column, right_order: Column, ties: tuple[list[str], list[str]]) -> DataFrame:
    """Item i of the left with item i of the right, columns side by side."""
    a = global_numbers(left, left_order, ties[0])
    b = global_numbers(right, right_order, ties[1])
    return a.join(b, "position")


def scored(items: DataFrame, raw: str = "score_raw") -> DataFrame:
    """Parsed score columns in place of the raw output."""
    return with_job_score(items, raw)


def matches(scored_items: DataFrame) -> DataFrame:
    """Score 5 or more. Disqualified items are not left out here; the flag is only reported."""
    return scored_items.filter(F.col("score") >= C.JOB_MIN_SCORE)


def number_text(value: Column) -> Column:
    """7.0 as 7, 7.5 as 7.5."""
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))


def collected(rows: DataFrame, order: Column, ties: list[str], line: Column, page_rows: int = 500) -> DataFrame:
    """All rows gathered in order, as pages of 500 lines, so that no task holds the whole list."""
    numbered = global_numbers(rows.withColumn("_line", line), order, ties)
    page = F.floor(F.col("position") / page_rows).cast("long")
    lines = F.sort_array(F.collect_list(F.struct("position", "_line")))
    paged = numbered.groupBy(page.alias("page")).agg(lines.alias("_lines"))
    return paged.select(
        "page", F.size("_lines").alias("items"), F.array_join(F.transform("_lines", lambda x: x["_line"]), "\n").alias("lines")
    )


def top_ranked(rows: DataFrame, n: int = C.JOB_TOP, order: list[str] = ORDER) -> DataFrame:
    """Best n by score; equal scores keep the incoming order. Rank and band are added to at most n rows."""
    best = rows.orderBy(F.col("score").desc(), *order).limit(n)
    listed = best.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("_neg"), *order, F.struct("*").alias("_row")))).alias("_all"))
    ranked = listed.select(F.posexplode("_all").alias("_i", "_x")).select((F.col("_i") + 1).alias("rank"), "_x._row.*")
    return ranked.withColumn("band", job_band(F.col("score")))


def digest(match_rows: DataFrame, day: dt.date, title: str = "Job matches", order: list[str] = ORDER) -> DataFrame:
    """One row (subject, body): the count of all matches and the best 30 as text."""
    day_text = f"{day:%A}, {day:%B} {day.day}, {day.year}"
    optional = lambda label, c: F.when(F.col(c) != "", F.concat(F.lit(label), F.col(c)))
    entry = F.concat_ws(
        "\n",
        F.concat(F.col("rank").cast("string"), F.lit(". "), "title"),
        F.concat(
            F.col("company"), F.lit(" - "), F.when(F.col("location") != "", F.col("location")).otherwise("Remote"),
            F.coalesce(optional(" - Posted: ", "posted"), F.lit("")),
        ),
        F.concat(F.lit("Score: "), number_text(F.col("score")), F.lit("/10 ("), "band", F.lit(")")),
        optional("Salary: ", "salary"),
        optional("", "score_reason"),
        F.col("url"),
    )
    cards = top_ranked(match_rows, order=order).agg(
        F.sort_array(F.collect_list(F.struct("rank", entry.alias("text")))).alias("_cards"), F.count(F.lit(1)).alias("shown")
    )
    counted = cards.withColumn("n", match_rows.agg(F.count(F.lit(1))).scalar())
    n = F.col("n").cast("string")
    noun = F.when(F.col("n") == 1, " match").otherwise(" matches")
    shown = F.when(F.col("shown") < F.col("n"), F.concat(F.lit(" (showing top "), F.col("shown").cast("string"), F.lit(")"))).otherwise("")
    return counted.select(
        F.when(F.col("n") == 0, F.lit(f"{title}: No matches — {day_text}"))
        .otherwise(F.concat(F.lit(f"{title}: "), n, noun, F.lit(f" (5+) — {day_text}")))
        .alias("subject"),
        F.when(F.col("n") == 0, F.lit("No jobs scored 5 or above today."))
        .otherwise(
            F.concat(
                F.lit("Found "), n, noun, F.lit(" scoring 5+ this week"), shown, F.lit(", sorted by score.\n\n"),
                F.array_join(F.transform("_cards", lambda x: x["text"]), "\n\n"),
            )
        )
        .alias("body"),
    )


def csv_fields(rows: DataFrame, columns: list[str] = C.JOB_CSV_COLUMNS) -> list[Column]:
    """Columns as CSV shows them: one line each, and nothing for NULL, blank, 0 and false."""
    fields = []
    for name in columns:
        kind, value = rows.schema[name].dataType.simpleString(), F.col(name)
        if kind == "boolean":
            text = F.when(value, "true")
        elif kind == "string":
            text = F.replace(value, F.lit("\n"), F.lit(" "))
        else:
            text = F.when(value != 0, number_text(value))
        fields.append(F.coalesce(text, F.lit("")).alias(name))
    return fields


def csv_line(rows: DataFrame, columns: list[str] = C.JOB_CSV_COLUMNS) -> Column:
    quoted = [F.concat(F.lit('"'), F.replace(f, F.lit('"'), F.lit('""')), F.lit('"')) for f in csv_fields(rows, columns)]
    return F.concat_ws(",", *quoted)

