"""Job matching."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quotaflow import constants as C
from quotaflow.functions.scores import job_band
from quotaflow.plans import jobs as J
from quotaflow.plans.views import Inputs
from quotaflow.registry.common import Entry, oracle
from quotaflow.session import run_folder
from quotaflow.sinks.tables import write_csv
from quotaflow.sources.documents import parse_search_responses

DAY = dt.date(2024, 1, 31)
DAY_TEXT = "Wednesday, January 31, 2024"
PER_RESPONSE = 10
ITEM_ORDER = ["query_idx", "response_no", "item_no"]
JOBS = ["job_results"]


def response_texts(i: Inputs):
    """Search responses as files of JSON lines, ten results each, as a search service returns them."""
    options = F.when(F.col("link") != "", F.array(F.struct(F.col("link").alias("link"))))
    highlights = F.array(F.struct(F.lit("Benefits").alias("title"), F.array("location", "posted").alias("items")))
    found = F.when(F.col("pos") % 6 == 0, "90K a year")
    item = F.struct(
        "title", F.col("company").alias("company_name"), "location", F.nullif("salary", F.lit("")).alias("salary"), "description",
        highlights.alias("highlights"), options.alias("apply_options"), F.struct(found.alias("salary"), F.nullif("posted", F.lit("")).alias("posted_at")).alias("detected_extensions"),
    )
    rows = i.job_results.select("query_idx", F.floor(F.col("pos") / (12 * PER_RESPONSE)).alias("response_no"), F.struct("pos", item.alias("item")).alias("x"))
    grouped = rows.groupBy("query_idx", "response_no").agg(F.sort_array(F.collect_list("x")).alias("x"))
    response = F.struct(
        F.concat(F.lit("query "), F.col("query_idx").cast("string")).alias("search_query"), "query_idx", "response_no", F.transform("x", lambda x: x["item"]).alias("jobs_results")
    )
    path = f"{run_folder(i.spark, 'responses')}/responses"
    grouped.select(F.to_json(response).alias("value")).write.text(path)
    return i.spark.read.text(path)


def _items(i: Inputs):
    return J.flatten(parse_search_responses(response_texts(i)))


def _profiles(i: Inputs):
    """One profile per customer: its distinct order years and priorities (35 at most) are the queries."""
    words = F.concat(F.year("o_orderdate").cast("string"), F.lit(" "), "o_orderpriority")
    asked = i.orders.select(F.col("o_custkey").alias("profile_id"), words.alias("q")).distinct()
    return asked.groupBy("profile_id").agg(F.sort_array(F.collect_list("q")).alias("search_queries"))


def _scored(i: Inputs):
    return J.scored(i.job_results.withColumnRenamed("link", "url"))


def _merged(i: Inputs):
    items = i.job_results.select("title", "company", "query_idx", "pos")
    outputs = i.job_results.select("score_raw", F.col("query_idx").alias("o_idx"), F.col("pos").alias("o_pos"))
    place = lambda idx, pos: F.col(idx).cast("long") * 1_000_000_000_000 + F.col(pos)
    pairs = J.merge_by_index(items, outputs, place("query_idx", "pos"), place("o_idx", "o_pos"), (["pos"], ["o_pos"]))
    return pairs.select("position", "title", "company", "pos", "score_raw")


def _prompts(i: Inputs):
    profile = {"summary": "Leads data teams.", "skills": ["SQL", "Python"], "disqualifiers": ["intern"]}
    return J.prompt(_items(i), profile).select(*ITEM_ORDER, "score_request")


_PAGE = "CAST(floor(pos / 120) AS BIGINT)"
_URL = (
    "CASE WHEN link <> '' THEN link ELSE concat('https://www.google.com/search?q=', replace(replace(replace(replace(replace(url_encode(concat(title, ' ', company, ' job')), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')) END"
)
_ITEMS = (
    f"items AS (SELECT query_idx, {_PAGE} AS response_no, CAST(row_number() OVER (PARTITION BY query_idx, {_PAGE} ORDER BY pos) - 1 AS INTEGER) AS item_no, title, company, location, "
    "CASE WHEN salary <> '' THEN salary WHEN pos % 6 = 0 THEN '90K a year' ELSE '' END AS salary, posted, "
    f"{_URL} AS url, left(concat(description, ' | ', 'Benefits: ', location, ', ', posted), 400) AS snippet FROM job_results)"
)
_FIRST = (
    "firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(concat(title, '|', company)) ORDER BY query_idx, response_no, item_no) AS rn FROM items) WHERE rn = 1)"
)
_OK = "json_valid(score_raw)"
_SCORED = (
    "scored AS (SELECT title, company, location, salary, link AS url, posted, pos, query_idx, coalesce(CASE WHEN ok AND json_type(j, '$.score') = 'VARCHAR' THEN TRY_CAST(nullif(regexp_extract(j ->> '$.score', '^\\s*([+-]?\\d+)', 1), '') AS DOUBLE) "
    "WHEN ok THEN CAST(j ->> '$.score' AS DOUBLE) END, 0.0) AS score, CASE WHEN ok THEN coalesce(j ->> '$.reason', '') ELSE 'not scored' END AS score_reason, "
    "coalesce(ok AND json_type(j, '$.is_disqualified') = 'BOOLEAN' AND (j ->> '$.is_disqualified') = 'true', false) AS is_disqualified "
    f"FROM (SELECT *, {_OK} AS ok, CASE WHEN {_OK} THEN CAST(score_raw AS JSON) END AS j FROM job_results)), "
    "matched AS (SELECT * FROM scored WHERE score >= 5), "
    "best AS (SELECT *, CASE WHEN score >= 8 THEN 'green' WHEN score >= 6 THEN 'amber' ELSE 'grey' END AS band FROM (SELECT *, row_number() OVER (ORDER BY score DESC, query_idx, pos) AS rank FROM matched) WHERE rank <= 30)"
)
_NUM = "CASE WHEN score = floor(score) THEN CAST(CAST(score AS BIGINT) AS VARCHAR) ELSE CAST(score AS VARCHAR) END"


def _quoted(text: str) -> str:
    return f"concat('\"', replace(coalesce({text}, ''), '\"', '\"\"'), '\"')"


def _csv_sql() -> str:
    plain = lambda c: f"replace({c}, chr(10), ' ')"
    fields = [plain(c) for c in ("title", "company", "location", "salary")]
    fields += [f"CASE WHEN score <> 0 THEN {_NUM} END", plain("score_reason"), plain("url"), plain("posted"), "CASE WHEN is_disqualified THEN 'true' END"]
    return "concat_ws(',', " + ", ".join(_quoted(f) for f in fields) + ")"


_CARD = (
    "concat_ws(chr(10), concat(CAST(rank AS VARCHAR), '. ', title), concat(company, ' - ', CASE WHEN location <> '' THEN location ELSE 'Remote' END, CASE WHEN posted <> '' THEN concat(' - Posted: ', posted) ELSE '' END), "
    f"concat('Score: ', {_NUM}, '/10 (', band, ')'), CASE WHEN salary <> '' THEN concat('Salary: ', salary) END, CASE WHEN score_reason <> '' THEN score_reason END, url)"
)

ENTRIES: dict[str, Entry] = {
    "src_search_json": Entry(
        lambda i: parse_search_responses(response_texts(i)).select("search_query", "query_idx", "response_no", F.size("jobs_results").alias("results")),
        oracle(
            JOBS,
            f"SELECT concat('query ', CAST(query_idx AS VARCHAR)) AS search_query, query_idx, {_PAGE} AS response_no, CAST(count(*) AS INTEGER) AS results FROM job_results GROUP BY 2, 3",
        ),
    ),
    "job_queries": Entry(
        lambda i: J.search_queries(_profiles(i)),
        "SELECT profile_id, CAST(rn - 1 AS INTEGER) AS query_idx, q FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY q) AS rn FROM "
        "(SELECT DISTINCT o_custkey AS profile_id, concat(CAST(year(o_orderdate) AS VARCHAR), ' ', o_orderpriority) AS q FROM orders)) WHERE rn <= 12",
    ),
    "job_flatten": Entry(_items, oracle(JOBS, "SELECT * FROM items", _ITEMS)),
    "union_search_results": Entry(
        lambda i: _items(i).select(*ITEM_ORDER, "title", "company", "url"), oracle(JOBS, "SELECT query_idx, response_no, item_no, title, company, url FROM items", _ITEMS)
    ),
    "apply_url": Entry(lambda i: _items(i).select(*ITEM_ORDER, "url"), oracle(JOBS, "SELECT query_idx, response_no, item_no, url FROM items", _ITEMS)),
    "highlights_text": Entry(
        lambda i: parse_search_responses(response_texts(i))
        .select("query_idx", "response_no", F.posexplode("jobs_results").alias("item_no", "j"))
        .select(*ITEM_ORDER, J.highlights_text(F.col("j.highlights")).alias("highlights")),
        oracle(
            JOBS,
            f"SELECT query_idx, {_PAGE} AS response_no, CAST(row_number() OVER (PARTITION BY query_idx, {_PAGE} ORDER BY pos) - 1 AS INTEGER) AS item_no, concat('Benefits: ', location, ', ', posted) AS highlights FROM job_results",
        ),
    ),
    "dedupe_first_seen": Entry(
        lambda i: J.first_seen(_items(i), ITEM_ORDER),
        oracle(JOBS, "SELECT * EXCLUDE (rn) FROM firsts", f"{_ITEMS}, {_FIRST}"),
    ),
    "job_prompt": Entry(
        _prompts,
        oracle(
            JOBS,
            "SELECT query_idx, response_no, item_no, CAST(to_json({'model': 'default', 'max_tokens': 150, 'messages': [{'role': 'system', 'content': 'You rate how well a job fits a candidate. Answer with JSON only: "
            "{\"score\": <integer 1-10>, \"reason\": \"<one sentence>\", \"is_disqualified\": <true or false>}'}, {'role': 'user', 'content': concat('Candidate: Leads data teams. Skills: SQL, Python. Rule out: intern.', chr(10), 'Job: ', title, ' at ', company, "
            "'. Location: ', location, '. Salary: ', CASE WHEN salary <> '' THEN salary ELSE 'not listed' END, '. Description: ', snippet)}]}) AS VARCHAR) AS score_request FROM items",
            _ITEMS,
        ),
    ),
    "merge_by_index": Entry(
        _merged,
        oracle(JOBS, "SELECT row_number() OVER (ORDER BY query_idx, pos) - 1 AS position, title, company, pos, score_raw FROM job_results"),
    ),
    "parse_score": Entry(
        lambda i: _scored(i).select("pos", "score", "score_reason", "is_disqualified"),
        oracle(JOBS, "SELECT pos, score, score_reason, is_disqualified FROM scored", _SCORED),
    ),
    "job_threshold": Entry(
        lambda i: J.matches(_scored(i)).select("pos", "title", "score", "is_disqualified"),
        oracle(JOBS, "SELECT pos, title, score, is_disqualified FROM matched", _SCORED),
    ),
    "job_band": Entry(
        lambda i: _scored(i).select("pos", job_band(F.col("score")).alias("band")),
        oracle(JOBS, "SELECT pos, CASE WHEN score >= 8 THEN 'green' WHEN score >= 6 THEN 'amber' ELSE 'grey' END AS band FROM scored", _SCORED),
    ),
    "collect_matches": Entry(
        lambda i: J.collected(
            J.matches(_scored(i)), F.col("query_idx").cast("long") * 1_000_000_000_000 + F.col("pos"), ["pos"], F.concat_ws(" | ", "title", "company", J.number_text(F.col("score")))
        ),
        oracle(
            JOBS,
            f"SELECT CAST(n // 500 AS BIGINT) AS page, CAST(count(*) AS INTEGER) AS items, string_agg(concat_ws(' | ', title, company, {_NUM}), chr(10) ORDER BY n) AS lines FROM (SELECT *, row_number() OVER (ORDER BY query_idx, pos) - 1 AS n FROM matched) GROUP BY 1",
            _SCORED,
        ),
    ),
    "digest_top30": Entry(
        lambda i: J.top_ranked(J.matches(_scored(i))).select("rank", "title", "company", "score", "band"),
        oracle(JOBS, "SELECT CAST(rank AS INTEGER) AS rank, title, company, score, band FROM best", _SCORED),
    ),
    "job_digest": Entry(
        lambda i: J.digest(J.matches(_scored(i)), DAY),
        oracle(
            JOBS,
            f"SELECT concat('Job matches: ', CAST(n AS VARCHAR), CASE WHEN n = 1 THEN ' match' ELSE ' matches' END, ' (5+) — {DAY_TEXT}') AS subject, concat('Found ', CAST(n AS VARCHAR), CASE WHEN n = 1 THEN ' match' ELSE ' matches' END, "
            f"' scoring 5+ this week', CASE WHEN n > 30 THEN ' (showing top 30)' ELSE '' END, ', sorted by score.', chr(10), chr(10), (SELECT string_agg({_CARD}, chr(10) || chr(10) ORDER BY rank) FROM best)) AS body FROM (SELECT count(*) AS n FROM matched)",
            _SCORED,
        ),
    ),
    "job_csv": Entry(
        lambda i: _csv(J.matches(_scored(i)), ["pos"]), oracle(JOBS, f"SELECT {_csv_sql()} AS line FROM matched", _SCORED)
    ),
    "sink_csv": Entry(lambda i: _csv(_scored(i)), oracle(JOBS, f"SELECT {_csv_sql()} AS line FROM scored", _SCORED)),
}


def _csv(rows, order=None):
    """The rows as CSV files, read back as lines; every file starts with the header."""
    path = f"{run_folder(rows.sparkSession, 'csv')}/csv"
    write_csv(rows, path, order=order)
    lines = rows.sparkSession.read.text(path).withColumnRenamed("value", "line")
    return lines.filter(F.replace("line", F.lit('"'), F.lit("")) != ",".join(C.JOB_CSV_COLUMNS))

job_items, ITEMS_CTE = _items, _ITEMS
