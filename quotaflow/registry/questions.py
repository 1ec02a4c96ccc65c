"""Routing, safety, context, confidence, conversation history, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotaflow import constants as C
from quotaflow.functions import scores, text as X
from quotaflow.plans import answers, deals
from quotaflow.plans.views import Inputs
from quotaflow.registry import metrics
from quotaflow.registry.common import WORD, Entry, oracle
from quotaflow.registry.documents import CHUNK_CTE, SEARCH_CHUNKS_CTE, searchable_chunks

Q = ["questions"]


def _any(column: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms) + ")"


def _word(column: str, words: str) -> str:
    return f"regexp_matches({column}, '{WORD % words}', 'i')"


def _stem(column: str, words: str) -> str:
    return rf"regexp_matches({column}, '(^|[^\p{{L}}\p{{N}}_])({words})', 'i')"


def _route(matcher, column: str = "query") -> str:
    p, c = matcher(column, C.PIPELINE_WORDS), matcher(column, C.CUSTOMER_WORDS)
    return f"CASE WHEN {p} AND NOT {c} THEN 'PIPELINE' WHEN {c} AND NOT {p} THEN 'CUSTOMER' END"


def _normal(column: str, allowed: list[str], default: str) -> str:
    listed = ", ".join(f"'{a}'" for a in allowed)
    return f"CASE WHEN upper(trim({column})) IN ({listed}) THEN upper(trim({column})) ELSE '{default}' END"


SHORTCUT = f"CASE WHEN {_any('lower(query)', C.DOCUMENT_TERMS)} THEN CASE WHEN {_any('lower(query)', C.METRIC_TERMS)} THEN 'HYBRID' ELSE 'DOCS' END END"
PREBUILT = f"({_any('lower(query)', C.RISK_TERMS)} AND NOT contains(query, '?'))"


def _candidate(lead_in: str) -> str:
    rest = f"substr(query, position('{lead_in}' IN lower(query)) + {len(lead_in)})"
    word = rf"regexp_replace(regexp_extract({rest}, '^\s*(\S+)', 1), '[?.,]+$', '')"
    return rf"CASE WHEN position('{lead_in}' IN lower(query)) > 0 AND length({word}) > 3 AND regexp_matches({word}, '^\p{{Lu}}') THEN {word} END"


ACCOUNT = f"coalesce({', '.join(_candidate(p) for p in C.ACCOUNT_LEAD_INS)})"


def _context(headings: tuple[str, str]) -> str:
    sql = f"CASE WHEN classification IN ('SQL', 'HYBRID') AND sql_text <> '' THEN concat('{headings[0]}', chr(10), sql_text) END"
    doc = f"CASE WHEN classification IN ('DOCS', 'HYBRID') AND doc_text <> '' THEN concat('{headings[1]}', chr(10), doc_text) END"
    return f"coalesce(nullif(concat_ws(chr(10) || chr(10), {sql}, {doc}), ''), 'No data available.')"


CONTEXT = f"CASE WHEN agent_type = 'pipeline_health' THEN {_context(C.PIPELINE_HEADINGS)} ELSE {_context(C.CUSTOMER_HEADINGS)} END"
_DEC = "CAST(CASE WHEN {0} THEN {1} ELSE 0 END AS DECIMAL(10,2))"
CONF_PIPELINE = (
    "CAST(greatest(CAST(0.1 AS DECIMAL(10,2)), CAST(0.9 AS DECIMAL(10,2)) - "
    + " - ".join(
        _DEC.format(*x) for x in (("NOT sql_success", "0.2"), ("contains(lower(context), 'no data')", "0.2"), ("contains(lower(context), 'no results')", "0.1"))
    )
    + ") AS DOUBLE)"
)
CONF_CUSTOMER = (
    "CAST(greatest(CAST(0.1 AS DECIMAL(10,2)), CAST(0.9 AS DECIMAL(10,2)) - "
    + " - ".join(
        _DEC.format(*x)
        for x in (
            ("NOT sql_success", "0.2"),
            ("contains(lower(context), 'no data') OR contains(lower(context), 'no results')", "0.15"),
            ("contains(lower(context), 'no relevant documents') AND classification IN ('DOCS', 'HYBRID')", "0.1"),
        )
    )
    + ") AS DOUBLE)"
)
_PARTS = f"parts AS (SELECT *, {CONTEXT} AS context FROM answer_parts)"


def _contexts(i: Inputs):
    parts = i.answer_parts
    return parts.withColumn("context", answers.agent_context(parts))


def _context_join(i: Inputs):
    """SQL and document texts arrive as two tables; questions may be missing in either."""
    parts = i.answer_parts
    sides = answers.context_sides(
        parts.filter("sql_text IS NOT NULL").select("query_id", "sql_text"), parts.filter("doc_text IS NOT NULL").select("query_id", "doc_text")
    )
    known = parts.select("query_id", "agent_type", "classification").join(sides, "query_id", "left")
    return known.select("query_id", answers.agent_context(known).alias("context"))


def _pair(i: Inputs, agent: str):
    """Both agents answer every question of the conversations."""
    parts = i.answer_parts
    pipeline = agent == "pipeline_health"
    return parts.select(
        "query_id", F.coalesce("sql_text" if pipeline else "doc_text", F.lit("none")).alias("response"),
        F.when(F.col("sql_success"), 0.9 if pipeline else 0.75).otherwise(0.6 if pipeline else 0.8).alias("confidence_score"),
        F.concat(F.lit("trace-"), F.col("query_id")).alias("trace_id"), F.array(F.concat(F.lit("c-" if pipeline else "d-"), F.col("query_id"))).alias("retrieved_chunk_ids"),
        "input_tokens", "output_tokens",
    )


def _merged(i: Inputs):
    rows = answers.merged_answers(_pair(i, "pipeline_health"), _pair(i, "customer_health"))
    return rows.withColumn("retrieved_chunk_ids", F.array_join("retrieved_chunk_ids", ","))


def metric_texts(i: Inputs):
    risk = metrics.risk_top25(i)
    shown = ["account_id", "account_name", "health_score", "risk_tier", "arr", "contract_end"]
    category = deals.by_category(i.opportunity_base)
    segment = metrics.ENTRIES["arr_by_segment"].run(i)
    texts = {
        "risk_top25": answers.rows_to_text(risk, [F.col("health_score").asc_nulls_first(), F.col("arr").desc(), F.col("account_id")], shown),
        "pipeline_by_category": answers.rows_to_text(category, [F.col("forecast_category")]),
        "arr_by_segment": answers.rows_to_text(segment, [F.col("segment")]),
    }
    rows = None
    for name, text in texts.items():
        row = text.select(F.lit(name).alias("metric"), F.col("context_text").alias("sql_text"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


def batch_answer(i: Inputs):
    questions = i.questions.withColumn("vector_id", F.col("conv_id"))
    rows = answers.batch_answer(questions, metric_texts(i), searchable_chunks(i), i.embeddings)
    return rows.select(
        "query_id", "agent_type", "response", "confidence_score", F.array_join("retrieved_chunk_ids", ",").alias("retrieved_chunk_ids"), "trace_id",
        "input_tokens", "output_tokens", F.round("estimated_cost_usd", 8).alias("estimated_cost_usd"),
    )


def _text_sql(columns: list[str], source: str, order: str) -> str:
    header = " | ".join(columns)
    line = ", ' | ', ".join(f"coalesce(CAST({c} AS VARCHAR), 'None')" for c in columns)
    return f"(SELECT concat('{header}', chr(10), '{'-' * len(header)}', chr(10), string_agg(concat({line}), chr(10) ORDER BY {order})) FROM ({source}))"


_BY_CATEGORY = "SELECT forecast_category, CAST(sum(amount) AS DECIMAL(28,2)) AS amount, count(*) AS deal_count FROM opportunity_current WHERE stage NOT IN ('Closed Won', 'Closed Lost') GROUP BY 1"
_BY_SEGMENT = "SELECT segment, CAST(sum(arr) AS DECIMAL(28,2)) AS arr, count(*) AS account_count FROM arr_source WHERE arr IS NOT NULL GROUP BY 1"
_BATCH = f"""
{CHUNK_CTE}, {SEARCH_CHUNKS_CTE},
texts AS (
  SELECT 'risk_top25' AS metric, {_text_sql(['account_id', 'account_name', 'health_score', 'risk_tier', 'arr', 'contract_end'], metrics.RISK_SQL, 'health_score, arr DESC, account_id')} AS sql_text
  UNION ALL SELECT 'pipeline_by_category', {_text_sql(['forecast_category', 'amount', 'deal_count'], _BY_CATEGORY, 'forecast_category')}
  UNION ALL SELECT 'arr_by_segment', {_text_sql(['segment', 'arr', 'account_count'], _BY_SEGMENT, 'segment')}),
routed AS (SELECT *, coalesce({_route(_word)}, {_normal('route_label', C.ROUTES, 'PIPELINE')}) AS route FROM questions WHERE length(query) BETWEEN 1 AND 2000),
asked AS (
  SELECT *, {_normal('class_label', C.CLASSES, 'SQL')} AS classification, 'pipeline_by_category' AS metric, NULL AS wanted, 'pipeline_health' AS agent_type, 'proposals' AS wanted_type FROM routed WHERE route <> 'CUSTOMER'
  UNION ALL SELECT *, coalesce({SHORTCUT}, {_normal('class_label', C.CLASSES, 'SQL')}), CASE WHEN {PREBUILT} THEN 'risk_top25' ELSE 'arr_by_segment' END, {ACCOUNT}, 'customer_health', 'contracts' FROM routed WHERE route <> 'PIPELINE'),
ranked AS (SELECT a.query_id, a.agent_type, a.wanted, s.*, row_number() OVER (PARTITION BY a.query_id, a.agent_type ORDER BY round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[])), 6) DESC, s.chunk_id) AS rk
  FROM asked a JOIN embeddings e ON e.vec_id = a.conv_id JOIN search_chunks s ON s.doc_type = a.wanted_type WHERE a.classification IN ('DOCS', 'HYBRID')),
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id, agent_type ORDER BY rk) AS place FROM ranked WHERE rk <= 6 AND (wanted IS NULL OR contains(lower(coalesce(account_name, '')), lower(wanted)))),
found AS (SELECT query_id, agent_type, string_agg(concat('[', CAST(place AS VARCHAR), '] ', doc_type, ' | ', coalesce(account_name, 'None'), ' | page ', CAST(source_page AS VARCHAR), chr(10), content), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY place) AS context_text,
  string_agg(chunk_id, ',' ORDER BY place) AS chunk_ids FROM kept GROUP BY 1, 2),
told AS (SELECT a.*, t.sql_text, CASE WHEN a.classification IN ('DOCS', 'HYBRID') THEN coalesce(f.context_text, 'No relevant documents found.') END AS doc_text, coalesce(f.chunk_ids, '') AS chunk_ids, true AS sql_success
  FROM asked a LEFT JOIN texts t ON t.metric = a.metric LEFT JOIN found f ON f.query_id = a.query_id AND f.agent_type = a.agent_type),
scored AS (SELECT *, CASE WHEN agent_type = 'pipeline_health' THEN {CONF_PIPELINE} ELSE {CONF_CUSTOMER} END AS confidence FROM (SELECT *, {CONTEXT} AS context FROM told))"""
_BATCH_SELECT = f"""
SELECT query_id, agent_type, context AS response, confidence AS confidence_score, chunk_ids AS retrieved_chunk_ids, query_id AS trace_id, input_tokens, output_tokens,
  round({'CAST(input_tokens AS DOUBLE) / 1e6 * 3.0 + CAST(output_tokens AS DOUBLE) / 1e6 * 15.0'}, 8) AS estimated_cost_usd FROM scored WHERE route <> 'AMBIGUOUS'
UNION ALL SELECT p.query_id, 'ambiguous', concat('**Pipeline View:**', chr(10), p.context, chr(10), chr(10), '---', chr(10), chr(10), '**Customer Health View:**', chr(10), c.context), least(p.confidence, c.confidence),
  concat(p.chunk_ids, CASE WHEN p.chunk_ids <> '' AND c.chunk_ids <> '' THEN ',' ELSE '' END, c.chunk_ids), p.query_id, p.input_tokens + c.input_tokens, p.output_tokens + c.output_tokens, 0.0
  FROM scored p JOIN scored c ON c.query_id = p.query_id AND p.agent_type = 'pipeline_health' AND c.agent_type = 'customer_health' WHERE p.route = 'AMBIGUOUS'
UNION ALL SELECT query_id, 'error', 'Error: invalid question length', 0.0, '', '', 0, 0, 0.0 FROM questions WHERE length(query) NOT BETWEEN 1 AND 2000"""


ENTRIES: dict[str, Entry] = {
    "route_query": Entry(
        lambda i: i.questions.select(
            "query_id", X.route_query(F.col("query")).alias("route"), X.route_query(F.col("query"), X.has_stem).alias("route_query_stemmed")
        ),
        oracle(Q, f"SELECT query_id, {_route(_word)} AS route, {_route(_stem)} AS route_query_stemmed FROM questions"),
    ),
    "route_label_normalise": Entry(
        lambda i: i.questions.select("query_id", X.normalise_label(F.col("route_label"), C.ROUTES, "PIPELINE").alias("route")),
        oracle(Q, f"SELECT query_id, {_normal('route_label', C.ROUTES, 'PIPELINE')} AS route FROM questions"),
    ),
    "classify_shortcut": Entry(
        lambda i: i.questions.select("query_id", X.classify_shortcut(F.col("query")).alias("classification")),
        oracle(Q, f"SELECT query_id, {SHORTCUT} AS classification FROM questions"),
    ),
    "classify_label_normalise": Entry(
        lambda i: i.questions.select("query_id", X.normalise_label(F.col("class_label"), C.CLASSES, "SQL").alias("classification")),
        oracle(Q, f"SELECT query_id, {_normal('class_label', C.CLASSES, 'SQL')} AS classification FROM questions"),
    ),
    "use_prebuilt_risk": Entry(
        lambda i: i.questions.select("query_id", X.use_prebuilt_risk(F.col("query")).alias("prebuilt")),
        oracle(Q, f"SELECT query_id, {PREBUILT} AS prebuilt FROM questions"),
    ),
    "account_candidate": Entry(
        lambda i: i.questions.select("query_id", X.account_candidate(F.col("query")).alias("account_name")),
        oracle(Q, f"SELECT query_id, {ACCOUNT} AS account_name FROM questions"),
    ),
    "sql_guard": Entry(
        lambda i: i.sql_texts.select("doc_id", X.sql_is_safe(F.col("sql_text")).alias("safe")),
        oracle(["sql_texts"], f"SELECT doc_id, NOT {_word('sql_text', C.UNSAFE_SQL_WORDS)} AS safe FROM sql_texts"),
    ),
    "strip_sql_fence": Entry(
        lambda i: i.sql_texts.select("doc_id", X.strip_fence(F.col("sql_text")).alias("sql")),
        oracle(["sql_texts"], "SELECT doc_id, regexp_replace(regexp_replace(sql_text, '^```sql\\s*', '', 'i'), '\\s*```$', '') AS sql FROM sql_texts"),
    ),
    "hybrid_context": Entry(
        lambda i: _contexts(i).select("query_id", "context"), oracle(["answer_parts"], "SELECT query_id, context FROM parts", _PARTS)
    ),
    "hybrid_context_join": Entry(_context_join, oracle(["answer_parts"], "SELECT query_id, context FROM parts", _PARTS)),
    "confidence_pipeline": Entry(
        lambda i: _contexts(i).select("query_id", scores.confidence_pipeline(F.col("context"), F.col("sql_success")).alias("confidence")),
        oracle(["answer_parts"], f"SELECT query_id, {CONF_PIPELINE} AS confidence FROM parts", _PARTS),
    ),
    "confidence_customer": Entry(
        lambda i: _contexts(i).select(
            "query_id", scores.confidence_customer(F.col("context"), F.col("sql_success"), F.col("classification")).alias("confidence")
        ),
        oracle(["answer_parts"], f"SELECT query_id, {CONF_CUSTOMER} AS confidence FROM parts", _PARTS),
    ),
    "merge_agent_results": Entry(
        _merged,
        oracle(
            ["answer_parts"],
            "SELECT query_id, concat('**Pipeline View:**', chr(10), coalesce(sql_text, 'none'), chr(10), chr(10), '---', chr(10), chr(10), '**Customer Health View:**', chr(10), coalesce(doc_text, 'none')) AS response, "
            "CAST(CASE WHEN sql_success THEN 0.75 ELSE 0.6 END AS DOUBLE) AS confidence_score, 'ambiguous' AS agent_type, concat('trace-', query_id) AS trace_id, concat('c-', query_id, ',d-', query_id) AS retrieved_chunk_ids, "
            "input_tokens * 2 AS input_tokens, output_tokens * 2 AS output_tokens FROM answer_parts",
        ),
    ),
    "conversation_history": Entry(
        lambda i: answers.history(i.conversations).select("conv_id", "turn", F.array_join("history", "\n").alias("history")),
        "SELECT c.conv_id, c.turn, coalesce(string_agg(p.role || ': ' || p.text, chr(10) ORDER BY p.no), '') AS history FROM "
        "(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM conversations) c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM conversations) p "
        "ON p.conv_id = c.conv_id AND p.no BETWEEN c.no - 4 AND c.no - 1 GROUP BY 1, 2",
    ),
    "batch_answer": Entry(
        batch_answer,
        oracle(["questions", "account_current", "health", "opportunity_current", "arr_source", "source_documents"], _BATCH_SELECT, _BATCH.strip()),
    ),
}
