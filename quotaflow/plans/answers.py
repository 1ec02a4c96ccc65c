"""Questions in, context / confidence / cost rows out: the question-answering path as one DataFrame pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotaflow import constants as C
from quotaflow.functions import text as X
from quotaflow.functions.scores import confidence_customer, confidence_pipeline, token_cost
from quotaflow.operators.ranking import last_n_before, numbers_per_key
from quotaflow.operators.retrieval import context_text, keep_account, nearest_chunks

CHUNK_COLUMNS = ["chunk_id", "doc_type", "account_name", "source_page", "content"]


def capped(df: DataFrame, order: list[Column], n: int = C.RESULT_ROW_CAP) -> DataFrame:
    """The result cap: first n rows of a total order."""
    return df.orderBy(*order).limit(n)


def rows_to_text(df: DataFrame, order: list[Column], columns: list[str] | None = None) -> DataFrame:
    """One row ``context_text``: header, rule, at most 50 lines of the (at most 200) result rows."""
    columns = columns or df.columns
    header = " | ".join(columns)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    line = F.concat_ws(" | ", *[X.shown(F.col(c), kinds[c]) for c in columns])
    # the window sees at most the 200 rows of the cap
    few = capped(df, order).select(F.row_number().over(Window.orderBy(*order)).alias("_i"), line.alias("_line"))
    listed = few.agg(F.sort_array(F.collect_list(F.struct("_i", "_line"))).alias("_rows"))
    n = F.size("_rows")
    body = F.array_join(F.transform(F.slice("_rows", 1, C.CONTEXT_ROW_CAP), lambda r: r["_line"]), "\n")
    more = F.when(n > C.CONTEXT_ROW_CAP, F.concat(F.lit("\n... and "), (n - C.CONTEXT_ROW_CAP).cast("string"), F.lit(" more rows")))
    text = F.concat(F.lit(f"{header}\n{'-' * len(header)}\n"), body, F.coalesce(more, F.lit("")))
    return listed.select(F.when(n == 0, C.NO_ROWS_TEXT).otherwise(text).alias("context_text"))


def combined_context(classification: Column, sql_text: Column, doc_text: Column, headings: tuple[str, str]) -> Column:
    """Headed SQL and document parts as the classification asks for, or the no-data text."""
    part = lambda wanted, text, heading: F.when(
        classification.isin(*wanted) & (text != ""), F.concat(F.lit(f"{heading}\n"), text)
    )
    joined = F.concat_ws("\n\n", part(("SQL", "HYBRID"), sql_text, headings[0]), part(("DOCS", "HYBRID"), doc_text, headings[1]))
    return F.when(joined == "", C.NO_DATA_TEXT).otherwise(joined)


def agent_context(df: DataFrame) -> Column:
    """Combined context with the headings of the row's agent."""
    args = (F.col("classification"), F.col("sql_text"), F.col("doc_text"))
    return F.when(F.col("agent_type") == "pipeline_health", combined_context(*args, C.PIPELINE_HEADINGS)).otherwise(
        combined_context(*args, C.CUSTOMER_HEADINGS)
    )


def context_sides(sql_side: DataFrame, doc_side: DataFrame, key: str = "query_id") -> DataFrame:
    """SQL texts and document texts per question; either side may be missing."""
    return sql_side.join(doc_side, key, "full")


def history(turns: DataFrame, n: int = 4, bucket_turns: int = 1000) -> DataFrame:
    """The last n turns of the session before each turn, oldest first."""
    numbered = numbers_per_key(turns, ["conv_id"], F.floor(F.col("turn") / bucket_turns), [F.col("turn")], "_no")
    item = F.concat("role", F.lit(": "), "text")
    return last_n_before(numbered, ["conv_id"], "_no", n, item, "history", bucket_turns).drop("_no")


def _merged_fields(p: Column, c: Column) -> dict[str, Column]:
    """Two agents' answers (structs) as one: texts under fixed headings, lower confidence, ids and tokens joined.

    The trace id of the pipeline answer is kept; cost and groundedness are not part of a merged answer.
    """
    score = lambda side: F.coalesce(side["confidence_score"], F.lit(0.9))
    ids = lambda side: F.coalesce(side["retrieved_chunk_ids"], F.array().cast("array<string>"))
    total = lambda name: F.coalesce(p[name], F.lit(0)) + F.coalesce(c[name], F.lit(0))
    return {
        "response": F.concat(
            F.lit(f"{C.PIPELINE_VIEW_HEADING}\n"), p["response"],
            F.lit(f"{C.CHUNK_SEPARATOR}{C.CUSTOMER_VIEW_HEADING}\n"), c["response"],
        ),
        "confidence_score": F.least(score(p), score(c)),
        "agent_type": F.lit("ambiguous"),
        "trace_id": p["trace_id"],
        "retrieved_chunk_ids": F.concat(ids(p), ids(c)),
        "input_tokens": total("input_tokens"),
        "output_tokens": total("output_tokens"),
    }


ANSWER_FIELDS = ["response", "confidence_score", "trace_id", "retrieved_chunk_ids", "input_tokens", "output_tokens"]


def merged_answers(pipeline: DataFrame, customer: DataFrame, key: str = "query_id") -> DataFrame:
    """The answers of both agents to the same questions, merged per question."""
    left = pipeline.select(key, F.struct(*ANSWER_FIELDS).alias("_p"))
    right = customer.select(key, F.struct(*ANSWER_FIELDS).alias("_c"))
    fields = _merged_fields(F.col("_p"), F.col("_c"))
    return left.join(right, key).select(key, *[v.alias(k) for k, v in fields.items()])


def one_answer(answers: DataFrame, key: str = "query_id") -> DataFrame:
    """One row per question from at most one row per question and agent, in a single grouped pass."""
    whole = F.struct("agent_type", *ANSWER_FIELDS, "estimated_cost_usd")
    side = lambda agent: F.first(F.when(F.col("agent_type") == agent, whole), ignorenulls=True)
    pairs = answers.groupBy(key).agg(side("pipeline_health").alias("_p"), side("customer_health").alias("_c"))
    p, c = F.col("_p"), F.col("_c")
    both, single = p.isNotNull() & c.isNotNull(), F.coalesce(p, c)
    fields = {**_merged_fields(p, c), "estimated_cost_usd": F.lit(0.0)}
    return pairs.select(key, *[F.when(both, v).otherwise(single[k]).alias(k) for k, v in fields.items()])


def agent_rows(questions: DataFrame) -> DataFrame:
    """Valid questions routed and classified: one row per agent that has to answer.

    Input: query_id, query, route_label and class_label (a classifier's words for undecided questions).
    """
    route = F.coalesce(X.route_query(F.col("query")), X.normalise_label(F.col("route_label"), C.ROUTES, "PIPELINE"))
    both = F.array(F.lit("pipeline_health"), F.lit("customer_health"))
    agents = (
        F.when(F.col("route") == "PIPELINE", F.array(F.lit("pipeline_health")))
        .when(F.col("route") == "CUSTOMER", F.array(F.lit("customer_health")))
        .otherwise(both)
    )
    label = X.normalise_label(F.col("class_label"), C.CLASSES, "SQL")
    customer = F.col("agent_type") == "customer_health"
    metric = (
        F.when(~customer, "pipeline_by_category")
        .when(X.use_prebuilt_risk(F.col("query")), "risk_top25")
        .otherwise("arr_by_segment")
    )
    return (
        questions.withColumn("route", route)
        .withColumn("agent_type", F.explode(agents))
        .withColumns(
            {
                "classification": F.when(customer, F.coalesce(X.classify_shortcut(F.col("query")), label)).otherwise(label),
                "metric": metric,
                "wanted_account": F.when(customer, X.account_candidate(F.col("query"))),
            }
        )
    )


def document_contexts(asked: DataFrame, chunks: DataFrame, vectors: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """Document text and chunk ids per (query_id, agent_type).

    asked: query_id, agent_type, vector_id, wanted_account. Equal vectors of one agent are searched once.
    """
    agents = list(C.AGENT_SEARCH_DOC_TYPE)
    number = lambda c: F.col("vector_id") * len(agents) + F.when(c == agents[0], 0).otherwise(1)
    keyed = asked.withColumn("search_id", number(F.col("agent_type")).cast("long"))
    doc_type = F.when(F.col("agent_type") == agents[0], C.AGENT_SEARCH_DOC_TYPE[agents[0]]).otherwise(C.AGENT_SEARCH_DOC_TYPE[agents[1]])
    requests = (
        keyed.select("search_id", "vector_id", "agent_type")
        .distinct()
        .join(vectors.select(F.col("vec_id").alias("vector_id"), "embedding"), "vector_id")
        .select(F.col("search_id").alias("query_id"), doc_type.alias("doc_type"), F.lit(None).cast("string").alias("account_id"), "embedding")
    )
    found = nearest_chunks(chunks, requests, C.AGENT_SEARCH_K, seed=seed).withColumnRenamed("query_id", "search_id")
    described = found.join(chunks.select(*CHUNK_COLUMNS), "chunk_id")
    per_question = keyed.select("query_id", "agent_type", "search_id", "wanted_account").join(described, "search_id")
    kept = keep_account(per_question).withColumn("question", F.struct("query_id", "agent_type"))
    return context_text(kept, "question").select("question.*", "context_text", "chunk_ids")


def batch_answer(questions: DataFrame, metric_texts: DataFrame, chunks: DataFrame, vectors: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """One result row per question.

    questions: query_id, query, route_label, class_label, vector_id, input_tokens, output_tokens.
    metric_texts: (metric, sql_text). ``seed``: any part of the chunks, see ``nearest_chunks``. The response column holds the combined context; a text generator, where
    one is at hand, replaces it. Questions of invalid length come back as agent_type 'error' with zero scores.
    """
    n = F.length("query")
    valid = F.coalesce(n.between(C.QUERY_MIN_CHARS, C.QUERY_MAX_CHARS), F.lit(False))
    rows = agent_rows(questions.filter(valid))
    wants_docs = F.col("classification").isin("DOCS", "HYBRID")
    documents = document_contexts(
        rows.filter(wants_docs).select("query_id", "agent_type", "vector_id", "wanted_account"), chunks, vectors, seed
    )
    told = (
        rows.join(metric_texts, "metric", "left")
        .join(documents, ["query_id", "agent_type"], "left")
        .withColumn("doc_text", F.when(wants_docs, F.coalesce("context_text", F.lit(C.NO_DOCUMENTS_TEXT))))
        .withColumn("sql_success", F.lit(True))
    )
    context = told.withColumn("context", agent_context(told))
    confidence = F.when(
        F.col("agent_type") == "pipeline_health", confidence_pipeline(F.col("context"), F.col("sql_success"))
    ).otherwise(confidence_customer(F.col("context"), F.col("sql_success"), F.col("classification")))
    answers = context.select(
        "query_id", "agent_type", F.col("context").alias("response"), confidence.alias("confidence_score"),
        F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("retrieved_chunk_ids"),
        F.col("query_id").alias("trace_id"), "input_tokens", "output_tokens",
        token_cost(F.col("input_tokens"), F.col("output_tokens")).alias("estimated_cost_usd"),
    )
    failed = questions.filter(~valid).select(
        "query_id", F.lit("Error: invalid question length").alias("response"), F.lit(0.0).alias("confidence_score"),
        F.lit("error").alias("agent_type"), F.lit("").alias("trace_id"),
        F.array().cast("array<string>").alias("retrieved_chunk_ids"), F.lit(0).alias("input_tokens"),
        F.lit(0).alias("output_tokens"), F.lit(0.0).alias("estimated_cost_usd"),
    )
    return one_answer(answers).unionByName(failed)
