"""Streams and sinks, run over the whole input tables into a new folder and read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaflow.operators.documents import identify
from quotaflow.plans import monitoring as M
from quotaflow.plans.views import Inputs
from quotaflow.registry.common import AS_OF_DATE, Entry, oracle
from quotaflow.registry.documents import CHUNK_CTE, CHUNK_ID
from quotaflow.registry.monitoring import _CHECKS, _RUNS, _VERDICT
from quotaflow.registry.tables import PARSE_CTE, VALID_TYPE, SCD1_CTE
from quotaflow.schemas import TABLES, conform
from quotaflow.session import run_folder
from quotaflow.sinks import batches
from quotaflow.sinks.keyed import KeyedTable
from quotaflow.sinks.tables import append, overwrite_partitions
from quotaflow.sources.messages import DEAD_LETTER_TOPICS, TOPICS, dead_letters
from quotaflow.streaming import documents as doc_stream
from quotaflow.streaming import medallion

EARLIER = dt.date(2001, 4, 1)
FILES = 4  # of a batch
_BRONZE = "SELECT raw_json, kafka_offset, kafka_partition, kafka_ts FROM {0}_raw"
_DLQ = "CASE WHEN kafka_partition < 3 THEN 'dlq.opportunity' ELSE 'dlq.account' END"
TRACE_COLUMNS = ["trace_id", "session_id", "agent_type", "query", "total_latency_ms", "confidence_score", "input_tokens", "output_tokens", "estimated_cost_usd", "model", "ts"]


def _messages(i: Inputs, entity: str) -> DataFrame:
    """The raw events of the entity as topic messages, streamed from the input table."""
    return i.view_stream(f"{entity}_raw").select(
        F.col("raw_json").alias("value"), F.lit(TOPICS[entity]).alias("topic"), F.col("kafka_partition").alias("partition"),
        F.col("kafka_offset").alias("offset"), F.col("kafka_ts").cast("timestamp").alias("timestamp"),
    )


def _bronze(i: Inputs, entity: str) -> DataFrame:
    root = run_folder(i.spark, f"bronze-{entity}")
    medallion.bronze(_messages(i, entity), root, once=True).awaitTermination()
    rows = i.spark.read.parquet(f"{root}/bronze")
    return rows.withColumn("kafka_ts", F.col("kafka_ts").cast("timestamp_ntz"))


def _dead_letters(i: Inputs) -> DataFrame:
    root = run_folder(i.spark, "dead-letters")
    events = i.view_stream("cdc_events").filter("event_type = 'UNDELETE'")
    topic = F.when(F.col("kafka_partition") < 3, DEAD_LETTER_TOPICS["opportunity"]).otherwise(DEAD_LETTER_TOPICS["account"])
    messages = events.select(
        F.concat(F.lit("rejected "), "entity_id").alias("value"), topic.alias("topic"), F.col("kafka_partition").alias("partition"),
        F.col("kafka_offset").alias("offset"), F.col("updated_at").cast("timestamp").alias("timestamp"),
    )
    medallion.append_stream(dead_letters(messages), root, "dlq", once=True).awaitTermination()
    rows = i.spark.read.parquet(f"{root}/dlq")
    return rows.select("raw_json", "topic", "kafka_offset", F.col("kafka_ts").cast("timestamp_ntz").alias("kafka_ts"), F.col("ingested_at").isNotNull().alias("stamped"))


def _medallion(i: Inputs, entity: str) -> DataFrame:
    """The gold table, in its declared columns."""
    root = run_folder(i.spark, f"medallion-{entity}")
    table = medallion.run_available(_messages(i, entity), root, entity)
    return medallion.gold_rows(table, entity).withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


def _scd1_stream(i: Inputs) -> DataFrame:
    """All events in four batches that overlap in time, so later batches bring late events, updates and deletes."""
    root = run_folder(i.spark, "scd1")
    events = i.cdc_events.filter("event_type IN ('CREATE', 'UPDATE', 'DELETE')")
    turn = F.coalesce(F.pmod("kafka_offset", F.lit(4)), F.lit(0))
    for part in range(4):
        events.filter(turn == part).repartition(FILES, "entity_id").write.mode("append").parquet(f"{root}/events")
    table = KeyedTable(i.spark, f"{root}/table", "entity_id", fold_every=2)
    stream = medallion.table_stream(i.spark, f"{root}/events", files_per_batch=FILES)
    medallion.keyed_sink(stream, table, root, "scd1", once=True).awaitTermination()
    return table.current().select("entity_id", "event_type", "amount", "updated_at", "kafka_offset")


def _document_stream(i: Inputs) -> DataFrame:
    root = run_folder(i.spark, "documents")
    files = i.view_stream("source_documents").select("file_path", "content")
    doc_stream.ingest_stream(files, root).awaitTermination()
    rows = i.spark.read.parquet(f"{root}/chunks")
    return rows.select("chunk_id", "doc_id", "doc_type", "account_id", F.sha2("content", 256).alias("content_hash"), "chunk_index", "token_count")


def _traces(i: Inputs) -> DataFrame:
    return M.with_cost(i.agent_traces).withColumn("estimated_cost_usd", F.round("estimated_cost_usd", 8))


def _appended(i: Inputs) -> DataFrame:
    """Traces of both agents appended in two writes, read back."""
    path = f"{run_folder(i.spark, 'traces')}/agent_traces"
    for agent in ("pipeline_health", "customer_health"):
        append(_traces(i).filter(F.col("agent_type") == agent), "monitoring.agent_traces", path)
    return i.spark.read.parquet(path).select(*TRACE_COLUMNS).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _replaced(i: Inputs) -> DataFrame:
    """Retention snapshots written by day, then one month's days written again with other values."""
    path = f"{run_folder(i.spark, 'nrr')}/nrr"
    rows = i.nrr_source
    overwrite_partitions(rows, path)
    overwrite_partitions(rows.filter("snapshot_date >= DATE '2001-01-01'").withColumn("churn_pct", F.lit(0.0)), path)
    return i.spark.read.parquet(path).select("period_date", "segment", "nrr_pct", "churn_pct", F.col("snapshot_date").cast("date").alias("snapshot_date"))


def _synced(i: Inputs) -> DataFrame:
    """Two runs of the metric sync over all sources, the second with other values for one segment; all five tables read back."""
    root = run_folder(i.spark, "metrics")
    sources = {"arr": i.arr_source, "acv": i.acv_source, "health": i.health, "forecast": i.forecast_snapshots.drop("snapshot_date"), "nrr": i.nrr_source}
    for name in ("acv", "forecast", "nrr"):  # joined and summed once; each run checks and writes what is stored
        sources[name].write.parquet(f"{root}/source-{name}")
        sources[name] = i.spark.read.schema(sources[name].schema).parquet(f"{root}/source-{name}")
    raised = F.when(F.col("segment") == "Enterprise", F.col("arr") + 100).otherwise(F.col("arr")).cast("decimal(18,2)")
    batches.sync_metrics(sources, root, EARLIER, 1)
    batches.sync_metrics({**sources, "arr": i.arr_source.withColumn("arr", raised)}, root, AS_OF_DATE, 2)
    read = {name: batches.metric_table(i.spark, root, name).current() for name in batches.METRIC_KEYS}
    read |= {name: i.spark.read.parquet(f"{root}/{name}") for name in ("forecast", "nrr")}
    value = {"arr": "arr", "acv": "acv", "health": "health_score", "forecast": "closed_won", "nrr": "nrr_pct"}
    key = {name: [column] for name, column in batches.METRIC_KEYS.items()} | {"forecast": ["period", "segment", "owner_id"], "nrr": ["period", "segment"]}
    rows = None
    for name, df in read.items():
        day = F.col("snapshot_date").cast("date") if name != "acv" else F.lit(None).cast("date")
        part = df.select(F.lit(name).alias("table_name"), F.concat_ws("|", *key[name]).alias("id"), day.alias("day"), F.col(value[name]).cast("double").alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def _monitored(i: Inputs) -> DataFrame:
    """Traces with their verdicts, claims, ratings and eval runs written by the monitoring writers and read back."""
    root = run_folder(i.spark, "monitoring")
    batches.record_answers(i.agent_traces.drop("groundedness_score"), i.judge_outputs.drop("query"), root, "1.0", "m")
    batches.record_feedback(i.user_feedback.withColumn("rating", F.col("rating") + (F.length("comment") % 3).cast("int") - 1), root)
    batches.record_eval(M.eval_checks(i.eval_results.withColumn("forbidden", F.array("forbidden"))), root, "1.0")
    columns = {
        "agent_traces": ("trace_id", F.col("groundedness_score")),
        "groundedness_issues": ("unsupported_claim", F.lit(1.0)),
        "user_feedback": ("trace_id", F.col("rating").cast("double")),
        "eval_runs": ("run_id", F.col("pass_rate")),
    }
    rows = None
    for name, (key, value) in columns.items():
        part = i.spark.read.parquet(f"{root}/{name}").select(F.lit(name).alias("table_name"), F.col(key).alias("id"), value.alias("value"), (F.col(M.DAY) == F.to_date("ts")).alias("day_matches"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def _all_tables(i: Inputs) -> DataFrame:
    """Whole inputs written through the schema of each of the 14 tables; rows and columns found on reading back."""
    root = run_folder(i.spark, "tables")
    documents = identify(i.source_documents)
    rows = {
        "realtime.opportunity_current": i.opportunity_current, "realtime.account_current": i.account_current,
        "metrics.arr": i.arr_source, "metrics.acv": i.acv_source, "metrics.health": i.health, "metrics.forecast": i.forecast_snapshots,
        "metrics.nrr": i.nrr_source.withColumn("period", F.col("period_date").cast("string")),
        "documents.metadata": documents, "documents.chunks": documents.withColumn("chunk_id", F.col("file_hash")),
        "monitoring.agent_traces": i.agent_traces, "monitoring.user_feedback": i.user_feedback, "monitoring.groundedness_issues": i.judge_outputs,
        "monitoring.eval_runs": i.eval_results.withColumn("ts", F.lit(None).cast("timestamp")), "monitoring.sql_log": i.agent_traces.withColumn("generated_sql", F.lit("SELECT 1")),
    }
    found = None
    for name, df in rows.items():
        append(df, name, f"{root}/{name}")
        back = i.spark.read.parquet(f"{root}/{name}").drop(M.DAY)
        part = back.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows", F.lit(",".join(back.columns)).alias("columns"))
        found = part if found is None else found.unionByName(part)
    return found


_ALL_TABLES = {
    "realtime.opportunity_current": "opportunity_current", "realtime.account_current": "account_current", "metrics.arr": "arr_source", "metrics.acv": "acv_source",
    "metrics.health": "health", "metrics.forecast": "forecast_snapshots", "metrics.nrr": "nrr_source", "documents.metadata": "source_documents",
    "documents.chunks": "source_documents", "monitoring.agent_traces": "agent_traces", "monitoring.user_feedback": "user_feedback",
    "monitoring.groundedness_issues": "judge_outputs", "monitoring.eval_runs": "eval_results", "monitoring.sql_log": "agent_traces",
}
_ALL_TABLES_SQL = " UNION ALL ".join(f"SELECT '{name}' AS table_name, count(*) AS rows, '{','.join(TABLES[name].names)}' AS columns FROM {view}" for name, view in _ALL_TABLES.items())
_DAYS = [f"DATE '{EARLIER}'", f"DATE '{AS_OF_DATE}'"]
_SYNCED_SQL = (
    f"SELECT 'arr' AS table_name, account_id AS id, {_DAYS[1]} AS day, CAST(CASE WHEN segment = 'Enterprise' THEN arr + 100 ELSE arr END AS DOUBLE) AS value FROM arr_source WHERE arr IS NOT NULL "
    "UNION ALL SELECT 'acv', opportunity_id, CAST(NULL AS DATE), CAST(acv AS DOUBLE) FROM acv_source WHERE acv IS NOT NULL "
    f"UNION ALL SELECT 'health', account_id, {_DAYS[1]}, CAST(health_score AS DOUBLE) FROM health "
    f"UNION ALL SELECT 'forecast', concat_ws('|', period, segment, owner_id), unnest([{', '.join(_DAYS)}]), CAST(closed_won AS DOUBLE) FROM forecast_snapshots "
    + "".join(f"UNION ALL SELECT 'nrr', concat_ws('|', CAST(period_date AS VARCHAR), segment), {day}, nrr_pct FROM nrr_source WHERE period_date >= CAST({day} - INTERVAL 24 MONTH AS DATE) " for day in _DAYS)
)
_MONITORED_SQL = (
    "SELECT 'agent_traces' AS table_name, t.trace_id AS id, coalesce(v.score, 0.0) AS value, true AS day_matches FROM agent_traces t LEFT JOIN verdicts v ON v.trace_id = t.trace_id "
    "UNION ALL SELECT 'groundedness_issues', unnest(unsupported_claims), 1.0, true FROM verdicts "
    "UNION ALL SELECT 'user_feedback', trace_id, CAST(r AS DOUBLE), true FROM (SELECT trace_id, rating + length(comment) % 3 - 1 AS r FROM user_feedback) WHERE r BETWEEN 1 AND 2 "
    "UNION ALL SELECT 'eval_runs', run_id, round(CASE WHEN passed + failed > 0 THEN CAST(passed AS DOUBLE) / (passed + failed) ELSE 0.0 END, 4), true FROM runs"
)
_GOLD = {entity: ", ".join(TABLES[f"realtime.{entity}_current"].names) for entity in ("opportunity", "account")}
_TRACE_SQL = (
    "SELECT trace_id, session_id, agent_type, query, total_latency_ms, confidence_score, input_tokens, output_tokens, "
    "round(CAST(input_tokens AS DOUBLE) / 1e6 * 3.0 + CAST(output_tokens AS DOUBLE) / 1e6 * 15.0, 8) AS estimated_cost_usd, CAST(NULL AS VARCHAR) AS model, ts FROM agent_traces"
)

ENTRIES: dict[str, Entry] = {
    "src_cdc_opportunity": Entry(lambda i: _bronze(i, "opportunity"), oracle(["opportunity_raw"], _BRONZE.format("opportunity"))),
    "src_cdc_account": Entry(lambda i: _bronze(i, "account"), oracle(["account_raw"], _BRONZE.format("account"))),
    "src_dlq": Entry(
        _dead_letters,
        oracle(
            ["cdc_events"],
            f"SELECT concat('rejected ', entity_id) AS raw_json, {_DLQ} AS topic, kafka_offset, updated_at AS kafka_ts, true AS stamped FROM cdc_events WHERE event_type = 'UNDELETE'",
        ),
    ),
    "src_new_files": Entry(
        _document_stream,
        oracle(
            ["source_documents"],
            f"SELECT {CHUNK_ID} AS chunk_id, doc_id, doc_type, account_id, sha256(content) AS content_hash, chunk_index, token_count FROM chunks WHERE token_count >= 20",
            CHUNK_CTE,
        ),
    ),
    "stream_medallion": Entry(
        lambda i: _medallion(i, "opportunity"),
        oracle(["opportunity_raw"], f"SELECT {_GOLD['opportunity']} FROM parsed WHERE opportunity_id IS NOT NULL AND {VALID_TYPE} AND event_type <> 'DELETE'", PARSE_CTE["opportunity"]),
    ),
    "stream_medallion_account": Entry(
        lambda i: _medallion(i, "account"), oracle(["account_raw"], f"SELECT {_GOLD['account']} FROM parsed WHERE account_id IS NOT NULL", PARSE_CTE["account"])
    ),
    "stream_scd1": Entry(
        _scd1_stream,
        oracle(["cdc_events"], "SELECT entity_id, event_type, amount, updated_at, kafka_offset FROM latest WHERE event_type <> 'DELETE'", SCD1_CTE),
    ),
    "sink_append": Entry(_appended, oracle(["agent_traces"], _TRACE_SQL)),
    "ddl_tables": Entry(_all_tables, oracle(sorted(set(_ALL_TABLES.values())), _ALL_TABLES_SQL)),
    "sync_metrics_tables": Entry(_synced, oracle(["arr_source", "acv_source", "health", "forecast_snapshots", "nrr_source"], _SYNCED_SQL)),
    "monitoring_tables": Entry(
        _monitored, oracle(["agent_traces", "judge_outputs", "user_feedback", "eval_results"], _MONITORED_SQL, f"{_VERDICT}, {_CHECKS}, {_RUNS}")
    ),
    "sink_replace_partitions": Entry(
        _replaced,
        oracle(
            ["nrr_source"],
            "SELECT period_date, segment, nrr_pct, CASE WHEN snapshot_date >= DATE '2001-01-01' THEN CAST(0 AS DOUBLE) ELSE churn_pct END AS churn_pct, snapshot_date FROM nrr_source",
        ),
    ),
}
