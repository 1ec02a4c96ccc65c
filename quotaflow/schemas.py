"""Table registry: one explicit schema per persistent table, and schema conformance for writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "money": T.DecimalType(18, 2),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "vector": T.ArrayType(T.FloatType()),
    "strings": T.ArrayType(T.StringType()),
}

# --- fixed values: columns of the persistent tables; ``!`` marks a required key ---------------------------
_COLUMNS = {
    "realtime.opportunity_current": (
        "opportunity_id string!, account_id string, account_name string, owner_id string, owner_name string, "
        "name string, amount money, acv money, stage string, close_date date, probability int, "
        "forecast_category string, days_in_stage int, last_activity_date date, health_score int, "
        "created_date date, updated_at timestamp"
    ),
    "realtime.account_current": (
        "account_id string!, name string, industry string, segment string, owner_id string, csm_id string, "
        "arr money, health_score int, risk_tier string, contract_end date, updated_at timestamp"
    ),
    "metrics.arr": (
        "account_id string!, account_name string, arr money, mrr money, arr_growth_pct double, "
        "new_logo_arr money, expansion_arr money, churn_arr money, segment string, snapshot_date date, "
        "synced_at timestamp"
    ),
    "metrics.acv": (
        "opportunity_id string!, account_id string, account_name string, acv money, tcv money, "
        "term_months int, close_date date, segment string, synced_at timestamp"
    ),
    "metrics.health": (
        "account_id string!, account_name string, health_score int, nps_score int, csat_score double, "
        "risk_tier string, dau_30d int, feature_adoption double, last_login_date date, snapshot_date date, "
        "synced_at timestamp"
    ),
    "metrics.forecast": (
        "period string!, segment string, owner_id string, committed money, best_case money, pipeline money, "
        "closed_won money, quota money, attainment_pct double, snapshot_date date, synced_at timestamp"
    ),
    "metrics.nrr": (
        "period string!, segment string, nrr_pct double, gross_retention double, expansion_pct double, "
        "churn_pct double, snapshot_date date, synced_at timestamp"
    ),
    "documents.metadata": (
        "doc_id string!, file_name string, file_path string, doc_type string, account_id string, "
        "account_name string, opportunity_id string, owner_id string, doc_date date, expiry_date date, "
        "source string, ingested_at timestamp, file_hash string"
    ),
    "documents.chunks": (
        "chunk_id string!, doc_id string, doc_type string, account_id string, account_name string, "
        "opportunity_id string, doc_date date, content string, source_page int, chunk_index int, "
        "token_count int, embedding vector, ingested_at timestamp"
    ),
    "monitoring.agent_traces": (
        "trace_id string!, session_id string, user_id string, agent_type string, query string, "
        "response string, generated_sql string, retrieved_chunk_ids strings, total_latency_ms int, "
        "retrieval_latency_ms int, llm_latency_ms int, confidence_score double, groundedness_score double, "
        "input_tokens int, output_tokens int, estimated_cost_usd double, agent_version string, model string, "
        "ts timestamp"
    ),
    "monitoring.user_feedback": "trace_id string, user_id string, rating int, comment string, ts timestamp",
    "monitoring.groundedness_issues": "trace_id string, query string, unsupported_claim string, ts timestamp",
    "monitoring.eval_runs": (
        "run_id string!, triggered_by string, agent_version string, total_questions int, passed int, "
        "failed int, avg_groundedness double, avg_sql_accuracy double, pass_rate double, "
        "threshold_met boolean, mlflow_run_id string, ts timestamp"
    ),
    "monitoring.sql_log": (
        "trace_id string, query string, generated_sql string, executed_successfully boolean, "
        "error_message string, rows_returned int, execution_ms int, agent_version string, ts timestamp"
    ),
}


def _schema(columns: str) -> T.StructType:
    fields = []
    for part in columns.split(", "):
        name, kind = part.split(" ")
        fields.append(T.StructField(name, _TYPES[kind.rstrip("!")], not kind.endswith("!")))
    return T.StructType(fields)


TABLES: dict[str, T.StructType] = {name: _schema(columns) for name, columns in _COLUMNS.items()}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Exactly the table's columns and types: missing columns become NULL, a NULL key fails the job."""
    columns = []
    for field in TABLES[table].fields:
        value = F.col(field.name).cast(field.dataType) if field.name in df.columns else F.lit(None).cast(field.dataType)
        if not field.nullable:
            problem = F.raise_error(F.lit(f"{table}.{field.name} is NULL")).cast(field.dataType)
            value = F.coalesce(value, problem)
        columns.append(value.alias(field.name))
    return df.select(*columns)
