"""Views that give the generic input tables the shape of the sales tables.

One SQL text per view serves Spark and the oracle engine; ``{name}`` stands for an input table. Every view reads
whole tables; missing amounts and rejected events come from the data itself (negative balances, orders without
lines, event kinds), never from a row filter that thins the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quotaflow import constants as C

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

SEGMENT = "CASE {key} % 3 WHEN 0 THEN 'Enterprise' WHEN 1 THEN 'Mid-Market' ELSE 'SMB' END"


def _segment(key: str) -> str:
    return SEGMENT.replace("{key}", key)


# Questions are conversation texts after a term of the routing rules and, for some, a lead-in or a second term.
TERMS = ["", *dict.fromkeys(w.replace(".", " ") for w in [*C.PIPELINE_WORDS.split("|"), *C.CUSTOMER_WORDS.split("|"), *C.DOCUMENT_TERMS, *C.METRIC_TERMS, *C.RISK_TERMS])]
JOINTS = [" ", *(f" {w}" for w in C.ACCOUNT_LEAD_INS), *(f" {w} " for w in (C.PIPELINE_WORDS.split("|")[0], C.CUSTOMER_WORDS.split("|")[0]))]


def _drawn(key: str, values: list[str]) -> str:
    """One of the values, by a whole number."""
    return f"CASE ({key}) % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


VIEWS: dict[str, str] = {
    "opportunity_current": f"""
SELECT cast(o.o_orderkey AS string) AS opportunity_id, cast(o.o_custkey AS string) AS account_id,
  c.c_name AS account_name, cast(o.o_orderkey % 25 AS string) AS owner_id,
  concat('Rep ', cast(o.o_orderkey % 25 AS string)) AS owner_name,
  concat('Deal ', cast(o.o_orderkey AS string)) AS name,
  cast(o.o_totalprice AS decimal(18,2)) AS amount, cast(l.acv AS decimal(18,2)) AS acv,
  CASE WHEN o.o_orderstatus = 'F' THEN CASE WHEN o.o_orderkey % 3 = 0 THEN 'Closed Lost' ELSE 'Closed Won' END
       WHEN o.o_orderstatus = 'O' THEN CASE WHEN o.o_orderkey % 2 = 0 THEN 'Proposal' ELSE 'Negotiation' END
       ELSE CASE WHEN o.o_orderkey % 2 = 0 THEN 'Prospecting' ELSE 'Discovery' END END AS stage,
  cast(o.o_orderdate AS date) AS close_date, cast(o.o_orderkey % 101 AS int) AS probability,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Commit' WHEN '2-HIGH' THEN 'Best Case'
    WHEN '5-LOW' THEN 'Omitted' ELSE 'Pipeline' END AS forecast_category,
  cast(o.o_orderkey % 120 AS int) AS days_in_stage,
  cast(o.o_orderdate AS date) - cast(o.o_orderkey % 60 AS int) AS last_activity_date,
  cast((o.o_orderkey * 37) % 101 AS int) AS health_score, cast(o.o_orderdate AS date) - 90 AS created_date,
  o.o_orderdate AS updated_at
FROM {{orders}} o JOIN {{customer}} c ON o.o_custkey = c.c_custkey
LEFT JOIN (SELECT l_orderkey, sum(cast(l_extendedprice AS decimal(18,2))) AS acv FROM {{lineitem}} GROUP BY l_orderkey) l
  ON l.l_orderkey = o.o_orderkey""",
    "opportunity_base": f"""
SELECT cast(o.o_orderkey AS string) AS opportunity_id, cast(o.o_custkey AS string) AS account_id,
  c.c_name AS account_name, cast(o.o_orderkey % 25 AS string) AS owner_id,
  concat('Rep ', cast(o.o_orderkey % 25 AS string)) AS owner_name,
  concat('Deal ', cast(o.o_orderkey AS string)) AS name,
  cast(o.o_totalprice AS decimal(18,2)) AS amount,
  CASE WHEN o.o_orderstatus = 'F' THEN CASE WHEN o.o_orderkey % 3 = 0 THEN 'Closed Lost' ELSE 'Closed Won' END
       WHEN o.o_orderstatus = 'O' THEN CASE WHEN o.o_orderkey % 2 = 0 THEN 'Proposal' ELSE 'Negotiation' END
       ELSE CASE WHEN o.o_orderkey % 2 = 0 THEN 'Prospecting' ELSE 'Discovery' END END AS stage,
  cast(o.o_orderdate AS date) AS close_date, cast(o.o_orderkey % 101 AS int) AS probability,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Commit' WHEN '2-HIGH' THEN 'Best Case'
    WHEN '5-LOW' THEN 'Omitted' ELSE 'Pipeline' END AS forecast_category,
  cast(o.o_orderkey % 120 AS int) AS days_in_stage,
  cast(o.o_orderdate AS date) - cast(o.o_orderkey % 60 AS int) AS last_activity_date,
  cast((o.o_orderkey * 37) % 101 AS int) AS health_score, cast(o.o_orderdate AS date) - 90 AS created_date,
  o.o_orderdate AS updated_at
FROM {{orders}} o JOIN {{customer}} c ON o.o_custkey = c.c_custkey""",
    "account_current": f"""
SELECT cast(c_custkey AS string) AS account_id, c_name AS name, c_mktsegment AS industry,
  {_segment('c_custkey')} AS segment, cast(c_custkey % 25 AS string) AS owner_id,
  cast(c_nationkey AS string) AS csm_id, cast(c_acctbal AS decimal(18,2)) AS arr,
  cast((c_custkey * 37) % 101 AS int) AS health_score,
  CASE WHEN (c_custkey * 37) % 101 < 40 THEN 'Red' WHEN (c_custkey * 37) % 101 < 70 THEN 'Yellow' ELSE 'Green' END AS risk_tier,
  DATE '2001-04-01' + cast(c_custkey % 365 AS int) AS contract_end
FROM {{customer}}""",
    "health": """
SELECT cast(c_custkey AS string) AS account_id, c_name AS account_name, cast((c_custkey * 37) % 101 AS int) AS health_score,
  cast((c_custkey * 53) % 201 - 100 AS int) AS nps_score, cast(c_custkey % 50 AS double) / 10 AS csat_score,
  CASE WHEN (c_custkey * 37) % 101 < 40 THEN 'Red' WHEN (c_custkey * 37) % 101 < 70 THEN 'Yellow' ELSE 'Green' END AS risk_tier,
  cast(c_custkey % 400 AS int) AS dau_30d, cast((c_custkey * 17) % 100 AS double) / 100 AS feature_adoption,
  DATE '2001-05-01' - cast(c_custkey % 90 AS int) AS last_login_date
FROM {customer}""",
    "adoption_history": """
SELECT cast(c_custkey AS string) AS account_id, DATE '2001-05-01' AS snapshot_date,
  cast((c_custkey * 17) % 100 AS double) / 100 AS feature_adoption FROM {customer}
UNION ALL
SELECT cast(c_custkey AS string), DATE '2001-04-01', cast((c_custkey * 29) % 90 AS double) / 100
FROM {customer}""",
    "arr_source": f"""
SELECT cast(c_custkey AS string) AS account_id, c_name AS account_name,
  CASE WHEN c_acctbal >= 0 THEN cast(c_acctbal AS decimal(18,2)) END AS arr,
  CASE WHEN c_acctbal >= 0 THEN cast(floor(c_acctbal / 12) AS decimal(18,2)) END AS mrr,
  cast(c_custkey % 41 - 10 AS double) / 100 AS arr_growth_pct,
  CASE WHEN c_custkey % 4 = 0 AND c_acctbal >= 0 THEN cast(c_acctbal AS decimal(18,2)) ELSE cast(0 AS decimal(18,2)) END AS new_logo_arr,
  CASE WHEN c_custkey % 4 = 1 AND c_acctbal >= 0 THEN cast(c_acctbal AS decimal(18,2)) ELSE cast(0 AS decimal(18,2)) END AS expansion_arr,
  CASE WHEN c_custkey % 4 = 2 AND c_acctbal >= 0 THEN cast(c_acctbal AS decimal(18,2)) ELSE cast(0 AS decimal(18,2)) END AS churn_arr,
  {_segment('c_custkey')} AS segment
FROM {{customer}}""",
    "arr_quarterly": f"""
SELECT {_segment('o_custkey')} AS segment, cast(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS int) AS quarter_no,
  cast(o_totalprice AS decimal(18,2)) AS arr FROM {{orders}}""",
    "acv_source": f"""
SELECT cast(o.o_orderkey AS string) AS opportunity_id, cast(o.o_custkey AS string) AS account_id,
  concat('Account ', cast(o.o_custkey AS string)) AS account_name, cast(l.acv AS decimal(18,2)) AS acv,
  cast(cast(o.o_totalprice AS decimal(18,2)) * 3 AS decimal(18,2)) AS tcv,
  cast(12 * (1 + o.o_orderkey % 3) AS int) AS term_months, cast(o.o_orderdate AS date) AS close_date,
  {_segment('o.o_custkey')} AS segment
FROM {{orders}} o
LEFT JOIN (SELECT l_orderkey, sum(cast(l_extendedprice AS decimal(18,2))) AS acv FROM {{lineitem}} GROUP BY l_orderkey) l
  ON l.l_orderkey = o.o_orderkey""",
    "forecast_snapshots": f"""
SELECT concat(cast(year(o_orderdate) AS string), '-Q', cast(quarter(o_orderdate) AS string)) AS period,
  {_segment('o_custkey')} AS segment, cast(o_orderkey % 25 AS string) AS owner_id,
  cast(date_trunc('month', o_orderdate) AS date) AS snapshot_date,
  cast(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN cast(o_totalprice AS decimal(18,2)) ELSE 0 END) AS decimal(18,2)) AS committed,
  cast(sum(CASE WHEN o_orderpriority = '2-HIGH' THEN cast(o_totalprice AS decimal(18,2)) ELSE 0 END) AS decimal(18,2)) AS best_case,
  cast(sum(CASE WHEN o_orderstatus <> 'F' THEN cast(o_totalprice AS decimal(18,2)) ELSE 0 END) AS decimal(18,2)) AS pipeline,
  cast(sum(CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 <> 0 THEN cast(o_totalprice AS decimal(18,2)) ELSE 0 END) AS decimal(18,2)) AS closed_won,
  CASE WHEN max(o_orderkey % 25) = 24 THEN cast(0 AS decimal(18,2)) ELSE cast(250000 AS decimal(18,2)) END AS quota
FROM {{orders}} GROUP BY 1, 2, 3, 4""",
    "nrr_source": f"""
SELECT cast(date_trunc('month', o_orderdate) AS date) AS period_date, {_segment('o_custkey')} AS segment,
  round(cast(sum(CASE WHEN o_orderstatus <> 'P' THEN cast(o_totalprice AS decimal(18,2)) ELSE 0 END) AS double) * 150
    / cast(sum(cast(o_totalprice AS decimal(18,2))) AS double), 4) AS nrr_pct,
  round(cast(sum(CASE WHEN o_orderstatus = 'F' THEN cast(o_totalprice AS decimal(18,2)) ELSE 0 END) AS double) * 100
    / cast(sum(cast(o_totalprice AS decimal(18,2))) AS double), 4) AS churn_pct,
  max(cast(o_orderdate AS date)) AS snapshot_date
FROM {{orders}} GROUP BY 1, 2""",
    "cdc_events": """
SELECT cast(user_id AS string) AS entity_id,
  CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'error' THEN 'DELETE' WHEN 'view' THEN 'UNDELETE' ELSE 'UPDATE' END AS event_type,
  cast(value AS decimal(18,2)) AS amount, ts AS updated_at, event_id AS kafka_offset,
  cast(event_id % 6 AS int) AS kafka_partition, cast(floor(value) AS int) AS health_score
FROM {events}""",
    "opportunity_raw": """
SELECT CASE WHEN o_orderkey % 97 = 0 THEN concat('{{"Id":"', cast(o_orderkey AS string), '","AccountId":')
  ELSE concat('{{"Id":', CASE WHEN o_orderkey % 89 = 0 THEN 'null' ELSE concat('"', cast(o_orderkey AS string), '"') END,
    ',"AccountId":"', cast(o_custkey AS string), '","AccountName":"Account ', cast(o_custkey AS string),
    '","OwnerId":"', cast(o_orderkey % 25 AS string), '","OwnerName":"Rep ', cast(o_orderkey % 25 AS string),
    '","Name":"Deal ', cast(o_orderkey AS string),
    '","Amount":"', CASE WHEN o_orderkey % 83 = 0 THEN 'not-a-number' ELSE cast(cast(o_totalprice AS decimal(18,2)) AS string) END,
    '","ACV__c":"', cast(cast(o_totalprice AS decimal(18,2)) AS string),
    '","StageName":"', CASE o_orderstatus WHEN 'F' THEN 'Closed Won' WHEN 'O' THEN 'Proposal' ELSE 'Discovery' END,
    '","CloseDate":"', CASE WHEN o_orderkey % 79 = 0 THEN '31/12/2001' ELSE cast(cast(o_orderdate AS date) AS string) END,
    '","Probability":"', cast(o_orderkey % 101 AS string), CASE WHEN o_orderkey % 2 = 0 THEN '.0' ELSE '' END,
    '","ForecastCategory":"', CASE o_orderpriority WHEN '1-URGENT' THEN 'Commit' WHEN '2-HIGH' THEN 'Best Case' WHEN '5-LOW' THEN 'Omitted' ELSE 'Pipeline' END,
    '","DaysInCurrentStage__c":"', cast(o_orderkey % 120 AS string),
    '","LastActivityDate":"', cast(cast(o_orderdate AS date) - cast(o_orderkey % 60 AS int) AS string),
    '","HealthScore__c":"', cast((o_orderkey * 37) % 101 AS string),
    '","CreatedDate":"', cast(cast(o_orderdate AS date) - 90 AS string),
    '","LastModifiedDate":"', cast(cast(o_orderdate AS date) AS string), ' 10:15:00',
    '","_EventType":"', CASE o_orderkey % 5 WHEN 0 THEN 'CREATE' WHEN 1 THEN 'DELETE' WHEN 2 THEN 'UNDELETE' ELSE 'UPDATE' END,
    '"}}') END AS raw_json, o_orderkey AS kafka_offset,
  cast(o_orderkey % 6 AS int) AS kafka_partition, o_orderdate AS kafka_ts
FROM {orders}""",
    "account_raw": f"""
SELECT CASE WHEN c_custkey % 97 = 0 THEN concat('{{{{"Id":"', cast(c_custkey AS string), '","Name":')
  ELSE concat('{{{{"Id":', CASE WHEN c_custkey % 89 = 0 THEN 'null' ELSE concat('"', cast(c_custkey AS string), '"') END,
    ',"Name":"', c_name, '","Industry":"', c_mktsegment, '","Segment__c":"', {_segment('c_custkey')},
    '","OwnerId":"', cast(c_custkey % 25 AS string), '","CSM__c":"', cast(c_nationkey AS string),
    '","ARR__c":"', cast(cast(c_acctbal AS decimal(18,2)) AS string),
    '","HealthScore__c":"', cast((c_custkey * 37) % 101 AS string), '","RiskTier__c":"Red',
    '","ContractEndDate__c":"', cast(DATE '2001-04-01' + cast(c_custkey % 365 AS int) AS string),
    '","LastModifiedDate":"2001-04-30 08:00:00","_EventType":"', CASE WHEN c_custkey % 5 = 0 THEN 'DELETE' ELSE 'UPDATE' END,
    '"}}}}') END AS raw_json, c_custkey AS kafka_offset,
  cast(c_custkey % 6 AS int) AS kafka_partition, TIMESTAMP_NTZ '2001-04-30 08:00:00' AS kafka_ts
FROM {{customer}}""",
    "agent_traces": """
SELECT cast(event_id AS string) AS trace_id, cast(user_id AS string) AS session_id,
  CASE WHEN event_type IN ('purchase','signup') THEN 'pipeline_health' ELSE 'customer_health' END AS agent_type,
  concat('question ', cast(event_id % 500 AS string)) AS query, cast(floor(value * 40) AS int) AS total_latency_ms,
  cast(event_id % 4000 AS int) AS input_tokens, cast(event_id % 1024 AS int) AS output_tokens,
  cast(60 + (event_id * 31) % 41 AS double) / 100 AS groundedness_score,
  cast(50 + (event_id * 17) % 41 AS double) / 100 AS confidence_score, event_id % 17 <> 0 AS sql_success, ts
FROM {events}""",
    "user_feedback": """
SELECT cast(event_id AS string) AS trace_id, cast(user_id AS string) AS user_id,
  CASE WHEN event_id % 5 = 0 THEN 1 ELSE 2 END AS rating, concat('note ', cast(event_id % 50 AS string)) AS comment, ts
FROM {events}""",
    "judge_outputs": """
SELECT cast(event_id AS string) AS trace_id, ts, concat('question ', cast(event_id % 500 AS string)) AS query,
  CASE event_type WHEN 'error' THEN 'no verdict possible'
    WHEN 'view' THEN concat('```json', chr(10), '{{"total_claims": ', cast(event_id % 6 AS string), ', "supported_claims": ',
      cast(event_id % 3 AS string), ', "unsupported_claims": ["claim ', cast(event_id AS string), '", "other"], "score": 0.',
      cast(10 + event_id % 90 AS string), '}}', chr(10), '```')
    WHEN 'click' THEN concat('{{"total_claims": 2, "unsupported_claims": []}}')
    ELSE concat('{{"total_claims": 3, "supported_claims": 2, "unsupported_claims": ["late ', cast(event_id AS string),
      '"], "score": 0.', cast(10 + event_id % 90 AS string), '}}') END AS raw,
  CASE WHEN event_type = 'signup' THEN '  ' ELSE 'answer' END AS response, 'context' AS context
FROM {events}""",
    "source_documents": """
SELECT doc_id AS source_id, text AS content, lang, source,
  CASE doc_id % 4 WHEN 0 THEN 'contracts' WHEN 1 THEN 'proposals' WHEN 2 THEN 'transcripts' ELSE 'emails' END AS doc_type,
  cast(doc_id % 150 AS string) AS account_id,
  concat('/Volumes/sales/documents/', CASE doc_id % 4 WHEN 0 THEN 'contracts' WHEN 1 THEN 'proposals' WHEN 2 THEN 'transcripts' ELSE 'emails' END,
    '/', cast(doc_id % 150 AS string), '/',
    CASE WHEN doc_id % 5 = 0 THEN concat('OPP-', cast(doc_id AS string), '.txt') ELSE concat('file', cast(doc_id AS string), '.txt') END) AS file_path
FROM {documents}""",
    "search_requests": """
SELECT vec_id AS query_id, CASE WHEN label % 2 = 0 THEN 'pipeline_health' ELSE 'customer_health' END AS agent_type,
  CASE WHEN label % 2 = 0 THEN 'proposals' ELSE 'contracts' END AS doc_type,
  CASE WHEN label = 3 THEN cast(vec_id % 150 AS string) END AS account_id,
  CASE WHEN label = 5 THEN cast(vec_id % 10 AS string) END AS account_name, embedding
FROM {embeddings}""",
    "questions": f"""
SELECT concat(cast(conv_id AS string), '-', cast(turn AS string)) AS query_id, conv_id, turn, role,
  concat({_drawn('conv_id * 7 + turn', TERMS)}, {_drawn('conv_id + turn * 3', JOINTS)}, text, CASE WHEN role = 'user' THEN '?' ELSE '' END) AS query,
  CASE conv_id % 4 WHEN 0 THEN ' sql ' WHEN 1 THEN 'Docs' WHEN 2 THEN 'hybrid' ELSE 'none of these' END AS class_label,
  CASE conv_id % 4 WHEN 0 THEN ' pipeline ' WHEN 1 THEN 'Customer' WHEN 2 THEN 'ambiguous' ELSE 'unsure' END AS route_label,
  cast(conv_id * 13 % 900 AS int) AS input_tokens, cast(turn * 31 AS int) AS output_tokens
FROM {{conversations}}""",
    "answer_parts": """
SELECT concat(cast(conv_id AS string), '-', cast(turn AS string)) AS query_id,
  CASE WHEN turn % 2 = 0 THEN 'pipeline_health' ELSE 'customer_health' END AS agent_type,
  CASE conv_id % 3 WHEN 0 THEN 'SQL' WHEN 1 THEN 'DOCS' ELSE 'HYBRID' END AS classification,
  CASE (conv_id + turn) % 4 WHEN 0 THEN 'Query returned no results.' WHEN 1 THEN concat('amount', chr(10), '------', chr(10), cast(conv_id AS string)) WHEN 2 THEN '' END AS sql_text,
  CASE (conv_id + turn) % 5 WHEN 0 THEN 'No relevant documents found.' WHEN 1 THEN NULL ELSE text END AS doc_text,
  (conv_id + turn) % 7 <> 0 AS sql_success, cast(conv_id * 13 % 900 AS int) AS input_tokens, cast(turn * 31 AS int) AS output_tokens
FROM {conversations}""",
    "sql_texts": """
SELECT doc_id, CASE doc_id % 8
    WHEN 0 THEN concat('SELECT * FROM metrics.arr WHERE note = ''', lang, '''')
    WHEN 1 THEN concat('```sql', chr(10), 'SELECT account_id FROM t -- ', text, chr(10), '```')
    WHEN 2 THEN concat('delete from metrics.arr -- ', text)
    WHEN 3 THEN concat('SELECT updated_at FROM t -- ', text)
    WHEN 4 THEN concat('SELECT REPLACE(a, ''x'', ''y'') FROM t -- ', source)
    WHEN 5 THEN concat('SELECT 1; DROP TABLE t -- ', text)
    WHEN 6 THEN concat('GRANT ALL ON t TO r -- ', text)
    ELSE text END AS sql_text
FROM {documents}""",
    "job_results": """
SELECT cast(p_partkey % 12 AS int) AS query_idx, p_partkey AS pos, p_name AS title, p_brand AS company, p_type AS location,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE cast(cast(p_retailprice AS decimal(18,2)) AS string) END AS salary,
  CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat(cast(p_size AS string), ' days ago') END AS posted,
  CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat('https://jobs.example.com/', cast(p_partkey AS string)) END AS link,
  concat('Role "', p_name, '"', chr(10), 'at ', p_brand, repeat(concat(' ', p_type), p_size)) AS description,
  CASE WHEN p_partkey % 13 = 0 THEN 'Sorry, no JSON' WHEN p_partkey % 11 = 0 THEN '{{"score": "7 of 10", "is_disqualified": "true"}}'
    ELSE concat('{{"score": ', cast(p_size % 11 AS string), ', "reason": "fit ', cast(p_size AS string), '", "is_disqualified": ',
    CASE WHEN p_partkey % 10 = 0 THEN 'true' ELSE 'false' END, '}}') END AS score_raw
FROM {part}""",
    "eval_results": """
SELECT concat('q', cast(d.doc_id AS string)) AS id, concat('run', cast(d.doc_id % 20 AS string)) AS run_id,
  CASE d.doc_id % 3 WHEN 0 THEN 'pipeline_health' WHEN 1 THEN 'customer_health' ELSE 'any' END AS agent,
  d.text AS response,
  CASE d.doc_id % 4 WHEN 0 THEN 'SELECT updated_at FROM t' WHEN 1 THEN 'SELECT 1' WHEN 2 THEN 'drop table t' END AS generated_sql,
  l.quality = 1 AS should_refuse, CASE WHEN l.toxic = 1 THEN 'the' ELSE 'salary' END AS forbidden,
  CASE WHEN l.quality IS NULL THEN NULL ELSE cast(70 + d.doc_id % 31 AS double) / 100 END AS groundedness_score,
  coalesce(l.toxic, 0) = 1 AS is_error
FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id""",
    "reporting_lines": """
SELECT concat('mgr-', cast(n_nationkey AS string)) AS manager, concat('mgr-', cast((n_nationkey * 3 + n_regionkey) % 25 AS string)) AS member
FROM {nation}
UNION ALL
SELECT concat('head-', cast(n_regionkey AS string)), concat('mgr-', cast(n_nationkey AS string)) FROM {nation}""",
    "entitlements": """
SELECT concat('mgr-', cast(s_nationkey AS string)) AS viewer, cast(s_suppkey % 25 AS string) AS owner_id FROM {supplier}""",
}


class Inputs:
    """Lazy access to the input tables and the views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def table_stream(self, name: str) -> DataFrame:
        """The same table as a stream of its files."""
        # a pattern, since a stream takes a table of one file only by pattern; a folder of files fits it as well
        return self.spark.readStream.schema(self.table(name).schema).parquet(f"{self.folder}/{name}.parquet*")

    def view_stream(self, name: str) -> DataFrame:
        """A view over one table, as a stream."""
        text = VIEWS[name]
        used = {t: self.table_stream(t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.view(name)
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)


def oracle_cte(name: str) -> str:
    """The view as a CTE for an engine in which the input tables are plain views."""
    text = VIEWS[name].format(**{t: t for t in TABLES})
    return f"{name} AS ({text.replace('TIMESTAMP_NTZ', 'TIMESTAMP')})"
