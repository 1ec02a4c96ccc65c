"""Results are only right when these equal the specification."""

# --- fixed values: domain enums ---------------------------------------------------------------------------
STAGES = ["Prospecting", "Discovery", "Proposal", "Negotiation", "Closed Won", "Closed Lost"]
CLOSED_STAGES = ["Closed Won", "Closed Lost"]
EARLY_STAGES = ["Prospecting", "Discovery"]
FORECAST_CATEGORIES = ["Commit", "Best Case", "Pipeline", "Omitted"]
SEGMENTS = ["Enterprise", "Mid-Market", "SMB"]
RISK_TIERS = ["Green", "Yellow", "Red"]
AT_RISK_TIERS = ["Yellow", "Red"]
CDC_EVENT_TYPES = ["CREATE", "UPDATE", "DELETE"]
DOC_TYPES = ["contracts", "proposals", "transcripts", "emails"]
ROUTES = ["PIPELINE", "CUSTOMER", "AMBIGUOUS"]
CLASSES = ["SQL", "DOCS", "HYBRID"]

# --- fixed values: change-event payload fields, (payload field, column, type) -----------------------------
OPPORTUNITY_FIELDS = [
    ("Id", "opportunity_id", "string"),
    ("AccountId", "account_id", "string"),
    ("AccountName", "account_name", "string"),
    ("OwnerId", "owner_id", "string"),
    ("OwnerName", "owner_name", "string"),
    ("Name", "name", "string"),
    ("Amount", "amount", "money"),
    ("ACV__c", "acv", "money"),
    ("StageName", "stage", "string"),
    ("CloseDate", "close_date", "date"),
    ("Probability", "probability", "int"),
    ("ForecastCategory", "forecast_category", "string"),
    ("DaysInCurrentStage__c", "days_in_stage", "int"),
    ("LastActivityDate", "last_activity_date", "date"),
    ("HealthScore__c", "health_score", "int"),
    ("CreatedDate", "created_date", "date"),
    ("LastModifiedDate", "updated_at", "timestamp"),
    ("_EventType", "event_type", "string"),
]
ACCOUNT_FIELDS = [
    ("Id", "account_id", "string"),
    ("Name", "name", "string"),
    ("Industry", "industry", "string"),
    ("Segment__c", "segment", "string"),
    ("OwnerId", "owner_id", "string"),
    ("CSM__c", "csm_id", "string"),
    ("ARR__c", "arr", "money"),
    ("HealthScore__c", "health_score", "int"),
    ("RiskTier__c", "risk_tier", "string"),
    ("ContractEndDate__c", "contract_end", "date"),
    ("LastModifiedDate", "updated_at", "timestamp"),
    ("_EventType", "event_type", "string"),
]
MAX_OFFSETS_PER_TRIGGER = 50_000
CDC_TRIGGER = "10 seconds"
TOMBSTONE_RETENTION_DAYS = 7

# --- fixed values: question routing -----------------------------------------------------------------------
PIPELINE_WORDS = "pipeline|forecast|quota|win rate|deal|stage|close date|acv|new logo|slipp|stuck"
CUSTOMER_WORDS = "health|churn|nrr|renewal|contract|at.risk|adoption|retention|csm|expansion|sentiment"
DOCUMENT_TERMS = ["contract", "renewal", "clause", "term", "nda", "agreement"]
METRIC_TERMS = ["score", "nrr", "churn", "arr", "risk", "health"]
RISK_TERMS = ["at risk", "churn", "churning"]
ACCOUNT_LEAD_INS = ["for ", "of ", "about ", "with "]
MIN_ACCOUNT_CHARS = 4
QUERY_MIN_CHARS, QUERY_MAX_CHARS = 1, 2000
RATING_DOWN, RATING_UP = 1, 2

# --- fixed values: SQL safety -----------------------------------------------------------------------------
UNSAFE_SQL_WORDS = "INSERT|UPDATE|DELETE|DROP|TRUNCATE|ALTER|CREATE|REPLACE|MERGE"
EVAL_UNSAFE_SUBSTRINGS = ["DELETE", "DROP", "TRUNCATE", "UPDATE", "INSERT", "ALTER"]
RESULT_ROW_CAP = 200
CONTEXT_ROW_CAP = 50

# --- fixed values: context texts --------------------------------------------------------------------------
NO_ROWS_TEXT = "Query returned no results."
NO_DOCUMENTS_TEXT = "No relevant documents found."
NO_DATA_TEXT = "No data available."
CHUNK_SEPARATOR = "\n\n---\n\n"
PIPELINE_HEADINGS = ("## Live Metrics Data", "## Relevant Documents")
CUSTOMER_HEADINGS = ("## Live Account & Health Data", "## Contract & Document Context")
PIPELINE_VIEW_HEADING = "**Pipeline View:**"
CUSTOMER_VIEW_HEADING = "**Customer Health View:**"
AGENT_SEARCH_DOC_TYPE = {"pipeline_health": "proposals", "customer_health": "contracts"}
SEARCH_K, AGENT_SEARCH_K = 8, 6

# --- fixed values: documents ------------------------------------------------------------------------------
CHUNK_TOKENS, CHUNK_OVERLAP, CHUNK_MIN_TOKENS = 512, 50, 20
EMBED_BATCH = 64
DOCUMENT_GLOB = "*.{pdf,docx,doc,txt,md}"
OPPORTUNITY_IN_NAME = r"(?i)(OPP[-_][\p{L}\p{N}_]+)"
URL_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"

# --- fixed values: scores, prices, thresholds -------------------------------------------------------------
USD_PER_M_INPUT, USD_PER_M_OUTPUT = 3.0, 15.0
GROUNDED_MIN = 0.85
BAND_GREEN, BAND_AMBER = 0.85, 0.6
JUDGE_CONTEXT_CHARS, JUDGE_RESPONSE_CHARS = 8000, 4000
JOB_SNIPPET_CHARS, EVAL_SNIPPET_CHARS = 400, 200
RISK_HEALTH_BELOW, RISK_TOP = 60, 25
ALERT_GROUNDED_7D, ALERT_CONFIDENCE, ALERT_P95_MS, ALERT_SQL_FAILURE = 0.80, 0.70, 5000, 0.10
LAG_MESSAGES, LAG_SILENT_MINUTES = 10_000, 5
STUCK_DAYS, INACTIVE_DAYS, EXPIRY_DAYS, LARGE_DEAL = 30, 14, 90, 50_000

# --- fixed values: job matching ---------------------------------------------------------------------------
JOB_MAX_QUERIES, JOB_MIN_SCORE, JOB_TOP = 12, 5, 30
JOB_BAND_GREEN, JOB_BAND_AMBER = 8, 6
JOB_CSV_COLUMNS = [
    "title", "company", "location", "salary", "score", "score_reason", "url", "posted", "is_disqualified",
]
JOB_SEARCH_URL = "https://www.google.com/search?q="
NOT_SCORED = "not scored"
