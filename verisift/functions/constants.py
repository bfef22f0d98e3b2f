"""Stored strings, thresholds and formats that results depend on."""

# Rule types
NOT_NULL = "not_null"
LENGTH_CHECK = "length_check"
RANGE_CHECK = "range_check"
DOMAIN_CHECK = "domain_check"
REGEX_CHECK = "regex_check"
UNIQUENESS = "uniqueness"
DATA_TYPE = "data_type"
CONDITIONAL = "conditional"
CUSTOM_SQL = "custom_sql"
REFERENTIAL = "referential"
COMPLETENESS = "completeness"
FRESHNESS = "freshness"
RULE_TYPES = (
    NOT_NULL,
    LENGTH_CHECK,
    RANGE_CHECK,
    DOMAIN_CHECK,
    REGEX_CHECK,
    UNIQUENESS,
    DATA_TYPE,
    CONDITIONAL,
    CUSTOM_SQL,
    REFERENTIAL,
    COMPLETENESS,
    FRESHNESS,
)

# Severities, statuses
SEVERITIES = ("critical", "high", "medium", "low", "info")
PASSED = "passed"
FAILED = "failed"
WARNING = "warning"
ERROR = "error"

# Thresholds
PASS_THRESHOLD = 95.0
DOMAIN_MAX_DISTINCT = 20
TOP_VALUES = 10
PROFILE_SAMPLE_ROWS = 5

# Column cleaning for money-like text
NA_TOKEN = "-"
MONEY_NOISE = r"(#?N/A|#VALUE!)|[$, ]"

# Ingest type names
INGEST_TYPES = ("string", "double", "int", "date", "number", "timestamp")

# data_type rule: names that are tested; every other name accepts all values
CASTABLE_TYPES = {"integer": "int", "double": "double", "date": "date", "timestamp": "timestamp"}

# Value classes of string columns
INTEGRAL_PATTERN = r"^[+-]? ?[0-9]+$"
FRACTIONAL_PATTERN = r"^[+-]? ?([0-9]+\.[0-9]*|\.[0-9]+)$"
BOOLEAN_PATTERN = r"^(true|false)$"

# Rule-table columns
RULE_COLUMNS = (
    "db_name",
    "table_name",
    "column_name",
    "sql",
    "constraint_name",
    "constraint_rule",
    "constraint_desc",
    "is_active",
    "reject_capture",
    "reject_sql",
    "rule_type",
    "check_level",
    "check_message",
)
NOTIFY_COLUMNS = ("notify_capture", "notify_topic")
SCOPE_COLUMNS = ("db_name", "table_name", "column_name", "is_active")

# Default alert channels
ALERT_CHANNELS = ("email", "sns", "log")

# Verdict text
VERDICTS = {
    PASSED: "DATA QUALITY PASSED",
    WARNING: "DATA QUALITY WARNING",
    FAILED: "DATA QUALITY FAILED",
}
