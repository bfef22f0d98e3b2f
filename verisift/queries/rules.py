"""Rule checks, run reports and audit records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisift.functions.rules import Rule
from verisift.operators.checks import check
from verisift.operators.rejects import audit_trail, failing_rows, rejects
from verisift.operators.report import (
    alert_history, alert_payload, anomaly_counts, column_health, report_document, summarise,
    supplier_style_report, supplier_style_samples, verdict,
)

from verisift.session import settle

from .common import (
    AS_OF, DIRTY_CUSTOMER_SQL, DIRTY_ORDERS_SQL, EVENT_TEXT_SQL, RUN_ID, SUPPLIER_STYLE_SQL,
    dirty_customer, dirty_orders, event_text, supplier_style, table,
)

SHOWN = [
    "rule_id", "column", "severity", "status", "total_records", "passed_records",
    "failed_records", "pass_percentage",
]

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

# (rule, SQL condition of a failing row of view d, or a scalar SQL text when it starts with "(")
CUSTOMER_RULES: list[tuple[Rule, str]] = [
    (Rule("R01", "not_null", "c_name", "critical"), "c_name IS NULL OR trim(c_name) = ''"),
    (Rule("R02", "length_check", "c_name", "low", params={"min_length": 10, "max_length": 17}),
     "length(c_name) < 10 OR length(c_name) > 17"),
    (Rule("R03", "range_check", "c_acctbal", "high", params={"min_value": 0, "max_value": 9000}),
     "c_acctbal < 0 OR c_acctbal > 9000"),
    (Rule("R04", "domain_check", "c_mktsegment", "medium", params={"allowed_values": SEGMENTS}),
     "c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')"),
    (Rule("R05", "regex_check", "c_name", "medium", params={"pattern": "^Customer#[0-9]{9}$"}),
     "NOT regexp_matches(c_name, '^Customer#[0-9]{9}$')"),
    (Rule("R06", "uniqueness", "c_name", "critical"),
     "(SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM d GROUP BY c_name) AS g WHERE n > 1)"),
    (Rule("R07", "data_type", "c_name", "info", params={"expected_type": "integer"}), "c_name IS NOT NULL"),
    (Rule("R08", "conditional", "c_acctbal", "high", params={
        "condition_column": "c_mktsegment", "condition_operator": "equals", "condition_value": "BUILDING",
        "then_rule_type": "range_check", "then_params": {"min_value": 0}}),
     "c_mktsegment = 'BUILDING' AND c_acctbal < 0"),
    (Rule("R09", "custom_sql", "c_acctbal", "low", params={
        "sql_expression": "SELECT * FROM {table} WHERE c_acctbal > 5000 AND c_mktsegment = 'UNKNOWN'"}),
     "c_acctbal > 5000 AND c_mktsegment = 'UNKNOWN'"),
    (Rule("R10", "referential", "c_nationkey", "high", params={
        "reference": "nation", "reference_column": "n_nationkey"}),
     "c_nationkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey)"),
    (Rule("R11", "length_check", "c_mktsegment", "low"), "1 = 0"),
    (Rule("R12", "range_check", "c_custkey", "medium", params={}), "1 = 0"),
]
BROKEN_RULE = Rule("R13", "not_null", "no_such_column", "high")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _failed_count(condition: str) -> str:
    if condition.startswith("("):
        return condition
    return f"(SELECT count(*) FROM d WHERE {condition})"


def results_sql(view_sql: str, rules: list[tuple[Rule, str]], broken: tuple[Rule, ...] = ()) -> str:
    """Result rows of row-level rules over a view, as common table expressions."""
    rows = [
        f"SELECT {i} AS rule_order, '{r.rule_id}' AS rule_id, '{r.rule_type}' AS rule_type, '{r.column}' AS \"column\", "
        f"'{r.severity}' AS severity, {_failed_count(cond)} AS failed, false AS broken"
        for i, (r, cond) in enumerate(rules)
    ] + [
        f"SELECT {len(rules) + i}, '{r.rule_id}', '{r.rule_type}', '{r.column}', '{r.severity}', 0, true"
        for i, r in enumerate(broken)
    ]
    return f"""
WITH d AS ({view_sql}),
t AS (SELECT count(*) AS n FROM d),
f AS ({' UNION ALL '.join(rows)}),
p AS (SELECT f.*, n, CASE WHEN broken THEN 0 ELSE greatest(n - failed, 0) END AS passed FROM f, t),
results AS (
  SELECT rule_order, rule_id, rule_type, "column", severity, n AS total_records, passed AS passed_records,
         CAST(failed AS BIGINT) AS failed_records,
         CASE WHEN broken THEN 0.0 WHEN n > 0 THEN round(passed * 100.0::DOUBLE / n, 2) ELSE 100.0 END AS pass_percentage,
         CASE WHEN broken THEN 'error' WHEN failed = 0 THEN 'passed'
              WHEN round(passed * 100.0::DOUBLE / n, 2) >= 95 THEN 'warning' ELSE 'failed' END AS status
  FROM p)"""


SHOWN_SQL = ", ".join('"column"' if c == "column" else c for c in SHOWN)


def _listing(view_sql: str, rules: list[tuple[Rule, str]], broken: tuple[Rule, ...] = ()) -> str:
    return results_sql(view_sql, rules, broken) + f"\nSELECT {SHOWN_SQL} FROM results"


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return add


def _checked(name: str, source, view_sql: str, rules: list[tuple[Rule, str]], refs=None) -> None:
    """A query that runs a few rules over one input and lists the results."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        named = {k: table(spark, sf_dir, v) for k, v in (refs or {}).items()}
        return check(
            source(spark, sf_dir), [r for r, _ in rules], dataset_id=name, run_id=RUN_ID,
            as_of=AS_OF, refs=named,
        ).select(*SHOWN)
    QUERIES[name] = run
    ORACLE[name] = _listing(view_sql, rules)


def _table(name: str):
    return lambda spark, sf_dir: table(spark, sf_dir, name)


def _pick(*rule_ids: str) -> list[tuple[Rule, str]]:
    return [r for r in CUSTOMER_RULES if r[0].rule_id in rule_ids]


# --- one query per rule type -------------------------------------------------------------

_checked("rule_not_null", dirty_customer, DIRTY_CUSTOMER_SQL, [
    *_pick("R01"), (Rule("R02", "not_null", "c_acctbal"), "c_acctbal IS NULL")])
_checked("rule_length", _table("documents"), "SELECT * FROM documents", [
    (Rule("R01", "length_check", "text", params={"min_length": 50, "max_length": 20000}),
     "length(text) < 50 OR length(text) > 20000"),
    (Rule("R02", "length_check", "n_chars", params={"max_length": 3}), "length(CAST(n_chars AS VARCHAR)) > 3")])
_checked("rule_range", _table("customer"), "SELECT * FROM customer", [
    (Rule("R01", "range_check", "c_acctbal", params={"min_value": 0}), "c_acctbal < 0")])
_checked("rule_domain", dirty_customer, DIRTY_CUSTOMER_SQL, [
    *_pick("R04"),
    (Rule("R05", "domain_check", "c_nationkey", params={"allowed_values": [1, 2, 3, None]}),
     "c_nationkey NOT IN (1, 2, 3)")])
_checked("rule_regex", _table("documents"), "SELECT * FROM documents", [
    (Rule("R01", "regex_check", "text", params={"pattern": EMAIL}), f"NOT regexp_matches(text, '{EMAIL}')"),
    (Rule("R02", "regex_check", "source", params={"pattern": "1$"}), "NOT regexp_matches(source, '1$')")])
_checked("rule_unique", _table("lineitem"), "SELECT * FROM lineitem", [
    (Rule("R01", "uniqueness", "l_orderkey", params={"columns": ["l_orderkey", "l_linenumber"]}),
     "(SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM d GROUP BY l_orderkey, l_linenumber) AS g WHERE n > 1)"),
    (Rule("R02", "uniqueness", "l_returnflag"), "1 = 1")])
_checked("rule_data_type", event_text, EVENT_TEXT_SQL, [
    (Rule("R01", "data_type", "k_text", params={"expected_type": "integer"}), "NOT regexp_matches(k_text, '^[0-9]+$')"),
    (Rule("R02", "data_type", "k_text", params={"expected_type": "double"}), "k_text = 'n/a'"),
    (Rule("R03", "data_type", "k_flag", params={"expected_type": "date"}), "1 = 1"),
    (Rule("R04", "data_type", "k_text", params={"expected_type": "string"}), "1 = 0")])


def _conditional(rule_id: str, column: str, when: tuple[str, str, object], then: str, params: dict) -> Rule:
    return Rule(rule_id, "conditional", column, "medium", params={
        "condition_column": when[0], "condition_operator": when[1], "condition_value": when[2],
        "then_rule_type": then, "then_params": params})


_checked("rule_conditional", dirty_orders, DIRTY_ORDERS_SQL, [
    (_conditional("R01", "o_orderpriority", ("o_orderstatus", "equals", "F"), "not_null", {}),
     "o_orderstatus = 'F' AND o_orderpriority IS NULL"),
    (_conditional("R02", "o_orderpriority", ("o_orderstatus", "not_equals", "F"), "domain_check",
                  {"allowed_values": ["1-URGENT", "2-HIGH"]}),
     "o_orderstatus <> 'F' AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"),
    (_conditional("R03", "o_totalprice", ("o_orderpriority", "in", ["1-URGENT", "5-LOW"]), "range_check",
                  {"max_value": 400000}),
     "o_orderpriority IN ('1-URGENT', '5-LOW') AND o_totalprice > 400000"),
    (_conditional("R04", "o_orderpriority", ("o_totalprice", "greater_than", 300000), "regex_check", {"pattern": "^[1-3]"}),
     "o_totalprice > 300000 AND NOT regexp_matches(o_orderpriority, '^[1-3]')"),
    (_conditional("R05", "o_orderpriority", ("o_totalprice", "less_than", 50000), "length_check", {"max_length": 6}),
     "o_totalprice < 50000 AND length(o_orderpriority) > 6")])
_checked("rule_referential", dirty_orders, DIRTY_ORDERS_SQL, [
    (Rule("R01", "referential", "o_custkey", params={"reference": "customer", "reference_column": "c_custkey"}),
     "o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)")],
    refs={"customer": "customer"})
_checked("rule_referential_labels", _table("documents"), "SELECT * FROM documents", [
    (Rule("R01", "referential", "doc_id", params={"reference": "labels"}),
     "NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = d.doc_id)")],
    refs={"labels": "labels"})


@_query("rule_error", """
SELECT 'R01' AS rule_id, 'error' AS status, count(*) AS total_records, CAST(0 AS BIGINT) AS passed_records,
       CAST(0 AS BIGINT) AS failed_records FROM embeddings
UNION ALL SELECT 'R02', 'error', count(*), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM embeddings
UNION ALL SELECT 'R03', 'passed', count(*), count(*), CAST(0 AS BIGINT) FROM embeddings""")
def rule_error(spark, sf_dir):
    rules = [Rule("R01", "not_null", "embedding"), Rule("R02", "regex_check", "label", params={"pattern": "(("}),
             Rule("R03", "not_null", "label")]
    found = check(table(spark, sf_dir, "embeddings"), rules, dataset_id="embeddings", run_id=RUN_ID)
    return found.select("rule_id", "status", "total_records", "passed_records", "failed_records")


@_query("rule_completeness", f"""
WITH d AS ({DIRTY_CUSTOMER_SQL}),
m AS (SELECT count(*) AS n, count(*) - count(c_acctbal) AS bal, count(*) - count(c_name) AS nam FROM d)
SELECT 'R01' AS rule_id, CASE WHEN (n - bal) / n >= 0.9 THEN 'passed' ELSE 'failed' END AS status, bal AS failed_records FROM m
UNION ALL SELECT 'R02', CASE WHEN (n - nam) / n >= 0.99 THEN 'passed' ELSE 'failed' END, nam FROM m""")
def rule_completeness(spark, sf_dir):
    rules = [Rule("R01", "completeness", "c_acctbal", params={"min_ratio": 0.9}),
             Rule("R02", "completeness", "c_name", params={"min_ratio": 0.99})]
    found = check(dirty_customer(spark, sf_dir), rules, dataset_id="customer", run_id=RUN_ID)
    return found.select("rule_id", "status", "failed_records")


@_query("rule_freshness", """
WITH m AS (SELECT count(*) AS n, max(ts) AS newest FROM events)
SELECT 'R01' AS rule_id, CASE WHEN newest < TIMESTAMP '2024-01-31' - INTERVAL 2 DAY THEN 'failed' ELSE 'passed' END AS status,
       CASE WHEN newest < TIMESTAMP '2024-01-31' - INTERVAL 2 DAY THEN n ELSE 0 END AS failed_records FROM m
UNION ALL
SELECT 'R02', CASE WHEN newest < TIMESTAMP '2024-01-31' - INTERVAL 1 MINUTE THEN 'failed' ELSE 'passed' END,
       CASE WHEN newest < TIMESTAMP '2024-01-31' - INTERVAL 1 MINUTE THEN n ELSE 0 END FROM m""")
def rule_freshness(spark, sf_dir):
    rules = [Rule("R01", "freshness", "ts", params={"max_age_seconds": 2 * 86400}),
             Rule("R02", "freshness", "ts", params={"max_age_seconds": 60})]
    found = check(table(spark, sf_dir, "events"), rules, dataset_id="events", run_id=RUN_ID, as_of="2024-01-31 00:00:00")
    return found.select("rule_id", "status", "failed_records")


SHIPPED_EARLY = """
SELECT l.* FROM {table} l JOIN ordered o ON l.l_orderkey = o.o_orderkey WHERE l.l_shipdate < o.o_orderdate"""


@_query("rule_custom_sql", _listing("SELECT * FROM lineitem", [
    (Rule("R01", "custom_sql", "l_shipdate"),
     "EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND l_shipdate < o_orderdate)")]))
def rule_custom_sql(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("ordered")
    rule = Rule("R01", "custom_sql", "l_shipdate", params={"sql_expression": SHIPPED_EARLY})
    return check(table(spark, sf_dir, "lineitem"), [rule], dataset_id="lineitem", run_id=RUN_ID).select(*SHOWN)


# --- failing rows ------------------------------------------------------------------------

@_query("rule_unique_rows", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
  SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) AS w WHERE n > 1""")
def rule_unique_rows(spark, sf_dir):
    rule = Rule("R", "uniqueness", "l_orderkey", params={"columns": ["l_orderkey", "l_linenumber"]})
    rows = failing_rows(table(spark, sf_dir, "lineitem"), [rule])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@_query("rule_unique_null_rows", f"""
WITH d AS ({DIRTY_CUSTOMER_SQL})
SELECT c_custkey, c_name FROM (SELECT *, count(*) OVER (PARTITION BY c_name) AS n FROM d) AS w WHERE n > 1""")
def rule_unique_null_rows(spark, sf_dir):
    return failing_rows(dirty_customer(spark, sf_dir), [Rule("R", "uniqueness", "c_name")]).select("c_custkey", "c_name")


@_query("rule_referential_rows", f"""
WITH d AS ({DIRTY_ORDERS_SQL})
SELECT o_orderkey, o_custkey FROM d
WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)""")
def rule_referential_rows(spark, sf_dir):
    rule = Rule("R", "referential", "o_custkey", params={"reference": "customer", "reference_column": "c_custkey"})
    rows = failing_rows(dirty_orders(spark, sf_dir), [rule], refs={"customer": table(spark, sf_dir, "customer")})
    return rows.select("o_orderkey", "o_custkey")


@_query("rule_regex_rows", f"SELECT doc_id, source FROM documents WHERE NOT regexp_matches(text, '{EMAIL}')")
def rule_regex_rows(spark, sf_dir):
    rule = Rule("R", "regex_check", "text", params={"pattern": EMAIL})
    return failing_rows(table(spark, sf_dir, "documents"), [rule]).select("doc_id", "source")


@_query("rule_conditional_rows", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_returnflag = 'R' AND l_linestatus <> 'F'""")
def rule_conditional_rows(spark, sf_dir):
    rule = _conditional("R", "l_linestatus", ("l_returnflag", "equals", "R"), "domain_check", {"allowed_values": ["F"]})
    return failing_rows(table(spark, sf_dir, "lineitem"), [rule]).select("l_orderkey", "l_linenumber", "l_quantity")


# --- runs over a rule set ------------------------------------------------------------------

def customer_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [r for r, _ in CUSTOMER_RULES] + [BROKEN_RULE]
    return check(
        dirty_customer(spark, sf_dir), rules, dataset_id="customer", run_id=RUN_ID, as_of=AS_OF,
        refs={"nation": table(spark, sf_dir, "nation")},
    )


def customer_rejects(spark: SparkSession, sf_dir: str, sample: int | None = None) -> DataFrame:
    rules = [r for r, _ in CUSTOMER_RULES] + [BROKEN_RULE]
    return rejects(
        dirty_customer(spark, sf_dir), rules, dataset_id="customer", run_id=RUN_ID, as_of=AS_OF,
        keys=["c_custkey"], sample=sample, refs={"nation": table(spark, sf_dir, "nation")},
    )


def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results as a run stores them; reports derive from these, not from the data."""
    return settle(customer_results(spark, sf_dir))


RESULTS_SQL = results_sql(DIRTY_CUSTOMER_SQL, CUSTOMER_RULES, (BROKEN_RULE,))
SUMMARY_SQL = RESULTS_SQL + f""",
c AS (SELECT count(*) AS total_rules,
        count(*) FILTER (status = 'passed') AS passed_rules, count(*) FILTER (status = 'failed') AS failed_rules,
        count(*) FILTER (status = 'warning') AS warning_rules, count(*) FILTER (status = 'error') AS error_rules,
        count(*) FILTER (status = 'failed' AND severity IN ('critical', 'high')) AS severe FROM results),
s AS (SELECT *, round(passed_rules * 100.0::DOUBLE / total_rules, 2) AS overall_score FROM c),
summary AS (SELECT '{RUN_ID}' AS run_id, 'customer' AS dataset_id,
        CASE WHEN severe > 0 OR overall_score < 95 THEN 'failed' WHEN warning_rules > 0 THEN 'warning' ELSE 'passed' END AS overall_status,
        overall_score, total_rules, passed_rules, failed_rules, warning_rules, error_rules FROM s)"""


@_query("ruleset_results", RESULTS_SQL + f"\nSELECT {SHOWN_SQL} FROM results")
def ruleset_results(spark, sf_dir):
    return customer_results(spark, sf_dir).select(*SHOWN)


def _customer_summary(spark, sf_dir):
    return summarise(stored_results(spark, sf_dir), dataset_id="customer", run_id=RUN_ID)


@_query("ruleset_summary", SUMMARY_SQL + "\nSELECT * FROM summary")
def ruleset_summary(spark, sf_dir):
    return _customer_summary(spark, sf_dir)


@_query("run_verdict", SUMMARY_SQL + """
SELECT run_id, dataset_id, overall_status, overall_score,
       CASE overall_status WHEN 'passed' THEN 'DATA QUALITY PASSED' WHEN 'warning' THEN 'DATA QUALITY WARNING'
            ELSE 'DATA QUALITY FAILED' END AS verdict, total_rules, passed_rules, failed_rules, warning_rules FROM summary""")
def run_verdict(spark, sf_dir):
    return verdict(_customer_summary(spark, sf_dir))


@_query("column_health", RESULTS_SQL + """
SELECT "column", count(*) AS total_checks, count(*) FILTER (status = 'passed') AS passed,
       count(*) FILTER (status = 'failed') AS failed,
       CASE WHEN count(*) FILTER (status = 'failed') = 0 THEN 'HEALTHY' ELSE 'UNHEALTHY' END AS health,
       string_agg(rule_id || ':' || status, ',' ORDER BY rule_order) AS checks
FROM results WHERE status <> 'error' GROUP BY "column\"""")
def column_health_query(spark, sf_dir):
    listed = F.array_join(F.transform("checks", lambda c: F.concat(c["rule_id"], F.lit(":"), c["status"])), ",")
    return column_health(stored_results(spark, sf_dir)).select(
        "column", "total_checks", "passed", "failed", "health", listed.alias("checks"))


JSON_ROW = """CAST(to_json({'c_custkey': CAST(c_custkey AS VARCHAR), 'c_name': c_name,
  'c_nationkey': CAST(c_nationkey AS VARCHAR), 'c_acctbal': CAST(c_acctbal AS VARCHAR), 'c_mktsegment': c_mktsegment}) AS VARCHAR)"""


def _rejects_sql() -> str:
    parts = []
    for rule, condition in CUSTOMER_RULES:
        if rule.rule_type == "uniqueness":
            source = "(SELECT *, count(*) OVER (PARTITION BY c_name) AS n FROM d) AS d"
            condition = "n > 1"
        else:
            source = "d"
        parts.append(
            f"SELECT '{rule.rule_id}' AS rule_id, '{rule.rule_type}' AS rule_type, '{rule.column}' AS \"column\", "
            f"'{rule.severity}' AS severity, c_custkey, CAST(c_custkey AS VARCHAR) AS row_key, "
            f"CAST({rule.column} AS VARCHAR) AS actual_value, {_quoted(rule.expected_constraint)} AS expected_constraint, "
            f"{JSON_ROW} AS row_data FROM {source} WHERE {condition}"
        )
    union = "\nUNION ALL ".join(parts)
    return f"""
WITH d AS ({DIRTY_CUSTOMER_SQL}),
found AS ({union}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY c_custkey) AS rn,
  'ANO_' || left(sha256('{RUN_ID}|' || rule_id || '|' || row_key), 32) AS anomaly_id FROM found)"""


REJECTS_SQL = _rejects_sql()
REJECT_COLUMNS = ["anomaly_id", "rule_id", "rule_type", "column", "severity", "row_key", "actual_value", "expected_constraint", "row_data"]
REJECT_SQL_COLUMNS = ", ".join('"column"' if c == "column" else c for c in REJECT_COLUMNS)


def _shown(found: DataFrame) -> DataFrame:
    """Records with the digest part of their id; the number behind it has no counterpart in SQL."""
    return found.withColumn("anomaly_id", F.substring_index("anomaly_id", "-", 1))


RECORDS_TOGETHER = 200_000  # records that one task counts, about


def _counted(found: DataFrame, group: list[str], **distinct: str) -> DataFrame:
    """Records and exact numbers of distinct values per group.

    Nearly all values differ, so summing them up before the shuffle would only fill the memory of
    the tasks that read; they are dealt to as many tasks as their number needs."""
    parts = -(-found.count() // RECORDS_TOGETHER) or 1
    counted = []
    for name, column in distinct.items():
        once = found.select(*group, column).repartition(parts, *group, column).groupBy(*group, column).agg(F.count(F.lit(1)).alias("n"))
        numbers = [F.count(column) if other == name else F.max(F.lit(None).cast("long")) for other in distinct]
        counted.append(once.groupBy(*group).agg(F.sum("n").alias("records"), *[n.alias(other) for n, other in zip(numbers, distinct, strict=True)]))
    return reduce(DataFrame.union, counted).groupBy(*group).agg(F.max("records").alias("records"), *[F.max(n).alias(n) for n in distinct])


@_query("rejects_default", REJECTS_SQL + """
SELECT rule_id, severity, count(*) AS records, count(*) AS ids, count(DISTINCT row_key) AS row_keys FROM ranked GROUP BY 1, 2""")
def rejects_default(spark, sf_dir):
    found = customer_rejects(spark, sf_dir)
    return _counted(found, ["rule_id", "severity"], ids="anomaly_id", row_keys="row_key")


@_query("rejects_by_rule", REJECTS_SQL + f"\nSELECT {REJECT_SQL_COLUMNS} FROM ranked")
def rejects_by_rule(spark, sf_dir):
    return _shown(customer_rejects(spark, sf_dir)).select(*REJECT_COLUMNS)


@_query("rejects_sample", REJECTS_SQL + """
SELECT rule_id, "column", severity, least(count(*), 100) AS records, least(count(*), 100) AS rows_sampled FROM ranked GROUP BY 1, 2, 3""")
def rejects_sample(spark, sf_dir):
    found = customer_rejects(spark, sf_dir, sample=100)
    return found.groupBy("rule_id", "column", "severity").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("row_key").alias("rows_sampled"))


LINEITEM_RULES = [
    (Rule("L01", "range_check", "l_quantity", "low", params={"min_value": 5}), "l_quantity < 5"),
    (Rule("L02", "range_check", "l_discount", "low", params={"max_value": 0.05}), "l_discount > 0.05"),
    (Rule("L03", "domain_check", "l_returnflag", "low", params={"allowed_values": ["A", "R"]}), "l_returnflag NOT IN ('A', 'R')"),
]


@_query("rejects_without_keys", """
WITH f AS (SELECT 'L01' AS rule_id FROM lineitem WHERE l_quantity < 5
  UNION ALL SELECT 'L02' FROM lineitem WHERE l_discount > 0.05
  UNION ALL SELECT 'L03' FROM lineitem WHERE l_returnflag NOT IN ('A', 'R'))
SELECT rule_id, count(*) AS records, count(*) AS ids FROM f GROUP BY rule_id""")
def rejects_without_keys(spark, sf_dir):
    found = rejects(table(spark, sf_dir, "lineitem"), [r for r, _ in LINEITEM_RULES], dataset_id="lineitem", run_id=RUN_ID, as_of=AS_OF)
    return _counted(found, ["rule_id"], ids="anomaly_id")


@_query("audit_for_run", REJECTS_SQL + f"""
SELECT {REJECT_SQL_COLUMNS}, '2024-03-05T00:00:00' AS detected_at, (SELECT count(*) FROM found) AS total_anomalies
FROM ranked""")
def audit_for_run(spark, sf_dir):
    trail = audit_trail(settle(customer_rejects(spark, sf_dir)), RUN_ID)
    return _shown(trail).select(*REJECT_COLUMNS, "detected_at", "total_anomalies")


@_query("severity_counts", REJECTS_SQL + """
SELECT severity, count(*) AS anomalies FROM ranked GROUP BY severity""")
def severity_counts(spark, sf_dir):
    return anomaly_counts(stored_results(spark, sf_dir), "severity").select("severity", "anomalies")


@_query("column_counts", REJECTS_SQL + """
SELECT "column", count(*) AS anomalies FROM ranked GROUP BY "column\"""")
def column_counts(spark, sf_dir):
    return anomaly_counts(stored_results(spark, sf_dir), "column").select("column", "anomalies")


ALERT_SQL = SUMMARY_SQL + """,
payload AS (SELECT run_id, 'DQ Alert: Dataset ''' || dataset_id || ''' - ' || upper(overall_status) AS subject,
  overall_status AS status, overall_score AS score, total_rules, failed_rules,
  (SELECT string_agg(format('  - [{}] {}: ''{}'' {} -> {:.1f}% pass ({} failures)', upper(severity), rule_id, "column",
     rule_type, pass_percentage, failed_records), chr(10) ORDER BY "column", rule_order) FROM results WHERE status = 'failed') AS failure_details
  FROM summary WHERE overall_status IN ('failed', 'warning'))"""


def _payload(spark, sf_dir):
    results = stored_results(spark, sf_dir)
    return alert_payload(summarise(results, dataset_id="customer", run_id=RUN_ID), results, AS_OF)


@_query("alerts_payload", ALERT_SQL + "\nSELECT * FROM payload")
def alerts_payload(spark, sf_dir):
    return _payload(spark, sf_dir).select(
        "run_id", "subject", "status", "score", "total_rules", "failed_rules",
        F.array_join("failure_details", "\n").alias("failure_details"))


@_query("alert_history", ALERT_SQL + """
SELECT run_id, channel, CASE WHEN channel = 'sns' THEN 'failed' ELSE 'sent' END AS status,
       CASE WHEN channel <> 'sns' THEN subject END AS message, CASE WHEN channel = 'sns' THEN 'no route' END AS error
FROM payload, (VALUES ('email'), ('sns'), ('log')) AS c(channel)""")
def alert_history_query(spark, sf_dir):
    return alert_history(_payload(spark, sf_dir), failures={"sns": "no route"}).select(
        "run_id", "channel", "status", "message", "error")


@_query("report_document", SUMMARY_SQL + """
SELECT run_id, overall_status, overall_score, (SELECT count(DISTINCT "column") FROM results WHERE status <> 'error') AS columns,
  (SELECT CAST(sum(failed_records) AS BIGINT) FROM results) AS total_anomalies FROM summary""")
def report_document_query(spark, sf_dir):
    results = stored_results(spark, sf_dir)
    document = report_document(
        summarise(results, dataset_id="customer", run_id=RUN_ID), results, AS_OF)
    return document.select(
        "run_id", "overall_status", "overall_score",
        F.size("column_summary").cast("bigint").alias("columns"), "total_anomalies")


# --- the small supplier report ---------------------------------------------------------------

SUPPLIER_RULES = [
    ("PART_NO", "NotNull"), ("ORIGINATING_PCT", "Range"), ("ORIGINATING_FLG", "Domain"),
    ("ACTV_IND", "Domain"), ("ACTV_IND", "Unheard"),
]
SUPPLIER_FAILING = [
    ("PART_NO", "PART_NO IS NULL"),
    ("ORIGINATING_PCT", "ORIGINATING_PCT IS NULL OR ORIGINATING_PCT NOT IN (0, 100)"),
    ("ORIGINATING_FLG", "ORIGINATING_FLG IS NULL OR ORIGINATING_FLG NOT IN ('Yes', 'No')"),
    ("ACTV_IND", "ACTV_IND IS NULL OR ACTV_IND NOT IN ('Y', 'N')"),
]


@_query("supplier_report", f"WITH d AS ({SUPPLIER_STYLE_SQL}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CASE WHEN count(*) > 0 THEN 'FAILED' ELSE 'PASSED' END AS status, count(*) AS \"count\" FROM d WHERE {cond}"
    for c, cond in SUPPLIER_FAILING))
def supplier_report(spark, sf_dir):
    return supplier_style_report(supplier_style(spark, sf_dir), SUPPLIER_RULES).select("column", "status", "count")


@_query("supplier_samples", f"WITH d AS ({SUPPLIER_STYLE_SQL}) " + " UNION ALL ".join(
    f"SELECT {i} AS rule_order, CAST(to_json(d) AS VARCHAR) AS sample FROM d WHERE {cond}"
    for i, (_, cond) in enumerate(SUPPLIER_FAILING)))
def supplier_samples(spark, sf_dir):
    return supplier_style_samples(supplier_style(spark, sf_dir), SUPPLIER_RULES)
