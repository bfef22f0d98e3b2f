"""Profiles, suggestions and rule import."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisift.operators.checks import check
from verisift.operators.profile import column_stats, dataset_listing, profile, profile_document
from verisift.operators.report import summarise
from verisift.operators.suggest import (
    constraint_rules, import_rules, only_new, suggest, suggest_constraints,
)
from verisift.plans.batch import profile_rows
from verisift.sources.tables import sample_rows

from .common import (
    AS_OF, DIRTY_CUSTOMER_SQL, EVENT_TEXT_SQL, PART_RULES_SQL, RUN_ID, dirty_customer, event_text,
    part_rules, table,
)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return add


def _union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


def _nulls_sql(columns: list[str], source: str) -> str:
    return f"WITH d AS ({source})\n" + _union([
        f"SELECT '{c}' AS column_name, count(*) AS row_count, count({c}) AS non_null_count, "
        f"count(*) - count({c}) AS null_count, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS null_percentage, "
        f"count(DISTINCT {c}) AS distinct_count, round(count(DISTINCT {c}) * 100.0::DOUBLE / count(*), 2) AS uniqueness_ratio FROM d"
        for c in columns
    ])


NULL_COLUMNS = ["column_name", "row_count", "non_null_count", "null_count", "null_percentage", "distinct_count", "uniqueness_ratio"]
LINEITEM_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINEITEM_NUMBERS = LINEITEM_COLUMNS[:8]


@_query("profile_nulls", _nulls_sql(["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], DIRTY_CUSTOMER_SQL))
def profile_nulls(spark, sf_dir):
    return profile(dirty_customer(spark, sf_dir)).select(*NULL_COLUMNS)


@_query("profile_lineitem", _nulls_sql(LINEITEM_COLUMNS, "SELECT * FROM lineitem"))
def profile_lineitem(spark, sf_dir):
    return profile(table(spark, sf_dir, "lineitem")).select(*NULL_COLUMNS)


@_query("profile_numeric", "WITH d AS (SELECT * FROM lineitem)\n" + _union([
    f"SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS min_number, CAST(max({c}) AS DOUBLE) AS max_number, "
    f"round(avg({c}), 2) AS mean_value, round(stddev_samp({c}), 2) AS stddev FROM d" for c in LINEITEM_NUMBERS]))
def profile_numeric(spark, sf_dir):
    return profile(table(spark, sf_dir, "lineitem")).filter(F.col("min_number").isNotNull()).select(
        "column_name", "min_number", "max_number", "mean_value", "stddev")


@_query("profile_string", "WITH d AS (SELECT * FROM documents)\n" + _union([
    f"SELECT '{c}' AS column_name, CAST(min(length({c})) AS INTEGER) AS min_length, CAST(max(length({c})) AS INTEGER) AS max_length, "
    f"round(avg(length({c})), 2) AS avg_length, count(DISTINCT {c}) AS distinct_count FROM d" for c in ("text", "lang", "source")]))
def profile_string(spark, sf_dir):
    return profile(table(spark, sf_dir, "documents")).filter(F.col("data_type") == "string").select(
        "column_name", "min_length", "max_length", "avg_length", "distinct_count")


def _topk_sql(column: str, source: str) -> str:
    return (f"SELECT * FROM (SELECT '{column}' AS column_name, {column} AS value, count(*) AS \"count\" FROM {source} "
            f"WHERE {column} IS NOT NULL GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 10) AS t_{column}")


@_query("profile_topk", _union([
    _topk_sql("source", "documents"), _topk_sql("lang", "documents"), _topk_sql("p_type", "part"), _topk_sql("p_name", "part")]))
def profile_topk(spark, sf_dir):
    documents = profile(table(spark, sf_dir, "documents").select("source", "lang"))
    parts = profile(table(spark, sf_dir, "part").select("p_type", "p_name"))
    return documents.unionByName(parts).select("column_name", F.inline("top_values"))


@_query("profile_types", f"""WITH d AS ({EVENT_TEXT_SQL})
SELECT 'event_id' AS column_name, 'Integral' AS data_type, 1.0::DOUBLE AS completeness
UNION ALL SELECT 'event_type', 'String', 1.0
UNION ALL SELECT 'k_text', CASE WHEN bool_or(k_text = 'n/a') THEN 'String' ELSE 'Fractional' END, 1.0 FROM d
UNION ALL SELECT 'k_whole', CASE WHEN bool_and(regexp_matches(k_whole, '^[0-9]+$')) THEN 'Integral' ELSE 'String' END, 1.0 FROM d
UNION ALL SELECT 'k_flag', CASE WHEN bool_and(k_flag IN ('true', 'false')) THEN 'Boolean' ELSE 'String' END, 1.0 FROM d""")
def profile_types(spark, sf_dir):
    return column_stats(event_text(spark, sf_dir)).select("column_name", "data_type", "completeness")


@_query("profile_batch", f"WITH d AS ({DIRTY_CUSTOMER_SQL})\n" + _union([
    f"SELECT 'sales' AS db_name, 'customer' AS table_name, '{c}' AS column_name, round(count({c}) / count(*), 2) AS completeness, "
    f"'{t}' AS data_type, CAST(202403 AS INTEGER) AS create_month_prtn FROM d"
    for c, t in (("c_custkey", "Integral"), ("c_name", "String"), ("c_nationkey", "Integral"),
                 ("c_acctbal", "Fractional"), ("c_mktsegment", "String"))]))
def profile_batch(spark, sf_dir):
    rows = profile_rows(dirty_customer(spark, sf_dir), db_name="sales", table_name="customer", as_of=AS_OF)
    return rows.drop("approx_num_distinct_values", "audit_create_date")


# Sketched distinct counts are estimates: the query says whether each is within a tenth of
# the exact count.
@_query("profile_sketched", _union([
    f"SELECT '{c}' AS column_name, count(*) AS row_count, true AS close FROM lineitem" for c in LINEITEM_COLUMNS]))
def profile_sketched(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    sketched, exact = profile(df, exact=False), profile(df)
    both = sketched.select("column_name", "row_count", F.col("distinct_count").alias("estimate")).join(
        exact.select("column_name", "distinct_count"), "column_name")
    error = F.abs(F.col("estimate") - F.col("distinct_count")) / F.col("distinct_count")
    return both.select("column_name", "row_count", (error <= 0.1).alias("close"))


@_query("profile_document", """
SELECT 'orders' AS dataset_id, 'parquet' AS source, count(*) AS row_count, CAST(6 AS INTEGER) AS column_count,
  'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS columns FROM orders""")
def profile_document_query(spark, sf_dir):
    document = profile_document(table(spark, sf_dir, "orders"), dataset_id="orders", source="parquet")
    return dataset_listing(document).withColumn("columns", F.array_join("columns", ","))


@_query("sample_rows", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, user_id, event_type, value, props FROM events ORDER BY event_id LIMIT 10""")
def sample_rows_query(spark, sf_dir):
    return sample_rows(table(spark, sf_dir, "events").orderBy("event_id"), 10)


# --- suggestions ---------------------------------------------------------------------------

SUGGESTED_TYPES = (
    ("c_custkey", "n"), ("c_name", "s"), ("c_nationkey", "n"), ("c_acctbal", "n"), ("c_mktsegment", "s"),
)


def _suggest_sql(source: str, columns: tuple[tuple[str, str], ...]) -> str:
    stats = _union([
        f"SELECT {i} AS pos, '{c}' AS col, '{kind}' AS kind, count(*) AS n, count(*) - count({c}) AS nulls, "
        f"round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS null_pct, "
        f"round(count(DISTINCT {c}) * 100.0::DOUBLE / count(*), 2) AS uniq, count(DISTINCT {c}) AS nd, "
        f"(SELECT coalesce(sum(k), 0) FROM (SELECT count(*) AS k FROM d GROUP BY {c}) AS g WHERE k > 1) AS repeated, "
        + (f"CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, NULL AS minlen, NULL AS maxlen" if kind == "n"
           else f"NULL AS lo, NULL AS hi, min(length({c})) AS minlen, max(length({c})) AS maxlen")
        + " FROM d"
        for i, (c, kind) in enumerate(columns)
    ])
    return f"""
WITH d AS ({source}),
s AS ({stats}),
r AS (
  SELECT pos, 1 AS ord, col, 'not_null' AS rule_type, CASE WHEN nulls = 0 THEN 'high' ELSE 'medium' END AS severity,
         NULL AS low, NULL AS high, nulls AS failing, n FROM s WHERE null_pct < 5
  UNION ALL SELECT pos, 2, col, 'uniqueness', 'critical', NULL, NULL, repeated, n FROM s WHERE uniq > 95
  UNION ALL SELECT pos, 3, col, 'domain_check', 'medium', NULL, NULL, 0, n FROM s WHERE kind = 's' AND nd BETWEEN 1 AND 20
  UNION ALL SELECT pos, 4, col, 'range_check', 'medium', lo - CASE WHEN hi <> lo THEN abs(hi - lo) * 0.1 ELSE 1 END,
         hi + CASE WHEN hi <> lo THEN abs(hi - lo) * 0.1 ELSE 1 END, 0, n FROM s WHERE kind = 'n' AND lo IS NOT NULL
  UNION ALL SELECT pos, 5, col, 'length_check', 'low', greatest(1, minlen), maxlen + 10, 0, n FROM s WHERE kind = 's' AND minlen IS NOT NULL)
"""


SUGGEST_SQL = _suggest_sql(DIRTY_CUSTOMER_SQL, SUGGESTED_TYPES)
PART_COLUMNS = (("p_partkey", "n"), ("p_name", "s"), ("p_brand", "s"), ("p_type", "s"), ("p_size", "n"), ("p_retailprice", "n"))


@_query("suggest_rules", SUGGEST_SQL + """
SELECT 'H_R' || lpad(CAST(row_number() OVER (ORDER BY pos, ord) AS VARCHAR), 3, '0') AS rule_id, rule_type, col AS "column", severity,
       round(CAST(low AS DOUBLE), 4) AS low, round(CAST(high AS DOUBLE), 4) AS high FROM r""")
def suggest_rules(spark, sf_dir):
    rules = suggest(profile(dirty_customer(spark, sf_dir)))
    number = lambda name: F.get_json_object("params", f"$.{name}").cast("double")
    return rules.select(
        "rule_id", "rule_type", "column", "severity",
        F.round(F.coalesce(number("min_value"), number("min_length")), 4).alias("low"),
        F.round(F.coalesce(number("max_value"), number("max_length")), 4).alias("high"))


@_query("suggest_domains", """
WITH v AS (SELECT 'source' AS "column", source AS value FROM documents UNION ALL SELECT 'lang', lang FROM documents),
k AS (SELECT "column" FROM v GROUP BY "column" HAVING count(DISTINCT value) <= 20)
SELECT DISTINCT v."column", v.value FROM v JOIN k ON v."column" = k."column\"""")
def suggest_domains(spark, sf_dir):
    rules = suggest(profile(table(spark, sf_dir, "documents").select("source", "lang")))
    values = F.from_json("params", "allowed_values array<string>")["allowed_values"]
    return rules.filter("rule_type = 'domain_check'").select("column", F.explode(values).alias("value"))


@_query("quick_check_summary", _suggest_sql("SELECT * FROM part", PART_COLUMNS) + f""",
v AS (SELECT severity, CASE WHEN failing = 0 THEN 'passed' WHEN round((n - failing) * 100.0::DOUBLE / n, 2) >= 95 THEN 'warning' ELSE 'failed' END AS status FROM r),
c AS (SELECT count(*) AS total_rules, count(*) FILTER (status = 'passed') AS passed_rules, count(*) FILTER (status = 'failed') AS failed_rules,
  count(*) FILTER (status = 'warning') AS warning_rules, CAST(0 AS BIGINT) AS error_rules,
  count(*) FILTER (status = 'failed' AND severity IN ('critical', 'high')) AS severe FROM v),
w AS (SELECT *, round(passed_rules * 100.0::DOUBLE / total_rules, 2) AS overall_score FROM c)
SELECT '{RUN_ID}' AS run_id, 'part' AS dataset_id,
  CASE WHEN severe > 0 OR overall_score < 95 THEN 'failed' WHEN warning_rules > 0 THEN 'warning' ELSE 'passed' END AS overall_status,
  overall_score, total_rules, passed_rules, failed_rules, warning_rules, error_rules FROM w""")
def quick_check_summary(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    rules = suggest(profile(df))
    results = check(df, rules, dataset_id="part", run_id=RUN_ID, as_of=AS_OF)
    return summarise(results, dataset_id="part", run_id=RUN_ID)


def _constraints_sql() -> str:
    segments = "(SELECT string_agg('\"' || v || '\"', ', ' ORDER BY n DESC, v) FROM (SELECT c_mktsegment AS v, count(*) AS n FROM d GROUP BY c_mktsegment) AS g)"
    complete = lambda c: (
        f"SELECT '{c}' AS column_name, '.isComplete(\"{c}\")' AS constraint_rule FROM m WHERE rows_{c} = rows")
    partly = lambda c: (
        f"SELECT '{c}', '.hasCompleteness(\"{c}\", lambda x: x >= ' || CAST(floor((p - 1.96 * sqrt(p * (1 - p) / rows)) * 100) / 100 AS VARCHAR) || ')' "
        f"FROM (SELECT rows_{c} / rows AS p, rows FROM m) AS q WHERE p < 1")
    columns = [c for c, _ in SUGGESTED_TYPES]
    return f"""
WITH d AS ({DIRTY_CUSTOMER_SQL}),
m AS (SELECT count(*) AS rows, {', '.join(f'count({c}) AS rows_{c}' for c in columns)} FROM d)
{_union([complete(c) for c in columns])}
UNION ALL {_union([partly(c) for c in columns])}
UNION ALL SELECT 'c_mktsegment', '.isContainedIn("c_mktsegment", [' || {segments} || '])'
UNION ALL SELECT c, '.isNonNegative("' || c || '")' FROM (SELECT 'c_custkey' AS c, min(c_custkey) AS low FROM d
  UNION ALL SELECT 'c_nationkey', min(c_nationkey) FROM d UNION ALL SELECT 'c_acctbal', min(c_acctbal) FROM d) AS n WHERE low >= 0"""


@_query("suggest_constraints", _constraints_sql())
def suggest_constraints_query(spark, sf_dir):
    return suggest_constraints(dirty_customer(spark, sf_dir), max_categories=100).select("column_name", "constraint_rule")


@_query("suggest_new_only", f"""
WITH r AS ({PART_RULES_SQL})
SELECT constraint_name, db_name, table_name, column_name, constraint_rule FROM r AS a
WHERE is_active = 'N' AND NOT EXISTS (SELECT 1 FROM r AS b WHERE b.is_active = 'Y' AND b.db_name = a.db_name
  AND b.table_name = a.table_name AND b.column_name = a.column_name AND b.constraint_rule = a.constraint_rule)""")
def suggest_new_only(spark, sf_dir):
    rules = part_rules(spark, sf_dir)
    fresh = only_new(rules.filter("is_active = 'N'"), rules.filter("is_active = 'Y'"))
    return fresh.select("constraint_name", "db_name", "table_name", "column_name", "constraint_rule")


# One response document per part, with four entries of which some are invalid
RESPONSES = """
SELECT p_partkey,
       concat('{{"rules":[{{"rule_type":"not_null","column":"', p_brand, '"}},',
              '{{"rule_id":"X', CAST(p_partkey AS STRING), '","rule_type":"',
              CASE WHEN p_size % 2 = 0 THEN 'range_check' ELSE 'nonsense' END,
              '","column":"p_size","severity":"high","description":"sizes","params":{{"max_value":', CAST(p_size AS STRING), '}}}},',
              '{{"rule_type":"not_null","column":"p_name","severity":"', CASE WHEN p_size % 3 = 0 THEN 'odd' ELSE 'low' END, '"}},',
              '{{"rule_type":"uniqueness","column":"p_partkey"}}]}}') AS response
FROM {part}
"""


@_query("import_rules_json", """
SELECT p_partkey, 'AI_R001' AS rule_id, 'not_null' AS rule_type, p_brand AS "column", 'medium' AS severity, '' AS description, '{}' AS params FROM part
UNION ALL SELECT p_partkey, 'X' || CAST(p_partkey AS VARCHAR), 'range_check', 'p_size', 'high', 'sizes', '{"max_value":' || CAST(p_size AS VARCHAR) || '}' FROM part WHERE p_size % 2 = 0
UNION ALL SELECT p_partkey, 'AI_R003', 'not_null', 'p_name', 'low', '', '{}' FROM part WHERE p_size % 3 <> 0""")
def import_rules_json(spark, sf_dir):
    responses = spark.sql(RESPONSES, part=table(spark, sf_dir, "part"))
    return import_rules(responses, "response", 3).drop("active")


@_query("constraint_rule_rows", f"""
SELECT 'sales' AS db_name, 'customer' AS table_name, column_name, constraint_rule, 'N' AS is_active, 'N' AS reject_capture,
       'verify' AS rule_type, 'Error' AS check_level FROM ({_constraints_sql()}) AS c""")
def constraint_rule_rows(spark, sf_dir):
    rows = constraint_rules(
        suggest_constraints(dirty_customer(spark, sf_dir), max_categories=100), db_name="sales", table_name="customer", as_of=AS_OF)
    return rows.select("db_name", "table_name", "column_name", "constraint_rule", "is_active", "reject_capture",
                       "rule_type", "check_level")
