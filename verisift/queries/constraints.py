"""Constraint metrics, verification runs and metric history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisift.operators.anomalies import median_deviation, metric_anomalies, normal_deviation, relative_change
from verisift.operators.metrics import histogram, metric_changes, type_histogram
from verisift.operators.verification import ConstraintRule, failures, metric_rows, named_columns, notify_rollup, verify

from .common import (
    AS_OF, DIRTY_CUSTOMER_SQL, DIRTY_ORDERS_SQL, EVENT_TEXT_SQL, PART_RULES_SQL, dirty_customer,
    dirty_orders, event_text, part_rules, table,
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


def _metric(name: str, source, source_sql: str, constraints: list[tuple[str, str, str]]) -> None:
    """A query over constraints of one table: (constraint, metric SQL over view d, holds SQL over v)."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rules = [ConstraintRule(text, constraint_name=f"k{i}") for i, (text, _, _) in enumerate(constraints)]
        found = verify(source(spark, sf_dir), rules, db_name="db", table_name=name, as_of=AS_OF)
        return found.select("constraint_name", "constraint_status", F.round("metric_value", 4).alias("metric_value"))
    QUERIES[name] = run
    ORACLE[name] = f"WITH d AS ({source_sql}) " + "\nUNION ALL ".join(
        f"SELECT 'k{i}' AS constraint_name, CASE WHEN {holds} THEN 'Success' ELSE 'Failure' END AS constraint_status, "
        f"round(v, 4) AS metric_value FROM (SELECT CAST({sql} AS DOUBLE) AS v{'' if sql.startswith('(') else ' FROM d'}) AS m{i}"
        for i, (_, sql, holds) in enumerate(constraints)
    )


def _table(name: str):
    return lambda spark, sf_dir: table(spark, sf_dir, name)


LINEITEM = _table("lineitem")
ALL_LINEITEM = "SELECT * FROM lineitem"


def _groups(columns: str, select: str, present: str) -> str:
    return f"(SELECT {select} FROM (SELECT {columns}, count(*) AS n FROM d WHERE {present} GROUP BY {columns}) AS g)"


def _share(condition: str) -> str:
    return f"avg(CASE WHEN {condition} THEN 1.0 ELSE 0.0 END)"


_metric("k_completeness", dirty_customer, DIRTY_CUSTOMER_SQL, [
    (".isComplete('c_name')", "count(c_name) / count(*)", "v = 1"),
    (".isComplete('c_custkey')", "count(c_custkey) / count(*)", "v = 1"),
    (".hasCompleteness('c_acctbal', lambda x: x >= 0.95)", "count(c_acctbal) / count(*)", "v >= 0.95"),
    (".haveCompleteness(['c_name', 'c_acctbal'], '> 0.9')", _share("c_name IS NOT NULL AND c_acctbal IS NOT NULL"), "v > 0.9"),
    (".areAnyComplete(['c_name', 'c_acctbal'])", _share("c_name IS NOT NULL OR c_acctbal IS NOT NULL"), "v = 1")])
_metric("k_uniqueness", dirty_customer, DIRTY_CUSTOMER_SQL, [
    (".isUnique('c_name')", _groups("c_name", "sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / sum(n)", "c_name IS NOT NULL"), "v = 1"),
    (".isUnique('c_custkey')", _groups("c_custkey", "sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / sum(n)", "c_custkey IS NOT NULL"), "v = 1"),
    (".hasUniqueness(['c_nationkey', 'c_acctbal'], '> 0.5')",
     _groups("c_nationkey, c_acctbal", "sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / sum(n)", "c_nationkey IS NOT NULL OR c_acctbal IS NOT NULL"), "v > 0.5"),
    (".hasUniqueValueRatio('c_name', '> 0.9')", _groups("c_name", "sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / count(*)", "c_name IS NOT NULL"), "v > 0.9")])
_metric("k_uniqueness_pair", LINEITEM, ALL_LINEITEM, [
    (".hasUniqueness(['l_orderkey', 'l_linenumber'], lambda x: 0 < x < 1)",
     _groups("l_orderkey, l_linenumber", "sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / sum(n)", "true"), "v > 0 AND v < 1")])
_metric("k_distinctness", LINEITEM, ALL_LINEITEM, [
    (".hasDistinctness('l_partkey', '> 0')", "count(DISTINCT l_partkey) / count(l_partkey)", "v > 0"),
    (".hasDistinctness(['l_orderkey', 'l_linenumber'], '== 1')", _groups("l_orderkey, l_linenumber", "count(*) / sum(n)", "true"), "v = 1")])
_metric("k_size", LINEITEM, ALL_LINEITEM, [(".hasSize(lambda n: n >= 1000)", "count(*)", "v >= 1000")])
_metric("k_distinct_exact", LINEITEM, ALL_LINEITEM, [
    (".hasCountDistinct('l_partkey', '> 10')", "count(DISTINCT l_partkey)", "v > 10"),
    (".hasNumberOfDistinctValues('l_returnflag', '== 3')", "count(DISTINCT l_returnflag)", "v = 3")])


# Estimates: the constraints allow a tenth around the exact count
@_query("k_distinct_sketched", """
SELECT 'parts' AS constraint_name, 'Success' AS constraint_status UNION ALL SELECT 'orders', 'Success'""")
def k_distinct_sketched(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    exact = df.agg(F.count_distinct("l_partkey"), F.count_distinct("l_orderkey")).first()
    rules = [
        ConstraintRule(f".hasApproxCountDistinct('{column}', lambda n: {0.9 * n} <= n <= {1.1 * n})", constraint_name=name)
        for name, column, n in (("parts", "l_partkey", exact[0]), ("orders", "l_orderkey", exact[1]))
    ]
    found = verify(df, rules, db_name="db", table_name="lineitem", as_of=AS_OF)
    return found.select("constraint_name", "constraint_status")


_metric("k_statistics", LINEITEM, ALL_LINEITEM, [
    (".hasMin('l_quantity', '>= 1')", "min(l_quantity)", "v >= 1"),
    (".hasMax('l_quantity', '<= 49')", "max(l_quantity)", "v <= 49"),
    (".hasMean('l_discount', lambda m: 0.04 <= m <= 0.06)", "avg(l_discount)", "v >= 0.04 AND v <= 0.06"),
    (".hasStandardDeviation('l_quantity', '< 15')", "stddev_pop(l_quantity)", "v < 15"),
    (".hasSum('l_quantity', '> 0')", "sum(l_quantity)", "v > 0")])
_metric("k_quantile", LINEITEM, ALL_LINEITEM, [
    (".hasApproxQuantile('l_quantity', 0.25, '> 10')", "quantile_disc(l_quantity, 0.25)", "v > 10"),
    (".hasApproxQuantile('l_linenumber', 0.5, '== 4')", "quantile_disc(l_linenumber, 0.5)", "v = 4")])
_metric("k_nonnegative", _table("customer"), "SELECT * FROM customer", [
    (".isNonNegative('c_acctbal')", _share("coalesce(c_acctbal, 0) >= 0"), "v = 1"),
    (".isNonNegative('c_custkey')", _share("coalesce(c_custkey, 0) >= 0"), "v = 1")])
_metric("k_range", dirty_orders, DIRTY_ORDERS_SQL, [
    (".isInRange('o_orderpriority', ['1-URGENT', '2-HIGH'])", _share("o_orderpriority IS NULL OR o_orderpriority IN ('1-URGENT', '2-HIGH')"), "v = 1"),
    (".isInRange('o_totalprice', 0, 1000000)", _share("o_totalprice IS NULL OR o_totalprice BETWEEN 0 AND 1000000"), "v = 1"),
    (".isContainedIn('o_orderstatus', ['F', 'O', 'P'], lambda x: x >= 0.99)", _share("o_orderstatus IS NULL OR o_orderstatus IN ('F', 'O', 'P')"), "v >= 0.99")])
_metric("k_less_than", LINEITEM, ALL_LINEITEM, [
    (".isLessThan('l_discount', 'l_quantity')", _share("l_discount < l_quantity"), "v = 1"),
    (".isLessThan('l_suppkey', 'l_partkey')", _share("l_suppkey < l_partkey"), "v = 1"),
    (".isGreaterThanOrEqualTo('l_extendedprice', 'l_quantity')", _share("l_extendedprice >= l_quantity"), "v = 1")])
_metric("k_satisfies", dirty_customer, DIRTY_CUSTOMER_SQL, [
    ('.satisfies("c_name is not null", "c_name is valid")', _share("c_name IS NOT NULL"), "v = 1"),
    ('.satisfies("c_acctbal > 1000 or c_nationkey < 5", "rich or near", lambda x: x > 0.8)', _share("c_acctbal > 1000 OR c_nationkey < 5"), "v > 0.8")])
_metric("k_satisfies_if", dirty_customer, DIRTY_CUSTOMER_SQL, [
    (".satisfiesIf(\"c_mktsegment = 'UNKNOWN'\", \"c_acctbal >= 0\")",
     _share("NOT coalesce(c_mktsegment = 'UNKNOWN', false) OR coalesce(c_acctbal >= 0, false)"), "v = 1")])
_metric("k_type_consistency", event_text, EVENT_TEXT_SQL, [
    (".hasConsistentType('k_whole')", _share("regexp_matches(k_whole, '^[0-9]+$')"), "v = 1"),
    (".hasTypeConsistency('k_text', '> 0.7')",
     "greatest(avg(CASE WHEN regexp_matches(k_text, '^[0-9]+$') THEN 1.0 ELSE 0.0 END), avg(CASE WHEN k_text = 'n/a' THEN 1.0 ELSE 0.0 END), avg(CASE WHEN contains(k_text, '.') THEN 1.0 ELSE 0.0 END))", "v > 0.7"),
    (".hasDataType('k_flag', ConstrainableDataTypes.Boolean)", _share("k_flag IN ('true', 'false')"), "v = 1")])
_metric("k_entropy", LINEITEM, ALL_LINEITEM, [
    (".hasEntropy('l_returnflag', '> 1')", _groups("l_returnflag", "sum(-(n / t) * ln(n / t)) FROM (SELECT *, sum(n) OVER () AS t", "true").replace("AS g)", "AS g0) AS g)"), "v > 1"),
    (".hasEntropy('l_quantity', '> 3')", _groups("l_quantity", "sum(-(n / t) * ln(n / t)) FROM (SELECT *, sum(n) OVER () AS t", "true").replace("AS g)", "AS g0) AS g)"), "v > 3")])
_metric("k_mutual_information", LINEITEM, ALL_LINEITEM, [
    (".hasMutualInformation('l_returnflag', 'l_linestatus', '>= 0')", """(SELECT sum(pab * ln(pab / (pa * pb))) FROM (
       SELECT n / sum(n) OVER () AS pab, sum(n) OVER (PARTITION BY a) / sum(n) OVER () AS pa, sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS pb
       FROM (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM d GROUP BY 1, 2) AS j) AS q)""", "v >= 0")])
_metric("k_mutual_information_keys", LINEITEM, ALL_LINEITEM, [
    (".hasMutualInformation('l_suppkey', 'l_linenumber', '>= 0')", """(SELECT sum(pab * ln(pab / (pa * pb))) FROM (
       SELECT n / sum(n) OVER () AS pab, sum(n) OVER (PARTITION BY a) / sum(n) OVER () AS pa, sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS pb
       FROM (SELECT l_suppkey AS a, l_linenumber AS b, count(*) AS n FROM d GROUP BY 1, 2) AS j) AS q)""", "v >= 0")])
_metric("k_correlation", LINEITEM, ALL_LINEITEM, [
    (".hasCorrelation('l_quantity', 'l_extendedprice', '> 0')", "corr(l_quantity, l_extendedprice)", "v > 0"),
    (".hasCorrelation('l_discount', 'l_tax', lambda r: -0.1 < r < 0.1)", "corr(l_discount, l_tax)", "v > -0.1 AND v < 0.1")])
_metric("k_histogram_values", LINEITEM, ALL_LINEITEM, [
    (".hasHistogramValues('l_returnflag', 'A', '> 0.2')", _share("l_returnflag = 'A'"), "v > 0.2")])
_metric("k_pattern_length", _table("documents"), "SELECT * FROM documents", [
    (".hasPattern('source', '^[a-z]')", _share("regexp_matches(source, '^[a-z]')"), "v = 1"),
    (".hasMinLength('text', '>= 1')", "min(length(text))", "v >= 1"),
    (".hasMaxLength('text', '<= 1000')", "max(length(text))", "v <= 1000")])


@_query("k_histogram", f"""
WITH d AS ({DIRTY_ORDERS_SQL})
SELECT coalesce(o_orderpriority, 'NullValue') AS value, count(*) AS "count", round(count(*) / (SELECT count(*) FROM d), 6) AS ratio
FROM d GROUP BY 1""")
def k_histogram(spark, sf_dir):
    return histogram(dirty_orders(spark, sf_dir), "o_orderpriority").withColumn("ratio", F.round("ratio", 6))


@_query("value_classes", f"""
WITH d AS ({EVENT_TEXT_SQL})
SELECT CASE WHEN regexp_matches(k_text, '^[0-9]+$') THEN 'Integral' WHEN k_text = 'n/a' THEN 'String' ELSE 'Fractional' END AS value_class,
       count(*) AS "count" FROM d GROUP BY 1""")
def value_classes(spark, sf_dir):
    return type_histogram(event_text(spark, sf_dir), "k_text")


# --- verification runs -------------------------------------------------------------------------

CUSTOMER_CONSTRAINTS = [
    ConstraintRule(".isComplete('c_name')", constraint_name="names", check_level="error", check_message="names missing"),
    ConstraintRule(".isUnique('c_custkey').hasSize('> 10')", constraint_name="keys", check_level="Warning"),
    ConstraintRule(".isNonNegative('c_acctbal')", constraint_name="balance", check_level="info"),
    ConstraintRule(".isComplete('no_such_column')", constraint_name="broken"),
]


@_query("verify_results", f"""
WITH d AS ({DIRTY_CUSTOMER_SQL}),
r AS (SELECT 'names' AS constraint_name, 'Error' AS check_level, 'names missing' AS check_message, 'isComplete(''c_name'')' AS "constraint",
        CASE WHEN count(c_name) = count(*) THEN 'Success' ELSE 'Failure' END AS constraint_status FROM d
  UNION ALL SELECT 'keys', 'Warning', NULL, 'isUnique(''c_custkey'')', CASE WHEN count(DISTINCT c_custkey) = count(*) THEN 'Success' ELSE 'Failure' END FROM d
  UNION ALL SELECT 'keys', 'Warning', NULL, 'hasSize(''> 10'')', CASE WHEN count(*) > 10 THEN 'Success' ELSE 'Failure' END FROM d
  UNION ALL SELECT 'balance', 'Warning', NULL, 'isNonNegative(''c_acctbal'')', CASE WHEN min(coalesce(c_acctbal, 0)) >= 0 THEN 'Success' ELSE 'Failure' END FROM d
  UNION ALL SELECT 'broken', 'Error', NULL, 'isComplete(''no_such_column'')', 'Error')
SELECT 'customer_check' AS "check", check_level,
  CASE WHEN (SELECT count(*) FROM r WHERE constraint_status <> 'Success' AND check_level = 'Error') > 0 THEN 'Error'
       WHEN (SELECT count(*) FROM r WHERE constraint_status <> 'Success') > 0 THEN 'Warning' ELSE 'Success' END AS check_status,
  "constraint", constraint_status, constraint_name, check_message, 'sales' AS db_name, 'customer' AS table_name,
  CAST(202403 AS INTEGER) AS create_month_prtn FROM r""")
def verify_results(spark, sf_dir):
    found = verify(dirty_customer(spark, sf_dir), CUSTOMER_CONSTRAINTS, db_name="sales", table_name="customer", as_of=AS_OF)
    return found.select(
        "check", "check_level", "check_status", "constraint", "constraint_status", "constraint_name",
        "check_message", "db_name", "table_name", "create_month_prtn")


@_query("verify_filtered", f"""
WITH d AS (SELECT * FROM ({DIRTY_CUSTOMER_SQL}) AS c WHERE c_acctbal < 0)
SELECT 'names' AS constraint_name, CASE WHEN count(c_name) = count(*) THEN 'Success' ELSE 'Failure' END AS constraint_status, round(count(c_name) / count(*), 6) AS metric_value FROM d
UNION ALL SELECT 'balance', CASE WHEN min(c_acctbal) >= 0 THEN 'Success' ELSE 'Failure' END, avg(CASE WHEN c_acctbal >= 0 THEN 1.0 ELSE 0.0 END)::DOUBLE FROM d""")
def verify_filtered(spark, sf_dir):
    rules = [r for r in CUSTOMER_CONSTRAINTS if r.constraint_name in ("names", "balance")]
    found = verify(dirty_customer(spark, sf_dir), rules, db_name="sales", table_name="customer", as_of=AS_OF, where="c_acctbal < 0")
    return found.select("constraint_name", "constraint_status", F.round("metric_value", 6).alias("metric_value"))


@_query("verify_failures", f"""
WITH d AS ({DIRTY_CUSTOMER_SQL})
SELECT 'names' AS constraint_name, 'Failure' AS constraint_status, 'Value: ' || CAST(count(c_name) / count(*) AS VARCHAR) || ' does not meet the constraint requirement!' AS constraint_message FROM d HAVING count(c_name) < count(*)
UNION ALL SELECT 'broken', 'Error', 'unknown column: no_such_column'""")
def verify_failures(spark, sf_dir):
    rules = [r for r in CUSTOMER_CONSTRAINTS if r.constraint_name != "balance"]
    found = verify(dirty_customer(spark, sf_dir), rules, db_name="sales", table_name="customer", as_of=AS_OF)
    return failures(found).select("constraint_name", "constraint_status", "constraint_message")


@_query("metric_values", f"""
WITH d AS ({DIRTY_CUSTOMER_SQL})
SELECT 'c_name' AS column_name, 'Completeness' AS metric, round(count(c_name) / count(*), 6) AS value FROM d
UNION ALL SELECT 'c_acctbal', 'Mean', round(avg(c_acctbal), 6) FROM d
UNION ALL SELECT 'c_mktsegment', 'CountDistinct', count(DISTINCT c_mktsegment)::DOUBLE FROM d
UNION ALL SELECT '*', 'Size', count(*)::DOUBLE FROM d""")
def metric_values(spark, sf_dir):
    rules = [ConstraintRule(r) for r in (
        ".isComplete('c_name')", ".hasCompleteness('c_name', '> 0.5')", ".hasMean('c_acctbal', '> 0')",
        ".hasCountDistinct('c_mktsegment', '> 0')", ".hasSize('> 0')")]
    found = metric_rows(dirty_customer(spark, sf_dir), rules, db_name="sales", table_name="customer", as_of=AS_OF)
    return found.select("column_name", "metric", F.round("value", 6).alias("value"))


@_query("metric_history_anomaly", """
WITH h AS (SELECT event_type AS column_name, CAST(ts AS DATE) AS day, count(*) AS n, sum(value) AS s FROM events GROUP BY 1, 2),
m AS (SELECT column_name, 'Size' AS metric, day, n::DOUBLE AS value FROM h UNION ALL SELECT column_name, 'Sum', day, s FROM h),
l AS (SELECT *, lag(value) OVER (PARTITION BY column_name, metric ORDER BY day) AS previous_value FROM m)
SELECT column_name, metric, day, round(value, 2) AS value, round(previous_value, 2) AS previous_value, round(value / previous_value, 4) AS change_ratio,
  coalesce(value / previous_value > 1.2, false) OR coalesce(value / previous_value < 0.8, false) AS is_anomaly FROM l""")
def metric_history_anomaly(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("column_name"), F.to_date("ts").alias("audit_create_date")
    ).agg(F.count(F.lit(1)).cast("double").alias("Size"), F.sum("value").alias("Sum"))
    history = daily.unpivot(["column_name", "audit_create_date"], ["Size", "Sum"], "metric", "value").select(
        F.lit("db").alias("db_name"), F.lit("events").alias("table_name"), "*")
    found = metric_changes(history, max_increase=1.2, max_decrease=0.8)
    return found.select(
        "column_name", "metric", F.col("audit_create_date").alias("day"), F.round("value", 2).alias("value"),
        F.round("previous_value", 2).alias("previous_value"), F.round("change_ratio", 4).alias("change_ratio"), "is_anomaly")


# Daily metrics of the events as a table of stored metrics.  One day's count is tripled (a jump).
JUMP_DAY = "2024-01-18"
METRICS_SQL = f"""
SELECT event_type, CAST(ts AS DATE) AS day,
       CAST(count(*) * CASE WHEN CAST(ts AS DATE) = DATE '{JUMP_DAY}' THEN 3 ELSE 1 END AS DOUBLE) AS size, avg(value) AS mean
FROM events GROUP BY event_type, CAST(ts AS DATE)"""


def _daily_metrics(spark: SparkSession, sf_dir: str, table_name: str | None = None) -> DataFrame:
    daily = spark.sql(METRICS_SQL.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
    named = F.concat(F.lit("events_"), "event_type") if table_name is None else F.lit(table_name)
    points = F.array(
        F.struct(F.lit("*").alias("column_name"), F.lit("Size").alias("metric"), F.col("size").alias("value")),
        F.struct(F.lit("value").alias("column_name"), F.lit("Mean").alias("metric"), F.col("mean").alias("value")))
    return daily.select(F.lit("DB").alias("db_name"), named.alias("table_name"), "event_type", "day", F.explode(points).alias("p")).select(
        "db_name", "table_name", "event_type", "p.column_name", "p.metric", "p.value", F.col("day").cast("timestamp").alias("audit_create_date"))


@_query("metric_anomalies", f"""
WITH m AS ({METRICS_SQL}),
p AS (SELECT event_type, day, 'Size' AS metric, size AS value FROM m UNION ALL SELECT event_type, day, 'Mean', mean FROM m),
w AS (SELECT *, lag(value, 7) OVER s AS season, avg(value) OVER d AS centre, stddev_pop(value) OVER d AS spread, count(value) OVER d AS n,
             median(value) OVER d AS middle, list(value) OVER d AS past
      FROM p WINDOW s AS (PARTITION BY event_type, metric ORDER BY day),
      d AS (PARTITION BY event_type, metric ORDER BY day RANGE BETWEEN INTERVAL 10 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)),
b AS (SELECT *, list_aggregate(list_transform(past, lambda v: abs(v - middle)), 'median') AS mad FROM w)
SELECT 'median' AS detector, event_type, metric, day, CASE WHEN n >= 3 THEN round(middle - 4 * mad, 6) END AS lower,
       n >= 3 AND (value < middle - 4 * mad OR value > middle + 4 * mad) AS is_anomaly FROM b
UNION ALL SELECT 'normal', event_type, metric, day, CASE WHEN n >= 5 THEN round(centre - 3 * spread, 6) END,
       n >= 5 AND (value < centre - 3 * spread OR value > centre + 3 * spread) FROM b
UNION ALL SELECT 'season', event_type, metric, day, round(season * 0.5, 6), season IS NOT NULL AND (value < season * 0.5 OR value > season * 2) FROM b""")
def metric_anomalies_query(spark, sf_dir):
    """Every point of the history by three detectors; the jump is planted."""
    history = _daily_metrics(spark, sf_dir)
    detectors = {"median": median_deviation(days=10, factor=4), "normal": normal_deviation(days=10, factor=3, least=5),
                 "season": relative_change(max_increase=2.0, max_decrease=0.5, lag=7)}
    found = [
        metric_anomalies(history, d).select(
            F.lit(name).alias("detector"), "event_type", "metric", F.to_date("audit_create_date").alias("day"),
            F.round("lower", 6).alias("lower"), "is_anomaly")
        for name, d in detectors.items()
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


ANOMALY_RULES = [
    ("size_median", ".hasNoAnomalies(Size(), MedianDeviation(days=10, factor=6, floor=1))"),
    ("size_drop", ".hasNoAnomalies(Size(), RelativeRateOfChange(max_decrease=0.2))"),
    ("size_cap", ".hasNoAnomalies(Size(), SimpleThreshold(upper=1.0))"),
    ("mean_normal", ".hasNoAnomalies(Mean('value'), NormalDeviation(days=10, factor=8))"),
]


@_query("k_no_anomalies", f"""
WITH m AS (SELECT * FROM ({METRICS_SQL}) AS x WHERE event_type = 'click'),
past AS (SELECT * FROM m WHERE day < DATE '2024-01-30'),
near AS (SELECT * FROM past WHERE day >= DATE '2024-01-20'),
mid AS (SELECT median(size) AS middle, avg(mean) AS centre, stddev_pop(mean) AS spread FROM near),
mad AS (SELECT greatest(median(abs(size - middle)), 1) AS mad FROM near, mid),
last AS (SELECT arg_max(size, day) AS size FROM past),
runs AS (SELECT 'plain' AS run, size, mean FROM m WHERE day = DATE '2024-01-30' UNION ALL SELECT 'tripled', size * 3, mean FROM m WHERE day = DATE '2024-01-30')
SELECT run, name AS constraint_name, CASE WHEN holds THEN 'Success' ELSE 'Failure' END AS constraint_status FROM (
  SELECT run, 'size_median' AS name, runs.size BETWEEN middle - 6 * mad AND middle + 6 * mad AS holds FROM runs, mid, mad
  UNION ALL SELECT run, 'size_drop', runs.size >= last.size * 0.2 FROM runs, last
  UNION ALL SELECT run, 'size_cap', size <= 1 FROM runs
  UNION ALL SELECT run, 'mean_normal', mean BETWEEN centre - 8 * spread AND centre + 8 * spread FROM runs, mid) AS h""")
def k_no_anomalies(spark, sf_dir):
    """A day's clicks against the stored metrics of the days before, as they are and tripled."""
    history = _daily_metrics(spark, sf_dir, "clicks").filter("event_type = 'click'")
    today = table(spark, sf_dir, "events").filter("event_type = 'click' AND CAST(ts AS DATE) = DATE '2024-01-30'")
    rules = spark.createDataFrame(
        [("clicks", name, rule, "Error", None, None) for name, rule in ANOMALY_RULES],
        "table_name string, constraint_name string, constraint_rule string, check_level string, check_message string, column_name string")
    found = [
        verify(rows, rules, db_name="db", table_name="clicks", as_of="2024-01-30 00:00:00", history=history).select(
            F.lit(run).alias("run"), "constraint_name", "constraint_status")
        for run, rows in (("plain", today), ("tripled", today.unionByName(today).unionByName(today)))
    ]
    return found[0].unionByName(found[1])


NAMED_RULES = [
    ConstraintRule(".isComplete('l_orderkey')", constraint_name="keys", column_name=" L_ORDERKEY , l_linenumber"),
    ConstraintRule('.satisfies("l_discount <= 0.1 and l_tax < 0.09", "cap")', constraint_name="cap", column_name="l_discount"),
    ConstraintRule(".hasEntropy('l_returnflag', '> 0')", constraint_name="flags"),
]


@_query("verify_named_columns", """
WITH c AS (SELECT 'l_orderkey,l_linenumber,l_discount,l_tax,l_returnflag' AS columns),
f AS (SELECT count(DISTINCT l_returnflag) AS n FROM lineitem)
SELECT columns, 'keys' AS constraint_name, CASE WHEN (SELECT count(*) = count(l_orderkey) FROM lineitem) THEN 'Success' ELSE 'Failure' END AS constraint_status FROM c
UNION ALL SELECT columns, 'cap', CASE WHEN (SELECT count(*) FILTER (NOT (l_discount <= 0.1 AND l_tax < 0.09)) = 0 FROM lineitem) THEN 'Success' ELSE 'Failure' END FROM c
UNION ALL SELECT columns, 'flags', CASE WHEN n > 1 THEN 'Success' ELSE 'Failure' END FROM c, f""")
def verify_named_columns(spark, sf_dir):
    """Checks on just the columns that the rules name, predicates included."""
    df = table(spark, sf_dir, "lineitem")
    names = ",".join(named_columns(NAMED_RULES, df.columns))
    found = verify(df, NAMED_RULES, db_name="db", table_name="lineitem", as_of=AS_OF)
    return found.select(F.lit(names).alias("columns"), "constraint_name", "constraint_status")


@_query("notify_rollup", f"""
WITH r AS ({PART_RULES_SQL}),
f AS (SELECT DISTINCT lower(db_name) AS db_name, table_name FROM r WHERE is_active = 'N'),
w AS (SELECT DISTINCT lower(db_name) AS db_name, lower(table_name) AS table_name, notify_topic FROM r WHERE notify_capture = 'Y')
SELECT notify_topic AS topic, string_agg(f.db_name || '-' || lower(f.table_name), chr(10) ORDER BY f.db_name || '-' || lower(f.table_name)) AS message, count(*) AS failures
FROM f JOIN w ON f.db_name = w.db_name AND lower(f.table_name) = w.table_name GROUP BY notify_topic""")
def notify_rollup_query(spark, sf_dir):
    rules = part_rules(spark, sf_dir)
    failed = rules.filter("is_active = 'N'").select("db_name", "table_name").distinct()
    return notify_rollup(failed, rules)
