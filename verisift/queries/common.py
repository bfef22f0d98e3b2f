"""Inputs shared by the queries.

The tables hold no nulls and few defects, so many queries start from a view with planted
ones.  Each view is one SQL text that both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-03-05 00:00:00"
RUN_ID = "RPT_0001"

DIRTY_CUSTOMER = """
SELECT c_custkey,
       CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN '  ' ELSE c_name END AS c_name,
       c_nationkey,
       CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
       CASE WHEN c_custkey % 29 = 0 THEN 'UNKNOWN' ELSE c_mktsegment END AS c_mktsegment
FROM {customer}
"""

DIRTY_ORDERS = """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 31 = 0 THEN -1 - o_custkey WHEN o_orderkey % 41 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
       o_orderstatus,
       o_totalprice,
       o_orderdate,
       CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM {orders}
"""

# Event values as text: integers, some with a fraction, some not numbers
EVENT_TEXT = """
SELECT event_id, event_type,
       CASE WHEN event_id % 13 = 0 THEN 'n/a'
            WHEN event_id % 7 = 0 THEN concat(regexp_extract(props, '([0-9]+)', 1), '.5')
            ELSE regexp_extract(props, '([0-9]+)', 1) END AS k_text,
       regexp_extract(props, '([0-9]+)', 1) AS k_whole,
       CASE WHEN value > 250 THEN 'true' ELSE 'false' END AS k_flag
FROM {events}
"""

# Lineitem in the shape of the small supplier report
SUPPLIER_STYLE = """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_partkey END AS PART_NO,
       CASE WHEN l_returnflag = 'R' THEN 'Yes' WHEN l_returnflag = 'A' THEN 'No'
            WHEN l_linenumber % 2 = 0 THEN NULL ELSE 'Invalid' END AS ORIGINATING_FLG,
       CAST(round(l_discount * 1000) AS INT) AS ORIGINATING_PCT,
       CASE WHEN l_linestatus = 'O' THEN 'Y' WHEN l_quantity > 25 THEN 'N' ELSE 'X' END AS ACTV_IND
FROM {lineitem}
"""

# Suppliers as an untyped text feed
SUPPLIER_FEED = """
SELECT CAST(s_suppkey AS STRING) AS s_suppkey,
       s_name,
       CASE WHEN s_suppkey % 13 = 0 THEN 'x' ELSE CAST(s_nationkey AS STRING) END AS s_nationkey,
       CASE WHEN s_suppkey % 7 = 0 THEN ' - ' WHEN s_suppkey % 11 = 0 THEN '#N/A'
            WHEN s_suppkey % 17 = 0 THEN '#VALUE!'
            ELSE concat('$ ', CAST(s_acctbal AS STRING)) END AS s_acctbal
FROM {supplier}
"""

# A rules table derived from the parts: one rule per part, grouped in databases
PART_RULES = """
SELECT CASE WHEN p_size % 2 = 0 THEN 'Sales' ELSE 'stock' END AS db_name,
       p_type AS table_name,
       p_brand AS column_name,
       CAST(NULL AS STRING) AS sql,
       concat('rule_', CAST(p_partkey AS STRING)) AS constraint_name,
       concat('.isComplete("', p_name, '")') AS constraint_rule,
       CASE WHEN p_size % 5 = 0 THEN 'N' ELSE 'Y' END AS is_active,
       CASE WHEN p_size % 3 = 0 THEN 'Y' ELSE 'N' END AS reject_capture,
       CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat('select ', CAST(p_partkey AS STRING)) END AS reject_sql,
       CASE WHEN p_size % 7 = 0 THEN 'metrics' ELSE 'verify' END AS rule_type,
       'Error' AS check_level,
       p_name AS check_message,
       CASE WHEN p_size % 4 = 0 THEN 'Y' ELSE 'N' END AS notify_capture,
       concat('topic_', CAST(p_size % 6 AS STRING)) AS notify_topic
FROM {part}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """The rows of a view text over the named tables."""
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def sql_text(sql: str, *names: str) -> str:
    """The same view text over registered table names."""
    for n in names:
        sql = sql.replace("{" + n + "}", n)
    return sql.strip()


def dirty_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, DIRTY_CUSTOMER, "customer")


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, DIRTY_ORDERS, "orders")


def event_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, EVENT_TEXT, "events")


def supplier_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SUPPLIER_STYLE, "lineitem")


def supplier_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SUPPLIER_FEED, "supplier")


def part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PART_RULES, "part")


DIRTY_CUSTOMER_SQL = sql_text(DIRTY_CUSTOMER, "customer")
DIRTY_ORDERS_SQL = sql_text(DIRTY_ORDERS, "orders")
EVENT_TEXT_SQL = sql_text(EVENT_TEXT, "events")
SUPPLIER_STYLE_SQL = sql_text(SUPPLIER_STYLE, "lineitem")
SUPPLIER_FEED_SQL = sql_text(SUPPLIER_FEED, "supplier")
PART_RULES_SQL = sql_text(PART_RULES, "part")
