"""Whole jobs on catalog tables: table writes, ingestion into a table, listings, stored reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisift.functions.rules import Rule
from verisift.operators import states
from verisift.operators.rejects import rejects
from verisift.operators.skew import discrete_quantile
from verisift.operators.verification import ConstraintRule, verify
from verisift.plans import transform
from verisift.plans.batch import profile_rows
from verisift.plans.ingest import ingest
from verisift.plans.validation import get_report, quick_check, run_rules, store_report
from verisift.session import scratch_path, settle
from verisift.sources import files, manifest, sinks
from verisift.sources.tables import list_tables, source_frame

from .common import AS_OF, DIRTY_CUSTOMER_SQL, RUN_ID, SUPPLIER_FEED_SQL, dirty_customer, supplier_feed, table, view

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
DATABASE = "verisift_jobs"


def _query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return add


def _database(spark: SparkSession) -> str:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE} LOCATION '{scratch_path(spark, 'jobs')}'")
    return DATABASE


def _new_table(spark: SparkSession, df: DataFrame, kind: str, *parts: str) -> str:
    """A table of its own in the shared folder, holding ``df``."""
    name = f"{_database(spark)}.{kind}_{uuid.uuid4().hex}"
    df.write.partitionBy(*parts).option("path", scratch_path(spark, kind)).saveAsTable(name)
    return name


# Orders with a partition column that has a time part and is null for some rows
STAMPED = """
SELECT o_orderkey, o_orderstatus, o_totalprice,
       CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE TIMESTAMP '2024-03-05 10:20:30' + (o_custkey % 5) * INTERVAL '90' MINUTE END AS loaded_at
FROM {orders}
"""
STAMPED_SQL = STAMPED.replace("{orders}", "orders")
SECOND = "TIMESTAMP '2024-03-05 11:50:30'"


def _stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, STAMPED, "orders")


def stamped_table(spark: SparkSession, sf_dir: str) -> str:
    return _new_table(spark, _stamped(spark, sf_dir), "stamped", "loaded_at")


@_query("table_replace_slice", f"""WITH t AS ({STAMPED_SQL})
SELECT * FROM t WHERE loaded_at IS NULL OR loaded_at <> {SECOND}
UNION ALL SELECT o_orderkey + 100000000, o_orderstatus, 0, loaded_at FROM t WHERE loaded_at = {SECOND} AND o_orderstatus = 'P'""")
def table_replace_slice(spark, sf_dir):
    name = stamped_table(spark, sf_dir)
    new = _stamped(spark, sf_dir).filter(f"loaded_at = {SECOND} AND o_orderstatus = 'P'").selectExpr(
        "o_orderkey + 100000000 AS o_orderkey", "o_orderstatus", "0 AS o_totalprice", "loaded_at")
    sinks.replace_slice(new, name, F.col("loaded_at") == F.expr(SECOND))
    return spark.table(name)


MERGED = """
SELECT o_orderkey, o_orderstatus, o_totalprice / 2 AS o_totalprice, loaded_at FROM {t} WHERE loaded_at = TIMESTAMP '2024-03-05 13:20:30'
UNION ALL SELECT o_orderkey + 100000000, o_orderstatus, o_totalprice, TIMESTAMP '2024-04-01 00:00:01' FROM {t} WHERE o_totalprice > 450000
UNION ALL SELECT CAST(NULL AS BIGINT), o_orderstatus, o_totalprice, loaded_at FROM {t} WHERE o_totalprice < 2000
"""


@_query("table_upsert", f"""WITH t AS ({STAMPED_SQL}), s AS ({MERGED.replace("{t}", "t")})
SELECT * FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s WHERE o_orderkey IS NOT NULL)
UNION ALL SELECT * FROM s""")
def table_upsert(spark, sf_dir):
    name = stamped_table(spark, sf_dir)
    sinks.upsert(spark.sql(MERGED, t=_stamped(spark, sf_dir)), name, ["o_orderkey"])
    return spark.table(name)


ORDER_CHANGES = """
SELECT o_orderkey, o_orderstatus, o_totalprice / 2 AS o_totalprice FROM {t} WHERE o_orderkey % 97 = 0
UNION ALL SELECT o_orderkey + 100000000, o_orderstatus, o_totalprice FROM {t} WHERE o_totalprice > 450000
UNION ALL SELECT CAST(NULL AS BIGINT), o_orderstatus, o_totalprice FROM {t} WHERE o_totalprice < 2000
"""


@_query("table_bucketed_upsert", f"""WITH s AS ({ORDER_CHANGES.replace("{t}", "orders")})
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s WHERE o_orderkey IS NOT NULL)
UNION ALL SELECT * FROM s
UNION ALL SELECT o_orderkey + 200000000, 'X', 0 FROM orders WHERE o_orderstatus = 'P'""")
def table_bucketed_upsert(spark, sf_dir):
    """A table in hash buckets of its key: a merge, then rows appended without naming the bucket."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    name = f"{_database(spark)}.bucketed_{uuid.uuid4().hex}"
    sinks.create_bucketed(orders, name, ["o_orderkey"], 16, scratch_path(spark, "bucketed"))
    sinks.upsert(spark.sql(ORDER_CHANGES, t=orders), name, ["o_orderkey"])
    more = orders.filter("o_orderstatus = 'P'").selectExpr("o_orderkey + 200000000 AS o_orderkey", "'X' AS o_orderstatus", "0 AS o_totalprice")
    sinks.append_by_name(more, name)
    return spark.table(name).drop(sinks.BUCKET)


@_query("table_whole_rewrite", f"""WITH s AS ({ORDER_CHANGES.replace("{t}", "orders")})
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN (SELECT o_orderkey FROM s WHERE o_orderkey IS NOT NULL)
UNION ALL SELECT * FROM s""")
def table_whole_rewrite(spark, sf_dir):
    """A table without partitions: a slice replaced by nothing, then a merge; each switches to new files."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    name = _new_table(spark, orders, "whole")
    sinks.replace_slice(orders.limit(0), name, F.col("o_orderstatus") == "P")
    sinks.upsert(spark.sql(ORDER_CHANGES, t=orders), name, ["o_orderkey"])
    return spark.table(name)


REGISTERED = [Rule("R1", "not_null", "c_name", "critical"), Rule("R2", "range_check", "c_acctbal", "high", params={"min_value": 0})]


# --- result tables ---------------------------------------------------------------------------

RESULT_COLUMNS = "db_name string, table_name string, constraint_name string, constraint_status string, metric_value double"
RESULT_RULES = [
    ConstraintRule(".isComplete('c_name')", constraint_name="names"), ConstraintRule(".isUnique('c_custkey')", constraint_name="keys"),
    ConstraintRule(".hasCompleteness('c_acctbal', '> 0.9')", constraint_name="balances"),
]


@_query("results_written_twice", f"""WITH d AS ({DIRTY_CUSTOMER_SQL}),
r AS (SELECT 'names' AS constraint_name, count(c_name) / count(*) AS v, count(c_name) = count(*) AS ok FROM d
  UNION ALL SELECT 'keys', 1.0, true UNION ALL SELECT 'balances', count(c_acctbal) / count(*), count(c_acctbal) / count(*) > 0.9 FROM d)
SELECT run_id, constraint_name, CASE WHEN ok THEN 'Success' ELSE 'Failure' END AS constraint_status, round(v, 6) AS metric_value, CAST(month AS INTEGER) AS month
FROM r, (VALUES ('first', 202403), ('second', 202405)) AS runs(run_id, month)""")
def results_written_twice(spark, sf_dir):
    """Check results of two runs; one is written twice, the other again in a later month."""
    name = f"{_database(spark)}.results_{uuid.uuid4().hex}"
    sinks.create_results(spark, name, RESULT_COLUMNS, scratch_path(spark, "results"))
    for run_id, as_of in (("first", AS_OF), ("second", "2024-04-01 00:00:00"), ("first", AS_OF), ("second", "2024-05-01 00:00:00")):
        found = verify(dirty_customer(spark, sf_dir), RESULT_RULES, db_name="db", table_name="customer", as_of=as_of)
        kept = found.select("db_name", "table_name", "constraint_name", "constraint_status", "metric_value", "create_month_prtn")
        sinks.append_run(kept, name, run_id)
    return spark.table(name).select("run_id", "constraint_name", "constraint_status", F.round("metric_value", 6).alias("metric_value"),
                                    F.col("create_month_prtn").alias("month"))


@_query("profile_written_twice", """
SELECT 'p1' AS run_id, 'part' AS table_name, c AS column_name, 1.0::DOUBLE AS completeness, t AS data_type FROM (VALUES
  ('p_partkey', 'Integral'), ('p_name', 'String'), ('p_brand', 'String'), ('p_type', 'String'), ('p_size', 'Integral'),
  ('p_retailprice', 'Fractional')) AS v(c, t) WHERE EXISTS (SELECT 1 FROM part)""")
def profile_written_twice(spark, sf_dir):
    """Profile rows of a run, appended twice."""
    name = f"{_database(spark)}.profiles_{uuid.uuid4().hex}"
    columns = "db_name string, table_name string, column_name string, completeness double, data_type string, approx_num_distinct_values bigint, audit_create_date timestamp"
    sinks.create_results(spark, name, columns, scratch_path(spark, "profiles"))
    for _ in range(2):
        sinks.append_run(profile_rows(table(spark, sf_dir, "part"), db_name="db", table_name="part", as_of=AS_OF), name, "p1")
    return spark.table(name).select("run_id", "table_name", "column_name", "completeness", "data_type")


@_query("rejects_written_twice", f"""WITH d AS ({DIRTY_CUSTOMER_SQL})
SELECT 'r1' AS run_id, 'R1' AS rule_id, CAST(c_custkey AS VARCHAR) AS row_key FROM d WHERE c_name IS NULL OR trim(c_name) = ''
UNION ALL SELECT 'r1', 'R2', CAST(c_custkey AS VARCHAR) FROM d WHERE c_acctbal < 0""")
def rejects_written_twice(spark, sf_dir):
    """A rejects table that is created when first needed; the run is captured twice, another one finds nothing any more."""
    name = f"{_database(spark)}.rejects_{uuid.uuid4().hex}"
    found = rejects(dirty_customer(spark, sf_dir), REGISTERED, dataset_id="customer", run_id="r1", as_of=AS_OF, keys=["c_custkey"])
    kept = found.select("rule_id", "row_key", "row_data", F.lit(202403).alias("create_month_prtn"))
    for rows, run_id in ((kept, "r1"), (kept, "r2"), (kept, "r1"), (kept.limit(0), "r2")):
        sinks.create_results(spark, name, "rule_id string, row_key string, row_data string", scratch_path(spark, "rejects"))
        sinks.append_run(rows, name, run_id)
    return spark.table(name).select("run_id", "rule_id", "row_key")


# --- metrics from states -------------------------------------------------------------------------

def _within(estimate, exact, share: float):
    """The exact number if the estimate lies near it, else the estimate."""
    return F.when(F.abs(estimate - exact) <= share * exact, exact).otherwise(estimate)


@_query("metric_states", """
WITH v AS (SELECT 'l_quantity' AS column_name, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem
  UNION ALL SELECT 'l_partkey', l_partkey FROM lineitem)
SELECT column_name, metric, round(value, 4) AS value FROM (SELECT column_name, unnest(['Size', 'Completeness', 'ApproxCountDistinct', 'Minimum', 'Maximum',
  'Mean', 'Sum', 'StandardDeviation', 'ApproxQuantile(0.5)']) AS metric, unnest([count(*), count(v) / count(*), count(DISTINCT v), min(v), max(v), avg(v), sum(v),
  stddev_pop(v), quantile_disc(v, 0.5)]) AS value FROM v GROUP BY column_name) AS m""")
def metric_states(spark, sf_dir):
    """Metrics of a table from the states of its slices: two are stored, the third comes later and is
    the only one read then.  Estimates near the exact number count as it."""
    columns = ["l_quantity", "l_extendedprice", "l_partkey"]
    whole = table(spark, sf_dir, "lineitem").select(*columns, "l_returnflag")
    early = whole.filter("l_returnflag <> 'R'")
    path = scratch_path(spark, "states")
    for rows in (early, whole):
        stored = spark.read.parquet(path) if rows is whole else spark.createDataFrame([], states.STATE)
        fresh = states.new_slices(rows, "l_returnflag", stored)
        states.column_states(fresh, F.col("l_returnflag")).write.mode("append").parquet(path)
    found = states.state_metrics(spark.read.parquet(path).filter(F.col("column_name").isin(columns)), db_name="db", table_name="lineitem",
                                 as_of=AS_OF, quantiles=(0.5,))
    counts = settle(whole.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "of", "v").groupBy("of", "v").agg(
        F.count(F.lit(1)).alias("__n")))
    middle = discrete_quantile(counts, "of", "v", 0.5).select(F.col("of").alias("of_middle"), F.col("quantile").alias("middle"))
    exact = counts.groupBy("of").agg(F.count("v").alias("distinct")).join(middle, F.col("of") == F.col("of_middle"), "left")
    value = F.when(F.col("metric") == "ApproxCountDistinct", _within(F.col("value"), F.col("distinct"), 0.03)).when(
        F.col("metric") == "ApproxQuantile(0.5)", _within(F.col("value"), F.col("middle"), 0.03)).otherwise(F.col("value"))
    return found.join(exact, F.col("column_name") == F.col("of")).select("column_name", "metric", F.round(value, 4).alias("value"))


@_query("table_compact", STAMPED_SQL)
def table_compact(spark, sf_dir):
    name = _new_table(spark, _stamped(spark, sf_dir).repartition(6), "scattered", "loaded_at")
    sinks.compact(spark, name)
    return spark.table(name)


@_query("table_append_evolving", f"""WITH t AS ({STAMPED_SQL})
SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(NULL AS VARCHAR) AS remark, loaded_at FROM t
UNION ALL SELECT o_orderkey, o_orderstatus, NULL, 'again', loaded_at FROM t WHERE o_orderstatus = 'P'""")
def table_append_evolving(spark, sf_dir):
    name = stamped_table(spark, sf_dir)
    again = _stamped(spark, sf_dir).filter("o_orderstatus = 'P'").selectExpr(
        "o_orderkey AS O_OrderKey", "o_orderstatus", "loaded_at", "'again' AS Remark")
    sinks.append_evolving(again, name)
    return spark.table(name).select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("remark").alias("remark"), "loaded_at")


# --- ingestion ------------------------------------------------------------------------------

FEED_SCHEMA = "s_suppkey number, s_name string, s_nationkey int, s_acctbal string"
LANDED_SQL = """SELECT CAST(s_suppkey AS BIGINT) AS id, sha256(s_name) AS label,
  CASE WHEN regexp_matches(s_nationkey, '^[0-9]+$') THEN CAST(s_nationkey AS INT) END AS nation,
  CASE WHEN trim(s_acctbal) = '-' THEN NULL ELSE regexp_replace(trim(s_acctbal), '(#?N/A|#VALUE!)|[$, ]', '', 'g') END AS balance"""


def _feed(spark: SparkSession, sf_dir: str, root: str, folder: str, condition: str) -> None:
    """One part of the supplier feed as one delimited file; each folder names its file alike."""
    supplier_feed(spark, sf_dir).filter(condition).coalesce(1).write.option("sep", "|").option("header", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{root}/in/{folder}")


def _landing(spark: SparkSession, root: str, **more) -> dict:
    name = f"landed_{uuid.uuid4().hex}"
    return {
        "type": "csv", "delimiter": "|", "include_header": "y", "file_path": f"{root}/in/*", "schema": FEED_SCHEMA,
        "target_schema": "id number, label string, nation int, balance string", "columnsWithDollar": "balance",
        "dataMasking": "Y", "maskingRulesStr": '{"label": {"kind": "hash"}}', "table_schema": _database(spark),
        "table_name": name, "location": f"{root}/{DATABASE}/{name}", **more,
    }


@_query("ingest_table", f"WITH d AS ({SUPPLIER_FEED_SQL}) {LANDED_SQL}, '2024-03-05 00:00:00' AS loaded FROM d")
def ingest_table(spark, sf_dir):
    root = scratch_path(spark, "feed")
    _feed(spark, sf_dir, root, "d1", "true")
    landed = ingest(spark, _landing(spark, root, append_ind="N"), as_of=AS_OF)
    return landed.select("id", "label", "nation", "balance", F.date_format("incr_ingest_timestamp", "yyyy-MM-dd HH:mm:ss").alias("loaded"))


@_query("ingest_append_new_files", f"""WITH d AS ({SUPPLIER_FEED_SQL}) {LANDED_SQL},
  CASE WHEN CAST(s_suppkey AS BIGINT) % 3 = 0 THEN '2024-03-05 00:00:00' ELSE '2024-03-06 10:20:30' END AS loaded FROM d""")
def ingest_append_new_files(spark, sf_dir):
    root = scratch_path(spark, "feed")
    conf = _landing(spark, root, append_ind="Y")
    _feed(spark, sf_dir, root, "d1", "s_suppkey % 3 = 0")
    ingest(spark, conf, as_of=AS_OF)
    _feed(spark, sf_dir, root, "d2", "s_suppkey % 3 <> 0")
    for _ in range(2):  # the second run finds nothing new
        landed = ingest(spark, conf, as_of="2024-03-06 10:20:30")
    return landed.select("id", "label", "nation", "balance", F.date_format("incr_ingest_timestamp", "yyyy-MM-dd HH:mm:ss").alias("loaded"))


@_query("ingest_pattern_names", f"""WITH d AS ({SUPPLIER_FEED_SQL}),
n AS (SELECT CASE WHEN CAST(s_suppkey AS BIGINT) % 3 = 0 THEN 'a*[1].csv' ELSE 'b[1]{{2}}?.csv' END AS file_name, count(*) AS rows FROM d GROUP BY 1)
SELECT file_name, rows, CAST(1 AS BIGINT) AS loads, true AS sized FROM n""")
def ingest_pattern_names(spark, sf_dir):
    """Files whose names look like patterns, each loaded once, as the manifest tells."""
    root = scratch_path(spark, "feed")
    conf = _landing(spark, root, append_ind="Y", file_path=f"{root}/in")
    name = f"{conf['table_schema']}.{conf['table_name']}"
    for folder, file, condition in (("d1", "a*[1].csv", "s_suppkey % 3 = 0"), ("d2", "b[1]{2}?.csv", "s_suppkey % 3 <> 0")):
        _feed(spark, sf_dir, f"{root}/parts", folder, condition)
        files.move_file(spark, f"{root}/parts/in/{folder}", f"{root}/in/{file}")
        for _ in range(2):  # the second run finds nothing new
            landed = ingest(spark, conf, as_of=AS_OF)
    listed = manifest.loaded_files(spark, name).groupBy(F.element_at(F.split("file_path", "/"), -1).alias("listed")).agg(
        F.count("*").alias("loads"), F.bool_and(F.col("file_size") > 0).alias("sized"))
    rows = landed.groupBy("file_name").agg(F.count("*").alias("rows"))
    return rows.join(listed, F.col("file_name") == F.col("listed")).drop("listed")


@_query("ingest_deletes_inputs", f"""WITH d AS ({SUPPLIER_FEED_SQL}) {LANDED_SQL}, CAST(1 AS BIGINT) AS inputs_left FROM d""")
def ingest_deletes_inputs(spark, sf_dir):
    """A job that deletes what it has loaded; a file that came meanwhile stays for the next run."""
    root = scratch_path(spark, "feed")
    conf = _landing(spark, root, append_ind="Y", filedel_ind="Y")
    for folder, condition in (("d1", "s_suppkey % 3 = 0"), ("d2", "s_suppkey % 3 <> 0")):
        _feed(spark, sf_dir, root, folder, condition)
        landed = ingest(spark, conf, as_of=AS_OF)
    _feed(spark, sf_dir, root, "d3", "true")
    left = files.list_files(spark, f"{root}/in/*/*.csv").agg(F.count("*")).scalar()
    return landed.select("id", "label", "nation", "balance", left.alias("inputs_left"))


@_query("ingest_lineage", f"""WITH d AS ({SUPPLIER_FEED_SQL})
SELECT CASE WHEN CAST(s_suppkey AS BIGINT) % 3 = 0 THEN 'd1' ELSE 'd2' END AS folder, count(*) AS n, true AS name_in_path, true AS csv_name FROM d GROUP BY 1""")
def ingest_lineage(spark, sf_dir):
    root = scratch_path(spark, "feed")
    _feed(spark, sf_dir, root, "d1", "s_suppkey % 3 = 0")
    _feed(spark, sf_dir, root, "d2", "s_suppkey % 3 <> 0")
    landed = ingest(spark, _landing(spark, root), as_of=AS_OF)
    return landed.groupBy(F.element_at(F.split("file_path", "/"), -2).alias("folder")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.endswith("file_path", "file_name")).alias("name_in_path"),
        F.bool_and(F.col("file_name").endswith(".csv")).alias("csv_name"))


@_query("list_input_files", """
SELECT DISTINCT CASE WHEN CAST(s_suppkey AS BIGINT) % 3 = 0 THEN 'd1' ELSE 'd2' END AS folder, CAST(1 AS BIGINT) AS files FROM supplier""")
def list_input_files(spark, sf_dir):
    root = scratch_path(spark, "feed")
    _feed(spark, sf_dir, root, "d1", "s_suppkey % 3 = 0")
    _feed(spark, sf_dir, root, "d2", "s_suppkey % 3 <> 0")
    return files.list_files(spark, f"{root}/in/*").groupBy(F.element_at(F.split("file_path", "/"), -2).alias("folder")).agg(
        F.count(F.lit(1)).alias("files"))


# --- loads, listings, documents -------------------------------------------------------------

CHAIN_TABLES = "cheap, dear"
CHAIN_SQL = """SELECT 'cheap' AS kind, o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 5000
UNION ALL SELECT 'dear', o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END FROM orders WHERE o_totalprice > 300000"""


@_query("load_dispatch", CHAIN_SQL)
def load_dispatch(spark, sf_dir):
    """Two tables of a configured list: one appended to, one merged into."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("dq_chain_orders")
    db = f"dq_load_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {db} LOCATION '{scratch_path(spark, 'load')}'")
    dear = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select("o_orderkey", "o_totalprice")
    sinks.append_load(dear, f"{db}.dear")
    blocks = {
        "cheap": {"settings": {"loadType": "ins"}, "queries": {
            transform.FINAL_VIEW: "SELECT o_orderkey, o_totalprice FROM dq_chain_orders WHERE o_totalprice < 5000"}},
        "dear": {"settings": {"loadType": "merge", "mergeKey": ["o_orderkey"]}, "queries": {
            "dq_partial": "SELECT * FROM dq_chain_orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000",
            transform.FINAL_VIEW: "SELECT o_orderkey, CAST(0 AS DOUBLE) AS o_totalprice FROM dq_partial"}},
    }
    transform.process_tables(spark, {"trnconfig": blocks}, CHAIN_TABLES, db)
    loaded = [spark.table(f"{db}.{t}").select(F.lit(t).alias("kind"), "o_orderkey", "o_totalprice") for t in list_tables(spark, db)]
    return loaded[0].unionByName(loaded[1])


@_query("given_frame_wins", "SELECT s_suppkey, s_name FROM supplier")
def given_frame_wins(spark, sf_dir):
    given = table(spark, sf_dir, "supplier")
    return source_frame(spark, db_name="absent", table_name="absent", data=given, where="1 = 0", columns=["s_suppkey", "s_name"])


@_query("keyed_json_file", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_acctbal AS balance FROM customer")
def keyed_json_file(spark, sf_dir):
    """Files of one JSON object from id to record, read back.  An object holds about 500 records of
    a nation, however many customers the nation has."""
    path = scratch_path(spark, "keyed")
    entry = F.struct(F.col("c_custkey").cast("string"), F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")))
    customers = table(spark, sf_dir, "customer")
    sizes = customers.groupBy(F.col("c_nationkey").alias("nation")).agg(F.ceil(F.count("*") / 500).alias("objects"))
    dealt = customers.join(F.broadcast(sizes), F.col("c_nationkey") == F.col("nation")).withColumn(
        "object", F.pmod(F.xxhash64("c_custkey"), "objects"))  # one row per nation
    groups = dealt.groupBy("nation", "object").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    groups.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.read_keyed_json(spark, path, "name string, balance double").select("id", "name", "balance")


@_query("insert_document", """
SELECT event_id, event_type, value > 250 AS "isImportant" FROM events
UNION ALL SELECT event_id + 1000000, 'late', false FROM events WHERE value > 480""")
def insert_document(spark, sf_dir):
    path = scratch_path(spark, "notes")
    events = table(spark, sf_dir, "events")
    flag = F.when(F.col("value") > 250, "on")
    sinks.insert_document(events.select("event_id", "event_type", flag.alias("isImportant")), path)
    late = events.filter("value > 480").select((F.col("event_id") + 1000000).alias("event_id"), F.lit("late").alias("event_type"))
    sinks.insert_document(late.withColumn("isImportant", F.lit(None).cast("string")), path)
    return files.read_documents(spark, path, "event_id long, event_type string, isImportant boolean")




@_query("report_registry", f"""WITH d AS ({DIRTY_CUSTOMER_SQL})
SELECT '{RUN_ID}' AS run_id, 'failed' AS overall_status, CAST(2 AS BIGINT) AS total_rules,
  (SELECT count(*) FROM d WHERE c_name IS NULL OR trim(c_name) = '') + (SELECT count(*) FROM d WHERE c_acctbal < 0) AS rejects,
  (SELECT count(*) FROM d WHERE c_acctbal < 0) AS high_anomalies""")
def report_registry(spark, sf_dir):
    """A run whose report is stored in a table, found again by its id, with its audit files."""
    run = run_rules(dirty_customer(spark, sf_dir), REGISTERED, dataset_id="customer", run_id=RUN_ID, as_of=AS_OF, keys=["c_custkey"])
    name = f"{_database(spark)}.reports_{uuid.uuid4().hex}"
    store_report(run.summary, name)
    path = scratch_path(spark, "report")
    sinks.write_audit(run.rejects, f"{path}/audit")
    sinks.write_json(run.document, f"{path}/document")
    audit = spark.read.schema(run.rejects.schema).json(f"{path}/audit").agg(F.count(F.lit(1)).alias("rejects"))
    document = spark.read.json(f"{path}/document").select("run_id", F.col("by_severity.high").alias("high_anomalies"))
    stored = get_report(spark.table(name), RUN_ID).select("run_id", "overall_status", "total_rules")
    return stored.join(document, "run_id").select("*", audit.scalar().alias("rejects"))


@_query("quick_check_run", """
SELECT count(*) FILTER (n_distinct = n_rows) AS unique_columns FROM (
  SELECT count(*) AS n_rows, count(DISTINCT p_partkey) AS n_distinct FROM part
  UNION ALL SELECT count(*), count(DISTINCT p_name) FROM part UNION ALL SELECT count(*), count(DISTINCT p_brand) FROM part
  UNION ALL SELECT count(*), count(DISTINCT p_type) FROM part UNION ALL SELECT count(*), count(DISTINCT p_size) FROM part
  UNION ALL SELECT count(*), count(DISTINCT p_retailprice) FROM part) AS c""")
def quick_check_run(spark, sf_dir):
    """Profile, suggestion and check as one job: unique columns are proposed as such and pass."""
    run = quick_check(table(spark, sf_dir, "part"), dataset_id="part", run_id=RUN_ID, as_of=AS_OF)
    passed = (F.col("rule_type") == "uniqueness") & (F.col("status") == "passed")
    return run.results.agg(F.count(F.when(passed, 1)).alias("unique_columns"))
