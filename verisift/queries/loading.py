"""Rule tables, batch jobs, file scans, ingestion, transforms, table writes, records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisift.functions.schemas import parse_schema
from verisift.operators import collection, rulebook
from verisift.operators.conform import (
    clean_columns, conform, mask_columns, only_new_files, rename_by_position,
)
from verisift.plans import batch
from verisift.plans.ingest import scan, shape
from verisift.plans.transform import FINAL_VIEW, run_views
from verisift.session import scratch_path
from verisift.sources import files, sinks
from verisift.sources.tables import nan_to_null, source_frame
from verisift.streaming.ingest_stream import ingest_stream

from .common import (
    AS_OF, DIRTY_CUSTOMER_SQL, PART_RULES_SQL, SUPPLIER_FEED_SQL, dirty_customer, dirty_orders,
    part_rules, supplier_feed, table, view,
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


# --- rule tables -------------------------------------------------------------------------

@_query("rules_active", f"""
WITH r AS ({PART_RULES_SQL})
SELECT DISTINCT lower(db_name) AS db_name, lower(table_name) AS table_name, lower(column_name) AS column_name,
  constraint_name, constraint_rule, check_level, check_message
FROM r WHERE is_active = 'Y' AND lower(db_name) = 'sales' AND rule_type = 'verify' AND lower(table_name) IN ('economy', 'promo')""")
def rules_active(spark, sf_dir):
    return rulebook.active_rules(part_rules(spark, sf_dir), "sales", tables="Economy, promo").drop("sql")


REJECT_ELIGIBLE_SQL = f"""
WITH r AS ({PART_RULES_SQL}),
e AS (SELECT DISTINCT db_name, table_name, constraint_name, reject_sql FROM r
  WHERE is_active = 'Y' AND reject_capture = 'Y' AND lower(db_name) = 'sales' AND rule_type = 'verify' AND reject_sql IS NOT NULL)"""


@_query("rules_reject_eligible", REJECT_ELIGIBLE_SQL + "\nSELECT * FROM e")
def rules_reject_eligible(spark, sf_dir):
    return rulebook.reject_rules(part_rules(spark, sf_dir), "SALES")


@_query("rules_failed_only", REJECT_ELIGIBLE_SQL + """,
f AS (SELECT db_name, table_name, constraint_name FROM r WHERE is_active = 'Y' AND check_message < 'm')
SELECT * FROM e WHERE EXISTS (SELECT 1 FROM f WHERE lower(f.db_name) = lower(e.db_name)
  AND lower(f.table_name) = lower(e.table_name) AND f.constraint_name = e.constraint_name)""")
def rules_failed_only(spark, sf_dir):
    rules = part_rules(spark, sf_dir)
    failed = rules.filter("is_active = 'Y' and check_message < 'm'")
    return rulebook.failed_only(rulebook.reject_rules(rules, "Sales"), failed)


RULE_SETS = """
SELECT concat('d', CAST(p_partkey % 5 AS STRING)) AS dataset_id, concat('R', CAST(p_partkey AS STRING)) AS rule_id,
       p_brand AS rule_column, p_size % 2 = 0 AS active
FROM {part}
"""
RULE_SETS_SQL = RULE_SETS.replace("{part}", "part")


def _rule_sets(spark, sf_dir):
    return view(spark, sf_dir, RULE_SETS, "part")


@_query("rules_toggle", f"""WITH s AS ({RULE_SETS_SQL})
SELECT dataset_id, rule_id, rule_column, CASE WHEN dataset_id = 'd0' AND rule_id = 'R0' THEN false ELSE active END AS active FROM s""")
def rules_toggle(spark, sf_dir):
    return rulebook.toggle_rule(_rule_sets(spark, sf_dir), "d0", "R0", False)


@_query("rules_delete", f"WITH s AS ({RULE_SETS_SQL}) SELECT * FROM s WHERE NOT (dataset_id = 'd0' AND rule_id = 'R0')")
def rules_delete(spark, sf_dir):
    return rulebook.delete_rule(_rule_sets(spark, sf_dir), "d0", "R0")


@_query("rules_set", f"""WITH s AS ({RULE_SETS_SQL})
SELECT * FROM s WHERE dataset_id <> 'd1' UNION ALL SELECT 'd1', 'N' || rule_id, rule_column, true FROM s WHERE dataset_id = 'd2'""")
def rules_set(spark, sf_dir):
    sets = _rule_sets(spark, sf_dir)
    new = rulebook.get_rule_set(sets, "d2").select(
        F.lit("d1").alias("dataset_id"), F.concat(F.lit("N"), "rule_id").alias("rule_id"), "rule_column",
        F.lit(True).alias("active"))
    return rulebook.set_rule_set(sets, new, "d1")


LOADED_COLUMNS = ["db_name", "table_name", "constraint_name", "constraint_rule", "is_active", "check_level"]


def _rules_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part rules as a rules file of 15 columns, read back."""
    rules = part_rules(spark, sf_dir).withColumn("constraint_desc", F.lit("d"))
    path = scratch_path(spark, "rules-file")
    rules.write.option("sep", "|").option("header", True).csv(path)
    return files.read_rules_file(spark, path)


@_query("rules_replace_slice", f"""WITH r AS ({PART_RULES_SQL})
SELECT {', '.join(LOADED_COLUMNS)} FROM r WHERE db_name <> 'Sales'
UNION ALL SELECT {', '.join(LOADED_COLUMNS)} FROM r""")
def rules_replace_slice(spark, sf_dir):
    loaded = _rules_file(spark, sf_dir)
    existing = part_rules(spark, sf_dir).withColumn("audit_create_date", F.lit(AS_OF).cast("timestamp"))
    return rulebook.load_rules(existing, loaded, "Sales", as_of=AS_OF).select(*LOADED_COLUMNS)


@_query("scan_rules_file", f"""WITH r AS ({PART_RULES_SQL})
SELECT db_name, table_name, column_name, sql, constraint_name, constraint_rule, 'd' AS constraint_desc, is_active, reject_capture,
  reject_sql, rule_type, check_level, check_message, notify_capture, notify_topic FROM r""")
def scan_rules_file(spark, sf_dir):
    return _rules_file(spark, sf_dir)


SCOPE_SQL = "SELECT 'sales' AS db_name, p_type AS table_name, p_brand AS column_name, CASE WHEN p_size % 2 = 0 THEN 'Y' ELSE 'N' END AS is_active FROM part"


@_query("scan_scope_file", f"""
SELECT DISTINCT db_name, table_name, column_name, is_active FROM ({SCOPE_SQL}) AS s
UNION ALL SELECT DISTINCT 'other', table_name, column_name, is_active FROM ({SCOPE_SQL}) AS o""")
def scan_scope_file(spark, sf_dir):
    scope = view(spark, sf_dir, SCOPE_SQL.replace("FROM part", "FROM {part}"), "part").distinct()
    path = scratch_path(spark, "scope-file")
    scope.write.option("sep", "|").option("header", True).csv(path)
    existing = scope.unionByName(scope.withColumn("db_name", F.lit("other")))
    existing = existing.withColumn("audit_create_date", F.lit(AS_OF).cast("timestamp"))
    loaded = rulebook.load_scope(existing, files.read_scope_file(spark, path), "sales", AS_OF)
    return loaded.drop("audit_create_date")


# --- batch jobs over tables of a database ------------------------------------------------------

BATCH_DB = "global_temp"


def _register(spark: SparkSession, sf_dir: str) -> None:
    """The dirty tables as views of one database."""
    dirty_customer(spark, sf_dir).createOrReplaceGlobalTempView("dq_customer")
    dirty_orders(spark, sf_dir).createOrReplaceGlobalTempView("dq_orders")


def _batch_rules(spark: SparkSession) -> DataFrame:
    """A rules table over the two views: what a user would keep in the catalog."""
    base = {"db_name": BATCH_DB, "is_active": "Y", "rule_type": "verify", "check_level": "Error", "check_message": "m"}
    rows = [
        {"table_name": "DQ_customer", "column_name": "c_name", "sql": None, "constraint_name": "names",
         "constraint_rule": ".isComplete('c_name')", "reject_capture": "Y",
         "reject_sql": f"SELECT c_custkey, c_name, c_acctbal FROM {BATCH_DB}.dq_customer WHERE c_name IS NULL"},
        {"table_name": "dq_customer", "column_name": "c_custkey", "sql": None, "constraint_name": "keys",
         "constraint_rule": ".isUnique('c_custkey')", "reject_capture": "Y",
         "reject_sql": f"SELECT * FROM {BATCH_DB}.dq_customer"},
        {"table_name": "dq_orders", "column_name": "o_custkey", "sql":
         f"SELECT * FROM {BATCH_DB}.dq_orders WHERE o_orderstatus = 'F'", "constraint_name": "orphans",
         "constraint_rule": ".isNonNegative('o_custkey')", "reject_capture": "Y",
         "reject_sql": f"SELECT o_orderkey, o_custkey FROM {BATCH_DB}.dq_orders WHERE o_custkey < 0 AND o_orderstatus = 'F'"},
    ]
    schema = ("db_name string, table_name string, column_name string, sql string, constraint_name string, "
              "constraint_rule string, is_active string, reject_capture string, reject_sql string, rule_type string, "
              "check_level string, check_message string")
    return spark.createDataFrame([{**base, **r} for r in rows], schema)


@_query("batch_verify", f"""
WITH c AS ({DIRTY_CUSTOMER_SQL})
SELECT 'dq_customer' AS table_name, 'names' AS constraint_name, CASE WHEN count(c_name) = count(*) THEN 'Success' ELSE 'Failure' END AS constraint_status FROM c
UNION ALL SELECT 'dq_customer', 'keys', CASE WHEN count(DISTINCT c_custkey) = count(*) THEN 'Success' ELSE 'Failure' END FROM c
UNION ALL SELECT 'dq_orders', 'orphans', CASE WHEN count(*) FILTER (o_orderkey % 31 = 0) > 0 THEN 'Failure' ELSE 'Success' END FROM orders WHERE o_orderstatus = 'F'""")
def batch_verify(spark, sf_dir):
    _register(spark, sf_dir)
    found = batch.verify_tables(spark, _batch_rules(spark), db_name=BATCH_DB, as_of=AS_OF)
    return found.select("table_name", "constraint_name", "constraint_status")


@_query("reject_capture", f"""
WITH c AS ({DIRTY_CUSTOMER_SQL})
SELECT CAST(json_merge_patch('{{}}', to_json({{'c_custkey': c_custkey, 'c_name': c_name, 'c_acctbal': c_acctbal}})) AS VARCHAR) AS query_result,
  'global_temp' AS db_name, 'DQ_customer' AS table_name, 'names' AS constraint_name FROM c WHERE c_name IS NULL
UNION ALL SELECT CAST(to_json({{'o_orderkey': o_orderkey, 'o_custkey': -1 - o_custkey}}) AS VARCHAR), 'global_temp', 'dq_orders', 'orphans'
FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 31 = 0""")
def reject_capture(spark, sf_dir):
    _register(spark, sf_dir)
    rules = _batch_rules(spark)
    failed = batch.verify_tables(spark, rules, db_name=BATCH_DB, as_of=AS_OF).filter("constraint_status <> 'Success'")
    return batch.capture_rejects(spark, rules, db_name=BATCH_DB, failed=failed, as_of=AS_OF).drop("audit_create_date")


@_query("batch_profile", """
SELECT 'dq_customer' AS table_name, 'c_custkey' AS column_name, 1.0::DOUBLE AS completeness, 'Integral' AS data_type
UNION ALL SELECT 'dq_orders', 'o_custkey', round(count(*) FILTER (o_orderkey % 31 = 0 OR o_orderkey % 41 <> 0) / count(*), 2), 'Integral' FROM orders""")
def batch_profile(spark, sf_dir):
    _register(spark, sf_dir)
    found = batch.profile_tables(spark, None, db_name=BATCH_DB, tables="dq_customer,dq_orders", as_of=AS_OF)
    return found.filter(F.col("column_name").isin("c_custkey", "o_custkey")).select(
        "table_name", "column_name", "completeness", "data_type")


@_query("batch_profile_scope", f"""WITH c AS ({DIRTY_CUSTOMER_SQL})
SELECT 'dq_customer' AS table_name, 'c_name' AS column_name, round(count(c_name) / count(*), 2) AS completeness, 'String' AS data_type FROM c
UNION ALL SELECT 'dq_customer', 'c_acctbal', round(count(c_acctbal) / count(*), 2), 'Fractional' FROM c
UNION ALL SELECT 'dq_orders', 'o_orderkey', 1.0, 'Integral' UNION ALL SELECT 'dq_orders', 'o_custkey', round(count(*) FILTER (o_orderkey % 31 = 0 OR o_orderkey % 41 <> 0) / count(*), 2), 'Integral' FROM orders
UNION ALL SELECT 'dq_orders', 'o_orderstatus', 1.0, 'String' UNION ALL SELECT 'dq_orders', 'o_totalprice', 1.0, 'Fractional'
UNION ALL SELECT 'dq_orders', 'o_orderdate', 1.0, 'String'
UNION ALL SELECT 'dq_orders', 'o_orderpriority', round(count(*) FILTER (o_orderkey % 37 <> 0) / count(*), 2), 'String' FROM orders""")
def batch_profile_scope(spark, sf_dir):
    """Profiles of what a scope table names: two columns of one table, all of another, nothing inactive."""
    _register(spark, sf_dir)
    scope = spark.createDataFrame(
        [(BATCH_DB, "dq_customer", "c_name", "Y"), (BATCH_DB, "dq_customer", "c_acctbal", "Y"), (BATCH_DB, "dq_customer", "c_custkey", "N"),
         (BATCH_DB, "dq_orders", None, "Y"), ("other", "dq_customer", "c_mktsegment", "Y")],
        "db_name string, table_name string, column_name string, is_active string")
    found = batch.profile_tables(spark, scope, db_name=BATCH_DB, as_of=AS_OF)
    return found.select("table_name", "column_name", "completeness", "data_type")


@_query("batch_profile_columns", f"""WITH c AS ({DIRTY_CUSTOMER_SQL})
SELECT 'dq_customer' AS table_name, 'c_name' AS column_name, round(count(c_name) / count(*), 2) AS completeness, 'String' AS data_type FROM c WHERE c_nationkey < 10
UNION ALL SELECT 'dq_customer', 'c_mktsegment', 1.0, 'String'""")
def batch_profile_columns(spark, sf_dir):
    """Given columns of a table, of the rows that a filter on another column keeps."""
    _register(spark, sf_dir)
    found = batch.profile_tables(
        spark, None, db_name=BATCH_DB, tables="dq_customer", columns=["c_name", "c_mktsegment"], where="c_nationkey < 10", as_of=AS_OF)
    return found.select("table_name", "column_name", "completeness", "data_type")


@_query("batch_suggest", """
SELECT 'dq_orders' AS table_name, '.isComplete("o_orderkey")' AS constraint_rule, 'N' AS is_active
UNION ALL SELECT 'dq_orders', '.isComplete("o_orderstatus")', 'N' UNION ALL SELECT 'dq_orders', '.isComplete("o_totalprice")', 'Y'
UNION ALL SELECT 'dq_orders', '.isComplete("o_orderdate")', 'N'""")
def batch_suggest(spark, sf_dir):
    _register(spark, sf_dir)
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
    proposals = batch.constraint_rules(
        batch.suggest_constraints(source_frame(spark, db_name=BATCH_DB, table_name="dq_orders", columns=columns), max_categories=100),
        db_name=BATCH_DB, table_name="dq_orders", as_of=AS_OF)
    # the price rule was accepted earlier, the others are stale proposals to be replaced
    existing = proposals.withColumn(
        "is_active", F.when(F.col("constraint_rule") == '.isComplete("o_totalprice")', "Y").otherwise("N"))
    found = batch.suggest_for_tables(
        spark, existing, db_name=BATCH_DB, tables="dq_orders", columns=columns, as_of=AS_OF, max_categories=100)
    return found.filter(F.col("constraint_rule").contains("isComplete")).select("table_name", "constraint_rule", "is_active")


# --- file scans ------------------------------------------------------------------------------

@_query("scan_csv", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def scan_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    rows = table(spark, sf_dir, "orders").drop("o_orderdate")
    rows.write.option("header", True).csv(path)
    back = files.read_csv(spark, path)
    return back.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema.fields])


@_query("scan_csv_multiline", "SELECT doc_id, text, source FROM documents")
def scan_csv_multiline(spark, sf_dir):
    path = scratch_path(spark, "csv")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    plain = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.options(header=True, escape='"', quoteAll=True, **plain).csv(path)
    back = files.read_csv(spark, path, schema=rows.schema, multi_line=True)
    return back


@_query("scan_delimited", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def scan_delimited(spark, sf_dir):
    path = scratch_path(spark, "delimited")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").write.option("sep", "|").csv(path)
    schema = parse_schema("c_custkey number, c_name string, c_acctbal double")
    return files.read_delimited(spark, path, schema, header=False, delimiter="|")


@_query("scan_text", "SELECT url AS value FROM pages")
def scan_text(spark, sf_dir):
    path = scratch_path(spark, "text")
    table(spark, sf_dir, "pages").select("url").write.text(path)
    return files.require_rows(files.read_text(spark, path))


@_query("scan_documents", "SELECT CAST(page_id AS VARCHAR) AS id, url, length(html) AS html_chars FROM pages")
def scan_documents(spark, sf_dir):
    path = scratch_path(spark, "documents")
    table(spark, sf_dir, "pages").withColumnRenamed("page_id", "_id").write.json(path)
    docs = files.read_documents(spark, path, "_id bigint, url string, html string")
    return collection.project_documents(docs, ("url", "html")).select(
        "id", "url", F.length("html").cast("bigint").alias("html_chars"))


@_query("nan_to_null", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 40 THEN NULL ELSE l_quantity END AS quantity FROM lineitem")
def nan_to_null_query(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_quantity") > 40, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("quantity"))
    return nan_to_null(rows)


# --- records and documents -------------------------------------------------------------------

KEYED = """
SELECT concat('{{"P', CAST(c_custkey AS STRING), '":{{"name":"', c_name, '","bmi":', CAST(c_acctbal AS STRING),
              '}},"Q', CAST(c_custkey AS STRING), '":{{"name":"', c_mktsegment, '"}}}}') AS body FROM {customer}
"""


@_query("keyed_json", """
SELECT 'P' || CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_acctbal AS bmi FROM customer
UNION ALL SELECT 'Q' || CAST(c_custkey AS VARCHAR), c_mktsegment, NULL FROM customer""")
def keyed_json(spark, sf_dir):
    objects = view(spark, sf_dir, KEYED, "customer").select(
        F.from_json("body", "map<string,struct<name:string,bmi:double>>").alias("m"))
    return files.explode_keyed(objects, "m")


@_query("sort_field", f"""WITH d AS ({DIRTY_CUSTOMER_SQL}),
s AS (SELECT c_custkey, coalesce(c_acctbal, 0) AS k FROM d)
SELECT c_custkey, k FROM s ORDER BY k DESC""")
def sort_field(spark, sf_dir):
    ordered = collection.sort_by(dirty_customer(spark, sf_dir), "c_acctbal", "desc", allowed=("c_acctbal",))
    return ordered.select("c_custkey", F.coalesce("c_acctbal", F.lit(0.0)).alias("k"))


@_query("lookup_id", "SELECT * FROM part WHERE p_partkey = 7")
def lookup_id(spark, sf_dir):
    return collection.lookup(table(spark, sf_dir, "part"), 7, "p_partkey")


@_query("doc_flags", """
SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 10 = 0 THEN false ELSE event_type = 'click' END AS important FROM events""")
def doc_flags(spark, sf_dir):
    forms = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("_id"),
        F.when(F.col("event_id") % 10 == 0, F.lit(None)).when(F.col("event_type") == "click", "on").otherwise("off").alias("important"))
    return collection.project_documents(collection.normalise_flag(forms, "important"), ("important",))


# --- ingestion -----------------------------------------------------------------------------------

FEED_SCHEMA = "s_suppkey number, s_name string, s_nationkey int, s_acctbal string"
CLEANED_SQL = "CASE WHEN trim(s_acctbal) = '-' THEN NULL ELSE regexp_replace(trim(s_acctbal), '(#?N/A|#VALUE!)|[$, ]', '', 'g') END"
CONFORMED_KEY_SQL = "CASE WHEN s_nationkey = 'x' THEN NULL ELSE CAST(s_nationkey AS INTEGER) END"


@_query("ingest_conform", f"""WITH d AS ({SUPPLIER_FEED_SQL})
SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, {CONFORMED_KEY_SQL} AS s_nationkey, CAST(NULL AS DATE) AS opened, s_acctbal FROM d""")
def ingest_conform(spark, sf_dir):
    return conform(supplier_feed(spark, sf_dir), parse_schema("s_suppkey number, s_nationkey int, opened date, s_acctbal string"))


@_query("ingest_rename", f"WITH d AS ({SUPPLIER_FEED_SQL}) SELECT s_suppkey AS id, s_name AS label, s_nationkey, s_acctbal FROM d")
def ingest_rename(spark, sf_dir):
    return rename_by_position(supplier_feed(spark, sf_dir), parse_schema(FEED_SCHEMA), parse_schema("id number, label string"))


@_query("ingest_clean", f"WITH d AS ({SUPPLIER_FEED_SQL}) SELECT s_suppkey, {CLEANED_SQL} AS s_acctbal FROM d")
def ingest_clean(spark, sf_dir):
    return clean_columns(supplier_feed(spark, sf_dir), ["s_acctbal", ""]).select("s_suppkey", "s_acctbal")


@_query("ingest_mask", """
SELECT c_custkey, sha256(c_name) AS c_name, CASE WHEN c_mktsegment IS NOT NULL THEN '***' END AS c_mktsegment,
  regexp_replace(regexp_replace(regexp_replace(c_phone, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') AS c_phone,
  regexp_replace(c_digits, '[0-9]', '#', 'g') AS c_digits
FROM (SELECT *, c_name AS c_phone, c_name AS c_digits FROM customer) AS c""")
def ingest_mask(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_mktsegment", F.col("c_name").alias("c_phone"), F.col("c_name").alias("c_digits"))
    return mask_columns(rows, {
        "c_name": {"kind": "hash"}, "c_mktsegment": {"kind": "fixed"}, "c_phone": {"kind": "mask"},
        "c_digits": {"kind": "pattern", "pattern": "[0-9]", "value": "#"}})


@_query("ingest_skip_loaded", """
SELECT o_orderkey, 'file_' || CAST(o_custkey % 7 AS VARCHAR) AS file_name FROM orders WHERE o_custkey % 7 NOT IN (
  SELECT o_custkey % 7 FROM orders WHERE o_custkey % 7 < 3)""")
def ingest_skip_loaded(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("file_"), (F.col("o_custkey") % 7).cast("string")).alias("file_name"))
    loaded = rows.filter("file_name < 'file_3'")
    return only_new_files(rows, loaded, "file_name")


def _feed_conf(spark: SparkSession, sf_dir: str) -> dict:
    """The supplier feed as delimited files with a header, and the config to load them."""
    root = scratch_path(spark, "feed")
    supplier_feed(spark, sf_dir).repartition(4).write.option("sep", "|").option("header", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{root}/in")
    return {
        "type": "csv", "delimiter": "|", "include_header": "Y", "file_path": f"{root}/in", "schema": FEED_SCHEMA,
        "target_schema": "id number, label string, nation int, balance string", "columnsWithDollar": "balance",
        "dataMasking": "Y", "maskingRules": {"label": {"kind": "hash"}},
        "location": f"{root}/out", "checkpoint": f"{root}/checkpoint",
    }


INGESTED_SQL = f"""WITH d AS ({SUPPLIER_FEED_SQL})
SELECT CAST(s_suppkey AS BIGINT) AS id, sha256(s_name) AS label, {CONFORMED_KEY_SQL} AS nation, {CLEANED_SQL} AS balance FROM d"""


@_query("ingest_files", INGESTED_SQL)
def ingest_files(spark, sf_dir):
    conf = _feed_conf(spark, sf_dir)
    return shape(scan(spark, conf), conf, AS_OF).drop("file_name", "file_path", "incr_ingest_timestamp")


@_query("ingest_stream", INGESTED_SQL)
def ingest_stream_query(spark, sf_dir):
    conf = {**_feed_conf(spark, sf_dir), "include_header": "y"}
    for _ in range(2):  # the second run finds nothing new
        ingest_stream(spark, conf).awaitTermination()
    return spark.read.parquet(conf["location"]).drop("file_name", "file_path", "incr_ingest_timestamp")


@_query("ingest_stream_deletes", f"""WITH d AS ({SUPPLIER_FEED_SQL})
SELECT CAST(count(*) AS BIGINT) AS rows, true AS at_most_the_last_left FROM d""")
def ingest_stream_deletes(spark, sf_dir):
    """A stream told to delete its inputs: a file goes when the batch after its own is done."""
    conf = {**_feed_conf(spark, sf_dir), "include_header": "1", "filedel_ind": "yes", "max_files": 1}
    setting = "spark.sql.streaming.fileSource.cleaner.numThreads"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "0")  # delete within the stream's own batches
    try:
        ingest_stream(spark, conf).awaitTermination()
    finally:
        spark.conf.set(setting, before)
    left = files.list_files(spark, conf["file_path"]).agg(F.count("*")).scalar()
    return spark.read.parquet(conf["location"]).agg(F.count("*").alias("rows")).select("rows", (left <= 1).alias("at_most_the_last_left"))


# --- transforms and loads ----------------------------------------------------------------------

CHAIN = {
    "dq_priced": "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS revenue FROM dq_base_lineitem",
    "dq_by_customer": "SELECT o.o_custkey, p.revenue FROM dq_priced p JOIN dq_base_orders o ON p.l_orderkey = o.o_orderkey",
    FINAL_VIEW: "SELECT n.n_name, count(*) AS lines, round(sum(r.revenue), 2) AS revenue FROM dq_by_customer r "
                "JOIN dq_base_customer c ON r.o_custkey = c.c_custkey JOIN dq_base_nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
}


@_query("transform_chain", """
WITH priced AS (SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem),
by_customer AS (SELECT o_custkey, revenue FROM priced JOIN orders ON l_orderkey = o_orderkey)
SELECT n_name, count(*) AS lines, round(sum(revenue), 2) AS revenue FROM by_customer
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def transform_chain(spark, sf_dir):
    for name in ("lineitem", "orders", "customer", "nation"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"dq_base_{name}")
    return run_views(spark, CHAIN)[FINAL_VIEW]


DIAMOND = {
    "dq_totals": "SELECT o_custkey, count(*) AS orders, sum(o_totalprice) AS spent FROM dq_base_orders GROUP BY o_custkey",
    "dq_rich": "SELECT o_custkey, spent FROM dq_totals WHERE spent > 500000",
    "dq_busy": "SELECT o_custkey, orders FROM dq_totals WHERE orders >= 10",
    FINAL_VIEW: "SELECT c.c_custkey, r.spent IS NOT NULL AS rich, b.orders IS NOT NULL AS busy FROM dq_base_customer c "
                "LEFT JOIN dq_rich r ON r.o_custkey = c.c_custkey LEFT JOIN dq_busy b ON b.o_custkey = c.c_custkey",
}


@_query("transform_diamond", """
WITH t AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey)
SELECT c_custkey, coalesce(spent > 500000, false) AS rich, coalesce(n >= 10, false) AS busy FROM customer LEFT JOIN t ON o_custkey = c_custkey""")
def transform_diamond(spark, sf_dir):
    """A chain in which two views use a third one, which is stored once."""
    for name in ("orders", "customer"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"dq_base_{name}")
    return run_views(spark, DIAMOND)[FINAL_VIEW]


@_query("load_append", "SELECT s_suppkey, s_acctbal FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_acctbal FROM supplier WHERE s_acctbal < 0")
def load_append(spark, sf_dir):
    path = scratch_path(spark, "append")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    sinks.append_files(rows, path)
    sinks.append_files(rows.filter("s_acctbal < 0").withColumn("s_suppkey", F.col("s_suppkey") + 1000000), path)
    return spark.read.parquet(path)


# Changed orders: half-price for one status, plus new keys and rows without a key
CHANGES = """
SELECT o_orderkey, o_custkey, o_totalprice / 2 AS o_totalprice FROM {orders} WHERE o_orderstatus = 'P'
UNION ALL SELECT o_orderkey + 100000000, o_custkey, o_totalprice FROM {orders} WHERE o_totalprice > 450000
UNION ALL SELECT NULL, o_custkey, o_totalprice FROM {orders} WHERE o_totalprice < 2000
"""
CHANGES_SQL = CHANGES.replace("{orders}", "orders")


@_query("load_upsert", f"""WITH s AS ({CHANGES_SQL})
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s WHERE o_orderkey IS NOT NULL)
UNION ALL SELECT * FROM s""")
def load_upsert(spark, sf_dir):
    target = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    source = view(spark, sf_dir, CHANGES, "orders")
    sinks.require_unique_keys(source, ["o_orderkey"])
    return sinks.upserted(target, source, ["o_orderkey"])


@_query("replace_slice", """
SELECT o_orderkey, o_orderstatus, NULL AS note FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT o_orderkey + 1, 'P', 'reloaded' FROM orders WHERE o_orderstatus = 'P'""")
def replace_slice(spark, sf_dir):
    existing = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    new = existing.filter("o_orderstatus = 'P'").select(
        (F.col("o_orderkey") + 1).alias("o_orderkey"), "o_orderstatus", F.lit("reloaded").alias("note"))
    return sinks.replaced_slice(existing, new, F.col("o_orderstatus") == "P")
