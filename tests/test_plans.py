"""Shapes of physical plans that performance depends on."""

import contextlib
import io

from pyspark.sql import functions as F

from verisift.functions.rules import Rule
from verisift.operators.checks import check
from verisift.operators.profile import _nearest, column_stats, profile, value_digests
from verisift.operators.rejects import failing_rows, rejects
from verisift.operators.verification import ConstraintRule, verify


def plan_of(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


def lineitem(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


ROW_RULES = [
    *[Rule(f"N{i}", "not_null", "l_returnflag") for i in range(30)],
    *[Rule(f"R{i}", "range_check", "l_quantity", params={"min_value": i}) for i in range(30)],
    Rule("K", "completeness", "l_tax"), Rule("BAD", "not_null", "nope"),
    Rule("F", "freshness", "l_shipdate", params={"max_age_seconds": 1}),
]


def test_row_rules_share_one_scan_of_their_columns(spark, sf_dir):
    plan = plan_of(check(lineitem(spark, sf_dir), ROW_RULES, dataset_id="d", run_id="r", as_of="2024-01-01"))
    assert plan.count("FileScan") == 1
    assert "ReadSchema: struct<l_quantity:double,l_tax:double,l_returnflag:string,l_shipdate:timestamp_ntz>" in plan
    assert "Exchange hashpartitioning" not in plan


def test_conditions_are_generated_code(spark, sf_dir):
    rules = [r for r in ROW_RULES if r.rule_id[0] in "NR"]
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        rejects(lineitem(spark, sf_dir), rules, dataset_id="d", run_id="r", sample=None).explain("codegen")
    assert "Found 1 WholeStageCodegen" in text.getvalue()


def test_whole_rejects_of_row_rules_do_not_shuffle(spark, sf_dir):
    plan = plan_of(rejects(lineitem(spark, sf_dir), ROW_RULES[:3], dataset_id="d", run_id="r", sample=None))
    assert "Exchange" not in plan and "Window" not in plan


def test_sampled_rejects_count_on_keys_only(spark, sf_dir):
    plan = plan_of(rejects(lineitem(spark, sf_dir), ROW_RULES[30:33], dataset_id="d", run_id="r", sample=100, keys=["l_orderkey"]))
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_uniqueness_counts_are_combined_before_the_shuffle(spark, sf_dir):
    plan = plan_of(check(lineitem(spark, sf_dir), [Rule("U", "uniqueness", "l_returnflag")], dataset_id="d", run_id="r"))
    assert "partial_count" in plan and "ReadSchema: struct<l_returnflag:string>" in plan
    assert "Window" not in plan


def test_failing_row_filters_reach_the_scan(spark, sf_dir):
    rows = failing_rows(lineitem(spark, sf_dir), [Rule("R", "range_check", "l_quantity", params={"min_value": 5})])
    plan = plan_of(rows.select("l_orderkey"))
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
    assert "PushedFilters: [" in plan and "LessThan(l_quantity,5.0)" in plan


def test_constraints_share_one_scan(spark, sf_dir):
    rules = [ConstraintRule(r) for r in (
        ".isComplete('l_tax')", ".hasMin('l_quantity', '> 0')", ".hasSize('> 0')",
        ".hasCorrelation('l_tax', 'l_discount', '> -1')", ".isNonNegative('l_discount')")]
    assert plan_of(verify(lineitem(spark, sf_dir), rules, db_name="d", table_name="t")).count("FileScan") == 1


def test_profile_scans(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    assert plan_of(column_stats(df)).count("FileScan") == 1
    # the table is scanned by one aggregate and by one grouping of all columns (stored before)
    assert plan_of(profile(df)).count("l_shipdate") and plan_of(profile(df)).count("sf0.001/lineitem") == 1
    counts = value_digests(df, list(enumerate(df.schema.fields)))
    assert plan_of(counts).count("FileScan") == 1
    assert "Expand" in plan_of(counts)


def test_texts_of_a_profile_travel_as_digests(spark, sf_dir):
    """Whole texts are in no exchange, and both uses of the counts share one."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = value_digests(df, [(1, df.schema["text"])])
    exchanges = [line for line in plan_of(counts).splitlines() if "Exchange" in line]
    assert len(exchanges) == 1 and all(c in exchanges[0] for c in ("k1", "k2", "head")) and "text" not in exchanges[0]
    both = counts.groupBy("position").agg(F.sum("n").alias("n")).select("n").union(_nearest(counts, 20).select("n"))
    both.collect()
    final = both._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in final


def test_rows_of_values_do_not_depend_on_the_salts(spark, sf_dir):
    from verisift.operators.checks import value_counts
    from verisift.operators.skew import rows_with_values
    df = lineitem(spark, sf_dir)
    counts = value_counts(df, ["l_partkey"]).filter(F.col("__n") > 1)
    sizes = {rows_with_values(df, ["l_partkey"], counts, salts=s).count() for s in (1, 7, 16)}
    assert len(sizes) == 1


def test_one_value_in_half_of_the_rows_is_spread(spark):
    from verisift.operators.checks import value_counts
    from verisift.operators.skew import rows_with_values
    df = spark.range(0, 40_000, 1, 8).selectExpr("CASE WHEN id % 2 = 0 THEN -1 ELSE id END AS k", "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = rows_with_values(df, ["k"], value_counts(df, ["k"]).filter("__n > 1"))
        sizes = [r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == 20_000 and max(sizes) < 10_000


def test_rows_without_failures_are_filtered_before_anything_else(spark, sf_dir):
    from verisift.functions.rules import Rule
    from verisift.operators.rejects import rejects
    rules = [Rule("R1", "range_check", "l_quantity", params={"min_value": -1}), Rule("R2", "range_check", "l_tax", params={"max_value": 9})]
    plan = rejects(lineitem(spark, sf_dir), rules, dataset_id="d", run_id="r")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Filter") > plan.index("Generate")
    assert rejects(lineitem(spark, sf_dir), rules, dataset_id="d", run_id="r").count() == 0


def test_sql_rules_are_counted_without_a_range(spark, sf_dir):
    from verisift.functions.rules import Rule
    from verisift.operators.checks import check
    rules = [Rule(f"R{k}", "custom_sql", "l_tax", params={"sql_expression": f"SELECT * FROM {{table}} WHERE l_quantity < {k}"}) for k in (3, 9)]
    df = check(lineitem(spark, sf_dir), rules, dataset_id="d", run_id="r", isolate_sql=True)
    assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
    want = [lineitem(spark, sf_dir).filter(f"l_quantity < {k}").count() for k in (3, 9)]
    assert [r["failed_records"] for r in df.orderBy("rule_order").collect()] == want
