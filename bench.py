"""Headline timings.  Prints one JSON line.

``value`` is the sum over the headline queries.  Entries under ``compare`` run the same work
in the one-job-per-check manner (count, then a count and a sample per rule; three jobs per
profiled column) and are not part of the sum.  Every query runs twice and the faster run
counts, so that class loading and code generation of the first run are left out.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from verisift.functions.predicates import ROW_RULES  # noqa: E402
from verisift.functions.rules import Rule  # noqa: E402
from verisift.operators.checks import check  # noqa: E402
from verisift.operators.profile import profile  # noqa: E402
from verisift.operators.rejects import failing_rows, rejects  # noqa: E402
from verisift.operators.suggest import suggest, suggest_constraints  # noqa: E402
from verisift.operators.verification import ConstraintRule, verify  # noqa: E402
from verisift.plans.ingest import scan, shape  # noqa: E402
from verisift.plans.transform import FINAL_VIEW, run_views  # noqa: E402
from verisift.queries.loading import CHAIN  # noqa: E402
from verisift.sources.sinks import upserted  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
FILES = 50
DATASET = {"dataset_id": "lineitem", "run_id": "RPT_BENCH", "as_of": "2024-03-05 00:00:00"}

TWENTY_RULES = [
    *[Rule(f"N{i}", "not_null", c) for i, c in enumerate(("l_orderkey", "l_partkey", "l_returnflag", "l_shipdate"))],
    *[Rule(f"R{i}", "range_check", c, params=p) for i, (c, p) in enumerate((
        ("l_quantity", {"min_value": 5, "max_value": 45}), ("l_extendedprice", {"min_value": 1000}),
        ("l_discount", {"max_value": 0.08}), ("l_tax", {"max_value": 0.06}),
        ("l_linenumber", {"max_value": 6}), ("l_suppkey", {"min_value": 1})))],
    *[Rule(f"D{i}", "domain_check", c, params={"allowed_values": v}) for i, (c, v) in enumerate((
        ("l_returnflag", ["A", "R"]), ("l_linestatus", ["O"]), ("l_linenumber", [1, 2, 3, 4, 5])))],
    *[Rule(f"X{i}", "regex_check", c, params={"pattern": p}) for i, (c, p) in enumerate((
        ("l_returnflag", "^[AR]"), ("l_linestatus", "F|O")))],
    *[Rule(f"L{i}", "length_check", c, params=p) for i, (c, p) in enumerate((
        ("l_returnflag", {"max_length": 1}), ("l_partkey", {"min_length": 3})))],
    Rule("T0", "data_type", "l_returnflag", params={"expected_type": "integer"}),
    *[Rule(f"C{i}", "conditional", "l_linestatus", params={
        "condition_column": "l_returnflag", "condition_value": v, "then_rule_type": "domain_check",
        "then_params": {"allowed_values": ["F"]}}) for i, v in enumerate(("A", "R"))],
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-shared-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def table(name):
        return spark.read.parquet(f"{SF_DIR}/{name}.parquet")

    for name in ("lineitem", "orders", "customer", "nation"):
        table(name).createOrReplaceTempView(f"dq_base_{name}")
    lineitem, orders, documents = table("lineitem"), table("orders"), table("documents")
    feed = tempfile.mkdtemp(prefix="bench-feed-")
    orders.drop("o_orderdate").repartition(FILES).write.option("header", True).mode("overwrite").csv(feed)
    conf = {
        "type": "csv", "include_header": "Y", "file_path": feed,
        "schema": "o_orderkey number, o_custkey number, o_orderstatus string, o_totalprice string, o_orderpriority string",
        "target_schema": "id number, customer number, status string, price string, priority string",
        "columnsWithDollar": "price",
    }
    changes = orders.filter("o_orderstatus = 'P'").withColumn("o_totalprice", F.col("o_totalprice") / 2)
    changes = changes.unionByName(orders.filter("o_totalprice > 450000").withColumn("o_orderkey", F.col("o_orderkey") + 10**9))
    constraints = [ConstraintRule(r, constraint_name=r) for r in (
        ".isComplete('l_orderkey')", ".hasSize('> 0')", ".hasMean('l_quantity', '> 1')",
        ".isNonNegative('l_tax')", ".isContainedIn('l_returnflag', ['A', 'N', 'R'])",
        ".hasUniqueness(['l_orderkey', 'l_linenumber'], '> 0')", ".hasEntropy('l_returnflag', '> 0')",
        ".hasMutualInformation('l_returnflag', 'l_linestatus', '>= 0')", ".hasCorrelation('l_quantity', 'l_extendedprice', '> 0')",
        ".satisfies('l_discount <= 0.1', 'cap')")]
    keys = ["l_orderkey", "l_linenumber"]
    pair = Rule("U", "uniqueness", "l_orderkey", params={"columns": keys})
    orphans = Rule("F", "referential", "l_orderkey", params={"reference": "o", "reference_column": "o_orderkey"})

    headline = {
        "validate_20_rules": lambda: run(check(lineitem, TWENTY_RULES, **DATASET)),
        "uniqueness_count": lambda: run(check(lineitem, [pair], **DATASET)),
        "uniqueness_rows": lambda: run(failing_rows(lineitem, [pair])),
        "referential_count": lambda: run(check(lineitem, [orphans], refs={"o": orders}, **DATASET)),
        "rejects_sample_20_rules": lambda: run(rejects(lineitem, TWENTY_RULES, keys=keys, sample=100, **DATASET)),
        "rejects_all_20_rules": lambda: run(rejects(lineitem, TWENTY_RULES, keys=keys, **DATASET)),
        "profile_lineitem": lambda: run(profile(lineitem)),
        "profile_documents": lambda: run(profile(documents)),
        "suggest_rules": lambda: run(suggest(profile(orders))),
        "suggest_constraints": lambda: run(suggest_constraints(orders, max_categories=100)),
        "verify_10_constraints": lambda: run(verify(lineitem, constraints, db_name="db", table_name="lineitem")),
        "ingest_50_files": lambda: run(shape(scan(spark, conf), conf, DATASET["as_of"])),
        "upsert_orders": lambda: run(upserted(orders, changes, ["o_orderkey"])),
        "transform_chain": lambda: run(run_views(spark, CHAIN)[FINAL_VIEW]),
    }

    def one_job_per_rule() -> None:
        lineitem.count()
        for rule in TWENTY_RULES:
            failing = lineitem.filter(ROW_RULES[rule.rule_type](lineitem.schema, rule.column, rule.params))
            if failing.count():
                failing.limit(100).collect()

    def jobs_per_column() -> None:
        lineitem.count()
        for field in lineitem.schema.fields:
            col = F.col(field.name)
            lineitem.agg(F.count(col), F.sum(F.when(col.isNull(), 1).otherwise(0)), F.count_distinct(col)).collect()
            if field.dataType.simpleString() == "string":
                lineitem.agg(F.min(F.length(col)), F.max(F.length(col)), F.avg(F.length(col))).collect()
                lineitem.filter(col.isNotNull()).groupBy(col).count().orderBy(F.desc("count")).limit(10).collect()
            elif field.dataType.typeName() != "timestamp_ntz":
                lineitem.agg(F.min(col), F.max(col), F.avg(col), F.stddev(col)).collect()

    compare = {"validate_one_job_per_rule": one_job_per_rule, "profile_jobs_per_column": jobs_per_column}

    def seconds(job) -> float:
        best = float("inf")
        for _ in range(RUNS):
            start = time.perf_counter()
            job()
            best = min(best, time.perf_counter() - start)
        return round(best, 3)

    queries = {name: seconds(job) for name, job in headline.items()}
    compared = {name: seconds(job) for name, job in compare.items()}
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(queries.values()), 3), "unit": "sec",
        "queries": queries, "compare": compared, "sf": os.path.basename(SF_DIR.rstrip("/")), "cpus": int(CPUS),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
