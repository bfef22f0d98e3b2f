import pytest
from pyspark.sql import functions as F

from verisift.functions.rules import Rule, rule_list, rules_frame
from verisift.operators.checks import check
from verisift.operators.rejects import audit_trail, failing_rows, rejects
from verisift.operators.report import (
    alert_history, alert_payload, anomaly_counts, column_health, report_document, summarise, verdict,
)

FIVE = [
    Rule("C1", "not_null", "employee_id", "critical"),
    Rule("C2", "range_check", "age", "high", params={"min_value": 18, "max_value": 100}),
    Rule("C3", "domain_check", "department", "high", params={
        "allowed_values": ["Engineering", "Marketing", "Sales", "HR"]}),
    Rule("C4", "conditional", "role", "medium", params={
        "condition_column": "department", "condition_operator": "equals",
        "condition_value": "Engineering", "then_rule_type": "domain_check",
        "then_params": {"allowed_values": ["Engineer", "Senior Engineer", "Tech Lead"]}}),
    Rule("C5", "regex_check", "email", "medium", params={"pattern": r"^[\w.]+@[\w.]+\.\w+$"}),
]


def run(df, rules, **kw):
    kw.setdefault("dataset_id", "demo")
    kw.setdefault("run_id", "RPT_1")
    return {r["rule_id"]: r for r in check(df, rules, **kw).collect()}


def failed(df, rule_type, column, **params):
    kw = {k: params.pop(k) for k in ("refs", "as_of") if k in params}
    return run(df, [Rule("R", rule_type, column, params=params)], **kw)["R"]


def test_five_rules_on_employees(employees):
    results = run(employees, FIVE)
    assert {k: v["failed_records"] for k, v in results.items()} == {"C1": 1, "C2": 2, "C3": 1, "C4": 0, "C5": 1}
    assert {k: v["status"] for k, v in results.items()} == {
        "C1": "failed", "C2": "failed", "C3": "failed", "C4": "passed", "C5": "failed"}
    assert results["C2"]["pass_percentage"] == 80.0
    frame = check(employees, FIVE, dataset_id="demo", run_id="RPT_1")
    summary = summarise(frame, dataset_id="demo", run_id="RPT_1").first()
    assert (summary["overall_score"], summary["overall_status"], summary["total_rules"]) == (20.0, "failed", 5)
    found = rejects(employees, FIVE, dataset_id="demo", run_id="RPT_1", as_of="2024-01-01 00:00:00")
    assert found.count() == 5


def test_passed_plus_failed_is_total(employees):
    for row in run(employees, FIVE).values():
        assert row["passed_records"] + row["failed_records"] == row["total_records"] == 10


def test_uniqueness_counts_every_member_and_groups_nulls(spark, employees):
    assert failed(employees, "uniqueness", "employee_id")["failed_records"] == 2
    df = spark.createDataFrame([(None,), (None,), ("a",), ("b",), ("b",)], "c string")
    assert failed(df, "uniqueness", "c")["failed_records"] == 4
    rows = failing_rows(df, [Rule("R", "uniqueness", "c")])
    assert sorted(str(r["c"]) for r in rows.collect()) == ["None", "None", "b", "b"]


def test_uniqueness_rows_of_hot_values(spark):
    from verisift.operators.checks import value_counts
    from verisift.operators.skew import rows_with_values
    df = spark.createDataFrame([(None, 1)] * 5 + [("x", 2)] * 3 + [("y", 3)] * 2 + [("z", 4)], "c string, v int")
    counts = value_counts(df, ["c"]).filter("__n > 1")
    for salts in (1, 3, 16):
        assert rows_with_values(df, ["c"], counts, salts=salts).count() == 10


def test_not_null_blank_nan_and_types(spark):
    df = spark.createDataFrame(
        [(None, float("nan"), [1]), ("  ", 1.0, [2]), ("a", None, None)], "s string, d double, a array<int>")
    assert failed(df, "not_null", "s")["failed_records"] == 2
    assert failed(df, "not_null", "d")["failed_records"] == 1
    assert failed(df, "not_null", "a")["status"] == "error"


def test_length_null_passes(spark):
    df = spark.createDataFrame([(None, 1), ("abc", 12345), ("", 7)], "s string, n int")
    assert failed(df, "length_check", "s", min_length=1, max_length=2)["failed_records"] == 2
    assert failed(df, "length_check", "n", max_length=4)["failed_records"] == 1
    assert failed(df, "length_check", "s")["failed_records"] == 0


def test_range_edges(spark):
    df = spark.createDataFrame([(1.0, "5"), (10.0, "x"), (None, None), (float("nan"), "11")], "d double, s string")
    assert failed(df, "range_check", "d", min_value=1, max_value=10)["failed_records"] == 1  # NaN sorts last
    assert failed(df, "range_check", "d")["failed_records"] == 0
    assert failed(df, "range_check", "s", max_value=10)["failed_records"] == 1  # text that is no number passes
    assert failed(df, "range_check", "d", min_value="abc")["failed_records"] == 0


def test_domain_edges(spark):
    df = spark.createDataFrame([("a", 5), ("A", 6), (None, None)], "s string, n int")
    assert failed(df, "domain_check", "s", allowed_values=["a"])["failed_records"] == 1
    assert failed(df, "domain_check", "s", allowed_values=["a", None])["failed_records"] == 1
    assert failed(df, "domain_check", "s", allowed_values=[])["failed_records"] == 0
    assert failed(df, "domain_check", "s", allowed_values=[5])["failed_records"] == 2
    assert failed(df, "domain_check", "n", allowed_values=["5", "q"])["failed_records"] == 1


def test_regex_is_a_search_and_bad_pattern_is_isolated(spark):
    df = spark.createDataFrame([("xxabc",), ("q",), (None,)], "s string")
    assert failed(df, "regex_check", "s", pattern="abc")["failed_records"] == 1
    results = run(df, [Rule("bad", "regex_check", "s", params={"pattern": "(("}),
                       Rule("good", "not_null", "s")])
    assert results["bad"]["status"] == "error" and results["bad"]["total_records"] == 3
    assert results["bad"]["passed_records"] == 0 and results["bad"]["pass_percentage"] == 0.0
    assert results["bad"]["description"].startswith("Execution error: ")
    assert results["good"]["failed_records"] == 1


def test_data_type(spark):
    df = spark.createDataFrame([("1",), ("1.5",), ("x",), (None,), ("2020-01-02",)], "s string")
    assert failed(df, "data_type", "s", expected_type="integer")["failed_records"] == 3
    assert failed(df, "data_type", "s", expected_type="double")["failed_records"] == 2
    assert failed(df, "data_type", "s", expected_type="date")["failed_records"] == 3
    assert failed(df, "data_type", "s", expected_type="anything")["failed_records"] == 0


@pytest.mark.parametrize("operator,value,expected", [
    ("equals", "a", 1), ("not_equals", "a", 1), ("in", ["a", "b"], 2), ("in", "b", 1),
    ("unheard_of", "a", 1),
])
def test_conditional_operators(spark, operator, value, expected):
    df = spark.createDataFrame([("a", None), ("b", None), ("a", "x"), (None, None)], "k string, v string")
    got = failed(df, "conditional", "v", condition_column="k", condition_operator=operator,
                 condition_value=value, then_rule_type="not_null")
    assert got["failed_records"] == expected
    assert got["total_records"] == 4


def test_conditional_comparisons_and_incomplete(spark):
    df = spark.createDataFrame([(0, None), (5, None), (9, "x")], "k int, v string")
    base = {"condition_column": "k", "then_rule_type": "not_null"}
    assert failed(df, "conditional", "v", condition_operator="greater_than", condition_value=1, **base)["failed_records"] == 1
    assert failed(df, "conditional", "v", condition_operator="less_than", condition_value=6, **base)["failed_records"] == 2
    assert failed(df, "conditional", "v", condition_value=0, **base)["failed_records"] == 1  # 0 is a value
    assert failed(df, "conditional", "v", condition_column="k", condition_value=5)["failed_records"] == 0
    unknown = {**base, "then_rule_type": "nonsense"}
    assert failed(df, "conditional", "v", condition_value=5, **unknown)["status"] == "error"
    other = {**base, "then_rule_type": "uniqueness"}
    assert failed(df, "conditional", "v", condition_value=5, **other)["failed_records"] == 0


def test_custom_sql(spark):
    df = spark.range(10).toDF("n")
    rules = [
        Rule("S-1", "custom_sql", "n", params={"sql_expression": "select * from {table} where n > 6"}),
        Rule("S-2", "custom_sql", "n", params={"sql_expression": "select a.n from {table} a join {table} b on a.n < b.n"}),
        Rule("S-3", "custom_sql", "n", params={"sql_expression": ""}),
        Rule("S-4", "custom_sql", "n", params={"sql_expression": "select nope from {table}"}),
        Rule("S-5", "custom_sql", "n", params={"sql_expression": "select cast('x' as int) y from {table}"}),
    ]
    results = run(df, rules, isolate_sql=True)
    assert results["S-1"]["failed_records"] == 3
    assert results["S-2"]["failed_records"] == 45 and results["S-2"]["passed_records"] == 0
    assert results["S-3"]["status"] == "passed"
    assert results["S-4"]["status"] == "error"
    assert results["S-5"]["failed_records"] == 10  # the count never evaluates the cast
    assert run(df, rules[:2])["S-1"]["failed_records"] == 3


def test_referential_completeness_freshness(spark):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-03"), (2, None), (None, None)], "k int, d string")
    df = df.withColumn("d", F.to_timestamp("d"))
    ref = spark.createDataFrame([(1,), (None,), (1,)], "id int")
    got = failed(df, "referential", "k", reference="r", reference_column="id", refs={"r": ref})
    assert (got["failed_records"], got["total_records"]) == (2, 4)
    assert failed(df, "referential", "k", reference="none")["status"] == "error"
    rule = Rule("R", "referential", "k", params={"reference": "r", "reference_column": "id"})
    assert failing_rows(df, [rule], refs={"r": ref}).count() == 2
    got = failed(df, "completeness", "d", min_ratio=0.5)
    assert (got["status"], got["failed_records"]) == ("passed", 2)
    assert failed(df, "completeness", "d", min_ratio=0.6)["status"] == "failed"
    assert failing_rows(df, [Rule("R", "completeness", "d", params={"min_ratio": 0.5})]).count() == 0
    assert failing_rows(df, [Rule("R", "completeness", "d", params={"min_ratio": 0.6})]).count() == 2
    assert failed(df, "freshness", "d", max_age_seconds=86400, as_of="2024-01-03 12:00:00")["status"] == "passed"
    assert failed(df, "freshness", "d", max_age_seconds=86400, as_of="2024-01-05")["status"] == "failed"


def test_empty_table_and_no_rules(spark, employees):
    empty = employees.limit(0)
    for row in run(empty, FIVE + [Rule("U", "uniqueness", "age")]).values():
        assert (row["status"], row["pass_percentage"], row["total_records"]) == ("passed", 100.0, 0)
    none = check(employees, [], dataset_id="d", run_id="r")
    assert none.count() == 0
    summary = summarise(none, dataset_id="d", run_id="r").first()
    assert (summary["overall_score"], summary["overall_status"]) == (0.0, "failed")


def test_inactive_rules_do_not_run(employees):
    assert run(employees, [Rule("X", "not_null", "age", active=False), FIVE[0]]).keys() == {"C1"}


def test_status_uses_exact_counts(spark):
    df = spark.range(60000).selectExpr("case when id < 2 then null else id end as n")
    row = failed(df, "not_null", "n")
    assert (row["pass_percentage"], row["status"]) == (100.0, "warning")


def test_fail_threshold_zero_is_honoured(spark):
    df = spark.createDataFrame([(None,)], "c string")
    frame = check(df, [Rule("R", "not_null", "c", "low")], dataset_id="d", run_id="r")
    assert summarise(frame, dataset_id="d", run_id="r").first()["overall_status"] == "failed"
    assert summarise(frame, dataset_id="d", run_id="r", fail_threshold=0).first()["overall_status"] == "passed"


def test_fused_counts_equal_single_counts(employees):
    rules = FIVE + [Rule(f"L{i}", "length_check", "first_name", params={"min_length": i}) for i in range(250)]
    together = {k: v["failed_records"] for k, v in run(employees, rules).items()}
    for rule in rules[:5] + rules[5::60]:
        assert run(employees, [rule])[rule.rule_id]["failed_records"] == together[rule.rule_id]
    assert len(together) == 255


def test_rules_round_trip_as_table(spark):
    assert rule_list(rules_frame(spark, FIVE)) == FIVE


@pytest.mark.parametrize("keys", [None, ["id"], ["grp"]])
def test_rejects_capped_and_whole(spark, keys):
    df = spark.range(5000).selectExpr("id", "id % 7 as grp", "cast(null as string) as c", "if(id < 30, -1, 1) as v")
    rules = [Rule("A", "not_null", "c"), Rule("B", "range_check", "v", params={"min_value": 0}),
             Rule("U", "uniqueness", "grp"), Rule("S", "custom_sql", "id", params={
                 "sql_expression": "select id from {table} where id >= 10"})]
    common = {"dataset_id": "d", "run_id": "r", "keys": keys}
    capped = {r["rule_id"]: r["count"] for r in rejects(df, rules, sample=100, **common).groupBy("rule_id").count().collect()}
    assert capped == {"A": 100, "B": 30, "U": 100, "S": 100}
    whole = rejects(df, rules, **common)
    assert {r["rule_id"]: r["count"] for r in whole.groupBy("rule_id").count().collect()} == {
        "A": 5000, "B": 30, "U": 5000, "S": 4990}
    if keys == ["id"]:
        found = rejects(df, rules, sample=100, **common).filter("rule_id = 'A'").collect()
        order = df.select("id", F.shiftrightunsigned(F.xxhash64("id"), 1).alias("h")).orderBy("h", "id")
        assert {r["row_key"] for r in found} == {str(r["id"]) for r in order.limit(100).collect()}


def test_sample_bounds_are_tight_and_sufficient(spark):
    from verisift.operators.skew import order_hash, sample_bounds, slice_of
    rows = spark.range(50000).select((F.col("id") % 2).alias("g"), order_hash("id").alias("h"))
    rows = rows.withColumn("s", slice_of(F.col("h")))
    assert rows.agg(F.min("s"), F.max("s")).first()[:] == (0, 4095)
    bounds = sample_bounds(rows, "g", "s", 100)
    kept = rows.join(bounds, "g").filter("s <= __bound").groupBy("g").count().collect()
    assert len(kept) == 2 and all(100 <= r["count"] < 150 for r in kept)
    few = sample_bounds(rows.limit(10), "g", "s", 100)
    assert rows.limit(10).join(few, "g").filter("s <= __bound").count() == 10


def test_rejects_are_repeatable(spark, employees):
    once = rejects(employees, FIVE, dataset_id="d", run_id="r", as_of="2024-01-01 00:00:00")
    again = rejects(employees.repartition(5), FIVE, dataset_id="d", run_id="r", as_of="2024-01-01 00:00:00")
    stable = [c for c in once.columns if c != "anomaly_id"] + ["substring_index(anomaly_id, '-', 1) AS digest"]
    assert sorted(once.selectExpr(*stable).collect()) == sorted(again.selectExpr(*stable).collect())
    twice = rejects(employees.union(employees), FIVE, dataset_id="d", run_id="r")
    assert twice.select("anomaly_id").distinct().count() == twice.count() == 2 * once.count()


def test_reports(spark, employees):
    results = check(employees, FIVE, dataset_id="demo", run_id="RPT_1")
    found = rejects(employees, FIVE, dataset_id="demo", run_id="RPT_1", as_of="2024-01-01 00:00:00")
    summary = summarise(results, dataset_id="demo", run_id="RPT_1")
    health = {r["column"]: r for r in column_health(results).collect()}
    assert health["role"]["health"] == "HEALTHY" and health["age"]["health"] == "UNHEALTHY"
    assert health["age"]["checks"][0]["rule_id"] == "C2"
    assert {r["severity"]: r["anomalies"] for r in anomaly_counts(results, "severity").collect()} == {
        "critical": 1, "high": 3, "medium": 1}
    assert verdict(summary).first()["verdict"] == "DATA QUALITY FAILED"
    payload = alert_payload(summary, results, as_of="2024-01-01 00:00:00")
    row = payload.first()
    assert row["anomaly_count"] == 5 and len(row["failure_details"]) == 4
    assert row["failure_details"][0] == "  - [HIGH] C2: 'age' range_check -> 80.0% pass (2 failures)"
    history = alert_history(payload, failures={"sns": "no route"})
    assert {(r["channel"], r["status"]) for r in history.collect()} == {
        ("email", "sent"), ("sns", "failed"), ("log", "sent")}
    trail = audit_trail(found, "RPT_1", first=2).collect()
    assert len(trail) == 2 and trail[0]["total_anomalies"] == 5
    document = report_document(summary, results).first()
    assert document["total_anomalies"] == 5 and set(document["column_summary"]) == {
        "employee_id", "age", "department", "role", "email"}


@pytest.mark.parametrize("target", ["int", "bigint", "double", "date", "timestamp"])
def test_reading_text_agrees_with_try_cast(spark, target):
    from pyspark.sql import types as T
    from verisift.functions.expressions import read_as
    texts = ["1", " 12 ", "\t-3\n", "+4", "1.5", ".5", "5.", "1e3", "1E-2", "1d", "2f", "NaN", "nan", "Infinity", "-inf",
             "+Infinity", "0x1p3", "", "  ", "x", "n/a", "99999999999", "99999999999999999999", "2020-01-02", " 2020-1-2 ",
             "2020", "2020-13-01", "2020-01-02 03:04:05", "2020-01-02T03:04:05.123Z", "T12:30", "12:30:00", "-0001-01-01",
             "+12345-01-01", "today", "epoch", "1,000", "\u0001 7 \u007f", " 7", "--1", "1 2", "true"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    both = df.select("s", F.col("s").try_cast(target).alias("a"), read_as(F.col("s"), T.StringType(), target).alias("b"))
    wrong = both.filter("not (cast(a as string) <=> cast(b as string))").collect()
    assert wrong == []
