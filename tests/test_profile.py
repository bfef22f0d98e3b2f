from datetime import datetime

from pyspark.sql import functions as F

from verisift.functions.rules import rule_list
from verisift.operators.checks import check
from verisift.operators.profile import column_stats, dataset_listing, profile, profile_document
from verisift.operators.report import summarise
from verisift.operators.suggest import (
    constraint_rules, import_rules, only_new, suggest, suggest_constraints,
)


def by_column(frame):
    return {r["column_name"]: r for r in frame.collect()}


def test_profile_of_employees(employees):
    rows = by_column(profile(employees))
    assert len(rows) == 11
    age = rows["age"]
    assert (age["min_value"], age["max_value"], age["mean_value"]) == ("-5", "200", 48.0)
    assert (age["null_count"], age["distinct_count"], age["uniqueness_ratio"]) == (0, 9, 90.0)
    emp = rows["employee_id"]
    assert (emp["null_count"], emp["null_percentage"], emp["distinct_count"]) == (1, 10.0, 8)
    assert (emp["min_length"], emp["max_length"], emp["avg_length"]) == (4, 4, 4.0)
    assert emp["top_values"][0].asDict() == {"value": "E003", "count": 2}
    assert rows["salary"]["top_values"] is None


def test_profile_edge_types(spark):
    df = spark.createDataFrame(
        [(0.0, True, [1, 2], {"a": 1}, datetime(2024, 1, 1)), (-0.0, None, [1, 2], {"a": 1}, None),
         (float("nan"), False, None, {"a": 2}, None), (float("nan"), False, [3], None, None)],
        "d double, b boolean, a array<int>, m map<string,int>, t timestamp")
    rows = by_column(profile(df))
    assert {k: v["distinct_count"] for k, v in rows.items()} == {"d": 2, "b": 2, "a": 2, "m": 2, "t": 1}
    approx = by_column(profile(df, exact=False))
    assert {k: v["distinct_count"] for k, v in approx.items()} == {"d": 2, "b": 2, "a": 2, "m": 2, "t": 1}


def test_profile_of_empty_table(employees):
    row = by_column(profile(employees.limit(0)))["age"]
    assert (row["row_count"], row["null_percentage"], row["uniqueness_ratio"], row["distinct_count"]) == (0, 0.0, 0.0, 0)


def test_zero_statistics_are_kept(spark):
    row = by_column(profile(spark.createDataFrame([(0, ""), (0, "")], "n int, s string")))
    assert (row["n"]["mean_value"], row["n"]["stddev"], row["s"]["avg_length"]) == (0.0, 0.0, 0.0)


def test_suggested_rules_on_employees(employees):
    rules = rule_list(suggest(profile(employees)))
    assert len(rules) == 28
    assert [r.rule_id for r in rules[:2]] == ["H_R001", "H_R002"]
    found = {(r.rule_type, r.column): r.params for r in rules}
    assert found[("range_check", "age")] == {"min_value": -25.5, "max_value": 220.5}
    assert found[("range_check", "salary")] == {"min_value": 62000.0, "max_value": 98000.0}
    results = check(employees, rules, dataset_id="d", run_id="r")
    bad = {r["rule_id"]: r for r in results.filter("status = 'failed'").collect()}
    assert set(bad) == {"H_R003", "H_R005"}
    assert bad["H_R005"]["rule_type"] == "length_check" and bad["H_R005"]["failed_records"] == 1
    summary = summarise(results, dataset_id="d", run_id="r").first()
    assert (summary["overall_score"], summary["overall_status"]) == (92.86, "failed")
    assert suggest(profile(employees), max_rules=3).count() == 3


def test_domain_of_twenty_values(spark):
    df = spark.range(400).selectExpr("concat('s', id % 20) as twenty", "concat('s', id % 21) as more")
    rules = {r.column: r for r in rule_list(suggest(profile(df))) if r.rule_type == "domain_check"}
    assert set(rules) == {"twenty"} and len(rules["twenty"].params["allowed_values"]) == 20


def test_unique_column_is_suggested(spark):
    rules = [r for r in rule_list(suggest(profile(spark.range(50)))) if r.rule_type == "uniqueness"]
    assert rules[0].severity == "critical"


def test_profile_document(employees):
    row = profile_document(employees, dataset_id="demo", source="inline").first()
    assert (row["row_count"], row["column_count"], len(row["column_profiles"]), len(row["sample"])) == (10, 11, 11, 5)
    listing = dataset_listing(profile_document(employees, dataset_id="demo", source="inline")).first()
    assert listing["dataset_id"] == "demo" and listing["row_count"] == 10


def test_value_classes(spark):
    df = spark.createDataFrame(
        [("1", "1.5", "true", "true", "x", None), ("-2", "3", "false", "1", "1", None)],
        "i string, f string, b string, mixed string, s string, u string")
    assert {k: v["data_type"] for k, v in by_column(column_stats(df)).items()} == {
        "i": "Integral", "f": "Fractional", "b": "Boolean", "mixed": "String", "s": "String", "u": "Unknown"}


def test_import_rules(spark):
    text = (
        '{"rules":[{"rule_type":"not_null","column":"a"},{"rule_type":"nonsense","column":"a"},'
        '{"rule_id":"X","rule_type":"range_check","column":"b","severity":"high","params":{"min_value":1}},'
        '{"rule_type":"not_null"},{"rule_type":"not_null","column":"c","severity":"odd"},'
        '{"rule_type":"not_null","column":"d"}]}'
    )
    df = spark.createDataFrame([("q", text)], "id string, response string")
    rules = rule_list(import_rules(df, "response", 5))
    assert [(r.rule_id, r.column, r.severity) for r in rules] == [("AI_R001", "a", "medium"), ("X", "b", "high")]
    assert rules[1].params == {"min_value": 1}


def test_constraint_suggestions(spark):
    df = spark.range(1000).selectExpr(
        "id", "cast(id as string) as digits", "concat('k', id % 3) as cat",
        "case when id % 10 = 0 then null else cast(id as double) - 500 end as partly")
    rows = suggest_constraints(df, max_categories=100)
    got = {(r["column_name"], r["constraint_rule"]) for r in rows.collect()}
    assert got == {
        ("id", '.isComplete("id")'), ("id", '.isNonNegative("id")'),
        ("digits", '.isComplete("digits")'), ("digits", '.hasDataType("digits", ConstrainableDataTypes.Integral)'),
        ("digits", '.isNonNegative("digits")'),
        ("cat", '.isComplete("cat")'), ("cat", '.isContainedIn("cat", ["k0", "k1", "k2"])'),
        ("partly", '.hasCompleteness("partly", lambda x: x >= 0.88)'),
    }
    new = constraint_rules(rows, db_name="db", table_name="t", as_of="2024-01-01")
    assert new.filter("is_active = 'N' and rule_type = 'verify'").count() == 8
    assert only_new(new, new.filter("column_name = 'id'")).count() == 6


def test_long_texts_with_equal_heads(spark):
    """Frequent values that differ only beyond the part that travels, ties among them, and a column of near-unique texts."""
    head = "h" * 40
    rows = [(head + str(k % 30), f"{head}{k:04d}", "x" * (30 + k % 5)) for k in range(300)] + [(head + "0", None, "")] * 3
    df = spark.createDataFrame(rows, "a string, b string, c string")
    got = by_column(profile(df))

    def top(values):
        counts = {}
        for v in values:
            if v is not None:
                counts[v] = counts.get(v, 0) + 1
        return sorted(counts.items(), key=lambda e: (-e[1], e[0]))[:10], len(counts)

    for k, name in enumerate("abc"):
        want, distinct = top([r[k] for r in rows])
        assert [(e["value"], e["count"]) for e in got[name]["top_values"]] == want
        assert got[name]["distinct_count"] == distinct
    assert got["c"]["domain_values"] == [v for v, _ in top([r[2] for r in rows])[0]]


def test_more_ties_than_a_broadcast_takes(spark, monkeypatch):
    from verisift.operators import profile as module
    monkeypatch.setattr(module, "BROADCAST_DIGESTS", 5)
    df = spark.range(100).selectExpr("concat(repeat('t', 40), lpad(cast(id as string), 3, '0')) as s")
    got = by_column(profile(df))["s"]
    assert [e["value"][-3:] for e in got["top_values"]] == [f"{k:03d}" for k in range(10)]
