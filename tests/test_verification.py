import math

import pytest

from verisift.functions.constraints import Assertion, ConstraintProblem, read_constraint
from verisift.operators.metrics import histogram, metric_changes, mutual_information, type_histogram
from verisift.operators.verification import (
    ConstraintRule, failures, metric_rows, notify_rollup, verify,
)

NOW = "2024-03-05 00:00:00"


@pytest.fixture(scope="module")
def battery(spark):
    return spark.createDataFrame(
        [(101, "BATT-001", "SupplierA"), (102, None, "SupplierB"), (103, "BATT-002", "SupplierA")],
        "id bigint, PART_NO string, SUPPLIER string")


def statuses(df, rules, **kw):
    frame = verify(df, [ConstraintRule(r, constraint_name=r) for r in rules],
                   db_name="db", table_name="t", as_of=NOW, **kw)
    return {(r["constraint_name"], r["constraint"]): r for r in frame.collect()}


def one(df, rule, **kw):
    (row,) = statuses(df, [rule], **kw).values()
    return row


def test_battery_rule(battery):
    row = one(battery, ".isComplete('PART_NO')")
    assert row["constraint_status"] == "Failure" and abs(row["metric_value"] - 2 / 3) < 1e-12
    assert row["constraint_message"].startswith("Value: 0.666")
    assert (row["check"], row["check_level"], row["check_status"]) == ("t_check", "Error", "Error")
    assert row["create_month_prtn"] == 202403
    assert one(battery, '.satisfies("PART_NO is not null","PART_NO is valid")')["constraint_status"] == "Failure"
    assert one(battery, ".isComplete('PART_NO')", where="id <> 102")["constraint_status"] == "Success"


@pytest.mark.parametrize("rule,value", [
    (".hasSize(lambda n: n == 3)", 3), ('.hasSize("== 3")', 3),
    (".hasCompleteness('PART_NO', lambda x: x > 0.6)", 2 / 3),
    (".areAnyComplete(['PART_NO', 'SUPPLIER'])", 1), (".haveCompleteness(['PART_NO', 'SUPPLIER'], '> 0.5')", 2 / 3),
    (".isUnique('PART_NO')", 1), (".hasUniqueness('SUPPLIER', lambda x: 0.3 < x < 0.4)", 1 / 3),
    (".isPrimaryKey('id', 'SUPPLIER')", 1),
    (".hasUniqueness(['SUPPLIER', 'PART_NO'], '== 1')", 1),
    (".hasDistinctness('SUPPLIER', lambda x: x > 0.6)", 2 / 3),
    (".hasUniqueValueRatio('SUPPLIER', '== 0.5')", 0.5),
    (".hasCountDistinct('SUPPLIER', '== 2')", 2), (".hasApproxCountDistinct('SUPPLIER', '== 2')", 2),
    (".hasMin('id', '>= 101')", 101), (".hasMax('id', '<= 103')", 103), (".hasMean('id', '== 102')", 102),
    (".hasSum('id', '== 306')", 306),
    (".hasStandardDeviation('id', '< 1')", math.sqrt(2 / 3)),
    (".hasMinLength('PART_NO', '== 8')", 8), (".hasMaxLength('SUPPLIER', '== 9')", 9),
    (".hasApproxQuantile('id', 0.5, '== 102')", 102),
    (".isNonNegative('id')", 1), (".isPositive('id')", 1),
    (".isInRange('id', 100, 200)", 1), (".isInRange('SUPPLIER', ['SupplierA', 'SupplierB'])", 1),
    (".isContainedIn('SUPPLIER', ['SupplierA'], lambda x: x >= 0.6, 'hint')", 2 / 3),
    (".isLessThanOrEqualTo('id', 'id')", 1), (".isGreaterThanOrEqualTo('id', 'id')", 1),
    (".satisfies('id > 101', 'name', lambda x: x > 0.5)", 2 / 3),
    (".satisfiesIf('id = 102', \"SUPPLIER = 'SupplierB'\")", 1),
    (".hasPattern('SUPPLIER', '^Supplier')", 1),
    (".hasConsistentType('SUPPLIER')", 1), (".hasTypeConsistency('PART_NO', '>= 1')", 1),
    (".hasDataType('id', ConstrainableDataTypes.Integral)", 1), (".hasDataType('SUPPLIER', 'String')", 1),
    (".hasEntropy('SUPPLIER', '< 0.7')", -(2 / 3) * math.log(2 / 3) - (1 / 3) * math.log(1 / 3)),
    (".hasMutualInformation('SUPPLIER', 'id', '> 0.6')", -(2 / 3) * math.log(2 / 3) - (1 / 3) * math.log(1 / 3)),
    (".hasHistogramValues('SUPPLIER', 'SupplierA', '> 0.6')", 2 / 3),
    (".hasCorrelation('id', 'id', '> 0.99')", 1),
])
def test_vocabulary(battery, rule, value):
    row = one(battery, rule)
    assert row["constraint_status"] == "Success", row
    assert abs(row["metric_value"] - value) < 1e-9


def test_chain_levels_and_errors(battery):
    rules = [
        ConstraintRule(".isComplete('id').isUnique('SUPPLIER')", constraint_name="a", check_level="warning"),
        ConstraintRule(".isComplete('nope')", constraint_name="b"),
        ConstraintRule(".__class__('x')", constraint_name="c"),
        ConstraintRule(".hasSize(lambda n: __import__('os').getpid() > 0)", constraint_name="d"),
        ConstraintRule("); import os", constraint_name="e"),
        ConstraintRule(".hasMean('SUPPLIER', '> 1')", constraint_name="f"),
    ]
    frame = verify(battery, rules, db_name="db", table_name="t", as_of=NOW)
    got = {(r["constraint_name"], r["constraint"]): r for r in frame.collect()}
    assert got[("a", "isComplete('id')")]["constraint_status"] == "Success"
    assert got[("a", "isUnique('SUPPLIER')")]["constraint_status"] == "Failure"
    assert {k[0] for k, r in got.items() if r["constraint_status"] == "Error"} == {"b", "c", "d", "e", "f"}
    assert failures(frame).count() == 6
    warned = verify(battery, rules[:1], db_name="db", table_name="t", as_of=NOW)
    assert {r["check_status"] for r in warned.collect()} == {"Warning"}


def test_reader_rejects_code():
    for text in (".f(open('x'))", ".f(lambda x: x.y > 1)", "x.f(1)", ".a", ".f(lambda: 1)", ".f(*[1])"):
        with pytest.raises(ConstraintProblem):
            read_constraint(text)
    with pytest.raises(ConstraintProblem):
        Assertion("in (1, 2)")(None)


def test_empty_table(battery):
    row = one(battery.limit(0), ".isComplete('PART_NO')")
    assert row["constraint_status"] == "Failure" and row["metric_value"] is None
    assert verify(battery, [], db_name="db", table_name="t").count() == 0


def test_mutual_information_against_brute_force(spark):
    rows = [(i % 3, (i * i) % 5) for i in range(60)] + [(None, 1), (2, None)]
    df = spark.createDataFrame(rows, "a int, b int")
    whole = [r for r in rows if None not in r]
    n = len(whole)
    expected = 0.0
    for a, b in set(whole):
        pab = whole.count((a, b)) / n
        pa = sum(r[0] == a for r in whole) / n
        pb = sum(r[1] == b for r in whole) / n
        expected += pab * math.log(pab / (pa * pb))
    assert abs(mutual_information(df, "a", "b").first()["value"] - expected) < 1e-9


def test_histograms(battery):
    bins = {r["value"]: (r["count"], r["ratio"]) for r in histogram(battery, "PART_NO").collect()}
    assert bins["NullValue"] == (1, 1 / 3) and len(bins) == 3
    assert {r["value_class"]: r["count"] for r in type_histogram(battery, "PART_NO").collect()} == {
        "String": 2, "Unknown": 1}


def test_metrics_and_history(spark, battery):
    rules = [ConstraintRule(r) for r in (".isComplete('PART_NO')", ".hasCompleteness('PART_NO', '> 0')", ".hasSize('> 0')")]
    first = metric_rows(battery, rules, db_name="db", table_name="t", as_of="2024-01-01")
    assert {(r["column_name"], r["metric"]): r["value"] for r in first.collect()} == {
        ("PART_NO", "Completeness"): 2 / 3, ("*", "Size"): 3.0}
    second = metric_rows(battery.unionByName(battery), rules, db_name="db", table_name="t", as_of="2024-02-01")
    changes = metric_changes(first.unionByName(second), max_increase=1.5, max_decrease=0.5)
    flagged = changes.filter("is_anomaly").collect()
    assert [(r["metric"], r["change_ratio"]) for r in flagged] == [("Size", 2.0)]


def test_notify_rollup(spark):
    failed = spark.createDataFrame([("db", "t1"), ("db", "t1"), ("db", "t2"), ("db", "t3")], "db_name string, table_name string")
    rules = spark.createDataFrame(
        [("DB", "T1", "Y", "ops"), ("db", "t1", "Y", "ops"), ("db", "t2", "Y", "ops"), ("db", "t3", "N", "ops")],
        "db_name string, table_name string, notify_capture string, notify_topic string")
    row = notify_rollup(failed, rules).collect()
    assert len(row) == 1 and row[0]["message"] == "db-t1\ndb-t1\ndb-t2" and row[0]["failures"] == 3
