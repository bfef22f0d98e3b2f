"""Detectors over metric histories, and the columns that rules name."""

import datetime
import statistics

import pytest
from pyspark.sql import functions as F

from verisift.functions.constraints import ConstraintProblem
from verisift.operators import anomalies
from verisift.operators.verification import ConstraintRule, metric_rows, named_columns, verify

SCHEMA = "db_name string, table_name string, column_name string, metric string, value double, audit_create_date timestamp"


@pytest.fixture(scope="module")
def history(spark):
    day = datetime.datetime(2024, 1, 1)
    values = [10, 12, 11, 13, 50, 12, 11, None, 12, 10, -4, 11]
    rows = [("DB", "T", "*", "Size", None if v is None else float(v), day + datetime.timedelta(days=k)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows + [("DB", "other", "*", "Size", 900.0, day)], SCHEMA)


def points(found):
    return {r["audit_create_date"].day: r for r in found.where("table_name = 'T'").collect()}


def test_median_deviation_by_hand(history):
    got = points(anomalies.metric_anomalies(history, anomalies.median_deviation(days=5, factor=4, floor=0.5)))
    rows = [(d, r["value"]) for d, r in sorted(got.items())]
    for day, value in rows:
        past = [v for d, v in rows if day - 5 <= d < day and v is not None]
        if len(past) < 3:
            assert got[day]["lower"] is None and not got[day]["is_anomaly"]
            continue
        middle = statistics.median(past)
        spread = 4 * max(statistics.median(abs(v - middle) for v in past), 0.5)
        assert (got[day]["lower"], got[day]["upper"]) == (middle - spread, middle + spread)
        assert got[day]["is_anomaly"] == (value is not None and not middle - spread <= value <= middle + spread)
    assert got[5]["is_anomaly"] and got[11]["is_anomaly"]


def test_changes_and_thresholds(history):
    relative = points(anomalies.metric_anomalies(history, anomalies.relative_change(max_increase=2, max_decrease=0.5)))
    assert sorted(d for d, r in relative.items() if r["is_anomaly"]) == [5, 6, 11, 12]  # 11 is far from -4, too
    season = points(anomalies.metric_anomalies(history, anomalies.relative_change(max_increase=1.1, lag=3)))
    assert season[4]["upper"] == pytest.approx(11) and season[1]["upper"] is None
    absolute = points(anomalies.metric_anomalies(history, anomalies.absolute_change(max_increase=5, max_decrease=1)))
    assert sorted(d for d, r in absolute.items() if r["is_anomaly"]) == [5, 6, 10, 11, 12]
    fixed = points(anomalies.metric_anomalies(history, anomalies.threshold(lower=0)))
    assert [d for d, r in fixed.items() if r["is_anomaly"]] == [11]
    normal = points(anomalies.metric_anomalies(history, anomalies.normal_deviation(days=30, factor=2)))
    assert normal[5]["is_anomaly"] and not normal[3]["is_anomaly"]


def test_constraint_against_history(spark, history):
    df = spark.range(11).withColumnRenamed("id", "n")
    rules = [ConstraintRule(f".hasNoAnomalies(Size(), {d})", constraint_name=d) for d in (
        "MedianDeviation(days=20, factor=3)", "SimpleThreshold(lower=12)", "RelativeRateOfChange(max_increase=1.5)", "Unknown()",
        "MedianDeviation(dayz=3)")] + [ConstraintRule(".hasNoAnomalies(Mean('n'), MedianDeviation())", constraint_name="no past")]
    found = verify(df, rules, db_name="db", table_name="t", as_of="2024-01-13 00:00:00", history=history)
    got = {r["constraint_name"]: r["constraint_status"] for r in found.collect()}
    assert got == {"MedianDeviation(days=20, factor=3)": "Success", "SimpleThreshold(lower=12)": "Failure",
                   "RelativeRateOfChange(max_increase=1.5)": "Success", "Unknown()": "Error", "MedianDeviation(dayz=3)": "Error",
                   "no past": "Success"}
    many = verify(spark.range(40).withColumnRenamed("id", "n"), rules[:1], db_name="db", table_name="t", as_of="2024-01-13", history=history)
    assert many.first()["constraint_status"] == "Failure"
    assert verify(df, rules[:1], db_name="db", table_name="t").first()["constraint_status"] == "Error"
    with pytest.raises(ConstraintProblem):
        anomalies.relative_change()


def test_stored_metrics_feed_the_constraint(spark):
    rules = [ConstraintRule(".hasMean('n', '> 0').hasSize('> 0')")]
    frames = [metric_rows(spark.range(1, 10 + k % 2).withColumnRenamed("id", "n"), rules, db_name="d", table_name="t", as_of=f"2024-01-{k:02d}")
              for k in range(1, 8)]
    stored = frames[0]
    for f in frames[1:]:
        stored = stored.unionByName(f)
    rule = [ConstraintRule(".hasNoAnomalies(Mean('n'), NormalDeviation(factor=3)).hasNoAnomalies(Size(), NormalDeviation(factor=3))")]
    for n, want in ((10, "Success"), (90, "Failure")):
        found = verify(spark.range(1, n).withColumnRenamed("id", "n"), rule, db_name="d", table_name="t", as_of="2024-01-09", history=stored)
        assert [r["constraint_status"] for r in found.collect()] == [want, want]


def test_named_columns(spark, sf_dir):
    columns = ["a", "b c", "Ab", "d.e", "f"]
    rule = ConstraintRule('.satisfies("`b c` > 1 and AB < 2", "x")', column_name=" D.E ,zz")
    assert named_columns([rule], columns) == ["b c", "Ab", "d.e"]
    assert named_columns([ConstraintRule(".hasSize('> 1')")], columns) == columns
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    found = verify(df, [ConstraintRule(".hasMin('l_tax', '>= 0')", column_name="l_tax")], db_name="d", table_name="t", where="l_quantity > 3")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double,l_tax:double>" in plan.replace("...", "")
    assert found.agg(F.count("*")).first()[0] == 1
