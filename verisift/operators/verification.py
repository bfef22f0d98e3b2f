"""Constraint rules kept in a rules table, evaluated per table."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime
from typing import Iterable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verisift.functions.constraints import ConstraintProblem, read_constraint
from verisift.functions.expressions import month_key, quoted, stamp
from verisift.functions.predicates import RuleProblem

from .anomalies import History
from .metrics import Constraint, Measure, bind, measure_values

SUCCESS, FAILURE, PROBLEM = "Success", "Failure", "Error"


@dataclass(frozen=True)
class ConstraintRule:
    constraint_rule: str
    table_name: str = "table"
    constraint_name: str = ""
    check_level: str = "Error"
    check_message: str | None = None
    column_name: str | None = None
    sql: str | None = None
    db_name: str = ""

    @property
    def level(self) -> str:
        return "Error" if (self.check_level or "").lower() == "error" else "Warning"


def constraint_rule_list(rules: DataFrame | Iterable[ConstraintRule]) -> list[ConstraintRule]:
    """Rules as records; a rules table holds one row per constraint."""
    if not isinstance(rules, DataFrame):
        return list(rules)
    wanted = [c for c in ConstraintRule.__dataclass_fields__ if c in rules.columns]
    ordered = rules.select(*wanted).orderBy(*[c for c in ("table_name", "constraint_name") if c in wanted])
    return [ConstraintRule(**r.asDict()) for r in ordered.collect()]


@dataclass
class Bound:
    """Constraints of a rule list on one table; ``errors`` hold what does not fit."""

    rules: list[tuple[ConstraintRule, str]]
    constraints: dict[int, Constraint]
    errors: dict[int, str]


def named_columns(rules: list[ConstraintRule], columns: list[str]) -> list[str]:
    """The columns that rules name: in their column lists, as arguments, or anywhere in a
    predicate.  A name that merely appears in a text keeps its column too, so no predicate loses
    one; rules that name no column keep all."""
    listed = {c.strip().lower() for r in rules for c in (r.column_name or "").split(",")}
    texts = "\n".join(r.constraint_rule or "" for r in rules)
    kept = [
        c for c in columns
        if c.lower() in listed or re.search(rf"(?<!\w){re.escape(c)}(?!\w)", texts, re.IGNORECASE)
    ]
    return kept or columns


def checked_rows(df: DataFrame, rules: list[ConstraintRule], where: str | None) -> DataFrame:
    """The rows and columns that are checked: filtered first, then reduced to what rules name."""
    rows = df.filter(F.expr(where)) if where else df
    return rows.select(*[quoted(c) for c in named_columns(rules, df.columns)])


def bind_rules(df: DataFrame, rules: list[ConstraintRule], history: History | None = None) -> Bound:
    bound = Bound([], {}, {})
    for rule in rules:
        try:
            calls = read_constraint(rule.constraint_rule)
        except ConstraintProblem as problem:
            bound.errors[len(bound.rules)] = str(problem)
            bound.rules.append((rule, rule.constraint_rule))
            continue
        for call in calls:
            seq = len(bound.rules)
            bound.rules.append((rule, call.text))
            try:
                bound.constraints[seq] = bind(df, call, history)
            except (ConstraintProblem, RuleProblem, PySparkException, TypeError, ValueError) as problem:
                bound.errors[seq] = str(problem).splitlines()[0]
    return bound


def _facts(bound: Bound) -> Column:
    return F.array(*[
        F.struct(
            F.lit(rule.constraint_name).alias("constraint_name"),
            F.lit(rule.level).alias("check_level"),
            F.lit(rule.check_message).cast("string").alias("check_message"),
            F.lit(rule.column_name).cast("string").alias("column_name"),
            F.lit(text).alias("constraint"),
        )
        for rule, text in bound.rules
    ])


def verify(
    df: DataFrame,
    rules: DataFrame | Iterable[ConstraintRule],
    *,
    db_name: str,
    table_name: str,
    as_of: datetime | str | None = None,
    where: str | None = None,
    history: DataFrame | None = None,
) -> DataFrame:
    """One row per constraint with its status and message.

    ``where`` restricts the rows that are checked; of the columns only those that rules name are
    read.  ``history`` holds stored metrics, for ``hasNoAnomalies``.  A constraint that cannot be
    evaluated appears with status ``Error`` and leaves the others alone.
    """
    listed = constraint_rule_list(rules)
    df = checked_rows(df, listed, where)
    stored = None if history is None else History(history, db_name, table_name, as_of)
    bound = bind_rules(df, listed, stored)
    measures = {seq: c.measure for seq, c in bound.constraints.items()}

    def outcome(seq: int, value: Column) -> list[Column]:
        return [
            F.when(bound.constraints[seq].assertion(value), SUCCESS).otherwise(FAILURE).alias("constraint_status"),
            F.lit(None).cast("string").alias("problem"),
        ]

    schema = "seq int, value double, constraint_status string, problem string"
    values = measure_values(df, measures, outcome)
    if bound.errors or values is None:
        broken = df.sparkSession.createDataFrame(
            [(seq, None, PROBLEM, text) for seq, text in bound.errors.items()], schema
        )
        values = broken if values is None else values.unionByName(broken)
    if not bound.rules:
        facts = F.lit(None).cast(
            "struct<constraint_name:string,check_level:string,check_message:string,"
            "column_name:string,constraint:string>"
        )
    else:
        facts = F.element_at(_facts(bound), F.col("seq") + 1)
    message = (
        F.when(F.col("constraint_status") == SUCCESS, F.lit(""))
        .when(F.col("constraint_status") == PROBLEM, F.col("problem"))
        .when(F.col("value").isNull(), F.lit("No value: the metric has no rows to be computed from"))
        .otherwise(F.concat(
            F.lit("Value: "), F.col("value").cast("string"),
            F.lit(" does not meet the constraint requirement!"),
        ))
    )
    rows = values.select("*", facts.alias("f")).select(
        F.lit(f"{table_name}_check").alias("check"),
        F.col("f.check_level").alias("check_level"),
        F.col("f.constraint").alias("constraint"),
        "constraint_status",
        message.alias("constraint_message"),
        F.col("f.constraint_name").alias("constraint_name"),
        F.col("f.column_name").alias("column_name"),
        F.col("f.check_message").alias("check_message"),
        F.col("value").alias("metric_value"),
        F.lit(db_name).alias("db_name"),
        F.lit(table_name).alias("table_name"),
        stamp(as_of).alias("audit_create_date"),
        month_key(as_of).alias("create_month_prtn"),
        F.col("seq").alias("rule_order"),
    )
    whole = W.partitionBy("check")  # rows of one check: as many as it has constraints
    bad = F.col("constraint_status") != SUCCESS
    status = (
        F.when(F.max((bad & (F.col("check_level") == "Error")).cast("int")).over(whole) == 1, "Error")
        .when(F.max(bad.cast("int")).over(whole) == 1, "Warning")
        .otherwise(SUCCESS)
    )
    return rows.withColumn("check_status", status)


def failures(results: DataFrame) -> DataFrame:
    return results.filter(F.col("constraint_status") != SUCCESS)


def metric_rows(
    df: DataFrame,
    rules: DataFrame | Iterable[ConstraintRule],
    *,
    db_name: str,
    table_name: str,
    as_of: datetime | str | None = None,
    where: str | None = None,
) -> DataFrame:
    """Values of the rules' metrics without judging them, one row per distinct metric."""
    listed = constraint_rule_list(rules)
    df = checked_rows(df, listed, where)
    bound = bind_rules(df, listed)
    distinct: dict[Measure, int] = {}
    for seq, constraint in bound.constraints.items():
        distinct.setdefault(constraint.measure, seq)
    measures = {seq: m for m, seq in distinct.items()}

    def labels(seq: int, value: Column) -> list[Column]:
        m = measures[seq]
        return [F.lit(",".join(m.columns) or "*").alias("column_name"), F.lit(m.metric).alias("metric")]

    values = measure_values(df, measures, labels)
    if values is None:
        values = df.sparkSession.createDataFrame(
            [], "seq int, value double, column_name string, metric string"
        )
    return values.select(
        F.lit(db_name).alias("db_name"), F.lit(table_name).alias("table_name"),
        "column_name", "metric", "value",
        stamp(as_of).alias("audit_create_date"), month_key(as_of).alias("create_month_prtn"),
    )


def notify_rollup(failed: DataFrame, rules: DataFrame) -> DataFrame:
    """One message per topic listing the failed tables whose rules ask to notify.

    Both inputs are rules-sized: failed constraints and the rules table."""
    wants = (
        rules.filter((F.col("notify_capture") == "Y") & F.col("notify_topic").isNotNull())
        .select(
            F.lower("db_name").alias("db_name"), F.lower("table_name").alias("table_name"), "notify_topic"
        )
        .distinct()
    )
    hits = failed.select(
        F.lower("db_name").alias("db_name"), F.lower("table_name").alias("table_name")
    ).join(wants, ["db_name", "table_name"])
    line = F.concat_ws("-", "db_name", "table_name")
    return hits.groupBy(F.col("notify_topic").alias("topic")).agg(
        F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("message"),
        F.count(F.lit(1)).alias("failures"),
    )
