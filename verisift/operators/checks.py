"""Run a rule set over a table.

All row rules, and the table-level rules that need nothing but aggregates, are counted
by one aggregate over one scan.  Uniqueness and referential rules first reduce the table
to one row per value, so a value that fills a third of the table is combined map-side.
Free SQL rules are plans of their own.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from datetime import datetime
from typing import Iterable, Mapping

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verisift.functions import constants as C
from verisift.functions.expressions import percent, quoted, stamp, tally
from verisift.functions.predicates import ROW_RULES, RuleProblem, column_type
from verisift.functions.rules import Rule, rule_list

# Aggregates per scan; beyond this the generated code of one aggregate gets too large.
RULES_PER_SCAN = 100

Rules = DataFrame | Iterable[Rule]


@dataclass
class RulePlan:
    """Active rules sorted by how they are evaluated.  ``seq`` is the rule's position."""

    rules: list[Rule]
    rows: dict[int, Column] = field(default_factory=dict)
    completeness: dict[int, float] = field(default_factory=dict)
    freshness: dict[int, Column] = field(default_factory=dict)
    unique: dict[int, list[str]] = field(default_factory=dict)
    referential: dict[int, DataFrame] = field(default_factory=dict)
    sql: dict[int, DataFrame] = field(default_factory=dict)
    errors: dict[int, str] = field(default_factory=dict)


def unique_columns(rule: Rule) -> list[str]:
    """The rule's column, or the column set named in its params."""
    return list(rule.params.get("columns") or [rule.column])


def plan_rules(
    df: DataFrame,
    rules: Rules,
    *,
    dataset_id: str,
    as_of: datetime | str | None = None,
    refs: Mapping[str, DataFrame] | None = None,
) -> RulePlan:
    """Bind the active rules to the table.  A rule that does not fit is kept as an error
    and does not disturb the others."""
    plan = RulePlan([r for r in rule_list(rules) if r.active])
    view: str | None = None
    patterns_hold = _valid_patterns(df, [p for r in plan.rules for p in _patterns(r)])
    for seq, rule in enumerate(plan.rules):
        try:
            if rule.rule_type == C.UNIQUENESS:
                columns = unique_columns(rule)
                df.groupBy(*[quoted(c) for c in columns]).count().schema
                plan.unique[seq] = columns
            elif rule.rule_type == C.REFERENTIAL:
                plan.referential[seq] = _reference_keys(rule, refs or {})
                column_type(df.schema, rule.column)
            elif rule.rule_type == C.CUSTOM_SQL:
                text = rule.params.get("sql_expression") or ""
                if not text:
                    plan.rows[seq] = F.lit(False)
                    continue
                if view is None:
                    view = "dq_" + hashlib.sha256(dataset_id.encode()).hexdigest()[:16]
                    df.createOrReplaceTempView(view)
                plan.sql[seq] = df.sparkSession.sql(text.replace("{table}", view))
            elif rule.rule_type == C.COMPLETENESS:
                column_type(df.schema, rule.column)
                plan.completeness[seq] = float(rule.params.get("min_ratio", 1.0))
            elif rule.rule_type == C.FRESHNESS:
                plan.freshness[seq] = _stale(df.schema, rule, as_of)
            else:
                if not patterns_hold and not _valid_patterns(df, _patterns(rule)):
                    raise RuleProblem(f"invalid pattern: {_patterns(rule)}")
                plan.rows[seq] = ROW_RULES[rule.rule_type](df.schema, rule.column, rule.params)
        except (PySparkException, RuleProblem, TypeError, KeyError, ValueError) as problem:
            plan.errors[seq] = str(problem).splitlines()[0]
    _drop_unanalysable(df, plan)
    return plan


def _analysed(df: DataFrame, columns: list[Column]) -> str | None:
    """The error Spark's analysis reports for the columns, if any.  Starts no job."""
    try:
        df.select(*columns).schema
    except PySparkException as problem:
        return str(problem).splitlines()[0]
    return None


def _drop_unanalysable(df: DataFrame, plan: RulePlan) -> None:
    """Turn conditions that do not type-check into errors: all at once, and one by one
    only if some are broken."""
    if plan.rows and _analysed(df, list(plan.rows.values())):
        for seq, failing in list(plan.rows.items()):
            problem = _analysed(df, [failing])
            if problem:
                plan.errors[seq] = problem
                del plan.rows[seq]


def _patterns(rule: Rule) -> list[str]:
    return [
        params["pattern"]
        for params in (rule.params, rule.params.get("then_params") or {})
        if "pattern" in params
    ]


def _valid_patterns(df: DataFrame, patterns: list[str]) -> bool:
    """Whether all patterns compile.  A malformed one would only surface while rows are
    read.  The query has no table, so it is folded on the driver and starts no job."""
    if not patterns:
        return True
    tests = ", ".join(f"'' RLIKE :p{i}" for i in range(len(patterns)))
    try:
        df.sparkSession.sql(f"SELECT {tests}", args={f"p{i}": p for i, p in enumerate(patterns)}).collect()
    except PySparkException:
        return False
    return True


def _reference_keys(rule: Rule, refs: Mapping[str, DataFrame]) -> DataFrame:
    name = rule.params.get("reference")
    if name not in refs:
        raise RuleProblem(f"unknown reference: {name}")
    key = quoted(rule.params.get("reference_column", rule.column))
    return refs[name].select(key.alias("__ref")).filter(F.col("__ref").isNotNull()).distinct()


def _stale(schema: T.StructType, rule: Rule, as_of: datetime | str | None) -> Column:
    """Aggregate that is true when the newest value is older than the allowed age."""
    dtype = column_type(schema, rule.column)
    if not isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        raise RuleProblem(f"{C.FRESHNESS} needs a date or time column, not {dtype.simpleString()}")
    age = F.expr(f"make_dt_interval(0, 0, 0, {float(rule.params['max_age_seconds'])})")
    newest = F.max(quoted(rule.column)).cast("timestamp")
    return F.coalesce(newest < stamp(as_of) - age, F.lit(True))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per distinct value (nulls are one value) with its number of rows."""
    return df.groupBy(*[quoted(c) for c in columns]).agg(F.count(F.lit(1)).alias("__n"))


COUNTS_SCHEMA = "seq int, failed bigint, total bigint, verdict string, problem string"


def _count_row(
    seq: int,
    failed: Column,
    total: Column,
    verdict: Column | None = None,
    problem: str | None = None,
) -> Column:
    return F.struct(
        F.lit(seq).alias("seq"),
        failed.cast("bigint").alias("failed"),
        total.cast("bigint").alias("total"),
        (F.lit(None) if verdict is None else verdict).cast("string").alias("verdict"),
        F.lit(problem).cast("string").alias("problem"),
    )


def _scan_counts(df: DataFrame, plan: RulePlan) -> list[DataFrame]:
    """Every rule that is a plain aggregate, a hundred to a scan."""
    aggregates: list[tuple[int, list[Column]]] = []
    for seq, failing in plan.rows.items():
        aggregates.append((seq, [tally(failing)]))
    for seq in plan.completeness:
        aggregates.append((seq, [tally(quoted(plan.rules[seq].column).isNull())]))
    for seq, stale in plan.freshness.items():
        aggregates.append((seq, [stale]))
    for seq in plan.errors:
        aggregates.append((seq, []))
    frames = []
    total = F.col("total")
    for start in range(0, len(aggregates), RULES_PER_SCAN):
        chunk = aggregates[start:start + RULES_PER_SCAN]
        wide = df.agg(
            F.count(F.lit(1)).alias("total"),
            *[agg.alias(f"v{seq}") for seq, columns in chunk for agg in columns],
        )
        records = []
        for seq, _ in chunk:
            value = F.col(f"v{seq}")
            if seq in plan.errors:
                problem = plan.errors[seq]
                records.append(_count_row(seq, F.lit(0), total, F.lit(C.ERROR), problem))
            elif seq in plan.completeness:
                kept = F.when(total > 0, (total - value) / total).otherwise(F.lit(1.0))
                verdict = F.when(kept >= plan.completeness[seq], C.PASSED).otherwise(C.FAILED)
                records.append(_count_row(seq, value, total, verdict))
            elif seq in plan.freshness:
                verdict = F.when(value, C.FAILED).otherwise(C.PASSED)
                records.append(_count_row(seq, F.when(value, total).otherwise(F.lit(0)), total, verdict))
            else:
                records.append(_count_row(seq, value, total))
        frames.append(wide.select(F.inline(F.array(*records))))
    return frames


def _uniqueness_count(df: DataFrame, seq: int, columns: list[str]) -> DataFrame:
    n = F.col("__n")
    sums = value_counts(df, columns).agg(
        F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("failed"),
        F.coalesce(F.sum(n), F.lit(0)).alias("total"),
    )
    return sums.select(F.inline(F.array(_count_row(seq, F.col("failed"), F.col("total")))))


def unmatched_values(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Value counts of the column with a mark on values that have no reference."""
    counts = value_counts(df, [column]).withColumnRenamed(column, "__value")
    joined = counts.join(keys, F.col("__value") == F.col("__ref"), "left")
    return joined.select(
        "__value", "__n",
        (F.col("__value").isNotNull() & F.col("__ref").isNull()).alias("__missing"),
    )


def _referential_count(df: DataFrame, seq: int, column: str, keys: DataFrame) -> DataFrame:
    n = F.col("__n")
    sums = unmatched_values(df, column, keys).agg(
        F.coalesce(F.sum(F.when(F.col("__missing"), n)), F.lit(0)).alias("failed"),
        F.coalesce(F.sum(n), F.lit(0)).alias("total"),
    )
    return sums.select(F.inline(F.array(_count_row(seq, F.col("failed"), F.col("total")))))


def _sql_count(df: DataFrame, seq: int, failing: DataFrame) -> DataFrame:
    total = df.agg(F.count(F.lit(1))).scalar()
    failed = failing.agg(F.count(F.lit(1)).alias("failed"))
    return failed.select(F.inline(F.array(_count_row(seq, F.col("failed"), total))))


def _known_sql_counts(df: DataFrame, known: dict[int, int]) -> DataFrame:
    """Counts that were taken before, beside one count of the table."""
    rows = F.array(*[_count_row(seq, F.lit(n).cast("bigint"), F.col("total")) for seq, n in known.items()])
    return df.agg(F.count(F.lit(1)).alias("total")).select(F.inline(rows))


def _probe_sql(plan: RulePlan) -> dict[int, int]:
    """Counts of the free SQL rules, all by one job; only if that breaks, each by a job of its
    own, so that those that break become errors."""
    if not plan.sql:
        return {}
    counts = [
        failing.agg(F.count(F.lit(1)).alias("n")).select(F.lit(seq).alias("seq"), "n")
        for seq, failing in plan.sql.items()
    ]
    together = counts[0]
    for frame in counts[1:]:
        together = together.unionByName(frame)
    try:
        return {r["seq"]: r["n"] for r in together.collect()}  # one row per rule
    except PySparkException:
        pass
    known = {}
    for seq, failing in list(plan.sql.items()):
        try:
            known[seq] = failing.count()
        except PySparkException as problem:
            plan.errors[seq] = str(problem).splitlines()[0]
            del plan.sql[seq]
    return known


def count_failures(df: DataFrame, plan: RulePlan, isolate_sql: bool = False) -> DataFrame:
    """``seq, failed, total, verdict, problem`` for every planned rule."""
    known = _probe_sql(plan) if isolate_sql else {}
    frames = _scan_counts(df, plan)
    frames += [_uniqueness_count(df, seq, cols) for seq, cols in plan.unique.items()]
    frames += [
        _referential_count(df, seq, plan.rules[seq].column, keys)
        for seq, keys in plan.referential.items()
    ]
    frames += [_sql_count(df, seq, failing) for seq, failing in plan.sql.items() if seq not in known]
    if known:
        frames.append(_known_sql_counts(df, known))
    if not frames:
        return df.sparkSession.createDataFrame([], COUNTS_SCHEMA)
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def rule_facts(rules: list[Rule]) -> Column:
    """Lookup from ``seq`` to the fixed facts of a rule, as a literal array."""
    if not rules:
        return F.array().cast(
            "array<struct<rule_id:string,rule_type:string,column:string,severity:string,"
            "description:string,expected_constraint:string>>"
        )
    return F.array(*[
        F.struct(
            F.lit(r.rule_id).alias("rule_id"),
            F.lit(r.rule_type).alias("rule_type"),
            F.lit(r.column).alias("column"),
            F.lit(r.severity).alias("severity"),
            F.lit(r.description).alias("description"),
            F.lit(r.expected_constraint).alias("expected_constraint"),
        )
        for r in rules
    ])


def judge(verdict: Column, failed: Column, share: Column) -> Column:
    """Status of one rule from its counts; ``verdict`` is set where counts do not decide."""
    clean = failed == 0
    return (
        F.when(verdict.isNotNull(), verdict)
        .when(clean, C.PASSED)
        .when(share >= C.PASS_THRESHOLD, C.WARNING)
        .otherwise(C.FAILED)
    )


def results_from_counts(counts: DataFrame, rules: list[Rule], *, dataset_id: str, run_id: str) -> DataFrame:
    """One row per rule."""
    facts = F.element_at(rule_facts(rules), F.col("seq") + 1)
    broken = F.col("problem").isNotNull()
    none = F.lit(0).cast("bigint")
    passed = F.when(broken, none).otherwise(F.greatest(F.col("total") - F.col("failed"), none))
    share = F.when(broken, F.lit(0.0)).otherwise(percent(passed, F.col("total"), empty=100.0))
    named = counts.select("*", facts.alias("r"), passed.alias("passed"), share.alias("share"))
    return named.select(
        F.lit(run_id).alias("run_id"),
        F.lit(dataset_id).alias("dataset_id"),
        F.col("r.rule_id").alias("rule_id"),
        F.col("r.rule_type").alias("rule_type"),
        F.col("r.column").alias("column"),
        F.col("r.severity").alias("severity"),
        judge(F.col("verdict"), F.col("failed"), F.col("share")).alias("status"),
        F.col("total").alias("total_records"),
        F.col("passed").alias("passed_records"),
        F.col("failed").alias("failed_records"),
        F.col("share").alias("pass_percentage"),
        F.when(broken, F.concat(F.lit("Execution error: "), F.col("problem")))
        .otherwise(F.col("r.description")).alias("description"),
        F.col("seq").alias("rule_order"),
    )


def check(
    df: DataFrame,
    rules: Rules,
    *,
    dataset_id: str,
    run_id: str,
    as_of: datetime | str | None = None,
    refs: Mapping[str, DataFrame] | None = None,
    isolate_sql: bool = False,
) -> DataFrame:
    """Result rows of a rule set, lazily.

    ``refs`` names the tables that referential rules point to.  With ``isolate_sql`` each
    free SQL rule is counted by a job of its own while the plan is built, so that one that
    breaks while reading rows is reported as an error instead of failing the run.
    """
    plan = plan_rules(df, rules, dataset_id=dataset_id, as_of=as_of, refs=refs)
    counts = count_failures(df, plan, isolate_sql)
    return results_from_counts(counts, plan.rules, dataset_id=dataset_id, run_id=run_id)
