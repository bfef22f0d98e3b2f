"""Failing rows as audit records."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.functions import constants as C
from verisift.functions.expressions import (
    as_iso_text,
    content_hash,
    digest_id,
    quoted,
    record_id,
    row_json,
    stamp,
)

from verisift.session import settle

from .checks import RulePlan, Rules, plan_rules, rule_facts, unmatched_values, value_counts
from .skew import bounds_of_counts, first_per_group, order_hash, rows_with_values, sample_bounds, slice_of


def _missing_beyond_share(df: DataFrame, column: str, min_ratio: float) -> Column:
    """Null rows of a column whose share of present values is too low."""
    missing = quoted(column).isNull()
    share = df.agg(F.avg((~missing).cast("double"))).scalar()
    return missing & (share < min_ratio)


def failing_rules(df: DataFrame, plan: RulePlan) -> dict[int, Column]:
    """Per row rule, by its position: whether a row fails it."""
    failing = dict(plan.rows)
    for seq, min_ratio in plan.completeness.items():
        failing[seq] = _missing_beyond_share(df, plan.rules[seq].column, min_ratio)
    return failing


FLAGS_TOGETHER = 62  # rules whose outcomes one long holds


def _exploded(rows: DataFrame, failing: dict[int, Column], values: dict[int, Column], *kept) -> DataFrame:
    """One row per failing (row, rule).

    Every condition is evaluated once, into a bit; rows without a bit are filtered out next, and
    the bits of the others tell their rules.  (The bits hold a part that the optimiser takes for
    not repeatable, as it would evaluate the conditions in the filter and again after it.)  The
    tested value is built with its rule, only where the rule fails."""
    seqs = list(failing)
    masks = []
    for at in range(0, len(seqs), FLAGS_TOGETHER):
        bits = F.monotonically_increasing_id().bitwiseAND(F.lit(0))
        for k, seq in enumerate(seqs[at:at + FLAGS_TOGETHER]):
            bits = bits.bitwiseOR(F.when(failing[seq], F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
        masks.append(bits.alias(f"__failed{at // FLAGS_TOGETHER}"))
    flagged = rows.select("*", *masks)
    any_bit = F.col("__failed0")
    for k in range(1, len(masks)):
        any_bit = any_bit.bitwiseOR(F.col(f"__failed{k}"))
    marks = F.array(*[
        F.when(
            F.col(f"__failed{k // FLAGS_TOGETHER}").bitwiseAND(F.lit(1 << (k % FLAGS_TOGETHER)).cast("long")) != 0,
            F.struct(F.lit(seq).alias("__seq"), values[seq].alias("__value")))
        for k, seq in enumerate(seqs)
    ])
    hits = flagged.filter(any_bit != 0).select(*kept, F.explode(marks).alias("__hit"))
    return hits.filter(F.col("__hit").isNotNull()).select("*", "__hit.__seq", "__hit.__value").drop("__hit")


def _values(plan: RulePlan, seqs, columns: list[str]) -> dict[int, Column]:
    """Text of the value each rule tests."""
    none = F.lit(None).cast("string")
    return {
        seq: as_iso_text(quoted(plan.rules[seq].column)) if plan.rules[seq].column in columns else none
        for seq in seqs
    }


def _hash(df: DataFrame, keys: list[str] | None) -> Column:
    """What samples are ordered by: a hash of the key columns, or of the whole row."""
    if keys:
        return order_hash(*[quoted(k) for k in keys])
    return F.shiftrightunsigned(content_hash(df), 1)


def _order(keys: list[str] | None) -> list[Column]:
    return [F.col("__hash"), *[quoted(k) for k in keys or []], F.col("__content")]


def _hits(df: DataFrame, plan: RulePlan, keys: list[str] | None, n: int | None) -> DataFrame:
    """One row per (row, failed row rule) with all columns of the table; with ``n``, only
    rows that can be among the first ``n`` of a rule.

    A first pass counts each rule's failing rows per slice of the hash range (it reads the
    keys and the columns the rules use), so the second pass keeps little more than ``n``
    rows per rule and nothing larger is ever sorted."""
    failing = failing_rules(df, plan)
    values = _values(plan, failing, df.columns)
    hashed = df.withColumn("__hash", _hash(df, keys))
    if n is None:  # what a record says of its row is built once a row, not once a record
        told = hashed.select("*", *_told(keys, df.columns))
        return _exploded(told, failing, values, "__hash", "__key", "__data")
    own = slice_of(F.col("__hash"))
    pairs = F.map_from_entries(F.collect_list(F.struct("__seq", "__bound")))
    listed = F.transform(F.array(*[F.lit(seq) for seq in failing]), lambda seq: F.try_element_at(pairs, seq))
    bounds = bounds_of_counts(_slice_counts(hashed, own, failing), "__seq", "__slice", n).agg(listed).scalar()
    within = {seq: fails & (own <= F.get(bounds, F.lit(k))) for k, (seq, fails) in enumerate(failing.items())}
    return _exploded(hashed.filter(own <= F.array_max(bounds)), within, values, *[quoted(c) for c in hashed.columns])


def _slice_counts(rows: DataFrame, own: Column, failing: dict[int, Column]) -> DataFrame:
    """``__seq, __slice, __n``: failing rows per rule and slice, of all rules by one grouping."""
    frames, seqs = [], list(failing)
    for at in range(0, len(seqs), FLAGS_TOGETHER):
        some = seqs[at:at + FLAGS_TOGETHER]
        wide = rows.groupBy(own.alias("__slice")).agg(*[F.count(F.when(failing[seq], 1)).alias(f"n{seq}") for seq in some])
        entries = F.array(*[F.struct(F.lit(seq).alias("__seq"), F.col(f"n{seq}").alias("__n")) for seq in some])
        frames.append(wide.select("__slice", F.inline(entries)).filter("__n > 0"))
    return reduce(lambda a, b: a.unionByName(b), frames)


def _value_hits(
    df: DataFrame, seq: int, columns: list[str], counts: DataFrame, keys: list[str] | None, n: int | None
) -> DataFrame:
    """Rows whose values are listed in ``counts``; with ``n``, only rows that can be among
    the first ``n``.

    The bound comes from a pass over just the tested columns and the hash, so the pass that
    carries whole rows drops nearly all of them before they are joined."""
    hashed = df.withColumn("__hash", _hash(df, keys))
    counts = settle(counts)
    if n is not None:
        narrow = hashed.select(*[quoted(c) for c in columns], slice_of(F.col("__hash")).alias("__slice"))
        failing = rows_with_values(narrow, columns, counts).select(F.lit(seq).alias("__seq"), "__slice")
        bound = sample_bounds(failing, "__seq", "__slice", n).agg(F.max("__bound")).scalar()
        hashed = hashed.filter(slice_of(F.col("__hash")) <= bound)
    return rows_with_values(hashed, columns, counts).withColumn("__seq", F.lit(seq))


def _told(keys: list[str] | None, columns: list[str]) -> list[Column]:
    """Key text and content of a row."""
    present = [k for k in keys or [] if k in columns]
    key = (
        F.concat_ws("|", *[as_iso_text(quoted(k)) for k in present])
        if present else F.lower(F.hex(F.col("__hash")))
    )
    return [key.alias("__key"), row_json(columns, keep_nulls=True, as_text=True).alias("__data")]


def _records(rows: DataFrame, keys: list[str] | None, columns: list[str]) -> DataFrame:
    """Common shape: position, rank order, key text, tested value, whole row."""
    told = rows if "__data" in rows.columns else rows.select("__seq", "__value", *_told(keys, columns))
    return told.select(
        F.col("__seq").alias("seq"), F.col("__key").alias("row_key"), F.col("__value").alias("actual_value"),
        F.col("__data").alias("row_data"))


def rejects(
    df: DataFrame,
    rules: Rules,
    *,
    dataset_id: str,
    run_id: str,
    as_of: datetime | str | None = None,
    keys: list[str] | None = None,
    sample: int | None = None,
    refs: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """One audit record per (failing row, rule).

    ``sample`` caps the records of each rule to the first rows in the order of a hash of
    the ``keys`` that identify a row, or of the row's content when no keys are given; unlike
    a running row number this order survives re-computation, and it spreads the sample over
    the table.  ``None`` keeps every failing row, without any ranking or shuffle for row
    rules.
    """
    plan = plan_rules(df, rules, dataset_id=dataset_id, as_of=as_of, refs=refs)
    columns = df.columns
    parts: list[DataFrame] = []

    def add(rows: DataFrame, names: list[str], ranked_by: list[str] | None, *rules_of: int) -> None:
        if "__value" not in rows.columns:  # rows of one rule
            rows = rows.withColumn("__value", _values(plan, rules_of, names)[rules_of[0]])
        if "__hash" not in rows.columns:
            rows = rows.withColumn("__hash", _hash(rows.select(*[quoted(c) for c in names]), ranked_by))
        if sample is not None:
            content = content_hash(rows.select(*[quoted(c) for c in names]))
            ranked = rows.withColumn("__content", content)
            rows = first_per_group(ranked, "__seq", _order(ranked_by), sample)
        parts.append(_records(rows, ranked_by, names))

    if plan.rows or plan.completeness:
        add(_hits(df, plan, keys, sample), columns, keys)
    for seq, unique in plan.unique.items():
        repeated = value_counts(df, unique).filter(F.col("__n") > 1)
        add(_value_hits(df, seq, unique, repeated, keys, sample), columns, keys, seq)
    for seq, reference in plan.referential.items():
        column = plan.rules[seq].column
        missing = unmatched_values(df, column, reference).filter("__missing")
        missing = missing.select(F.col("__value").alias(column), "__n")
        add(_value_hits(df, seq, [column], missing, keys, sample), columns, keys, seq)
    for seq, failing in plan.sql.items():
        usable = keys if keys and set(keys) <= set(failing.columns) else None
        add(failing.withColumn("__seq", F.lit(seq)), failing.columns, usable, seq)

    if not parts:
        empty = "seq int, row_key string, actual_value string, row_data string"
        parts.append(df.sparkSession.createDataFrame([], empty))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    facts = F.element_at(rule_facts(plan.rules), F.col("seq") + 1)
    named = found.select("*", facts.alias("r"))
    return named.select(
        F.lit(run_id).alias("run_id"),
        record_id(digest_id("ANO_", F.lit(run_id), F.col("r.rule_id"), F.col("row_key"))).alias("anomaly_id"),
        F.lit(dataset_id).alias("dataset_id"),
        F.col("r.rule_id").alias("rule_id"),
        F.col("r.rule_type").alias("rule_type"),
        F.col("r.column").alias("column"),
        F.col("r.severity").alias("severity"),
        "row_key",
        "actual_value",
        F.col("r.expected_constraint").alias("expected_constraint"),
        "row_data",
        stamp(as_of).alias("detected_at"),
    )


def failing_rows(
    df: DataFrame,
    rule_source: Rules,
    *,
    dataset_id: str = "dataset",
    as_of: datetime | str | None = None,
    refs: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """The rows one rule rejects, in the table's own columns (or the rule's SQL columns)."""
    plan = plan_rules(df, rule_source, dataset_id=dataset_id, as_of=as_of, refs=refs)
    if len(plan.rules) != 1:
        raise ValueError("failing_rows takes exactly one active rule")
    if plan.errors:
        raise ValueError(plan.errors[0])
    if plan.rows:
        return df.filter(plan.rows[0])
    if plan.completeness:
        return df.filter(_missing_beyond_share(df, plan.rules[0].column, plan.completeness[0]))
    if plan.unique:
        columns = plan.unique[0]
        return rows_with_values(df, columns, value_counts(df, columns).filter(F.col("__n") > 1))
    if plan.referential:
        column = plan.rules[0].column
        missing = unmatched_values(df, column, plan.referential[0]).filter("__missing")
        return rows_with_values(df, [column], missing.select(F.col("__value").alias(column), "__n"))
    if plan.sql:
        return plan.sql[0]
    return df.limit(0)  # freshness is a statement about the table, not about rows


def audit_trail(found: DataFrame, run_id: str, first: int | None = None) -> DataFrame:
    """Records of one run with their total; the first ``first`` of them when given."""
    mine = found.filter(F.col("run_id") == run_id)
    total = mine.agg(F.count(F.lit(1))).scalar()
    listed = mine.select(
        "anomaly_id", "dataset_id", "rule_id", "rule_type", "column", "row_key", "actual_value",
        "expected_constraint", "severity",
        F.date_format("detected_at", "yyyy-MM-dd'T'HH:mm:ss").alias("detected_at"),
        "row_data", total.alias("total_anomalies"),
    )
    if first is None:
        return listed
    return listed.orderBy("rule_id", "row_key", "anomaly_id").limit(first)

