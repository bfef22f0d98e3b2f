"""Batch jobs over catalog tables with rules kept in tables."""

from __future__ import annotations

from datetime import datetime
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisift.functions.expressions import month_key, row_json, stamp
from verisift.operators.profile import column_stats
from verisift.operators.rulebook import (
    active_rules, failed_only, profile_scope, reject_rules, require_rules,
)
from verisift.operators.suggest import constraint_rules, only_new, suggest_constraints
from verisift.operators.verification import constraint_rule_list, metric_rows, verify
from verisift.sources.sinks import replaced_slice
from verisift.sources.tables import list_tables, source_frame

REJECTS_SCHEMA = (
    "query_result string, db_name string, table_name string, constraint_name string, "
    "audit_create_date timestamp"
)


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def verify_tables(
    spark: SparkSession,
    rules: DataFrame,
    *,
    db_name: str,
    tables: str | None = None,
    mode: str = "verify",
    where: str | None = None,
    data: DataFrame | None = None,
    as_of: datetime | str | None = None,
    history: DataFrame | None = None,
) -> DataFrame:
    """Results (or metric values, ``mode="metrics"``) of all active rules of a database.

    Rules are grouped by table and source query, and each group is evaluated once, on the
    columns that its rules name.  ``history`` holds stored metrics, for ``hasNoAnomalies``."""
    chosen = constraint_rule_list(require_rules(active_rules(rules, db_name, mode, tables)))
    groups: dict[tuple[str, str | None], list] = {}
    for rule in chosen:
        groups.setdefault((rule.table_name, rule.sql), []).append(rule)
    run = metric_rows if mode == "metrics" else partial(verify, history=history)
    return _all([
        run(
            source_frame(spark, db_name=db_name, table_name=table, sql=sql, where=where, data=data),
            group, db_name=db_name, table_name=table, as_of=as_of,
        )
        for (table, sql), group in groups.items()
    ])


def capture_rejects(
    spark: SparkSession,
    rules: DataFrame,
    *,
    db_name: str,
    failed: DataFrame | None = None,
    capture_all: bool = False,
    tables: str | None = None,
    columns: list[str] | None = None,
    as_of: datetime | str | None = None,
) -> DataFrame:
    """Rows returned by the reject queries of the rules that failed, one JSON text each.

    All queries form one frame, to be appended by one write."""
    eligible = reject_rules(rules, db_name, tables, columns)
    queries = failed_only(eligible, failed, capture_all).orderBy("table_name", "constraint_name").collect()
    frames = []
    for rule in queries:
        rows = spark.sql(rule["reject_sql"])
        frames.append(rows.select(
            row_json(rows.columns).alias("query_result"),
            F.lit(rule["db_name"]).alias("db_name"),
            F.lit(rule["table_name"]).alias("table_name"),
            F.lit(rule["constraint_name"]).alias("constraint_name"),
            stamp(as_of).alias("audit_create_date"),
        ))
    return _all(frames) if frames else spark.createDataFrame([], REJECTS_SCHEMA)


def profile_rows(
    df: DataFrame, *, db_name: str, table_name: str, as_of: datetime | str | None = None
) -> DataFrame:
    """Stored form of a column profile."""
    return column_stats(df).select(
        F.lit(db_name).alias("db_name"),
        F.lit(table_name).alias("table_name"),
        "column_name",
        F.round("completeness", 2).alias("completeness"),
        "data_type",
        "approx_num_distinct_values",
        stamp(as_of).alias("audit_create_date"),
        month_key(as_of).alias("create_month_prtn"),
    )


def profile_tables(
    spark: SparkSession,
    scope: DataFrame | None,
    *,
    db_name: str,
    tables: str | None = None,
    columns: list[str] | None = None,
    where: str | None = None,
    as_of: datetime | str | None = None,
) -> DataFrame:
    """Column profiles of every table in scope."""
    if not db_name:
        raise ValueError("a profile run needs the name of a database")
    return _all([
        profile_rows(
            source_frame(spark, db_name=db_name, table_name=table, where=where, columns=named),
            db_name=db_name, table_name=table, as_of=as_of,
        )
        for table, named in profile_scope(spark, scope, db_name, tables, columns)
    ])


def suggest_for_tables(
    spark: SparkSession,
    existing: DataFrame,
    *,
    db_name: str,
    tables: str | None = None,
    columns: list[str] | None = None,
    where: str | None = None,
    as_of: datetime | str | None = None,
    max_categories: int,
) -> DataFrame:
    """Rules table after suggesting for each table: its inactive verify rules are replaced
    by the proposals that are not already among the remaining rules."""
    names = list_tables(spark, db_name, tables)
    proposals = _all([
        constraint_rules(
            suggest_constraints(
                source_frame(spark, db_name=db_name, table_name=t, where=where, columns=columns),
                max_categories=max_categories,
            ),
            db_name=db_name, table_name=t, as_of=as_of,
        )
        for t in names
    ])
    stale = (
        (F.col("db_name") == db_name) & F.col("table_name").isin(names)
        & (F.col("rule_type") == "verify") & (F.col("is_active") == "N")
    )
    kept = existing.filter(~F.coalesce(stale, F.lit(False)))
    return replaced_slice(existing, only_new(proposals, kept), stale)
