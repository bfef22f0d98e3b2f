"""Roll-ups of check results: run summary, health per column, alerts, exports.

Inputs here have one row per rule or per failing sample, not per row of data.  Store the
results and the audit records before deriving several frames from them, as ``run_rules``
does; each frame would otherwise scan the data again.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.functions import constants as C
from verisift.functions.expressions import percent, stamp, tally


def summarise(
    results: DataFrame,
    *,
    dataset_id: str,
    run_id: str,
    fail_threshold: float | None = None,
) -> DataFrame:
    """One row per run; a run without rules scores 0 and fails."""
    threshold = C.PASS_THRESHOLD if fail_threshold is None else float(fail_threshold)
    status = F.col("status")
    severe = (status == C.FAILED) & F.col("severity").isin("critical", "high")
    counted = results.agg(
        # taken from the rows, so that joins on it stay joins on a column
        F.coalesce(F.max("run_id"), F.lit(run_id)).alias("run_id"),
        F.count(F.lit(1)).alias("total_rules"),
        tally(status == C.PASSED).alias("passed_rules"),
        tally(status == C.FAILED).alias("failed_rules"),
        tally(status == C.WARNING).alias("warning_rules"),
        tally(status == C.ERROR).alias("error_rules"),
        tally(severe).alias("severe"),
    )
    score = percent(F.col("passed_rules"), F.col("total_rules"), empty=0.0)
    overall = (
        F.when((F.col("severe") > 0) | (score < threshold), C.FAILED)
        .when(F.col("warning_rules") > 0, C.WARNING)
        .otherwise(C.PASSED)
    )
    return counted.select(
        "run_id",
        F.lit(dataset_id).alias("dataset_id"),
        overall.alias("overall_status"),
        score.alias("overall_score"),
        "total_rules", "passed_rules", "failed_rules", "warning_rules", "error_rules",
    )


def verdict(summary: DataFrame) -> DataFrame:
    """Summary with its one-line verdict."""
    text = (
        F.when(F.col("overall_status") == C.PASSED, C.VERDICTS[C.PASSED])
        .when(F.col("overall_status") == C.WARNING, C.VERDICTS[C.WARNING])
        .otherwise(C.VERDICTS[C.FAILED])
    )
    return summary.select(
        "run_id", "dataset_id", "overall_status", "overall_score", text.alias("verdict"),
        "total_rules", "passed_rules", "failed_rules", "warning_rules",
    )


def column_health(results: DataFrame) -> DataFrame:
    """Checks per column; rules in error are listed in the results only."""
    evaluated = results.filter(F.col("status") != C.ERROR)
    check = F.struct(
        "rule_order", "rule_id", "rule_type", "status", "pass_percentage", "failed_records",
        "severity", "description",
    )
    failed = tally(F.col("status") == C.FAILED)
    return evaluated.groupBy("run_id", "dataset_id", "column").agg(
        F.count(F.lit(1)).alias("total_checks"),
        tally(F.col("status") == C.PASSED).alias("passed"),
        failed.alias("failed"),
        F.when(failed == 0, "HEALTHY").otherwise("UNHEALTHY").alias("health"),
        F.sort_array(F.collect_list(check)).alias("checks"),
    )


def anomaly_counts(results: DataFrame, by: str) -> DataFrame:
    """Failing rows per severity or per column, from the results: exact whatever part of the
    audit records is kept."""
    counted = results.filter((F.col("status") != C.ERROR) & (F.col("failed_records") > 0))
    return counted.groupBy("run_id", by).agg(F.sum("failed_records").alias("anomalies"))


def needs_alert(summary: DataFrame) -> DataFrame:
    return summary.filter(F.col("overall_status").isin(C.FAILED, C.WARNING))


def _detail_line() -> Column:
    return F.format_string(
        "  - [%s] %s: '%s' %s -> %.1f%% pass (%d failures)",
        F.upper("severity"), F.col("rule_id"), F.col("column"), F.col("rule_type"),
        F.col("pass_percentage"), F.col("failed_records"),
    )


def alert_payload(
    summary: DataFrame,
    results: DataFrame,
    as_of: datetime | str | None = None,
) -> DataFrame:
    """Subject, detail lines and counts for every run that needs an alert."""
    lines = results.filter(F.col("status") == C.FAILED).groupBy("run_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("column", "rule_order", _detail_line().alias("line")))),
            lambda item: item["line"],
        ).alias("failure_details")
    )
    payload = needs_alert(summary).join(lines, "run_id", "left")
    totals = results.filter(F.col("status") != C.ERROR).groupBy("run_id").agg(F.sum("failed_records").alias("anomaly_count"))
    payload = payload.join(totals, "run_id", "left")
    subject = F.format_string(
        "DQ Alert: Dataset '%s' - %s", F.col("dataset_id"), F.upper("overall_status")
    )
    return payload.select(
        "run_id", "dataset_id", subject.alias("subject"),
        F.col("overall_status").alias("status"), F.col("overall_score").alias("score"),
        "total_rules", "failed_rules",
        F.coalesce("failure_details", F.array().cast("array<string>")).alias("failure_details"),
        F.coalesce("anomaly_count", F.lit(0).cast("bigint")).alias("anomaly_count"),
        stamp(as_of).alias("alert_time"),
    )


def alert_history(
    payload: DataFrame,
    channels: tuple[str, ...] = C.ALERT_CHANNELS,
    failures: dict[str, str] | None = None,
) -> DataFrame:
    """One row per alert and channel.  ``failures`` maps a channel whose delivery failed
    to its error text."""
    failures = failures or {}
    marks = F.array(*[
        F.struct(
            F.lit(c).alias("channel"),
            F.lit("failed" if c in failures else "sent").alias("status"),
            F.lit(failures.get(c)).cast("string").alias("error"),
        )
        for c in channels
    ])
    return payload.select("alert_time", "run_id", "subject", F.explode(marks).alias("m")).select(
        "alert_time", "run_id", "m.channel", "m.status",
        F.when(F.col("m.status") == "sent", F.col("subject")).alias("message"), "m.error",
    )


def report_document(
    summary: DataFrame, results: DataFrame, as_of: datetime | str | None = None
) -> DataFrame:
    """One nested row per run, ready to be written as JSON.

    Column blocks are a map from column to checks.  The audit records are a table of their
    own (``write_audit``), as a run can have any number of them."""
    blocks = column_health(results).groupBy("run_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(
            "column",
            F.struct("total_checks", "passed", "failed", "health", "checks").alias("summary"),
        )))).alias("column_summary")
    )

    def tallies(by: str, name: str) -> DataFrame:
        return anomaly_counts(results, by).groupBy("run_id").agg(
            F.map_from_entries(F.sort_array(F.collect_list(F.struct(by, "anomalies")))).alias(name)
        )

    total = results.filter(F.col("status") != C.ERROR).groupBy("run_id").agg(F.sum("failed_records").alias("total_anomalies"))
    return (
        verdict(summary)
        .withColumn("generated_at", stamp(as_of))
        .join(blocks, "run_id", "left")
        .join(tallies("severity", "by_severity"), "run_id", "left")
        .join(tallies("column", "by_column"), "run_id", "left")
        .join(total, "run_id", "left")
        .fillna({"total_anomalies": 0})
    )


def supplier_style_report(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``column, status, count`` per (column, NotNull | Range | Domain) pair, counted in one
    scan.  Unknown logic is skipped.  The failing rows come from ``supplier_style_samples``."""
    from verisift.functions.predicates import REPORT_RULES

    known = [(i, column, logic) for i, (column, logic) in enumerate(rules) if logic in REPORT_RULES]
    if not known:
        return df.sparkSession.createDataFrame([], "rule_order int, column string, status string, count bigint")
    wide = df.agg(*[tally(REPORT_RULES[logic](column)).alias(f"v{i}") for i, column, logic in known])
    rows = [
        F.struct(
            F.lit(i).alias("rule_order"),
            F.lit(column).alias("column"),
            F.when(F.col(f"v{i}") > 0, "FAILED").otherwise("PASSED").alias("status"),
            F.col(f"v{i}").alias("count"),
        )
        for i, column, _ in known
    ]
    return wide.select(F.inline(F.array(*rows)))


def supplier_style_samples(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Every failing row as JSON, one record per (rule, row)."""
    from verisift.functions.expressions import row_json
    from verisift.functions.predicates import REPORT_RULES

    known = [(i, column, logic) for i, (column, logic) in enumerate(rules) if logic in REPORT_RULES]
    marks = F.array_compact(F.array(*[
        F.when(REPORT_RULES[logic](column), F.lit(i)) for i, column, logic in known
    ]))
    return df.select(
        F.explode(marks).alias("rule_order"), row_json(df.columns, keep_nulls=True).alias("sample")
    )
