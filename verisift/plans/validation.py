"""Validate one dataset: profile, suggest, check, report, alert."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from typing import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisift.functions import constants as C
from verisift.functions.rules import rule_list
from verisift.operators.checks import Rules, check
from verisift.operators.profile import profile
from verisift.operators.rejects import audit_trail, rejects
from verisift.operators.report import (
    alert_history, alert_payload, column_health, report_document, summarise, verdict,
)
from verisift.operators.suggest import suggest
from verisift.session import settle


@dataclass(frozen=True)
class Validation:
    """Frames of one run.  ``results`` and ``rejects`` are stored, the rest derives from
    them without touching the data again."""

    run_id: str
    results: DataFrame
    rejects: DataFrame
    summary: DataFrame
    verdict: DataFrame
    columns: DataFrame
    alerts: DataFrame
    alert_log: DataFrame
    document: DataFrame

    def records(self, first: int | None = None) -> DataFrame:
        return audit_trail(self.rejects, self.run_id, first)


def run_rules(
    df: DataFrame,
    rules: Rules,
    *,
    dataset_id: str,
    run_id: str,
    as_of: datetime | str | None = None,
    fail_threshold: float | None = None,
    sample: int | None = None,
    keys: list[str] | None = None,
    refs: Mapping[str, DataFrame] | None = None,
    isolate_sql: bool = True,
) -> Validation:
    """Check a table and report on it.

    Counts are one pass over the table for all row rules.  Audit records are collected only
    for rules that failed at least one row, by one more pass."""
    active = [r for r in rule_list(rules) if r.active]
    common = {"dataset_id": dataset_id, "run_id": run_id, "as_of": as_of, "refs": refs}
    results = settle(check(df, active, isolate_sql=isolate_sql, **common))
    broken = (F.col("status") == C.ERROR)
    failing = {  # rules-sized: one row per rule with failures
        r["rule_order"] for r in results.filter(~broken & (F.col("failed_records") > 0)).select("rule_order").collect()
    }
    found = settle(rejects(df, [r for i, r in enumerate(active) if i in failing], keys=keys, sample=sample, **common))
    summary = summarise(results, dataset_id=dataset_id, run_id=run_id, fail_threshold=fail_threshold)
    alerts = alert_payload(summary, results, as_of)
    return Validation(
        run_id, results, found, summary, verdict(summary), column_health(results), alerts,
        alert_history(alerts), report_document(summary, results, as_of),
    )


def quick_check(
    df: DataFrame,
    *,
    dataset_id: str,
    run_id: str,
    as_of: datetime | str | None = None,
    keys: list[str] | None = None,
    exact: bool = True,
) -> Validation:
    """Profile a table, suggest rules from the profile and run them."""
    rules = suggest(profile(df, exact=exact))
    return run_rules(df, rules, dataset_id=dataset_id, run_id=run_id, as_of=as_of, keys=keys)


# --- report registry: a table of summaries ---------------------------------------------

def store_report(summary: DataFrame, table: str) -> None:
    from verisift.sources.sinks import append_load

    append_load(summary, table)


def get_report(reports: DataFrame, run_id: str) -> DataFrame:
    return reports.filter(F.col("run_id") == run_id)


def list_reports(reports: DataFrame) -> DataFrame:
    return reports.select(
        "run_id", "dataset_id", "overall_status", "overall_score", "total_rules", "failed_rules"
    )
