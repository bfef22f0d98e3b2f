"""The rule record and its table form."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import constants as C

RULE_SCHEMA = T.StructType([
    T.StructField("rule_id", T.StringType(), False),
    T.StructField("rule_type", T.StringType(), False),
    T.StructField("column", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
    T.StructField("active", T.BooleanType(), False),
    T.StructField("params", T.StringType(), False),
])


@dataclass(frozen=True)
class Rule:
    rule_id: str
    rule_type: str
    column: str
    severity: str = "high"
    description: str = ""
    active: bool = True
    params: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.rule_type not in C.RULE_TYPES:
            raise ValueError(f"unknown rule type: {self.rule_type}")
        if self.severity not in C.SEVERITIES:
            raise ValueError(f"unknown severity: {self.severity}")

    @property
    def expected_constraint(self) -> str:
        return f"{self.rule_type}: {self.params}"


def rules_frame(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """Rules as a table; params are kept as JSON text."""
    rows = [
        (r.rule_id, r.rule_type, r.column, r.severity, r.description, r.active, json.dumps(r.params))
        for r in rules
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def rule_list(rules: DataFrame | Iterable[Rule]) -> list[Rule]:
    """Rules as records.  A rules table is read to the driver: it describes the plan to
    build and has one row per check, whatever the size of the data checked."""
    if not isinstance(rules, DataFrame):
        return list(rules)
    fields = [f.name for f in RULE_SCHEMA.fields]
    return [
        Rule(**{**row.asDict(), "params": json.loads(row["params"] or "{}")})
        for row in rules.select(*fields).collect()
    ]
