"""Sort, lookup and projection of keyed records and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisift.functions.expressions import content_hash, quoted

# Fields records may be sorted by
SORT_FIELDS = ("height", "weight", "bmi")


def sort_by(df: DataFrame, field: str, order: str = "asc", allowed: tuple[str, ...] = SORT_FIELDS) -> DataFrame:
    """Whole table in order of a permitted field; a missing value sorts as 0.

    Rows with equal values are ordered by their content, which also lets the sort deal them to
    several tasks, however many lack the value."""
    if field not in allowed:
        raise ValueError(f"records are sorted by one of {list(allowed)}, not {field}")
    if order not in ("asc", "desc"):
        raise ValueError("Invalid order, select between asc and desc")
    key = F.coalesce(quoted(field), F.lit(0))
    return df.orderBy(key.asc() if order == "asc" else key.desc(), content_hash(df))


def lookup(df: DataFrame, value, id_column: str = "id") -> DataFrame:
    """The record with the given id; raises when there is none."""
    found = df.filter(quoted(id_column) == value)
    if found.isEmpty():
        raise LookupError(f"{value} not found")
    return found


def project_documents(df: DataFrame, columns: tuple[str, ...], id_column: str = "_id") -> DataFrame:
    """Documents with their id as text under the name ``id`` and the named fields."""
    return df.select(quoted(id_column).cast("string").alias("id"), *[quoted(c) for c in columns])


def normalise_flag(df: DataFrame, column: str) -> DataFrame:
    """A form flag: ``on`` is true, everything else (also missing) is false."""
    if column not in df.columns:
        return df.withColumn(column, F.lit(False))
    return df.withColumn(column, F.coalesce(quoted(column).cast("string") == "on", F.lit(False)))
