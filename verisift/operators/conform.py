"""Projections that bring raw rows into a target table's shape."""

from __future__ import annotations

from datetime import datetime
from typing import Any, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verisift.functions import constants as C
from verisift.functions.expressions import quoted, read_as, stamp
from verisift.sources.files import file_name, file_path


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order: existing ones cast (null where the value cannot
    be read), missing ones null, others dropped."""
    given = {f.name: f.dataType for f in df.schema.fields}

    def column(f: T.StructField) -> Column:
        if f.name not in given:
            return F.lit(None).cast(f.dataType).alias(f.name)
        if given[f.name] == f.dataType:
            return quoted(f.name)
        return read_as(quoted(f.name), given[f.name], f.dataType.simpleString()).alias(f.name)

    return df.select(*[column(f) for f in schema.fields])


def rename_by_position(df: DataFrame, source: T.StructType, target: T.StructType | None) -> DataFrame:
    """Source names replaced by target names pairwise; fields without a partner keep
    their name."""
    if target is None:
        return df
    pairs = dict(zip(source.fieldNames(), target.fieldNames()))
    return df.select(*[quoted(c).alias(pairs.get(c, c)) for c in df.columns])


def with_lineage(df: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """Adds name and full path of the file a row came from and the ingest time.

    ``df`` must still be close to its file scan."""
    return df.select(
        "*", file_name().alias("file_name"), file_path().alias("file_path"), stamp(as_of).alias("incr_ingest_timestamp")
    )


def cleaned_money(value: Column) -> Column:
    """A lone dash is null; not-available marks, currency signs, separators and blanks go."""
    trimmed = F.trim(value)
    return F.when(trimmed == C.NA_TOKEN, F.lit(None)).otherwise(
        F.regexp_replace(trimmed, C.MONEY_NOISE, "")
    )


def clean_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Money cleaning of the named columns; empty names are ignored."""
    wanted = [c.strip() for c in columns if c.strip()]
    return df.withColumns({c: cleaned_money(quoted(c)) for c in wanted}) if wanted else df


def _mask(value: Column, rule: Mapping[str, Any]) -> Column:
    kind = rule["kind"]
    text = value.cast("string")
    if kind == "hash":
        return F.sha2(text, 256)
    if kind == "mask":
        return F.mask(text)
    if kind == "fixed":
        return F.when(value.isNotNull(), F.lit(rule.get("value", "***")))
    if kind == "pattern":
        return F.regexp_replace(text, rule["pattern"], rule.get("value", "*"))
    if kind == "null":
        return F.lit(None).cast("string")
    raise ValueError(f"unknown masking rule: {kind}")


def mask_columns(df: DataFrame, rules: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """Masks columns by rule: ``hash``, ``mask`` (letters and digits replaced), ``fixed``
    text, ``pattern`` replacement or ``null``.  Null values stay null."""
    return df.withColumns({c: _mask(quoted(c), r) for c, r in rules.items()}) if rules else df


def only_new_files(df: DataFrame, loaded: DataFrame, name: str = "file_path") -> DataFrame:
    """Rows (of a file listing: one per file) of files that the target does not contain yet.
    Files are told apart by their full path."""
    return df.join(loaded.select(name).distinct(), name, "left_anti").select(*df.columns)
