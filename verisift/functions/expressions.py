"""Scalar expressions shared by the operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> Column:
    """Column by exact top-level name, safe for dots and spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def flag(condition: Column) -> Column:
    """A two-valued condition: null counts as false."""
    return F.coalesce(condition, F.lit(False))


def tally(condition: Column) -> Column:
    """Number of rows for which the condition is true (0 on an empty input)."""
    return F.count(F.when(condition, F.lit(1)))


def percent(part: Column, whole: Column, empty: float) -> Column:
    """``part / whole`` in percent with two decimals; ``empty`` when there are no rows."""
    ratio = part.cast("double") / whole.cast("double") * F.lit(100.0)
    return F.when(whole > 0, F.round(ratio, 2)).otherwise(F.lit(float(empty)))


def stamp(as_of: datetime | str | None) -> Column:
    """Audit timestamp: the given instant, or the query's start time."""
    if as_of is None:
        return F.current_timestamp()
    return F.lit(str(as_of)).cast("timestamp")


def month_key(as_of: datetime | str | None) -> Column:
    """Month partition value ``yyyyMM`` as an integer."""
    return F.date_format(stamp(as_of), "yyyyMM").cast("int")


# Text that might be a value of the type.  A failing try_cast costs an exception per row, so
# text that cannot be a value is turned away by its first characters; the cast decides on
# the rest.  Leading and trailing blanks and control characters are ignored, as by casts.
_PAD = r"[\x00-\x20\x7f]*"
CANDIDATES = {
    "int": rf"^{_PAD}[+-]?[0-9]+{_PAD}$",
    "bigint": rf"^{_PAD}[+-]?[0-9]+{_PAD}$",
    "double": rf"^{_PAD}[+-]?([0-9.]|(?i:inf|nan))",
    "date": rf"^{_PAD}[+-]?[0-9]",
    "timestamp": rf"^{_PAD}([+-]?[0-9]|T)",
    "timestamp_ntz": rf"^{_PAD}([+-]?[0-9]|T)",
}


def read_as(col: Column, source: T.DataType, target: str) -> Column:
    """The column as the target type; what cannot be read becomes null."""
    cast = col.try_cast(target)
    if isinstance(source, T.StringType) and target in CANDIDATES:
        return F.when(col.rlike(CANDIDATES[target]), cast)
    return cast


def row_json(columns: list[str], keep_nulls: bool = False, as_text: bool = False) -> Column:
    """The named columns as one JSON object."""
    fields = [
        (as_iso_text(quoted(c)) if as_text else quoted(c)).alias(c) for c in columns
    ]
    options = {"ignoreNullFields": "false"} if keep_nulls else {}
    return F.to_json(F.struct(*fields), options)


def as_iso_text(value: Column) -> Column:
    """Text form of any value; dates and times come out in ISO order."""
    return value.cast("string")


def digest_id(prefix: str, *parts: Column) -> Column:
    """Stable record id: prefix plus 32 hex digits of a digest of the parts."""
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(32)))


def record_id(digest: Column) -> Column:
    """A digest followed by the number of the record within the computation, which tells
    records with equal parts (such as repeated rows) apart."""
    return F.concat(digest, F.lit("-"), F.lower(F.hex(F.monotonically_increasing_id())))


def distinct_key(field: T.StructField) -> Column:
    """Text that is equal for two values exactly when Spark groups them together."""
    col = quoted(field.name)
    dtype = field.dataType
    if isinstance(dtype, T.StringType):
        return col
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return (col + F.lit(0).cast(dtype)).cast("string")  # -0.0 groups with 0.0
    if isinstance(dtype, T.BinaryType):
        return F.hex(col)
    if isinstance(dtype, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(col)), {"ignoreNullFields": "false"})
    if isinstance(dtype, (T.ArrayType, T.StructType, T.VariantType)):
        return F.to_json(col, {"ignoreNullFields": "false"})
    return col.cast("string")


def content_hash(df: DataFrame) -> Column:
    """64-bit hash of a whole row (maps are hashed through their JSON text)."""
    return F.xxhash64(*[
        F.to_json(quoted(f.name)) if isinstance(f.dataType, (T.MapType, T.VariantType)) else quoted(f.name)
        for f in df.schema.fields
    ])
