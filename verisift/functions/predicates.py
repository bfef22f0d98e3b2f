"""Row-level rules as boolean columns that are true on failing rows.

They are used to filter and to count only, where null means not failing, so null is left as
it is: a condition wrapped to be two-valued would no longer be pushed down to the scan."""

from __future__ import annotations

from typing import Any, Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constants as C
from .expressions import flag, quoted, read_as

Params = dict[str, Any]


class RuleProblem(ValueError):
    """A rule that cannot be turned into a check."""


def column_type(schema: T.StructType, name: str) -> T.DataType:
    """Type of the column, matched the way Spark resolves names (case ignored)."""
    for field in schema.fields:
        if field.name == name:
            return field.dataType
    for field in schema.fields:
        if field.name.lower() == name.lower():
            return field.dataType
    raise RuleProblem(f"unknown column: {name}")


def _is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _sides(schema: T.StructType, name: str, value: Any) -> tuple[Column, Column]:
    """Column and literal in a common type; what cannot be read becomes null, not an error."""
    col, lit = quoted(name), F.lit(value)
    dtype = column_type(schema, name)
    if isinstance(dtype, T.StringType):
        if isinstance(value, bool):
            return col.try_cast("boolean"), lit
        if _is_number(value):
            return read_as(col, dtype, "double"), lit
    elif isinstance(value, str):
        return col, lit.try_cast(dtype)
    return col, lit


def _members(schema: T.StructType, name: str, values: list[Any]) -> Column:
    """Membership test; compared as text when either side is text, nulls are ignored."""
    present = [v for v in values if v is not None]
    if not present:
        return F.lit(False)
    is_text = isinstance(column_type(schema, name), T.StringType)
    if is_text or any(isinstance(v, str) for v in present):
        return quoted(name).cast("string").isin([_text(v) for v in present])
    return quoted(name).isin(present)


def _text(value: Any) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def not_null(schema: T.StructType, column: str, params: Params) -> Column:
    """Null or blank."""
    dtype = column_type(schema, column)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)):
        raise RuleProblem(f"{C.NOT_NULL} cannot test {dtype.simpleString()} column {column}")
    col = quoted(column)
    if isinstance(dtype, T.StringType):
        return col.isNull() | (F.trim(col) == "")
    return col.isNull()  # the text of a number, date or boolean is never blank


def length_check(schema: T.StructType, column: str, params: Params) -> Column:
    """Text length outside the closed interval; null passes, an open side is not tested."""
    dtype = column_type(schema, column)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        raise RuleProblem(f"{C.LENGTH_CHECK} cannot test {dtype.simpleString()} column {column}")
    size = F.length(quoted(column))
    low, high = params.get("min_length"), params.get("max_length")
    outside = F.lit(False)
    if low is not None:
        outside = outside | (size < low)
    if high is not None:
        outside = outside | (size > high)
    return outside


def range_check(schema: T.StructType, column: str, params: Params) -> Column:
    """Value outside the closed interval; null passes, an open side is not tested."""
    low, high = params.get("min_value"), params.get("max_value")
    column_type(schema, column)
    outside = F.lit(False)
    if low is not None:
        value, bound = _sides(schema, column, low)
        outside = outside | (value < bound)
    if high is not None:
        value, bound = _sides(schema, column, high)
        outside = outside | (value > bound)
    return outside


def domain_check(schema: T.StructType, column: str, params: Params) -> Column:
    """Value not in the list; null passes, an empty list accepts everything."""
    allowed = [v for v in params.get("allowed_values") or [] if v is not None]
    column_type(schema, column)
    if not allowed:
        return F.lit(False)
    return ~_members(schema, column, allowed)


def regex_check(schema: T.StructType, column: str, params: Params) -> Column:
    """Pattern not found anywhere in the value; null passes."""
    column_type(schema, column)
    return ~quoted(column).cast("string").rlike(params.get("pattern", ".*"))


def data_type(schema: T.StructType, column: str, params: Params) -> Column:
    """Value that cannot be read as the expected type; null passes."""
    target = C.CASTABLE_TYPES.get(params.get("expected_type", "string"))
    dtype = column_type(schema, column)
    if target is None:
        return F.lit(False)
    col = quoted(column)
    return col.isNotNull() & read_as(col, dtype, target).isNull()


def _condition(schema: T.StructType, params: Params) -> Column | None:
    name, value = params.get("condition_column"), params.get("condition_value")
    if not name or value is None or not params.get("then_rule_type"):
        return None
    operator = params.get("condition_operator", "equals")
    if operator == "in":
        return _members(schema, name, value if isinstance(value, list) else [value])
    left, right = _sides(schema, name, value)
    if operator == "not_equals":
        return left != right
    if operator == "greater_than":
        return left > right
    if operator == "less_than":
        return left < right
    return left == right


def conditional(schema: T.StructType, column: str, params: Params) -> Column:
    """Condition holds on the row and the dependent check fails on it."""
    condition = _condition(schema, params)
    column_type(schema, column)
    if condition is None:
        return F.lit(False)
    then_type = params["then_rule_type"]
    if then_type not in C.RULE_TYPES:
        raise RuleProblem(f"unknown rule type: {then_type}")
    build = DEPENDENT.get(then_type)
    if build is None:
        return F.lit(False)
    return condition & build(schema, column, params.get("then_params") or {})


# Checks a conditional rule may apply once its condition holds.
DEPENDENT: dict[str, Callable[[T.StructType, str, Params], Column]] = {
    C.NOT_NULL: not_null,
    C.DOMAIN_CHECK: domain_check,
    C.RANGE_CHECK: range_check,
    C.REGEX_CHECK: regex_check,
    C.LENGTH_CHECK: length_check,
}

ROW_RULES: dict[str, Callable[[T.StructType, str, Params], Column]] = {
    **DEPENDENT,
    C.DATA_TYPE: data_type,
    C.CONDITIONAL: conditional,
}


# --- the small supplier report: nulls fail, blanks do not count as null -------------

def plain_not_null(column: str) -> Column:
    return quoted(column).isNull()


def zero_or_hundred(column: str) -> Column:
    """Value other than 0 and 100 (membership, not an interval); null fails."""
    return ~flag(quoted(column).isin(0, 100))


def yes_no(column: str) -> Column:
    """Flag columns hold Yes/No, indicator columns Y/N; null fails."""
    valid = ("Yes", "No") if "FLG" in column else ("Y", "N")
    return ~flag(quoted(column).isin(*valid))


REPORT_RULES: dict[str, Callable[[str], Column]] = {
    "NotNull": plain_not_null,
    "Range": zero_or_hundred,
    "Domain": yes_no,
}
