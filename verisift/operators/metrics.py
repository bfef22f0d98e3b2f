"""Table metrics behind the constraints.

Metrics that are plain aggregates share one scan.  Metrics over value frequencies share
one grouping per column set, reduced to a single row by a second aggregate; nothing is
joined and no group is collected.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verisift.functions.constraints import IS_ONE, Assertion, Call, ConstraintProblem, Named
from verisift.functions.expressions import flag, quoted
from verisift.functions.predicates import column_type

from .anomalies import History, WithinBounds, read_detector
from .profile import CLASSES, class_counts, declared_class, value_class

METRICS_PER_SCAN = 100


@dataclass(frozen=True)
class Measure:
    """One metric of a table: a plain aggregate, or a value derived from frequencies."""

    metric: str
    columns: tuple[str, ...]
    scan: Column | None = field(default=None, compare=False)
    grouped: str | None = None


@dataclass(frozen=True)
class Constraint:
    measure: Measure
    assertion: Assertion | WithinBounds
    text: str


def _share(condition: Column) -> Column:
    """Share of all rows for which the condition holds; null counts as not."""
    return F.avg(flag(condition).cast("double"))


def _number(schema: T.StructType, column: str) -> Column:
    dtype = column_type(schema, column)
    if not isinstance(dtype, T.NumericType):
        raise ConstraintProblem(f"{column} is {dtype.simpleString()}, not a number")
    return quoted(column)


def _known(schema: T.StructType, *columns: str) -> None:
    for column in columns:
        column_type(schema, column)


def _quantile(schema: T.StructType, column: str, q: float) -> Column:
    return F.percentile_approx(_number(schema, column), float(q), 10_000)


def _type_share(schema: T.StructType, column: str, wanted: str | None) -> Column:
    """Share of present values of the wanted class, or of the most common class."""
    declared = declared_class(column_type(schema, column))
    if declared is not None:
        return F.max(F.lit(1.0 if wanted in (None, declared) else 0.0))
    counts = class_counts(value_class(quoted(column)))
    best = F.greatest(*counts) if wanted is None else counts[CLASSES.index(wanted)]
    return best / F.nullif(F.count(quoted(column)), F.lit(0))


def _columns(value: Any) -> tuple[str, ...]:
    return tuple(value) if isinstance(value, (tuple, list)) else (value,)


def _in_range(column: str, *bounds: Any) -> Column:
    """Null, one of the listed values, or inside the closed interval."""
    col = quoted(column)
    if len(bounds) == 1 and isinstance(bounds[0], tuple):
        return col.isNull() | col.isin(*bounds[0])
    if len(bounds) == 2:
        return col.isNull() | col.between(*bounds)
    raise ConstraintProblem("a range needs a list of values or two bounds")


Reader = Callable[[T.StructType, list[Any]], Measure]


def _aggregate(metric: str, build: Callable[..., Column], n_columns: int = 1) -> Reader:
    def read(schema: T.StructType, args: list[Any]) -> Measure:
        names = tuple(str(a) for a in args[:n_columns])
        return Measure(metric, names, build(schema, *args))
    return read


def _frequency(metric: str) -> Reader:
    def read(schema: T.StructType, args: list[Any]) -> Measure:
        columns = tuple(c for a in args for c in _columns(a))
        _known(schema, *columns)
        return Measure(metric, columns, grouped=metric)
    return read


def _compliance(build: Callable[..., Column]) -> Reader:
    def read(schema: T.StructType, args: list[Any]) -> Measure:
        label = ",".join(str(a) for a in args)
        return Measure("Compliance", (label,), _share(build(schema, *args)))
    return read


def _compared(op: Callable[[Column, Column], Column]) -> Reader:
    return _compliance(lambda s, a, b: op(quoted(a), quoted(b)))


def _complete(schema: T.StructType, column: str) -> Column:
    _known(schema, column)
    return _share(quoted(column).isNotNull())


def _all_complete(schema: T.StructType, columns: Any) -> Column:
    present = F.lit(True)
    for c in _columns(columns):
        present = present & quoted(c).isNotNull()
    return present


def _any_complete(schema: T.StructType, columns: Any) -> Column:
    present = F.lit(False)
    for c in _columns(columns):
        present = present | quoted(c).isNotNull()
    return present


def _length_of(schema: T.StructType, column: str) -> Column:
    if not isinstance(column_type(schema, column), T.StringType):
        raise ConstraintProblem(f"{column} is not text")
    return F.length(quoted(column))


# name -> (reader, needs an assertion)
VOCABULARY: dict[str, tuple[Reader, bool]] = {
    "hasSize": (_aggregate("Size", lambda s: F.count(F.lit(1)), 0), True),
    "isComplete": (_aggregate("Completeness", _complete), False),
    "hasCompleteness": (_aggregate("Completeness", _complete), True),
    "areComplete": (_compliance(_all_complete), False),
    "haveCompleteness": (_compliance(_all_complete), True),
    "areAnyComplete": (_compliance(_any_complete), False),
    "haveAnyCompleteness": (_compliance(_any_complete), True),
    "isUnique": (_frequency("Uniqueness"), False),
    "isPrimaryKey": (_frequency("Uniqueness"), False),
    "hasUniqueness": (_frequency("Uniqueness"), True),
    "hasDistinctness": (_frequency("Distinctness"), True),
    "hasUniqueValueRatio": (_frequency("UniqueValueRatio"), True),
    "hasCountDistinct": (_frequency("CountDistinct"), True),
    "hasNumberOfDistinctValues": (_frequency("CountDistinct"), True),
    "hasEntropy": (_frequency("Entropy"), True),
    "hasMutualInformation": (_frequency("MutualInformation"), True),
    "hasApproxCountDistinct": (
        _aggregate("ApproxCountDistinct", lambda s, c: F.approx_count_distinct(quoted(c))), True),
    "hasMin": (_aggregate("Minimum", lambda s, c: F.min(_number(s, c))), True),
    "hasMax": (_aggregate("Maximum", lambda s, c: F.max(_number(s, c))), True),
    "hasMean": (_aggregate("Mean", lambda s, c: F.avg(_number(s, c))), True),
    "hasSum": (_aggregate("Sum", lambda s, c: F.sum(_number(s, c))), True),
    "hasStandardDeviation": (
        _aggregate("StandardDeviation", lambda s, c: F.stddev_pop(_number(s, c))), True),
    "hasMinLength": (_aggregate("MinLength", lambda s, c: F.min(_length_of(s, c))), True),
    "hasMaxLength": (_aggregate("MaxLength", lambda s, c: F.max(_length_of(s, c))), True),
    "hasApproxQuantile": (_aggregate("ApproxQuantile", _quantile), True),
    "hasCorrelation": (
        _aggregate("Correlation", lambda s, a, b: F.corr(_number(s, a), _number(s, b)), 2), True),
    "hasHistogramValues": (
        _aggregate("HistogramRatio", lambda s, c, v: _share(quoted(c).eqNullSafe(F.lit(v)))), True),
    "isNonNegative": (
        _compliance(lambda s, c: F.coalesce(_number(s, c), F.lit(0)) >= 0), False),
    "isPositive": (_compliance(lambda s, c: F.coalesce(_number(s, c), F.lit(1)) > 0), False),
    "isInRange": (_compliance(lambda s, c, *b: _in_range(c, *b)), False),
    "isContainedIn": (_compliance(lambda s, c, *b: _in_range(c, *b)), False),
    "isLessThan": (_compared(lambda a, b: a < b), False),
    "isLessThanOrEqualTo": (_compared(lambda a, b: a <= b), False),
    "isGreaterThan": (_compared(lambda a, b: a > b), False),
    "isGreaterThanOrEqualTo": (_compared(lambda a, b: a >= b), False),
    "satisfies": (_compliance(lambda s, predicate, name="": F.expr(predicate)), False),
    "satisfiesIf": (_compliance(lambda s, p, q: ~flag(F.expr(p)) | flag(F.expr(q))), False),
    "hasPattern": (_compliance(lambda s, c, p: quoted(c).rlike(p)), False),
    "hasConsistentType": (_aggregate("TypeConsistency", lambda s, c: _type_share(s, c, None)), False),
    "hasTypeConsistency": (_aggregate("TypeConsistency", lambda s, c: _type_share(s, c, None)), True),
    "hasDataType": (_aggregate("DataType", _type_share), False),
}


# Constraints whose metric goes by another name
_METRIC_CALLS = {"Minimum": "hasMin", "Maximum": "hasMax"}


def _bind_anomalies(df: DataFrame, call: Call, history: History | None) -> Constraint:
    """``hasNoAnomalies(metric, detector)``: the metric's value lies where its history lets expect it."""
    if history is None:
        raise ConstraintProblem("hasNoAnomalies needs the stored metrics")
    if len(call.args) < 2 or not isinstance(call.args[0], Named):
        raise ConstraintProblem("hasNoAnomalies needs a metric and a detector")
    metric = call.args[0]
    name = _METRIC_CALLS.get(metric.name, f"has{metric.name}")
    if name not in VOCABULARY or metric.kwargs:
        raise ConstraintProblem(f"unknown metric: {metric.name}")
    measure = VOCABULARY[name][0](df.schema, list(metric.args))
    if measure.scan is not None:
        df.agg(measure.scan).schema
    within = WithinBounds(history, measure.metric, measure.columns, read_detector(call.args[1]))
    return Constraint(measure, within, call.text)


def bind(df: DataFrame, call: Call, history: History | None = None) -> Constraint:
    """Attach a constraint to a table; raises when it does not fit."""
    if call.name == "hasNoAnomalies":
        return _bind_anomalies(df, call, history)
    if call.name not in VOCABULARY:
        raise ConstraintProblem(f"unknown constraint: {call.name}")
    reader, needs_assertion = VOCABULARY[call.name]
    args = list(call.args)
    given = [i for i, a in enumerate(args) if isinstance(a, Assertion)]
    assertion = IS_ONE
    if given:
        assertion = args[given[0]]
        args = args[:given[0]]  # what follows a comparison is a hint text
    elif needs_assertion:
        if not args or not isinstance(args[-1], str):
            raise ConstraintProblem(f"{call.name} needs a comparison")
        assertion = Assertion(args.pop())
    assertion(F.lit(0.0))
    measure = reader(df.schema, args)
    if measure.scan is not None:
        df.agg(measure.scan).schema
    return Constraint(measure, assertion, call.text)


# --- evaluation -----------------------------------------------------------------------

def frequency_sums(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row: present rows, distinct values, values occurring once, and the sum of
    n ln n over the value counts.  Rows that are null in every column do not count."""
    present = F.lit(False)
    for c in columns:
        present = present | quoted(c).isNotNull()
    counts = df.filter(present).groupBy(*[quoted(c) for c in columns]).agg(
        F.count(F.lit(1)).alias("n")
    )
    return _sums_of_counts(counts)


def _sums_of_counts(counts: DataFrame) -> DataFrame:
    n = F.col("n").cast("double")
    return counts.agg(
        F.coalesce(F.sum(n), F.lit(0.0)).alias("present"),
        F.count(F.lit(1)).cast("double").alias("distinct"),
        F.count(F.when(n == 1, 1)).cast("double").alias("single"),
        F.coalesce(F.sum(n * F.ln(n)), F.lit(0.0)).alias("nlogn"),
    )


def _entropy(present: Column, nlogn: Column) -> Column:
    return F.when(present > 0, F.ln(present) - nlogn / present)


FROM_FREQUENCIES: dict[str, Callable[[], Column]] = {
    "Uniqueness": lambda: F.col("single") / F.nullif("present", F.lit(0.0)),
    "Distinctness": lambda: F.col("distinct") / F.nullif("present", F.lit(0.0)),
    "UniqueValueRatio": lambda: F.col("single") / F.nullif("distinct", F.lit(0.0)),
    "CountDistinct": lambda: F.col("distinct"),
    "Entropy": lambda: _entropy(F.col("present"), F.col("nlogn")),
}


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``value``: H(a) + H(b) - H(a, b) over rows where both are present.

    The pair counts come from one grouping; both marginals are sums of pair counts, so
    nothing is joined and a frequent value is combined before it is shuffled."""
    pairs = (
        df.filter(quoted(a).isNotNull() & quoted(b).isNotNull())
        .groupBy(quoted(a).alias("a"), quoted(b).alias("b"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    parts = [
        _sums_of_counts(counts).select(F.lit(sign).alias("sign"), "present", "nlogn")
        for sign, counts in (
            (1, pairs.groupBy("a").agg(F.sum("n").alias("n"))),
            (1, pairs.groupBy("b").agg(F.sum("n").alias("n"))),
            (-1, pairs),
        )
    ]
    entropies = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return entropies.agg(
        F.sum(F.col("sign") * _entropy(F.col("present"), F.col("nlogn"))).alias("value")
    )


def histogram(df: DataFrame, column: str) -> DataFrame:
    """``value, count, ratio`` of every value; nulls form a bin of their own."""
    total = df.agg(F.count(F.lit(1))).scalar()
    value = F.coalesce(quoted(column).cast("string"), F.lit("NullValue")).alias("value")
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("count")).select(
        "value", "count", (F.col("count") / total).alias("ratio")
    )


def measure_values(
    df: DataFrame, measures: dict[int, Measure], extra: Callable[[int, Column], list[Column]] | None = None
) -> DataFrame | None:
    """``seq, value`` per measure plus what ``extra`` derives from a value."""
    def record(seq: int, value: Column) -> Column:
        value = value.cast("double")
        return F.struct(F.lit(seq).alias("seq"), value.alias("value"), *(extra(seq, value) if extra else []))

    frames = []
    scans = [(seq, m) for seq, m in measures.items() if m.scan is not None]
    for start in range(0, len(scans), METRICS_PER_SCAN):
        chunk = scans[start:start + METRICS_PER_SCAN]
        wide = df.agg(*[m.scan.alias(f"m{seq}") for seq, m in chunk])
        frames.append(wide.select(F.inline(F.array(*[record(seq, F.col(f"m{seq}")) for seq, _ in chunk]))))
    by_columns: dict[tuple[str, ...], list[tuple[int, str]]] = {}
    for seq, m in measures.items():
        if m.grouped == "MutualInformation":
            if len(m.columns) != 2:
                raise ConstraintProblem("mutual information needs two columns")
            frames.append(
                mutual_information(df, *m.columns).select(F.inline(F.array(record(seq, F.col("value")))))
            )
        elif m.grouped is not None:
            by_columns.setdefault(m.columns, []).append((seq, m.grouped))
    for columns, wanted in by_columns.items():
        sums = frequency_sums(df, columns)
        frames.append(sums.select(F.inline(F.array(*[
            record(seq, FROM_FREQUENCIES[name]()) for seq, name in wanted
        ]))))
    if not frames:
        return None
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def metric_changes(
    history: DataFrame,
    max_increase: float | None = None,
    max_decrease: float | None = None,
) -> DataFrame:
    """Every stored metric value with the previous run's value, their ratio, and whether
    the ratio lies outside ``[max_decrease, max_increase]``.

    ``history`` holds one row per run and metric."""
    series = W.partitionBy("db_name", "table_name", "column_name", "metric").orderBy("audit_create_date")
    previous = F.lag("value").over(series)
    compared = history.withColumn("previous_value", previous)
    ratio = F.col("value") / F.nullif("previous_value", F.lit(0.0))
    outside = F.lit(False)
    if max_increase is not None:
        outside = outside | (ratio > max_increase)
    if max_decrease is not None:
        outside = outside | (ratio < max_decrease)
    return compared.withColumn("change_ratio", ratio).withColumn("is_anomaly", flag(outside))


def type_histogram(df: DataFrame, column: str) -> DataFrame:
    """Number of values per value class of a text column."""
    return df.groupBy(F.coalesce(value_class(quoted(column)), F.lit("Unknown")).alias("value_class")).agg(
        F.count(F.lit(1)).alias("count")
    )
