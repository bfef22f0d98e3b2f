"""Table metrics from stored states.

A state holds what is needed of one slice (a day, a file, a partition) and column to merge it
with others: counts, bounds, moments, a HyperLogLog sketch of the distinct values and a quantile
sketch.  When a slice is added, only its rows are read; the metrics of the whole table come from
merging the states, one row per slice and column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verisift.functions.expressions import distinct_key, month_key, quoted, stamp

SLICE = "slice"
LG_K = 14  # HyperLogLog registers, as a power of two: a relative error of about 0.8 %
QUANTILE_K = 800  # size of a quantile sketch: a rank error of about 0.4 %
COLUMNS_PER_SCAN = 40

STATE = (f"{SLICE} string, column_name string, rows bigint, present bigint, total double, mean double, m2 double, "
         "low double, high double, distinct_sketch binary, quantile_sketch binary")


def column_states(df: DataFrame, slice_of: Column) -> DataFrame:
    """One row per slice and column, by one grouping per ``COLUMNS_PER_SCAN`` columns."""
    fields, frames = list(df.schema.fields), []
    for at in range(0, len(fields), COLUMNS_PER_SCAN):
        some = fields[at:at + COLUMNS_PER_SCAN]
        wanted, entries = [F.count(F.lit(1)).alias("rows")], []
        for k, f in enumerate(some):
            col = quoted(f.name)
            number = col.cast("double") if isinstance(f.dataType, T.NumericType) else F.lit(None).cast("double")
            numeric = isinstance(f.dataType, T.NumericType)
            wanted += [
                F.count(col).alias(f"present{k}"), F.hll_sketch_agg(distinct_key(f), F.lit(LG_K)).alias(f"hll{k}"),
            ]
            if numeric:
                wanted += [
                    F.sum(number).alias(f"total{k}"), F.avg(number).alias(f"mean{k}"),
                    (F.var_pop(number) * F.count(number)).alias(f"m2{k}"), F.min(number).alias(f"low{k}"),
                    F.max(number).alias(f"high{k}"), F.kll_sketch_agg_double(number, F.lit(QUANTILE_K)).alias(f"kll{k}"),
                ]

            def pick(name: str, kind: str, k: int = k, numeric: bool = numeric) -> Column:
                return (F.col(f"{name}{k}") if numeric else F.lit(None)).cast(kind)

            entries.append(F.struct(
                F.lit(f.name).alias("column_name"), F.col("rows"), F.col(f"present{k}").alias("present"),
                pick("total", "double").alias("total"), pick("mean", "double").alias("mean"), pick("m2", "double").alias("m2"),
                pick("low", "double").alias("low"), pick("high", "double").alias("high"),
                F.col(f"hll{k}").alias("distinct_sketch"),
                F.when(F.col(f"present{k}") > 0, pick("kll", "binary")).alias("quantile_sketch")))
        wide = df.groupBy(slice_of.cast("string").alias(SLICE)).agg(*wanted)
        frames.append(wide.select(SLICE, F.inline(F.array(*entries))))
    result = frames[0]
    for more in frames[1:]:
        result = result.unionByName(more)
    return result


def merged_states(states: DataFrame) -> DataFrame:
    """One row per column: the state of all slices together.

    Moments are merged by the sums of n, n * mean and m2 + n * mean^2, taken around the mean of
    the slices' means so that large values don't cancel."""
    centre = states.groupBy(F.col("column_name").alias("__c")).agg(F.avg("mean").alias("__centre"))
    joined = states.join(F.broadcast(centre), F.col("column_name") == F.col("__c"))  # one row per column
    n, off = F.col("present").cast("double"), F.col("mean") - F.col("__centre")
    sums = joined.groupBy("column_name").agg(
        F.sum("rows").alias("rows"), F.sum("present").alias("present"), F.sum("total").alias("total"),
        F.first("__centre").alias("__centre"), F.sum(n * off).alias("__off"), F.sum(F.col("m2") + n * off * off).alias("__square"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.hll_union_agg("distinct_sketch", F.lit(True)).alias("distinct_sketch"),
        F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"))
    size = F.nullif(F.col("present").cast("double"), F.lit(0.0))
    return sums.select(
        "column_name", "rows", "present", "total", (F.col("__centre") + F.col("__off") / size).alias("mean"),
        F.greatest(F.lit(0.0), F.col("__square") - F.col("__off") * F.col("__off") / size).alias("m2"),
        "low", "high", "distinct_sketch", "quantile_sketch")


def state_metrics(states: DataFrame, *, db_name: str, table_name: str, as_of=None, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The metrics of a table from the states of its slices, in the form of stored metric rows."""
    n = F.nullif(F.col("present").cast("double"), F.lit(0.0))
    numeric = F.col("low").isNotNull()

    def entry(metric: str, value: Column, when: Column | None = None) -> Column:
        shown = F.struct(F.lit(metric).alias("metric"), value.cast("double").alias("value"))
        return shown if when is None else F.when(when, shown)

    metrics = [
        entry("Size", F.col("rows")), entry("Completeness", F.col("present") / F.col("rows")),
        entry("ApproxCountDistinct", F.coalesce(F.hll_sketch_estimate("distinct_sketch"), F.lit(0))),
        entry("Minimum", F.col("low"), numeric), entry("Maximum", F.col("high"), numeric), entry("Mean", F.col("mean"), numeric),
        entry("Sum", F.col("total"), numeric), entry("StandardDeviation", F.sqrt(F.col("m2") / n), numeric),
        *[entry(f"ApproxQuantile({q})", F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(float(q))), numeric) for q in quantiles],
    ]
    return merged_states(states).select("column_name", F.inline(F.array_compact(F.array(*metrics)))).select(
        F.lit(db_name).alias("db_name"), F.lit(table_name).alias("table_name"), "column_name", "metric", "value",
        stamp(as_of).alias("audit_create_date"), month_key(as_of).alias("create_month_prtn"))


def new_slices(df: DataFrame, column: str, states: DataFrame) -> DataFrame:
    """The rows of slices that have no state yet.  Slices are values of a partition column, as many
    as the table has partitions; the filter on them keeps the scan to the new ones."""
    held = {r[0] for r in states.select(SLICE).distinct().collect()}
    there = [r[0] for r in df.select(quoted(column)).distinct().collect()]
    texts = df.sparkSession.createDataFrame([(v,) for v in there], df.select(quoted(column)).schema) if there else None
    named = [] if texts is None else [tuple(r) for r in texts.select(quoted(column), quoted(column).cast("string")).collect()]
    fresh = [v for v, text in named if text not in held]
    known = [v for v in fresh if v is not None]
    wanted = quoted(column).isin(known) if known else F.lit(False)
    return df.filter(wanted | quoted(column).isNull() if None in fresh else wanted)
