"""Dataset and column profiles.

One aggregate computes every scalar statistic.  Exact distinct counts and the most frequent
values come from one grouping of ``(column, digest)`` pairs of all columns: a value travels as
its 128-bit digest, a text with its first ``HEAD`` characters.  Partial counts are combined
before the shuffle, so a frequent value costs one row per task.  The counts yield the texts that
can be among the most frequent (all that tie at the boundary included); only the longer ones of
these are fetched by a second pass.  ``exact=False`` replaces distinct counts by sketches inside
the first aggregate and groups only the text columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verisift.functions import constants as C
from verisift.functions.expressions import distinct_key, percent, quoted, row_json, tally
from verisift.session import settle

from .skew import first_per_group

# Columns per aggregate; a very wide table is covered by several scans of disjoint columns.
COLUMNS_PER_SCAN = 60
# Characters of a text that travel with its digest
HEAD = 32
# Texts (by digest) to be fetched that a join may broadcast, 20 bytes each
BROADCAST_DIGESTS = 200_000

Fields = list[tuple[int, T.StructField]]


def _column_chunks(df: DataFrame) -> list[Fields]:
    fields = list(enumerate(df.schema.fields))
    return [fields[i:i + COLUMNS_PER_SCAN] for i in range(0, len(fields), COLUMNS_PER_SCAN)]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def _round2(value: Column) -> Column:
    return F.round(value.cast("double"), 2)


def _statistics(field: T.StructField, i: int, exact: bool) -> list[Column]:
    """Scalar statistics of one column, all part of the same aggregate."""
    col = quoted(field.name)
    out = [F.count(col).alias(f"nn{i}")]
    if not exact:
        out.append(F.approx_count_distinct(distinct_key(field)).alias(f"ad{i}"))
    if _is_numeric(field.dataType):
        out += [
            F.min(col).cast("string").alias(f"min{i}"),
            F.max(col).cast("string").alias(f"max{i}"),
            F.min(col).cast("double").alias(f"lo{i}"),
            F.max(col).cast("double").alias(f"hi{i}"),
            F.avg(col).alias(f"mean{i}"),
            F.stddev_samp(col).alias(f"std{i}"),
        ]
    elif isinstance(field.dataType, T.StringType):
        size = F.length(col)
        out += [
            F.min(size).alias(f"minlen{i}"),
            F.max(size).alias(f"maxlen{i}"),
            F.avg(size).alias(f"avglen{i}"),
        ]
    return out


def _scalar_rows(df: DataFrame, fields: Fields, exact: bool) -> DataFrame:
    """One row per column from one wide aggregate."""
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[s for i, f in fields for s in _statistics(f, i, exact)],
    )
    rows = []
    for i, f in fields:
        numeric = _is_numeric(f.dataType)
        text = isinstance(f.dataType, T.StringType)

        def pick(name: str, when: bool, dtype: str) -> Column:
            return (F.col(f"{name}{i}") if when else F.lit(None)).cast(dtype)

        rows.append(F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col("rows").alias("row_count"),
            F.col(f"nn{i}").alias("non_null_count"),
            (F.col("rows") - F.col(f"nn{i}")).alias("null_count"),
            pick("ad", not exact, "bigint").alias("approx_distinct"),
            pick("min", numeric, "string").alias("min_value"),
            pick("max", numeric, "string").alias("max_value"),
            pick("lo", numeric, "double").alias("min_number"),
            pick("hi", numeric, "double").alias("max_number"),
            _round2(pick("mean", numeric, "double")).alias("mean_value"),
            _round2(pick("std", numeric, "double")).alias("stddev"),
            pick("minlen", text, "int").alias("min_length"),
            pick("maxlen", text, "int").alias("max_length"),
            _round2(pick("avglen", text, "double")).alias("avg_length"),
        ))
    return wide.select(F.inline(F.array(*rows)))


def _text_fields(df: DataFrame) -> Fields:
    return [(i, f) for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, T.StringType)]


def _hashed(field: T.StructField) -> Column:
    """What is digested: equal for two values exactly when Spark groups them together."""
    col = quoted(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return col + F.lit(0).cast(field.dataType)  # -0.0 groups with 0.0
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return distinct_key(field)
    return col


def _digests_of(fields: Fields) -> list[Column]:
    """``k1_i, k2_i``: the digest of each column's value, null for null."""
    return [
        F.when(quoted(f.name).isNotNull(), digest).alias(f"{name}_{i}")
        for i, f in fields
        for name, digest in (("k1", F.xxhash64(_hashed(f))), ("k2", F.xxhash64(F.lit("second"), _hashed(f))))
    ]


def _unpivoted(df: DataFrame, fields: Fields, names: str) -> DataFrame:
    """``position`` and the columns of ``names`` (each present as ``name_position``), a row per
    column and row of the table; rows that are null in all of them are left out."""
    listed = names.split(", ")
    blocks = ", ".join(f"({', '.join(f'{n}_{i}' for n in listed)}) AS `{i}`" for i, _ in fields)
    text = f"SELECT CAST(place AS INT) AS position, {names} FROM {{given}} UNPIVOT (({names}) FOR place IN ({blocks}))"
    return df.sparkSession.sql(text, given=df)


def value_digests(df: DataFrame, fields: Fields) -> DataFrame:
    """``position, k1, k2, head, n`` for every distinct non-null value of the columns."""
    heads = [
        (F.substring(quoted(f.name), 1, HEAD) if isinstance(f.dataType, T.StringType) else F.lit(None).cast("string")).alias(f"head_{i}")
        for i, f in fields
    ]
    chosen = df.select(*_digests_of(fields), *heads)
    # Never null, so no join on it adds a null filter that would keep plans from being shared
    counts = _unpivoted(chosen, fields, "k1, k2, head").groupBy("position", "k1", "k2", "head").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("position", F.coalesce("position", F.lit(-1)))


def _nearest(digests: DataFrame, n: int) -> DataFrame:
    """The texts that can be among the ``n`` most frequent of their column: by count, then by
    the first characters, with all that tie."""
    order = [F.col("n").desc(), F.col("head").asc()]
    # depends on n, so it stays above the grouping, which both uses of the counts can share then
    texts = digests.filter(F.when(F.col("n") > 0, F.col("head")).isNotNull())
    local = texts.withColumn(
        "__place", F.rank().over(W.partitionBy("position", F.pmod("k1", F.lit(64))).orderBy(*order))).filter(F.col("__place") <= n)
    return local.withColumn("__place", F.rank().over(W.partitionBy("position").orderBy(*order))).filter(F.col("__place") <= n).drop("__place")


def _fetched(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """``position, k1, k2, value`` of stored digests, read from the table; each task sends a text once."""
    places = {r["position"] for r in wanted.select("position").distinct().collect()}
    fields = [(i, f) for i, f in _text_fields(df) if i in places]
    chosen = df.select(*_digests_of(fields), *[quoted(f.name).alias(f"value_{i}") for i, f in fields])
    keys = wanted.select("position", "k1", "k2")
    few = keys.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    found = _unpivoted(chosen, fields, "k1, k2, value").join(F.broadcast(keys) if few else keys, ["position", "k1", "k2"], "left_semi")
    return found.groupBy("position", "k1", "k2").agg(F.min("value").alias("value"))


def value_summary(df: DataFrame, fields: Fields, n: int) -> tuple[DataFrame, DataFrame]:
    """``position, exact_distinct, present`` per column with values, and ``position, value, n,
    __rank``: the ``n`` most frequent values of the text columns, ties broken by value.

    Both come from one grouping; stored are one row per column and the frequent texts."""
    digests = value_digests(df, fields)
    counts = digests.groupBy("position").agg(
        F.count(F.when(F.col("n") > 0, 1)).alias("exact_distinct"), F.sum("n").alias("present"))
    both = settle(
        counts.select("position", F.col("exact_distinct").alias("distinct"), F.col("present").alias("n"),
                      *[F.lit(None).cast(t).alias(c) for c, t in (("k1", "bigint"), ("k2", "bigint"), ("head", "string"))])
        .unionByName(_nearest(digests, n).withColumn("distinct", F.lit(None).cast("bigint"))))
    distinct = both.filter("distinct IS NOT NULL").select("position", F.col("distinct").alias("exact_distinct"), F.col("n").alias("present"))
    nearest = both.filter("distinct IS NULL")
    short = nearest.filter(F.char_length("head") < HEAD).select("position", F.col("head").alias("value"), "n")
    longer = nearest.filter(F.char_length("head") >= HEAD)
    if not longer.isEmpty():
        texts = settle(_fetched(df, longer))
        short = short.unionByName(longer.join(texts, ["position", "k1", "k2"]).select("position", "value", "n"))
    return distinct, first_per_group(short, "position", [F.col("n").desc(), F.col("value").asc()], n)


def _top_lists(ranked: DataFrame) -> DataFrame:
    """Short ordered lists per column; at most ``DOMAIN_MAX_DISTINCT`` entries each."""
    entry = F.struct(F.col("__rank").alias("rank"), F.struct("value", F.col("n").alias("count")).alias("entry"))
    return ranked.groupBy("position").agg(
        F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["entry"]).alias("leading")
    )


def profile(df: DataFrame, *, exact: bool = True) -> DataFrame:
    """One row per column.

    ``top_values`` holds the ten most frequent values of text columns; ``domain_values``
    all values of a text column that has at most twenty.
    """
    fields = list(enumerate(df.schema.fields)) if exact else _text_fields(df)
    # All three have one row per column of the table.
    scalars = _union([_scalar_rows(df, chunk, exact) for chunk in _column_chunks(df)])
    if fields:
        distinct, ranked = value_summary(df, fields, C.DOMAIN_MAX_DISTINCT)
        joined = scalars.join(F.broadcast(distinct.drop("present")), "position", "left").join(
            F.broadcast(_top_lists(ranked)), "position", "left")
    else:
        joined = scalars.withColumn("exact_distinct", F.lit(None).cast("bigint")).withColumn(
            "leading", F.lit(None).cast("array<struct<value:string,count:bigint>>"))
    known = F.coalesce(F.col("exact_distinct"), F.col("approx_distinct"), F.lit(0).cast("bigint"))
    is_text = F.col("data_type") == "string"
    leading = F.coalesce(
        F.col("leading"), F.array().cast("array<struct<value:string,count:bigint>>")
    )
    return joined.select(
        "position", "column_name", "data_type", "row_count", "non_null_count", "null_count",
        percent(F.col("null_count"), F.col("row_count"), empty=0.0).alias("null_percentage"),
        known.alias("distinct_count"),
        percent(known, F.col("row_count"), empty=0.0).alias("uniqueness_ratio"),
        "min_value", "max_value", "min_number", "max_number", "mean_value", "stddev",
        "min_length", "max_length", "avg_length",
        F.when(is_text, F.slice(leading, 1, C.TOP_VALUES)).alias("top_values"),
        F.when(is_text & (known <= C.DOMAIN_MAX_DISTINCT), F.transform(leading, lambda e: e["value"]))
        .alias("domain_values"),
    )


def profile_document(df: DataFrame, *, dataset_id: str, source: str, exact: bool = True) -> DataFrame:
    """The whole profile as one nested row: counts, column blocks and the first rows."""
    columns = profile(df, exact=exact)
    blocks = columns.agg(
        F.sort_array(F.collect_list(F.struct(*columns.columns))).alias("column_profiles")
    )
    first = df.limit(C.PROFILE_SAMPLE_ROWS).select(row_json(df.columns, keep_nulls=True).alias("row"))
    return blocks.select(
        F.lit(dataset_id).alias("dataset_id"),
        F.lit(source).alias("source"),
        df.agg(F.count(F.lit(1))).scalar().alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        F.create_map(*[
            F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())
        ]).alias("dtypes"),
        "column_profiles",
        first.agg(F.collect_list("row")).scalar().alias("sample"),
    )


def dataset_listing(documents: DataFrame) -> DataFrame:
    """Identity and size of every profiled dataset."""
    return documents.select("dataset_id", "row_count", "column_count", "columns", "source")


# --- value classes ------------------------------------------------------------------

CLASSES = ("Integral", "Fractional", "Boolean", "String")

# First characters a value of another class than String can have
CLASS_STARTS = tuple("0123456789+- .tf")


def value_class(value: Column) -> Column:
    """Integral, Fractional, Boolean or String for a text value; null stays null.

    Most text is settled by its first character; an anchored pattern would still be tried
    at every position of a long text."""
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(~F.substring(value, 1, 1).isin(*CLASS_STARTS), "String")
        .when(value.rlike(C.INTEGRAL_PATTERN), "Integral")
        .when(value.rlike(C.FRACTIONAL_PATTERN), "Fractional")
        .when(value.rlike(C.BOOLEAN_PATTERN), "Boolean")
        .otherwise("String")
    )


def class_counts(cls: Column) -> list[Column]:
    """Aggregates counting each value class."""
    return [tally(cls == name) for name in CLASSES]


def widest_class(integral: Column, fractional: Column, boolean: Column, string: Column) -> Column:
    """The most general class present; booleans mixed with numbers are plain text."""
    numbers = integral + fractional
    return (
        F.when(numbers + boolean + string == 0, "Unknown")
        .when((string > 0) | ((boolean > 0) & (numbers > 0)), "String")
        .when(boolean > 0, "Boolean")
        .when(fractional > 0, "Fractional")
        .otherwise("Integral")
    )


def declared_class(dtype: T.DataType) -> str | None:
    """Class that follows from the column type; None for text, which is looked into."""
    if isinstance(dtype, T.StringType):
        return None
    if isinstance(dtype, T.IntegralType):
        return "Integral"
    if isinstance(dtype, (T.FractionalType,)):
        return "Fractional"
    if isinstance(dtype, T.BooleanType):
        return "Boolean"
    return "String"


def column_stats(df: DataFrame) -> DataFrame:
    """``position, column_name, rows, completeness, data_type, approx distinct, minimum``
    per column, from aggregates with no shuffle of values."""
    return _union([_stats_rows(df, chunk) for chunk in _column_chunks(df)])


def _stats_rows(df: DataFrame, fields: Fields) -> DataFrame:
    # The class of a text value is used several times below, so it is computed first.
    classed = df.select(
        *[quoted(f.name).alias(f"c{i}") for i, f in fields],
        *[distinct_key(f).alias(f"key{i}") for i, f in fields],
        *[value_class(quoted(f.name)).alias(f"cls{i}")
          for i, f in fields if declared_class(f.dataType) is None],
    )
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, f in fields:
        col = F.col(f"c{i}")
        aggregates.append(F.count(col).alias(f"nn{i}"))
        aggregates.append(F.approx_count_distinct(f"key{i}").alias(f"ad{i}"))
        if declared_class(f.dataType) is None:
            cls = F.col(f"cls{i}")
            aggregates += [c.alias(f"{n.lower()}{i}") for n, c in zip(CLASSES, class_counts(cls))]
            number = F.when(cls.isin("Integral", "Fractional"), col.try_cast("double"))
            aggregates.append(F.min(number).alias(f"lo{i}"))
        elif _is_numeric(f.dataType):
            aggregates.append(F.min(col).cast("double").alias(f"lo{i}"))
        else:
            aggregates.append(F.max(F.lit(None).cast("double")).alias(f"lo{i}"))
    wide = classed.agg(*aggregates)
    rows = []
    for i, f in fields:
        declared = declared_class(f.dataType)
        inferred = F.lit(declared) if declared else widest_class(
            *[F.col(f"{name}{i}") for name in ("integral", "fractional", "boolean", "string")]
        )
        share = F.when(F.col("rows") > 0, F.col(f"nn{i}") / F.col("rows")).otherwise(F.lit(1.0))
        rows.append(F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("declared_type"),
            F.col("rows").alias("row_count"),
            F.col(f"nn{i}").alias("non_null_count"),
            share.alias("completeness"),
            inferred.alias("data_type"),
            F.col(f"ad{i}").alias("approx_num_distinct_values"),
            F.col(f"lo{i}").alias("minimum"),
        ))
    return wide.select(F.inline(F.array(*rows)))
