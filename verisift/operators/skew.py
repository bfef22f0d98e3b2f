"""Joins and top-n that stay even when one value fills a large part of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verisift.functions.expressions import quoted
from verisift.session import settle

# Intermediate groups of a per-group top-n.
SPREAD = 64

# Slices of the hash range, as a power of two, from which a sample's bound is read.
SLICE_BITS = 12


# Rows of one value that a join leaves together, parts that one value is dealt to at most, and
# values with more rows that are broadcast (a value and a number each).
ROWS_TOGETHER = 1024
MOST_SALTS = 4096
BROADCAST_VALUES = 100_000


def rows_with_values(df: DataFrame, columns: list[str], counts: DataFrame, salts: int = MOST_SALTS) -> DataFrame:
    """Rows of ``df`` whose values appear in ``counts`` (same columns and ``__n``, the rows of each
    value), nulls matching nulls.

    The counts are stored first.  A value with few rows is joined as it is; one with more is
    dealt to as many salts as its rows need (``salts`` at most), and only such values are repeated
    for their salts.  So no task receives more than a part of one value's rows."""
    stored = settle(counts)
    hot = stored.filter(F.col("__n") > ROWS_TOGETHER)
    n_hot = hot.limit(BROADCAST_VALUES + 1).count()
    keys = [quoted(c).alias(f"__k{i}") for i, c in enumerate(columns)]

    def same(prefix: str) -> Column:
        found = F.lit(True)
        for i, c in enumerate(columns):
            found = found & quoted(c).eqNullSafe(F.col(f"{prefix}{i}"))
        return found

    if n_hot == 0:
        return df.join(stored.select(*keys), same("__k"), "left_semi")
    parts = F.least(F.ceil(F.col("__n") / ROWS_TOGETHER), F.lit(salts)).cast("long")
    listed = stored.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("__k_salt"))
    dealt = hot.select(*[quoted(c).alias(f"__h{i}") for i, c in enumerate(columns)], parts.alias("__parts"))
    marked = df.join(F.broadcast(dealt) if n_hot <= BROADCAST_VALUES else dealt, same("__h"), "left")
    salted = marked.select(
        *[quoted(c) for c in df.columns],
        F.pmod(F.monotonically_increasing_id(), F.coalesce("__parts", F.lit(1).cast("long"))).alias("__salt"))
    return salted.join(listed, same("__k") & (F.col("__salt") == F.col("__k_salt")), "left_semi").drop("__salt")


def first_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of every group.

    Each input partition keeps at most ``n`` rows per group, then one of ``SPREAD``
    intermediate groups does, so the last step sorts at most ``SPREAD * n`` rows of a
    group however large the group is.  The intermediate grouping does not affect the
    result: the order decides.
    """
    spread = df.withColumn("__part", F.pmod(F.spark_partition_id(), F.lit(SPREAD)))
    local = W.partitionBy(group, "__part").orderBy(*order)
    whole = W.partitionBy(group).orderBy(*order)
    return (
        spread.withColumn("__rank", F.row_number().over(local))
        .filter(F.col("__rank") <= n)
        .drop("__part")
        .withColumn("__rank", F.row_number().over(whole))
        .filter(F.col("__rank") <= n)
    )


def order_hash(*columns: Column) -> Column:
    """Non-negative hash that orders the rows of a sample."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 1)


def slice_of(order: Column) -> Column:
    """Slice of the hash range a row falls into; grows with its hash."""
    return F.shiftright(order, 63 - SLICE_BITS).cast("int")


def discrete_quantile(counts: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """``group, quantile``: the first value at which a share of ``q`` of a group's rows is reached.

    ``counts`` has a row per group and value with its number of rows ``__n``.  The values are sorted
    over many tasks; sums per task tell which of them holds the quantile, and only its rows are
    added up one by one."""
    rows = settle(counts.filter(quoted(value).isNotNull()).orderBy(quoted(group), quoted(value)).withColumn(
        "__row", F.monotonically_increasing_id()))
    task = F.shiftright("__row", 33)
    sums = rows.groupBy(quoted(group).alias("__group"), task.alias("__task")).agg(F.sum("__n").alias("__sum"))  # rows: tasks and groups
    reached = F.sum("__sum").over(W.partitionBy("__group").orderBy("__task"))
    wanted = F.greatest(F.lit(1), F.ceil(F.sum("__sum").over(W.partitionBy("__group")) * F.lit(float(q))))
    placed = sums.select("__group", "__task", "__sum", reached.alias("__reached"), wanted.alias("__wanted"))
    held = placed.filter((F.col("__reached") >= F.col("__wanted")) & (F.col("__reached") - F.col("__sum") < F.col("__wanted"))).select(
        "__group", "__task", (F.col("__wanted") - F.col("__reached") + F.col("__sum")).alias("__left"))
    near = rows.join(held, quoted(group).eqNullSafe(F.col("__group")) & (task == F.col("__task")))
    upto = F.sum("__n").over(W.partitionBy(quoted(group)).orderBy(quoted(value)))
    return near.withColumn("__upto", upto).filter("__upto >= __left").groupBy(quoted(group)).agg(F.min(quoted(value)).alias("quantile"))


def sample_bounds(rows: DataFrame, group: str, slice_name: str, n: int) -> DataFrame:
    """``group, __bound``: the slice up to which a group's first ``n`` rows in hash order
    are certain to lie.

    Rows are only counted per slice, which combines before the shuffle; the result has one
    row per group."""
    return bounds_of_counts(rows.groupBy(group, slice_name).agg(F.count(F.lit(1)).alias("__n")), group, slice_name, n)


def bounds_of_counts(counts: DataFrame, group: str, slice_name: str, n: int) -> DataFrame:
    """The same from ``group, slice, __n``."""
    before = F.sum("__n").over(W.partitionBy(group).orderBy(slice_name)) - F.col("__n")
    needed = counts.withColumn("__before", before).filter(F.col("__before") < n)
    return needed.groupBy(group).agg(F.max(slice_name).alias("__bound"))
