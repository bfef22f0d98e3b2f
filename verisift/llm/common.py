"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verisift.session import settle

# ASCII white space: blank, tab, line feed, vertical tab, form feed, carriage return
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
NOT_WHITE = r"[^\x20\x09-\x0D]"

# A side of a join is broadcast only if a count shows that it has no more rows than this
BROADCAST_ROWS = 50_000
# Rows of one key that a join leaves together, and the number of larger keys that are broadcast
HOT_ROWS = 200
HOT_KEYS = 200_000


# Arrow batches that a Python worker holds at a time; whole texts make large rows
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the library from where the driver has it
    (other machines get it the usual way, installed or with --py-files), and keeps the batches
    they are given small."""
    for name, value in ARROW_BATCH.items():
        spark.conf.set(name, value)
    root, known = str(Path(__file__).parents[2]), spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([root, *paths])


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Hands workers more rows at a time in what is computed inside, for rows known to be narrow."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text: longest runs without ASCII white space."""
    inner = F.trim(text, F.lit(WHITE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WHITE_RUN))


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a stored table for broadcast if its row count is within the bound; a larger one
    is left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_hot(rows: DataFrame, keys: Sequence[str], right: DataFrame, by: Sequence[str], unit: int = HOT_ROWS) -> DataFrame:
    """Inner join of rows with a table that has each key once, so that no key's rows land in one task.

    `right` is stored and its column `size` says how many of the rows have the key.  Rows of a key
    beyond the unit are dealt to salts by a hash of the `by` columns, and the key's row on the right is
    repeated for each salt; other keys are joined as they are."""
    salts = F.ceil(F.col("size") / unit)
    hot = right.where(F.col("size") > unit).select(*[F.col(k).alias(f"_hot_{k}") for k in keys], salts.alias("_salts"))
    marked = rows.join(broadcast_if_small(hot, HOT_KEYS), [F.col(k) == F.col(f"_hot_{k}") for k in keys], "left")
    dealt = marked.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*by), "_salts"), F.lit(0))).drop("_salts", *[f"_hot_{k}" for k in keys])
    spread = right.drop("size").withColumn("_salt", F.lit(0).cast("long")).union(
        right.where(F.col("size") > unit).withColumn("_salt", F.explode(F.sequence(F.lit(1).cast("long"), salts - 1))).drop("size"))
    return dealt.join(spread, [*keys, "_salt"]).drop("_salt")


def wrapped(df: DataFrame, **keys: Column) -> DataFrame:
    """The rows as one struct column `row` beside key columns, so that no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[k.alias(n) for n, k in keys.items()])


def unwrapped(columns: Sequence[str], **changed: Column) -> list[Column]:
    """The columns of wrapped rows in their order; `changed` ones are replaced or added."""
    kept = [changed[c].alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in columns]
    return kept + [v.alias(n) for n, v in changed.items() if n not in columns]


__all__ = ["BROADCAST_ROWS", "NOT_WHITE", "WHITE", "WHITE_RUN", "batches_of", "broadcast_if_small", "importable", "join_hot", "settle", "table",
           "text_of", "unwrapped", "words_of", "wrapped"]
