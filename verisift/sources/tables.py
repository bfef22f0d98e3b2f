"""Table, SQL, relational and in-memory sources."""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verisift.functions.expressions import quoted

# Fixed value: tables whose name contains this text are not listed
LISTING_EXCLUDED = "athena"


def from_pandas(spark: SparkSession, pdf: pd.DataFrame, schema: T.StructType | str | None = None) -> DataFrame:
    """A pandas frame as a table; missing numbers become null, not NaN."""
    df = spark.createDataFrame(pdf) if schema is None else spark.createDataFrame(pdf, schema)
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.when(~F.isnan(quoted(f.name)), quoted(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else quoted(f.name)
        for f in df.schema.fields
    ])


def list_tables(spark: SparkSession, db_name: str, names: str | None = None) -> list[str]:
    """Given comma-separated names, or every table of the database."""
    if names:
        return [n.strip() for n in names.split(",") if n.strip()]
    return [
        t.name for t in spark.catalog.listTables(db_name)
        if not t.isTemporary and LISTING_EXCLUDED not in t.name.lower()
    ]


def source_frame(
    spark: SparkSession,
    *,
    db_name: str | None = None,
    table_name: str | None = None,
    sql: str | None = None,
    data: DataFrame | None = None,
    where: str | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """Given data, else the rows of a query, else a catalog table; then filter and columns.

    The filter is applied before the projection so it may use columns that are not kept.
    It does not apply to given data."""
    if data is not None:
        df = data
    else:
        if sql:
            df = spark.sql(sql)
        else:
            df = spark.table(f"{db_name}.{table_name}" if db_name else table_name)
        if where:
            df = df.filter(F.expr(where))
    return df.select(*[quoted(c) for c in columns]) if columns else df


def read_relational(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    partition_column: str | None = None,
    bounds: tuple[Any, Any] | None = None,
    partitions: int | None = None,
    **options: str,
) -> DataFrame:
    """A table of a relational database.  With a partition column and its bounds the table
    is read by parallel range queries; without, by a single task."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column is not None:
        if bounds is None or partitions is None:
            raise ValueError("a partitioned read needs bounds and a number of partitions")
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]), numPartitions=str(partitions),
        )
    return reader.load()


def sample_rows(df: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` rows with dates and times as ISO text."""
    if n < 1:
        raise ValueError("n must be positive")
    patterns = {T.DateType: "yyyy-MM-dd"}
    columns = []
    for f in df.schema.fields:
        col = quoted(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss").alias(f.name)
        elif type(f.dataType) in patterns:
            col = F.date_format(col, patterns[type(f.dataType)]).alias(f.name)
        columns.append(col)
    return df.limit(n).select(*columns)
