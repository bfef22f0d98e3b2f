"""File scans."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verisift.functions import constants as C


def file_name() -> Column:
    """Base name of the file a row comes from.  The scan reports it in URL form, in which a
    plus sign stands for itself."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def file_path() -> Column:
    """Full path of the file a row comes from, with one slash after the scheme however the
    scan writes it."""
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, r"^([A-Za-z][\w+.-]*):/+", "$1:/")


def text_fields(names: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    *,
    infer_schema: bool = True,
    header: bool = True,
    multi_line: bool = False,
    schema: T.StructType | None = None,
) -> DataFrame:
    """CSV with a header and quotes escaped by doubling.

    ``multi_line`` reads quoted line breaks, but then a file cannot be split and one task reads
    it.  A schema saves the inference pass over the data."""
    reader = (
        spark.read.option("header", header)
        .option("multiLine", multi_line)
        .option("escape", '"')
    )
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", infer_schema).csv(path)


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    *,
    header: bool,
    delimiter: str,
) -> DataFrame:
    """Delimited files with a declared schema; a folder, glob or list is one scan."""
    return (
        spark.read.option("header", header).option("delimiter", delimiter).schema(schema).csv(path)
    )


def read_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per line, in column ``value``."""
    return spark.read.text(path)


def _piped(spark: SparkSession, path: str) -> DataFrame:
    # The header decides which of the optional columns exist, so names are read first
    # (one line); every column is text, no inference.
    header = spark.read.option("sep", "|").option("header", True).csv(path).schema.names
    return spark.read.option("sep", "|").option("header", True).schema(text_fields(tuple(header))).csv(path)


def read_rules_file(spark: SparkSession, path: str) -> DataFrame:
    """Constraint rules from a ``|``-separated file, all columns text."""
    return _piped(spark, path)


def read_scope_file(spark: SparkSession, path: str) -> DataFrame:
    """Profile scope from a ``|``-separated file, all columns text."""
    return _piped(spark, path)


def read_keyed_json(spark: SparkSession, path: str, record: T.StructType | str, id_name: str = "id") -> DataFrame:
    """Files that each hold one JSON object from id to record, as one row per record."""
    record_type = record if isinstance(record, str) else record.simpleString()
    if not record_type.startswith("struct<"):
        record_type = f"struct<{record_type}>"
    parsed = spark.read.text(path, wholetext=True).select(
        F.from_json("value", f"map<string,{record_type}>").alias("m")
    )
    return explode_keyed(parsed, "m", id_name)


def explode_keyed(df: DataFrame, column: str, id_name: str = "id") -> DataFrame:
    """A column holding a map from id to record, as one row per record."""
    return df.select(F.explode(column).alias(id_name, "record")).select(id_name, "record.*")


def read_documents(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A collection of JSON documents, one per line."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file_path, file_name, file_size, file_modified`` of the input files, without reading
    their content."""
    listed = spark.read.format("binaryFile").load(path)
    return listed.select(
        file_path().alias("file_path"), file_name().alias("file_name"), F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_modification_time").alias("file_modified"))


def literal_path(path: str) -> str:
    """A listed path as a reader takes it: characters that would make it a pattern are escaped."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def move_file(spark: SparkSession, folder: str, target: str) -> None:
    """Give the one data file of a written folder a path of its own."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(folder)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [s.getPath() for s in store.listStatus(where) if s.getPath().getName().startswith("part-")]
    if len(parts) != 1:
        raise ValueError(f"{folder} holds {len(parts)} data files, not one")
    goal = hadoop.Path(target)
    store.mkdirs(goal.getParent())
    if not store.rename(parts[0], goal):
        raise OSError(f"cannot move {parts[0]} to {target}")


def delete_files(spark: SparkSession, paths: list[str]) -> None:
    """Remove files by their listed paths; those that are gone already are no error."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, False)


def require_rows(df: DataFrame, message: str = "the input has no rows") -> DataFrame:
    """The same frame; raises when it has no rows.  Reads until the first row only."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def with_file_name(df: DataFrame, name: str = "file_name") -> DataFrame:
    """Adds the base name of the file each row came from."""
    return df.select("*", file_name().alias(name))


RULES_FILE_SCHEMA = text_fields(C.RULE_COLUMNS + C.NOTIFY_COLUMNS)
SCOPE_FILE_SCHEMA = text_fields(C.SCOPE_COLUMNS)
