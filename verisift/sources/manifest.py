"""Which input files a table has been loaded from.

The manifest is a small table beside the target: path, size and modification time of every
file, with the load it belongs to.  A load is entered as pending before its rows are appended
and as done afterwards.  A run that finds a pending load (the driver was lost in between) looks
for its files in the one partition that it would have written, so no run has to read the target
to find out what is new."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisift.functions.expressions import stamp

COLUMNS = ("file_path string, file_size bigint, file_modified timestamp, load_id string, loaded_at timestamp, state string")
PENDING, DONE, DROPPED = "pending", "done", "dropped"


def manifest_name(table: str) -> str:
    return f"{table}__files"


def create_manifest(spark: SparkSession, table: str) -> str:
    name = manifest_name(table)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({COLUMNS}) USING parquet")
    return name


def _enter(files: DataFrame, table: str, load_id: str, loaded_at: datetime, state: str) -> None:
    rows = files.select("file_path", "file_size", "file_modified", F.lit(load_id).alias("load_id"),
                        F.lit(loaded_at).cast("timestamp").alias("loaded_at"), F.lit(state).alias("state"))
    rows.coalesce(1).write.mode("append").insertInto(manifest_name(table))  # one row per input file of a run


def loads(spark: SparkSession, table: str) -> DataFrame:
    """Files per load with its last state."""
    rows = spark.table(manifest_name(table))
    return rows.groupBy("load_id", "file_path").agg(
        F.max("loaded_at").alias("loaded_at"), F.max("file_size").alias("file_size"), F.max("file_modified").alias("file_modified"),
        F.max(F.when(F.col("state") != PENDING, F.col("state"))).alias("ended"))


def loaded_files(spark: SparkSession, table: str) -> DataFrame:
    """``file_path, file_size, file_modified`` of the files whose rows the table holds."""
    return loads(spark, table).filter(F.col("ended") == DONE).select("file_path", "file_size", "file_modified")


def begin(files: DataFrame, table: str, loaded_at: datetime) -> str:
    """Enter the files of a load that is about to be written; returns its id."""
    load_id = uuid.uuid4().hex
    _enter(files, table, load_id, loaded_at, PENDING)
    return load_id


def finish(files: DataFrame, table: str, load_id: str, loaded_at: datetime, state: str = DONE) -> None:
    _enter(files, table, load_id, loaded_at, state)


def recover(spark: SparkSession, table: str) -> None:
    """Settle loads that were begun but not finished: done if their rows arrived, else dropped.

    Only the partition of the load's time is read."""
    open_loads = loads(spark, table).filter("ended IS NULL")
    for load in open_loads.select("load_id", "loaded_at").distinct().collect():  # at most one per lost driver
        files = open_loads.filter(F.col("load_id") == load["load_id"])
        arrived = spark.table(table).filter(F.col("incr_ingest_timestamp") == F.lit(load["loaded_at"])).select("file_path").distinct()
        # files without rows leave no trace: a load that arrived at all arrived as a whole
        found = not files.join(arrived, "file_path", "left_semi").isEmpty()
        finish(files, table, load["load_id"], load["loaded_at"], DONE if found else DROPPED)


def adopt(files: DataFrame, table: str, as_of: datetime | str | None) -> None:
    """A manifest for a table that was loaded before it had one: the listed files whose rows it
    holds (the one time that the target's lineage is read)."""
    spark = files.sparkSession
    create_manifest(spark, table)
    held = spark.table(table).select("file_path").distinct()
    now = instant(spark, as_of)
    finish(files.join(held, "file_path", "left_semi"), table, "adopted", now)


def instant(spark: SparkSession, as_of: datetime | str | None) -> datetime:
    """The time of a load, fixed for all its writes."""
    return spark.range(1).select(stamp(as_of).alias("t")).first()["t"]
