"""Where intermediate results go."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the session.

    A session that names none gets one below its warehouse, which executors share too."""
    named = spark.conf.get(CHECKPOINT_SETTING, None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session ends."""
    path = f"{shared_dir(spark).rstrip('/')}/verisift/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def release(spark: SparkSession) -> None:
    """Lets go of what finished jobs left (plans, broadcasts, shuffle files).

    Spark drops these when the driver collects its garbage, which may take as long as its heap has room."""
    spark._jvm.System.gc()


def settle(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage: the result is written to the shared folder and
    read back, so later steps neither repeat the work nor depend on live executors."""
    path = scratch_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
