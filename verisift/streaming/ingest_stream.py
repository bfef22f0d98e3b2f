"""The ingest job as an incremental stream: each run picks up files not seen before."""

from __future__ import annotations

from typing import Any, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from verisift.plans.ingest import is_set, shape, source_schema


def stream_scan(spark: SparkSession, conf: Mapping[str, Any]) -> DataFrame:
    """Input folder as a stream.  With ``filedel_ind`` set files are deleted once
    the batch after theirs is done; the default keeps them."""
    reader = spark.readStream
    if is_set(conf.get("filedel_ind")):
        reader = reader.option("cleanSource", "delete")
    if conf.get("max_files"):
        reader = reader.option("maxFilesPerTrigger", int(conf["max_files"]))
    if conf["type"] == "csv":
        return (
            reader.option("header", is_set(conf.get("include_header")))
            .option("delimiter", conf.get("delimiter", ","))
            .schema(source_schema(conf))
            .csv(conf["file_path"])
        )
    return reader.text(conf["file_path"])


def ingest_stream(spark: SparkSession, conf: Mapping[str, Any]) -> StreamingQuery:
    """Start loading all files that are not in the checkpoint yet, then stop.

    The checkpoint is what makes a file load exactly once, also when executors or the
    driver are lost in between."""
    rows = shape(stream_scan(spark, conf), conf)
    return (
        rows.writeStream.format("parquet")
        .option("path", conf["location"])
        .option("checkpointLocation", conf["checkpoint"])
        .partitionBy("incr_ingest_timestamp")
        .trigger(availableNow=True)
        .start()
    )
