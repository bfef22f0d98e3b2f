"""File ingestion: delimited or text files into a partitioned table."""

from __future__ import annotations

import json
import uuid
from datetime import datetime
from typing import Any, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from verisift.functions.schemas import parse_schema
from verisift.operators.conform import (
    clean_columns, conform, mask_columns, only_new_files, rename_by_position, with_lineage,
)
from verisift.session import settle
from verisift.sources import manifest
from verisift.sources.files import delete_files, list_files, literal_path, read_delimited, read_text, require_rows
from verisift.sources.sinks import append_by_name, create_table_from

NO_FILES = "no input files at the configured path"
LINEAGE = 3  # columns that with_lineage adds
TEXT_SCHEMA = T.StructType([T.StructField("value", T.StringType(), True)])


def _dollar_columns(conf: Mapping[str, Any]) -> list[str]:
    return str(conf.get("columnsWithDollar") or "").split(",")


def is_set(value: Any) -> bool:
    """A flag given as a boolean or as text (Y, yes, true, 1 in any case)."""
    return value is True or str(value).strip().lower() in ("y", "yes", "true", "1")


def _masking(conf: Mapping[str, Any]) -> Mapping[str, Any]:
    """Masking rules, given as a mapping or as JSON text (``maskingRulesStr``)."""
    if not is_set(conf.get("dataMasking")):
        return {}
    return conf.get("maskingRules") or json.loads(conf.get("maskingRulesStr") or "{}")


def source_schema(conf: Mapping[str, Any]) -> T.StructType:
    return parse_schema(conf["schema"]) if conf["type"] == "csv" else TEXT_SCHEMA


def scan(spark: SparkSession, conf: Mapping[str, Any], paths: list[str] | None = None) -> DataFrame:
    """All input files, or the given ones (by their listed paths), as one scan."""
    where = conf["file_path"] if paths is None else [literal_path(p) for p in paths]
    if conf["type"] == "csv":
        return read_delimited(
            spark, where, source_schema(conf),
            header=is_set(conf.get("include_header")), delimiter=conf.get("delimiter", ","),
        )
    return read_text(spark, where)


def new_listing(spark: SparkSession, conf: Mapping[str, Any], table: str, as_of: datetime | str | None = None) -> DataFrame:
    """The listed input files that the table's manifest doesn't know."""
    listed = list_files(spark, conf["file_path"])
    if spark.catalog.tableExists(manifest.manifest_name(table)):
        manifest.recover(spark, table)
    else:
        manifest.adopt(listed, table, as_of)
    return only_new_files(listed, manifest.loaded_files(spark, table))


def new_files(spark: SparkSession, conf: Mapping[str, Any], table: str) -> list[str]:
    """Paths of input files the table holds no rows of.

    The driver lists the input folder for any scan, so the result is never larger than
    what it already handles; what was loaded is read from the manifest."""
    return [r["file_path"] for r in new_listing(spark, conf, table).select("file_path").collect()]


def shape(df: DataFrame, conf: Mapping[str, Any], as_of: datetime | str | None = None) -> DataFrame:
    """Conform, lineage, rename, clean and mask; works on batch and streaming scans.

    The source columns are already typed by the scan's schema, so conforming happens
    before the lineage columns are added and keeps them and the new names intact."""
    schema = source_schema(conf)
    target = parse_schema(conf["target_schema"]) if conf.get("target_schema") else None
    stamped = with_lineage(df, as_of)
    typed = conform(stamped, T.StructType([*schema.fields, *stamped.schema.fields[-LINEAGE:]]))
    renamed = rename_by_position(typed, schema, target)
    return mask_columns(clean_columns(renamed, _dollar_columns(conf)), _masking(conf))


def ingest(
    spark: SparkSession, conf: Mapping[str, Any], *, as_of: datetime | str | None = None
) -> DataFrame:
    """Load the configured files; returns the table.

    An existing table with ``append_ind`` set receives only files its manifest doesn't list
    yet, and only those are read (with ``pick_all_files`` set, a text job that finds a new file
    loads the whole folder again); otherwise the table is created or replaced, with its
    manifest.  Input files are left in place unless ``filedel_ind`` is set: then those that the
    manifest lists as loaded are deleted at the end, also after a run that was cut off."""
    table = f"{conf['table_schema']}.{conf['table_name']}"
    now = manifest.instant(spark, as_of)
    if spark.catalog.tableExists(table) and is_set(conf.get("append_ind")):
        listed = settle(list_files(spark, conf["file_path"]))
        require_rows(listed, NO_FILES)
        fresh = settle(new_listing(spark, conf, table, as_of))
        if not fresh.isEmpty():
            whole = conf["type"] != "csv" and is_set(conf.get("pick_all_files"))
            paths = None if whole else [r["file_path"] for r in fresh.select("file_path").collect()]
            rows = shape(require_rows(scan(spark, conf, paths)), conf, now)
            load_id = manifest.begin(fresh, table, now)
            append_by_name(rows, table)
            manifest.finish(fresh, table, load_id, now)
    else:
        listed = settle(list_files(spark, conf["file_path"]))
        require_rows(listed, NO_FILES)
        rows = shape(require_rows(scan(spark, conf, [r["file_path"] for r in listed.select("file_path").collect()])), conf, now)
        create_table_from(rows, conf["table_schema"], conf["table_name"], conf["location"])
        spark.sql(f"DROP TABLE IF EXISTS {manifest.manifest_name(table)}")
        manifest.create_manifest(spark, table)
        manifest.finish(listed, table, uuid.uuid4().hex, now)
    if is_set(conf.get("filedel_ind")):
        done = listed.join(manifest.loaded_files(spark, table), "file_path", "left_semi")
        delete_files(spark, [r["file_path"] for r in done.select("file_path").collect()])
    spark.catalog.refreshTable(table)
    return spark.table(table)
