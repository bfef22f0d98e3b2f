"""Table writes on plain files: append, replace a slice, upsert, compact.

Of a partitioned table only the partitions that a change touches are rewritten, by Spark's
dynamic partition overwrite; the files of all others stay.  A table that has no partitions of
its own can be created in hash buckets of its key (``create_bucketed``), so that a merge rewrites
the buckets of the changed keys only.  Any other table is rewritten as a whole, beside its old
files, and switched to the new ones when they are complete: a job that is lost on the way leaves
the table as it was.
"""

from __future__ import annotations

import json
import re
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verisift.functions.expressions import quoted
from verisift.session import settle

DYNAMIC = "spark.sql.sources.partitionOverwriteMode"
BUCKET = "hash_bucket"
BUCKET_KEYS = "verisift.bucket.keys"
BUCKET_NUMBER = "verisift.bucket.number"


def aligned(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in its order, matched by name without case; columns the rows lack
    are null."""
    target = df.sparkSession.table(table).schema
    if BUCKET in target.fieldNames() and BUCKET not in df.columns:
        df = in_buckets(df, *bucketing(df.sparkSession, table))
    given = {c.lower(): c for c in df.columns}
    unknown = set(given) - {n.lower() for n in target.fieldNames()}
    if unknown:
        raise ValueError(f"{table} lacks the columns {sorted(unknown)}; append_evolving adds them")
    return df.select(*[
        (quoted(given[f.name.lower()]) if f.name.lower() in given else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in target.fields
    ])


def append_by_name(df: DataFrame, table: str) -> None:
    """Append with columns matched by name; columns the rows lack become null."""
    aligned(df, table).write.mode("append").insertInto(table)


def create_if_absent(spark: SparkSession, table: str, columns: str, location: str | None = None,
                     partition_by: str | None = None) -> None:
    """Empty parquet table, external when a location is given."""
    partitioned = f" PARTITIONED BY ({partition_by})" if partition_by else ""
    placed = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet{partitioned}{placed}")


def table_location(spark: SparkSession, table: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Location'")
    return rows.first()["data_type"]


def partition_columns(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition]


@contextmanager
def _dynamic_overwrite(spark: SparkSession):
    before = spark.conf.get(DYNAMIC, None)
    spark.conf.set(DYNAMIC, "dynamic")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DYNAMIC)
        else:
            spark.conf.set(DYNAMIC, before)


def _add_columns(df: DataFrame, table: str) -> None:
    """Adds the columns that only ``df`` has to the table."""
    known = {n.lower() for n in df.sparkSession.table(table).schema.fieldNames()}
    new = [f for f in df.schema.fields if f.name.lower() not in known]
    if new:
        listed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new)
        df.sparkSession.sql(f"ALTER TABLE {table} ADD COLUMNS ({listed})")


def bucketing(spark: SparkSession, table: str) -> tuple[list[str], int]:
    """Keys and number of a table's hash buckets."""
    found = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    if BUCKET_KEYS not in found:
        raise ValueError(f"{table} has a column {BUCKET} but was not created in buckets")
    return json.loads(found[BUCKET_KEYS]), int(found[BUCKET_NUMBER])


def in_buckets(df: DataFrame, keys: list[str], number: int) -> DataFrame:
    """The rows with the bucket of their key (keys are hashed by their text, whatever their type)."""
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*[quoted(k).cast("string") for k in keys]), F.lit(number)).cast("int"))


def create_bucketed(df: DataFrame, table: str, keys: list[str], number: int, location: str | None = None) -> None:
    """A table without partitions of its own, laid out in hash buckets of its key."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    kept = in_buckets(df.select(*[quoted(c).cast(kinds[c]).alias(c) for c in df.columns]), keys, number)
    writer = kept.hint("rebalance", F.col(BUCKET)).write.format("parquet").partitionBy(BUCKET)
    (writer.option("path", location) if location else writer).saveAsTable(table)
    df.sparkSession.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{BUCKET_KEYS}' = '{json.dumps(keys)}', '{BUCKET_NUMBER}' = '{number}')")


def _provider(spark: SparkSession, table: str) -> str:
    return spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Provider'").first()["data_type"].lower()


def overwrite_table(df: DataFrame, table: str) -> None:
    """Replace all rows of a table without partitions; ``df`` may read the table itself.

    The new files are written beside the old ones, then the table is pointed at them and the old
    ones go: until the switch the table holds its old rows, from then on the new ones."""
    spark = df.sparkSession
    if _provider(spark, table) != "parquet":
        settle(aligned(df, table)).write.mode("overwrite").insertInto(table)
        return
    old = table_location(spark, table)
    new = f"{re.sub(r'[.]v[0-9a-f]{32}$', '', old.rstrip('/'))}.v{uuid.uuid4().hex}"
    aligned(df, table).write.parquet(new)
    spark.sql(f"ALTER TABLE {table} SET LOCATION '{new}'")
    spark.catalog.refreshTable(table)
    gone = spark._jvm.org.apache.hadoop.fs.Path(old)
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def replace_partitions(df: DataFrame, table: str) -> None:
    """Overwrite just the partitions that ``df`` has rows for; ``df`` may read the table itself.

    One partition value may hold most rows: rebalancing splits it over many tasks."""
    spark = df.sparkSession
    parts = [quoted(c) for c in partition_columns(spark, table)]
    with _dynamic_overwrite(spark):
        aligned(df, table).hint("rebalance", *parts).write.mode("overwrite").insertInto(table)
    spark.catalog.refreshTable(table)


def partitions_of(df: DataFrame, parts: list[str]) -> list[tuple]:
    """The partition values that rows have: as many as the change touches partitions."""
    return [tuple(r) for r in df.select(*[quoted(p) for p in parts]).distinct().collect()]


def in_partitions(parts: list[str], values: list[tuple]) -> Column:
    """A filter on partition columns, by which the scan leaves other partitions out."""
    if len(parts) == 1:
        known = [value[0] for value in values if value[0] is not None]
        listed = quoted(parts[0]).isin(known) if known else F.lit(False)
        return listed | quoted(parts[0]).isNull() if len(known) < len(values) else listed
    found = F.lit(False)
    for value in values:
        same = F.lit(True)
        for p, v in zip(parts, value):
            same = same & (quoted(p).isNull() if v is None else quoted(p) == F.lit(v))
        found = found | same
    return found


def _rewrite(rows: DataFrame, table: str, parts: list[str], touched: list[tuple]) -> None:
    """``rows`` become the content of the touched partitions."""
    spark = rows.sparkSession
    stored = settle(aligned(rows, table))
    emptied = set(touched) - set(partitions_of(stored, parts))
    replace_partitions(stored, table)
    if emptied:  # an overwrite leaves partitions without rows as they are
        kinds = {f.name: f.dataType.simpleString() for f in spark.table(table).schema.fields}
        text = spark.range(1).select(F.array(*[
            F.array(*[F.lit(v).cast(kinds[p]).cast("string") for p, v in zip(parts, value)]) for value in emptied
        ]).alias("texts")).first()["texts"]
        specs = ", ".join(
            "PARTITION (" + ", ".join(f"`{p}` = " + ("NULL" if v is None else "'" + v.replace("'", "\\'") + "'") for p, v in zip(parts, value)) + ")"
            for value in text)
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {specs}")
    spark.catalog.refreshTable(table)


def replaced_slice(existing: DataFrame, new: DataFrame, match: Column) -> DataFrame:
    """``existing`` without the rows that match, followed by ``new``.

    Columns missing on either side are filled with nulls."""
    kept = existing.filter(~F.coalesce(match, F.lit(False)))
    return kept.unionByName(new, allowMissingColumns=True)


def replace_slice(new: DataFrame, table: str, match: Column) -> None:
    """Delete the matching rows of a table and add ``new``.  Of a partitioned table the
    partitions with matching or new rows are rewritten."""
    spark = new.sparkSession
    _add_columns(new, table)
    existing, parts = spark.table(table), partition_columns(spark, table)
    new = aligned(new, table)
    if not parts:
        overwrite_table(replaced_slice(existing, new, match), table)
        return
    touched = sorted({*partitions_of(existing.filter(match), parts), *partitions_of(new, parts)}, key=repr)
    if touched:
        _rewrite(replaced_slice(existing.filter(in_partitions(parts, touched)), new, match), table, parts, touched)


def append_evolving(df: DataFrame, table: str) -> None:
    """Append rows that may bring new columns; older rows read null there."""
    _add_columns(df, table)
    append_by_name(df, table)


def create_table_from(df: DataFrame, schema: str, table: str, location: str,
                      partition_by: tuple[str, ...] = ("incr_ingest_timestamp",)) -> None:
    """Create or replace a partitioned table at a location.

    Refuses a location whose path does not contain both the schema and the table name."""
    if schema.lower() not in location.lower() or table.lower() not in location.lower():
        raise ValueError(f"the location must name both {schema} and {table}")
    df.write.mode("overwrite").format("parquet").partitionBy(*partition_by).option(
        "path", location
    ).saveAsTable(f"{schema}.{table}")


def create_results(spark: SparkSession, table: str, columns: str, location: str | None = None) -> None:
    """A table of results, if there is none: partitioned by month and run, so that a run can be
    written again."""
    create_if_absent(spark, table, f"{columns}, create_month_prtn int, run_id string", location, "create_month_prtn, run_id")


def append_run(df: DataFrame, table: str, run_id: str) -> None:
    """Add the results of a run; whatever the table holds of the same run is replaced, also if the
    run now has other months or no results at all."""
    spark = df.sparkSession
    rows = settle(aligned(df.withColumn("run_id", F.lit(run_id)), table))
    replace_partitions(rows, table)
    months = {r[0] for r in rows.select("create_month_prtn").distinct().collect()}
    held = spark.table(table).filter(F.col("run_id") == run_id).select("create_month_prtn").distinct()
    for (month,) in held.collect():
        if month not in months:
            value = "NULL" if month is None else str(month)
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (create_month_prtn = {value}, run_id = '{_text(run_id)}')")
    spark.catalog.refreshTable(table)


def _text(value: str) -> str:
    return value.replace("\\", "\\\\").replace("'", "\\'")


def append_load(df: DataFrame, table: str) -> None:
    """Plain append; creates the table when it does not exist."""
    if df.sparkSession.catalog.tableExists(table):
        append_by_name(df, table)
    else:
        df.write.format("parquet").saveAsTable(table)


def require_unique_keys(source: DataFrame, keys: list[str]) -> None:
    """Raises when two source rows share a key (rows with a null key never match)."""
    complete = source.filter(~_any_null(keys))
    repeated = complete.groupBy(*[quoted(k) for k in keys]).count().filter("count > 1")
    if not repeated.isEmpty():
        raise ValueError(f"several source rows share a key in {keys}")


def _any_null(keys: list[str]) -> Column:
    missing = F.lit(False)
    for k in keys:
        missing = missing | quoted(k).isNull()
    return missing


def upserted(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows without a source row of the same key, plus all source rows.

    Null keys match nothing, so such target rows stay and such source rows are added.  Only
    the key columns of the source are shuffled to find the matches."""
    if not keys:
        raise ValueError("a merge needs key columns (mergeKey)")
    source_keys = source.select(*[quoted(k) for k in keys]).filter(~_any_null(keys))
    columns = [quoted(c) for c in target.columns]
    keyed = target.filter(~_any_null(keys)).join(source_keys, keys, "left_anti").select(*columns)
    # rows without a full key match nothing: they stay out of the join, where they would meet in one task
    return keyed.unionByName(target.filter(_any_null(keys))).unionByName(source.select(*columns))


def upsert(source: DataFrame, table: str, keys: list[str]) -> None:
    """Merge ``source`` into a table: matched rows are replaced, others inserted.  Of a
    partitioned table the partitions with matched or new rows are rewritten."""
    if not keys:
        raise ValueError("a merge needs key columns (mergeKey)")
    spark = source.sparkSession
    require_unique_keys(source, keys)
    source, target, parts = aligned(source, table), spark.table(table), partition_columns(spark, table)
    if not parts:
        overwrite_table(upserted(target, source, keys), table)
        return
    if parts == [BUCKET] and bucketing(spark, table)[0] == list(keys):  # equal keys share a bucket
        touched = sorted(partitions_of(source, parts))
        if touched:
            _rewrite(upserted(target.filter(in_partitions(parts, touched)), source, keys), table, parts, touched)
        return
    matched = target.filter(~_any_null(keys)).join(source.select(*[quoted(k) for k in keys]), keys, "left_semi")
    touched = sorted({*partitions_of(matched, parts), *partitions_of(source, parts)}, key=repr)
    if touched:
        _rewrite(upserted(target.filter(in_partitions(parts, touched)), source, keys), table, parts, touched)


def compact(spark: SparkSession, table: str) -> None:
    """Rewrite a table into few, evenly sized files (sizes follow the session's advisory
    partition size)."""
    df = spark.table(table)
    if partition_columns(spark, table):
        replace_partitions(df, table)
    else:
        overwrite_table(df.hint("rebalance"), table)


def append_files(df: DataFrame, path: str) -> bool:
    """Append to a parquet folder unless there is nothing to write; the rows are computed once."""
    stored = settle(df)
    if stored.isEmpty():
        return False
    stored.write.mode("append").parquet(path)
    return True


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row.  For report documents: one row, one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_audit(found: DataFrame, path: str) -> None:
    """The audit records as JSON lines, in as many files as there are tasks."""
    found.write.mode("overwrite").json(path)


def report_path(root: str, run_id: str, dataset_id: str) -> str:
    return f"{root.rstrip('/')}/{run_id}_{dataset_id}.json"


def insert_document(df: DataFrame, path: str, flag_column: str = "isImportant") -> None:
    """Append documents to a JSON collection, with the form flag made a boolean."""
    from verisift.operators.collection import normalise_flag

    normalise_flag(df, flag_column).write.mode("append").json(path)
