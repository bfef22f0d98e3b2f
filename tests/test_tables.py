import pandas as pd
import pytest
from pyspark.sql import functions as F

from verisift.functions.schemas import parse_schema
from verisift.operators import collection, rulebook
from verisift.operators.conform import (
    clean_columns, conform, mask_columns, only_new_files, rename_by_position,
)
from verisift.plans import batch
from verisift.plans.ingest import ingest
from verisift.plans.transform import process_tables, run_views, write_target
from verisift.plans.validation import (
    get_report, list_reports, quick_check, run_rules, store_report,
)
from verisift.session import settle, shared_dir
from verisift.sources import files, sinks, tables
from verisift.streaming.ingest_stream import ingest_stream

NOW = "2024-03-05 00:00:00"


@pytest.fixture(scope="module")
def db(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS dqdb")
    yield "dqdb"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- sources ---------------------------------------------------------------------------

def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"two\nlines"\n2,"with ""quotes"""\n')
    df = files.read_csv(spark, str(tmp_path / "a.csv"), multi_line=True)
    assert df.schema["id"].dataType.simpleString() == "int"
    assert rows(df) == [(1, "two\nlines"), (2, 'with "quotes"')]


def test_delimited_text_and_names(spark, tmp_path):
    (tmp_path / "a.txt").write_text("k|v\n1|x\n2|y\n")
    (tmp_path / "b.txt").write_text("k|v\n3|z\n")
    df = files.read_delimited(spark, str(tmp_path), parse_schema("k int, v string"), header=True, delimiter="|")
    assert rows(files.with_file_name(df)) == [(1, "x", "a.txt"), (2, "y", "a.txt"), (3, "z", "b.txt")]
    assert files.read_text(spark, str(tmp_path / "b.txt")).count() == 2
    assert files.read_text(spark, str(tmp_path)).count() == 5
    with pytest.raises(ValueError):
        files.require_rows(df.filter("k > 9"))


def test_keyed_json_and_documents(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"P1": {"name": "a", "bmi": 25.0},\n "P2": {"name": "b", "bmi": null}}')
    df = files.read_keyed_json(spark, str(tmp_path / "p.json"), "name:string,bmi:double")
    assert rows(df.select("id", "name")) == [("P1", "a"), ("P2", "b")]
    assert [r["id"] for r in collection.sort_by(df, "bmi", "desc").collect()] == ["P1", "P2"]
    assert collection.lookup(df, "P2").first()["name"] == "b"
    with pytest.raises(LookupError):
        collection.lookup(df, "P9")
    with pytest.raises(ValueError):
        collection.sort_by(df, "name")
    with pytest.raises(ValueError):
        collection.sort_by(df, "bmi", "up")


def test_patients_order(spark):
    bmi = {"P001": 25.0, "P002": 22.0, "P003": 26.0, "P004": 25.0 - 0.5, "P005": 21.0}
    df = spark.createDataFrame(list(bmi.items()), "id string, bmi double")
    assert [r["id"] for r in collection.sort_by(df, "bmi", "desc").collect()] == ["P003", "P001", "P004", "P002", "P005"]


def test_document_insert_and_projection(spark, tmp_path):
    new = spark.createDataFrame([(1, "t", "d", "on"), (2, "u", "e", None)], "_id int, title string, desc string, isImportant string")
    sinks.insert_document(new, str(tmp_path / "notes"))
    docs = files.read_documents(spark, str(tmp_path / "notes"))
    assert rows(collection.project_documents(docs, ("title", "isImportant"))) == [("1", "t", True), ("2", "u", False)]
    assert collection.normalise_flag(new.drop("isImportant"), "isImportant").filter("isImportant").count() == 0


def test_pandas_source(spark):
    df = tables.from_pandas(spark, pd.DataFrame({"a": [1.0, None], "b": ["x", None]}))
    assert df.filter("a is null").count() == 1


def test_sample_rows(spark):
    df = spark.sql("select timestamp'2024-01-02 03:04:05' t, date'2024-01-02' d, 1 n from range(20)")
    sample = tables.sample_rows(df, 3).collect()
    assert len(sample) == 3 and tuple(sample[0]) == ("2024-01-02T03:04:05", "2024-01-02", 1)
    with pytest.raises(ValueError):
        tables.sample_rows(df, 0)


def test_sources_by_precedence(spark, db):
    spark.range(5).toDF("n").write.mode("overwrite").saveAsTable(f"{db}.src_t")
    spark.range(1).write.mode("overwrite").saveAsTable(f"{db}.src_athena")
    listed = tables.list_tables(spark, db)
    assert "src_t" in listed and "src_athena" not in listed
    assert tables.list_tables(spark, db, " a, b ") == ["a", "b"]
    assert tables.source_frame(spark, db_name=db, table_name="src_t", where="n > 2").count() == 2
    assert tables.source_frame(spark, sql=f"select n, n*2 m from {db}.src_t", columns=["m"]).columns == ["m"]
    given = spark.range(9)
    assert tables.source_frame(spark, db_name=db, table_name="src_t", data=given, where="n > 2").count() == 9


# --- sinks -----------------------------------------------------------------------------

def test_append_matches_names(spark, db):
    sinks.create_if_absent(spark, f"{db}.app", "a int, b string, m int", partition_by="m")
    sinks.create_if_absent(spark, f"{db}.app", "a int")
    sinks.append_by_name(spark.createDataFrame([("x", 1, 202401)], "b string, a int, m int"), f"{db}.app")
    sinks.append_by_name(spark.createDataFrame([(2, 202402)], "a int, m int"), f"{db}.app")
    assert rows(spark.table(f"{db}.app").fillna("-")) == [(1, "x", 202401), (2, "-", 202402)]
    with pytest.raises(ValueError):
        sinks.append_by_name(spark.createDataFrame([(2, 1)], "a int, zzz int"), f"{db}.app")


def test_replace_slice_is_repeatable(spark, db):
    name = f"{db}.slices"
    spark.createDataFrame([("d1", 1), ("d2", 2), (None, 3)], "db_name string, v int").write.mode("overwrite").saveAsTable(name)
    new = spark.createDataFrame([("d1", 9)], "db_name string, v int")
    for _ in range(2):
        sinks.replace_slice(new, name, F.col("db_name") == "d1")
        assert rows(spark.table(name).fillna("-")) == [("-", 3), ("d1", 9), ("d2", 2)]


def test_replace_slice_of_partitioned_table(spark, db):
    name = f"{db}.parts"
    spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string").write.mode("overwrite").partitionBy("p").saveAsTable(name)
    sinks.replace_slice(spark.createDataFrame([(7, "b"), (8, "c")], "v int, p string"), name, F.col("p") == "b")
    assert rows(spark.table(name)) == [(1, "a"), (7, "b"), (8, "c")]
    sinks.replace_partitions(spark.createDataFrame([(5, "a")], "v int, p string"), name)
    assert rows(spark.table(name)) == [(5, "a"), (7, "b"), (8, "c")]
    sinks.compact(spark, name)
    assert rows(spark.table(name)) == [(5, "a"), (7, "b"), (8, "c")]


def test_untouched_partitions_keep_their_files(spark, db):
    name = f"{db}.stamped"
    df = spark.sql("SELECT id, timestamp'2024-03-05 10:20:30' + make_interval(0, 0, 0, 0, cast(id % 3 AS int)) AS p FROM range(30)")
    df.write.mode("overwrite").partitionBy("p").saveAsTable(name)
    files_of = lambda: {f.replace("%25", "%") for f in spark.table(name).inputFiles()}
    before = files_of()
    change = df.filter("id = 4").selectExpr("id", "p")
    sinks.upsert(change, name, ["id"])
    kept = before & files_of()
    assert spark.table(name).count() == 30 and kept and all("11%3A20" not in f for f in kept) and any("11%3A20" in f for f in before - kept)
    sinks.replace_slice(df.filter("id < 0"), name, F.col("p") == F.expr("timestamp'2024-03-05 12:20:30'"))
    assert spark.table(name).count() == 20
    assert {f for f in kept if "10%3A20" in f} <= files_of()
    sinks.compact(spark, name)
    assert spark.table(name).count() == 20


def test_append_with_new_column(spark, db):
    name = f"{db}.evolve"
    spark.createDataFrame([(1,)], "a int").write.mode("overwrite").saveAsTable(name)
    sinks.append_evolving(spark.createDataFrame([(2, "x")], "a int, b string"), name)
    assert rows(spark.table(name).fillna("-")) == [(1, "-"), (2, "x")]


def test_upsert_is_repeatable(spark, db):
    name = f"{db}.target"
    spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string").write.mode("overwrite").saveAsTable(name)
    source = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    for _ in range(2):
        write_target(source, {"loadType": "merge", "mergeKey": ["k"]}, name)
        assert rows(spark.table(name).fillna(-1)) == [(-1, "n"), (1, "a"), (2, "B"), (3, "C")]
    nulls = spark.createDataFrame([(None, "m")], "k int, v string")
    sinks.upsert(nulls, name, ["k"])
    assert spark.table(name).filter("k is null").count() == 2
    with pytest.raises(ValueError):
        sinks.upsert(source.unionByName(source), name, ["k"])
    with pytest.raises(ValueError):
        write_target(source, {"loadType": "merge"}, name)
    with pytest.raises(ValueError):
        write_target(source, {"loadType": "other"}, name)


def test_compact(spark, db):
    name = f"{db}.many"
    spark.range(1000).repartition(20).write.mode("overwrite").saveAsTable(name)
    sinks.compact(spark, name)
    assert spark.table(name).count() == 1000
    assert spark.table(name).inputFiles().__len__() < 20


def test_rejects_append_only_when_rows(spark, tmp_path):
    assert sinks.append_files(spark.range(0), str(tmp_path / "r")) is False
    assert sinks.append_files(spark.range(2), str(tmp_path / "r")) is True


def test_settle_uses_shared_dir(spark):
    assert shared_dir(spark) == shared_dir(spark)
    assert settle(spark.range(4)).count() == 4


# --- shaping -----------------------------------------------------------------------------

def test_schema_text():
    parsed = parse_schema("a string,  b DOUBLE, c int, d date, e number, f timestamp")
    assert [f.dataType.simpleString() for f in parsed.fields] == ["string", "double", "int", "date", "bigint", "timestamp"]
    for bad in ("a decimal", "a", "a int x"):
        with pytest.raises(ValueError):
            parse_schema(bad)


def test_conform_and_rename(spark):
    df = spark.createDataFrame([("1", "x", "z")], "a string, b string, extra string")
    out = conform(df, parse_schema("b int, a int, c date"))
    assert out.columns == ["b", "a", "c"] and tuple(out.first()) == (None, 1, None)
    named = rename_by_position(df, parse_schema("a int, b int, extra int"), parse_schema("x int, y int"))
    assert named.columns == ["x", "y", "extra"]


def test_cleaning(spark):
    values = [" - ", "$1,234.50", "#N/A", "N/A", "#VALUE!", "a b", None]
    df = spark.createDataFrame([(v,) for v in values], "c string")
    assert [r["c"] for r in clean_columns(df, ["c", ""]).collect()] == [None, "1234.50", "", "", "", "ab", None]


def test_masking(spark):
    df = spark.createDataFrame([("ab1", "ab1", "ab1", "ab1", "ab1"), (None,) * 5], "h string, m string, f string, p string, n string")
    out = mask_columns(df, {"h": {"kind": "hash"}, "m": {"kind": "mask"}, "f": {"kind": "fixed", "value": "#"},
                            "p": {"kind": "pattern", "pattern": "[0-9]", "value": "9"}, "n": {"kind": "null"}}).collect()
    assert (out[0]["m"], out[0]["f"], out[0]["p"], out[0]["n"]) == ("xxn", "#", "ab9", None)
    assert len(out[0]["h"]) == 64 and set(out[1]) == {None}
    with pytest.raises(ValueError):
        mask_columns(df, {"h": {"kind": "rot13"}})


# --- ingest and transform ------------------------------------------------------------------

def conf_for(tmp_path, **more):
    return {
        "type": "csv", "delimiter": "|", "include_header": "Y", "file_path": str(tmp_path / "in"),
        "schema": "k int, amount string", "target_schema": "id int, amt string", "table_schema": "dqdb",
        "table_name": "landed", "location": str(tmp_path / "dqdb" / "landed"), "columnsWithDollar": "amt", **more,
    }


def test_ingest_is_idempotent_per_file(spark, db, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f1.csv").write_text("k|amount\n1|$1,000\n2| - \n")
    conf = conf_for(tmp_path, append_ind=True)
    spark.sql("DROP TABLE IF EXISTS dqdb.landed")
    for _ in range(2):
        out = ingest(spark, conf, as_of=NOW)
        assert rows(out.select("id", "amt", "file_name").fillna("~")) == [(1, "1000", "f1.csv"), (2, "~", "f1.csv")]
    (tmp_path / "in" / "f2.csv").write_text("k|amount\nx|5\n")
    out = ingest(spark, conf, as_of="2024-03-06 00:00:00")
    assert rows(out.filter("file_name = 'f2.csv'").select("id", "amt")) == [(None, "5")]
    assert out.select("incr_ingest_timestamp").distinct().count() == 2
    replaced = ingest(spark, {**conf, "append_ind": False}, as_of=NOW)
    assert replaced.count() == 3 and replaced.select("incr_ingest_timestamp").distinct().count() == 1
    with pytest.raises(ValueError):
        ingest(spark, {**conf, "append_ind": False, "location": str(tmp_path / "elsewhere")})


def test_ingest_text_and_masking(spark, db, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\ntwo\n")
    conf = conf_for(tmp_path, type="text", table_name="lines", location=str(tmp_path / "dqdb" / "lines"),
                    target_schema=None, columnsWithDollar="", dataMasking="Y", maskingRules={"value": {"kind": "mask"}})
    assert rows(ingest(spark, conf, as_of=NOW).select("value")) == [("xxx",), ("xxx",)]


def test_stream_picks_up_new_files_only(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f1.csv").write_text("k|amount\n1|$1\n")
    conf = conf_for(tmp_path, location=str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"))
    for expected in (1, 1):
        ingest_stream(spark, conf).awaitTermination()
        assert spark.read.parquet(conf["location"]).count() == expected
    (tmp_path / "in" / "f2.csv").write_text("k|amount\n2|$2\n3|-\n")
    ingest_stream(spark, conf).awaitTermination()
    assert rows(spark.read.parquet(conf["location"]).select("id", "amt", "file_name").fillna("~")) == [
        (1, "1", "f1.csv"), (2, "2", "f2.csv"), (3, "~", "f2.csv")]


def test_append_reads_new_files_only(spark, db, tmp_path):
    from verisift.plans.ingest import new_files
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "with space +1%20.csv").write_text("k|amount\n1|$1\n")
    conf = conf_for(tmp_path, append_ind=True, table_name="spaced", location=str(tmp_path / "dqdb" / "spaced"))
    assert ingest(spark, conf, as_of=NOW).first()["file_name"] == "with space +1%20.csv"
    assert new_files(spark, conf, "dqdb.spaced") == []
    (tmp_path / "in" / "b.csv").write_text("k|amount\n2|$2\n")
    assert [p.split("/")[-1] for p in new_files(spark, conf, "dqdb.spaced")] == ["b.csv"]
    assert ingest(spark, conf, as_of=NOW).count() == 2


def test_stream_deletes_inputs_when_asked(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"f{i}.csv").write_text(f"k|amount\n{i}|$1\n")
    conf = conf_for(tmp_path, location=str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"), filedel_ind="Y", max_files=1)
    spark.conf.set("spark.sql.streaming.fileSource.cleaner.numThreads", "0")  # delete in line
    ingest_stream(spark, conf).awaitTermination()
    spark.conf.unset("spark.sql.streaming.fileSource.cleaner.numThreads")
    assert spark.read.parquet(conf["location"]).count() == 3
    assert len(list((tmp_path / "in").iterdir())) < 3


def test_only_new_files(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, file_name string")
    assert rows(only_new_files(df, df.filter("v = 1"), "file_name")) == [(2, "b")]


def test_view_chain(spark, db):
    spark.sql("DROP TABLE IF EXISTS dqdb.chain")
    config = {"trnconfig": {"chain": {
        "settings": {"loadType": "ins"},
        "queries": {"step1": "select id from range(4)", "final_dfview": "select id * 2 as d from step1"}}}}
    process_tables(spark, config, "chain", "dqdb")
    process_tables(spark, config, " chain ", "dqdb")
    assert spark.table("dqdb.chain").count() == 8
    for broken in ({}, {"settings": {}}, {"settings": {}, "queries": {}}):
        with pytest.raises(ValueError):
            process_tables(spark, {"trnconfig": {"chain": broken}}, "chain", "dqdb")
    assert list(run_views(spark, {"a": "select 1 x", "b": "select x + 1 y from a"})) == ["a", "b"]


# --- rule tables -----------------------------------------------------------------------

HEADER = ("db_name|table_name|column_name|sql|constraint_name|constraint_rule|constraint_desc|is_active|"
          "reject_capture|reject_sql|rule_type|check_level|check_message")


def write_rules(path, lines, header=HEADER):
    path.write_text("\n".join([header, *lines]) + "\n")
    return str(path)


RULE_1 = "dqdb|Parcels|kilos||weighed|.hasCompleteness('kilos', '> 0.9')|d|Y|Y|select parcel, depot from dqdb.parcels where kilos is null|verify|Error|m"
RULE_2 = "dqdb|parcels|parcel||numbered|.isComplete('parcel')|d|Y|N||verify|warning|m"
RULE_3 = "dqdb|parcels|kilos|select * from dqdb.parcels where kilos >= 1|heavy|.hasMax('kilos', '<= 10')|d|Y|N||verify|Error|m"


def existing_rules(spark, path):
    rules = files.read_rules_file(spark, path)
    return rules.limit(0).withColumn("audit_create_date", F.lit(None).cast("timestamp"))


def test_rule_file_checks(spark, tmp_path):
    good = files.read_rules_file(spark, write_rules(tmp_path / "r.csv", [RULE_1, RULE_2]))
    assert good.schema.fields[0].dataType.simpleString() == "string" and len(good.columns) == 13
    assert rulebook.validated_rules(good, "dqdb").count() == 2
    with pytest.raises(ValueError, match="no rules for"):
        rulebook.validated_rules(good, "other")
    with pytest.raises(ValueError, match="rejects are captured"):
        rulebook.validated_rules(good, "dqdb", "Y")
    with pytest.raises(ValueError, match="twice"):
        rulebook.validated_rules(good.unionByName(good), "dqdb")
    with pytest.raises(ValueError, match="rules file"):
        rulebook.validated_rules(good.withColumnRenamed("sql", "query"), "dqdb")
    with pytest.raises(ValueError, match="rules file"):
        rulebook.validated_rules(good.drop("sql"), "dqdb")
    wide = good.withColumn("notify_capture", F.lit("Y")).withColumn("notify_topic", F.lit("t"))
    stored = rulebook.load_rules(existing_rules(spark, str(tmp_path / "r.csv")), wide, "dqdb", as_of=NOW)
    assert "notify_topic" in stored.columns
    again = rulebook.load_rules(stored, wide, "dqdb", as_of=NOW)
    assert rows(again.fillna("-")) == rows(stored.fillna("-"))


def test_scope_file_checks(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("db_name|table_name|column_name|is_active\ndqdb|t|a|Y\ndqdb|t|b|N\n")
    scope = files.read_scope_file(spark, str(path))
    empty = scope.limit(0).withColumn("audit_create_date", F.lit(None).cast("timestamp"))
    stored = rulebook.load_scope(empty, scope, "dqdb", NOW)
    assert stored.count() == 2
    assert rulebook.profile_scope(spark, stored, "dqdb") == [("t", ["a"])]
    assert rulebook.profile_scope(spark, stored, "dqdb", "t", ["z"]) == [("t", ["z"])]
    assert rulebook.profile_scope(spark, None, "dqdb", "x,y") == [("x", None), ("y", None)]
    with pytest.raises(ValueError):
        rulebook.profile_scope(spark, stored, "dqdb", None, ["z"])
    with pytest.raises(ValueError):
        rulebook.load_scope(empty, scope, "other")
    with pytest.raises(ValueError):
        rulebook.load_scope(empty, scope.withColumn("q", F.lit(1)), "dqdb")


@pytest.fixture(scope="module")
def parcels(spark, db):
    """Five parcels: one not weighed, one without a depot, one number given twice."""
    spark.createDataFrame(
        [(1, "north", 2.5), (2, "south", None), (3, "north", 0.5), (4, None, 7.0), (4, "west", 1.0)],
        "parcel bigint, depot string, kilos double").write.mode("overwrite").saveAsTable("dqdb.parcels")


def test_batch_verification_and_capture(spark, parcels, tmp_path):
    rules = files.read_rules_file(spark, write_rules(tmp_path / "r.csv", [RULE_1, RULE_2, RULE_3]))
    results = batch.verify_tables(spark, rules, db_name="dqdb", as_of=NOW)
    status = {r["constraint_name"]: r["constraint_status"] for r in results.collect()}
    assert status == {"weighed": "Failure", "numbered": "Success", "heavy": "Success"}
    failed = results.filter("constraint_status <> 'Success'")
    found = batch.capture_rejects(spark, rules, db_name="dqdb", failed=failed, as_of=NOW).collect()
    assert [r["query_result"] for r in found] == ['{"parcel":2,"depot":"south"}']
    nothing = failed.filter("1 = 0")
    assert batch.capture_rejects(spark, rules, db_name="dqdb", failed=nothing, as_of=NOW).count() == 0
    assert batch.capture_rejects(spark, rules, db_name="dqdb", failed=nothing, capture_all=True).count() == 1
    with pytest.raises(ValueError, match="no rule is active"):
        batch.verify_tables(spark, rules, db_name="none")
    metric = rules.withColumn("rule_type", F.lit("metrics"))
    values = batch.verify_tables(spark, metric, db_name="dqdb", mode="metrics", as_of=NOW)
    assert {(r["column_name"], r["metric"]): r["value"] for r in values.collect()} == {
        ("kilos", "Completeness"): 0.8, ("parcel", "Completeness"): 1.0, ("kilos", "Maximum"): 7.0}
    given = batch.verify_tables(spark, rules, db_name="dqdb", tables="parcels", data=spark.table("dqdb.parcels").filter("parcel = 1"))
    assert {r["constraint_name"]: r["constraint_status"] for r in given.collect()}["weighed"] == "Success"


def test_batch_profile_and_suggestions(spark, parcels):
    found = batch.profile_tables(spark, None, db_name="dqdb", tables="parcels", as_of=NOW)
    part = found.filter("column_name = 'depot'").first()
    assert (part["completeness"], part["data_type"], part["create_month_prtn"]) == (0.8, "String", 202403)
    sinks.create_if_absent(
        spark, "dqdb.rulestable",
        "db_name string, table_name string, column_name string, constraint_rule string, constraint_desc string, "
        "is_active string, reject_capture string, rule_type string, check_level string, check_message string, "
        "audit_create_date timestamp")
    existing = spark.table("dqdb.rulestable")
    once = settle(batch.suggest_for_tables(spark, existing, db_name="dqdb", tables="parcels", as_of=NOW, max_categories=100))
    assert once.filter("constraint_rule = '.isComplete(\"parcel\")'").count() == 1
    activated = once.withColumn("is_active", F.when(F.col("column_name") == "parcel", "Y").otherwise(F.col("is_active")))
    twice = batch.suggest_for_tables(spark, activated, db_name="dqdb", tables="parcels", as_of=NOW, max_categories=100)
    assert twice.count() == once.count()
    assert twice.groupBy("column_name", "constraint_rule").count().filter("count > 1").count() == 0


def test_rule_sets(spark):
    rules = spark.createDataFrame([("d", "a", True), ("d", "b", True), ("e", "a", True)], "dataset_id string, rule_id string, active boolean")
    assert rulebook.toggle_rule(rules, "d", "a", False).filter("not active").count() == 1
    assert rows(rulebook.delete_rule(rules, "d", "a").select("dataset_id", "rule_id")) == [("d", "b"), ("e", "a")]
    assert rulebook.get_rule_set(rules, "d").count() == 2
    new = spark.createDataFrame([("d", "z", True)], rules.schema)
    assert rulebook.set_rule_set(rules, new, "d").count() == 2
    for change in (rulebook.toggle_rule, rulebook.delete_rule):
        with pytest.raises(LookupError):
            change(rules, "d", "zz", *([True] if change is rulebook.toggle_rule else []))


# --- whole jobs ----------------------------------------------------------------------------

def test_quick_check(spark, employees, db, tmp_path):
    run = quick_check(employees, dataset_id="demo", run_id="RPT_9", as_of=NOW)
    summary = run.summary.first()
    assert (summary["total_rules"], summary["failed_rules"], summary["overall_status"]) == (28, 2, "failed")
    assert run.records(1).count() == 1
    assert run.alert_log.count() == 3
    spark.sql("DROP TABLE IF EXISTS dqdb.reports")
    store_report(run.summary, "dqdb.reports")
    store_report(run.summary, "dqdb.reports")
    assert get_report(spark.table("dqdb.reports"), "RPT_9").count() == 2
    assert "overall_score" in list_reports(spark.table("dqdb.reports")).columns
    sinks.write_json(run.document, sinks.report_path(str(tmp_path), "RPT_9", "demo"))
    back = spark.read.json(sinks.report_path(str(tmp_path), "RPT_9", "demo")).first()
    assert back["overall_status"] == "failed" and back["total_anomalies"] == 2


def test_run_without_rules(employees):
    run = run_rules(employees, [], dataset_id="demo", run_id="r", as_of=NOW)
    assert run.summary.first()["overall_status"] == "failed" and run.rejects.count() == 0
    assert run.document.first()["total_anomalies"] == 0


def test_append_run_reads_the_manifest_only(spark, db, tmp_path, monkeypatch):
    """New files are told from the manifest: the target's files could be gone."""
    from verisift.plans import ingest as plan
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("k|amount\n1|$1\n")
    conf = conf_for(tmp_path, append_ind="y", table_name="listed", location=str(tmp_path / "dqdb" / "listed"))
    ingest(spark, conf, as_of=NOW)
    for part in (tmp_path / "dqdb" / "listed").glob("*/part-*"):
        part.rename(tmp_path / part.name)
    assert plan.new_files(spark, conf, "dqdb.listed") == []
    (tmp_path / "in" / "b[1].csv").write_text("k|amount\n2|$2\n")
    (tmp_path / "in" / "b1.csv").write_text("k|amount\n3|$2\n")
    assert sorted(p.split("/")[-1] for p in plan.new_files(spark, conf, "dqdb.listed")) == ["b1.csv", "b[1].csv"]


def test_interrupted_load_is_settled(spark, db, tmp_path, monkeypatch):
    """A driver lost before the rows were written loads the file again, one lost after them does not."""
    from verisift.plans import ingest as plan
    from verisift.sources import manifest
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("k|amount\n1|$1\n")
    conf = conf_for(tmp_path, append_ind="Y", table_name="cut", location=str(tmp_path / "dqdb" / "cut"))
    ingest(spark, conf, as_of=NOW)
    for name, day, step in (("b.csv", "2024-04-01", "append_by_name"), ("c.csv", "2024-04-02", "finish")):
        (tmp_path / "in" / name).write_text("k|amount\n2|$2\n")
        with monkeypatch.context() as patch:
            def lost(*_):
                raise RuntimeError("lost")
            patch.setattr(plan if step == "append_by_name" else manifest, step, lost)
            with pytest.raises(RuntimeError):
                ingest(spark, conf, as_of=day)
        want = {"append_by_name": 2, "finish": 3}[step]
        assert ingest(spark, conf, as_of=f"{day} 01:00:00").count() == want
        assert ingest(spark, conf, as_of=f"{day} 02:00:00").count() == want
    assert manifest.loaded_files(spark, "dqdb.cut").count() == 3


def test_manifest_of_an_older_table_and_whole_folders(spark, db, tmp_path):
    from verisift.sources import manifest
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\n")
    conf = conf_for(tmp_path, type="text", table_name="old", location=str(tmp_path / "dqdb" / "old"), target_schema=None,
                    columnsWithDollar="", append_ind="Y")
    ingest(spark, conf, as_of=NOW)
    spark.sql(f"DROP TABLE {manifest.manifest_name('dqdb.old')}")
    assert ingest(spark, conf, as_of=NOW).count() == 1
    (tmp_path / "in" / "b.txt").write_text("two\n")
    assert ingest(spark, conf, as_of="2024-04-01").count() == 2
    (tmp_path / "in" / "c.txt").write_text("three\n")
    assert rows(ingest(spark, {**conf, "pick_all_files": "Y"}, as_of="2024-04-02").groupBy("value").count()) == [
        ("one", 2), ("three", 1), ("two", 2)]


def test_merge_leaves_the_files_of_other_buckets(spark, db, tmp_path):
    name = f"{db}.bucketed"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    where = tmp_path / "bucketed"
    sinks.create_bucketed(spark.range(100).selectExpr("id AS k", "'old' AS v"), name, ["k"], 8, str(where))

    def files_of():
        return {str(p): p.stat().st_mtime_ns for p in where.glob("hash_bucket=*/part-*")}

    before = files_of()
    sinks.upsert(spark.createDataFrame([(7, "new"), (700, "more")], "k long, v string"), name, ["k"])
    after = files_of()
    touched = {r[0] for r in spark.table(name).filter("v <> 'old'").select("hash_bucket").collect()}
    kept = {p for p in before if not any(f"hash_bucket={b}/" in p for b in touched)}
    assert kept and all(after.get(p) == before[p] for p in kept)
    assert spark.table(name).filter("v = 'old'").count() == 99 and spark.table(name).count() == 101
    sinks.replace_slice(spark.createDataFrame([(7, "again")], "k long, v string"), name, F.col("k") == 7)
    assert rows(spark.table(name).filter("k = 7").select("v")) == [("again",)]
    spark.range(3).write.mode("overwrite").saveAsTable(f"{db}.plain")
    with pytest.raises(ValueError):
        sinks.bucketing(spark, f"{db}.plain")


def test_lost_rewrite_leaves_the_table(spark, db, monkeypatch):
    """A job that breaks off while it writes the new rows: the table still holds the old ones."""
    name = f"{db}.rewritten"
    spark.range(10).selectExpr("id AS k", "'old' AS v").write.mode("overwrite").saveAsTable(name)
    broken = spark.createDataFrame([(3, "new")], "k long, v string").withColumn("v", F.when(F.col("k") == 3, F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        sinks.upsert(broken.select("k", F.col("v").cast("string").alias("v")), name, ["k"])
    spark.catalog.refreshTable(name)
    assert spark.table(name).count() == 10
    for k in range(3):
        sinks.upsert(spark.createDataFrame([(3, f"new{k}")], "k long, v string"), name, ["k"])
        assert rows(spark.table(name).filter("v <> 'old'")) == [(3, f"new{k}")]
    assert spark.table(name).count() == 10


def test_runs_are_written_once(spark, db):
    name = f"{db}.runs"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    sinks.create_results(spark, name, "v int")
    sinks.create_results(spark, name, "v int")
    for run_id, values in (("it's", [1, 2]), ("b", [3]), ("it's", [4]), ("b", [])):
        new = spark.createDataFrame([(v, 202401 + v % 2) for v in values], "v int, create_month_prtn int")
        sinks.append_run(new, name, run_id)
    assert rows(spark.table(name).select("v", "run_id")) == [(4, "it's")]


def test_missing_values_are_sorted_in_several_tasks(spark):
    df = spark.range(0, 20_000, 1, 8).selectExpr("id", "CASE WHEN id % 2 = 0 THEN NULL ELSE CAST(id AS DOUBLE) END AS bmi")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        ordered = collection.sort_by(df, "bmi")
        sizes = [r[1] for r in ordered.groupBy(F.spark_partition_id()).count().collect()]
        values = [r["bmi"] or 0.0 for r in ordered.collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert values == sorted(values) and len(sizes) == 8 and max(sizes) < 5_000


def test_shared_view_is_stored_once(spark, sf_dir):
    from verisift.plans.transform import references, shared_views
    from verisift.queries.loading import CHAIN, DIAMOND, transform_diamond
    assert shared_views(CHAIN) == set() and shared_views(DIAMOND) == {"dq_totals"}
    assert references({"a": "x", "b": "SELECT a.v, 'a' FROM A a2"})["a"] == ["b", "b"]
    text = transform_diamond(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_totalprice" not in text  # the orders aren't read again


def test_states_merge_to_the_metrics_of_one_scan(spark, sf_dir):
    from verisift.operators import states
    rows_ = spark.createDataFrame(
        [("a", 1.0, "x", None), ("a", 1e9 + 1, None, None), ("b", 1e9 + 2, "x", None), ("b", None, "y", None), (None, 1e9 + 3, "z", None)],
        "s string, v double, t string, empty double")
    found = states.column_states(rows_, F.col("s"))
    assert found.schema.simpleString() == spark.createDataFrame([], states.STATE).schema.simpleString()
    got = {(r["column_name"], r["metric"]): r["value"] for r in states.state_metrics(found, db_name="d", table_name="t").collect()}
    exact = rows_.agg(F.avg("v"), F.stddev_pop("v"), F.sum("v")).first()
    assert got["v", "Mean"] == pytest.approx(exact[0]) and got["v", "Sum"] == pytest.approx(exact[2])
    assert got["v", "StandardDeviation"] == pytest.approx(exact[1])
    assert (got["t", "Completeness"], got["t", "ApproxCountDistinct"], got["empty", "Completeness"]) == (0.8, 3, 0)
    assert ("t", "Mean") not in got and ("empty", "Mean") not in got
    assert states.new_slices(rows_, "s", found.filter("slice = 'a'")).count() == 3
    assert states.new_slices(rows_, "s", found).count() == 0
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_extendedprice", "l_linenumber")
    merged = states.state_metrics(states.column_states(df, F.col("l_linenumber")), db_name="d", table_name="t", quantiles=(0.1, 0.9))
    by = {(r["column_name"], r["metric"]): r["value"] for r in merged.collect()}
    for q in (0.1, 0.9):
        share = df.agg(F.avg((F.col("l_extendedprice") <= by["l_extendedprice", f"ApproxQuantile({q})"]).cast("double"))).first()[0]
        assert abs(share - q) < 0.02
