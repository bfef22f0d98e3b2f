"""The registered queries and the pipeline's stages on planted cases."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402


def test_registered():
    names = entry.queries()
    assert sum(n.startswith(f"op{k}_") for k in range(1, 11) for n in names) == 10 and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "packing"]


@pytest.fixture(scope="module")
def planted(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prose = [r["text"] for r in docs.where("lang = 'en' and n_chars between 1500 and 4000").limit(3).collect()]
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    toxic = "you pathetic worthless idiot, stupid moron and scum " * 3
    rows = [(-5, prose[0]), (-4, prose[0]), (-3, prose[0] + "\n" + prose[1]), (-2, "some words before\n" + item + "\nand after"), (-1, toxic)]
    added = spark.createDataFrame([(d, t, "en", "planted", len(t)) for d, t in rows], docs.schema)
    return docs.union(added)


def test_stages(spark, sf_dir, planted):
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, planted, sf_dir)
    assert kept.columns == planted.columns
    assert -1 not in {r["doc_id"] for r in kept.select("doc_id").collect()}
    lined = stages["line_dedup"](spark, planted, sf_dir)
    assert lined.columns == planted.columns
    ids = {r["doc_id"] for r in lined.select("doc_id").collect()}
    assert -5 in ids and -4 not in ids and -2 in ids
    near = stages["simhash_near_dedup"](spark, planted, sf_dir)
    ids = {r["doc_id"] for r in near.select("doc_id").collect()}
    assert -5 in ids and -4 not in ids
    clean = stages["decontamination"](spark, planted, sf_dir)
    ids = {r["doc_id"] for r in clean.select("doc_id").collect()}
    assert -2 not in ids and -5 in ids
    assert stages["packing"](spark, planted, sf_dir).select("doc_id").distinct().count() == planted.count()


def test_columns_named_like_an_operators_output(spark, sf_dir, planted):
    from pyspark.sql import functions as F
    names = ("score", "predicted", "held_out", "n_lines", "n_removed", "contaminated", "item_ids", "n_matched")
    docs = planted.where("doc_id < 40").select("*", *[F.lit(777).alias(c) for c in names])
    for stage in ("toxicity", "line_dedup", "simhash_near_dedup", "decontamination"):
        kept = dict(corpus_pipeline.STAGES)[stage](spark, docs, sf_dir)
        assert kept.columns == docs.columns
        assert {tuple(r) for r in kept.select(*names).distinct().collect()} == {(777,) * len(names)}


def test_stages_on_odd_rows(spark, sf_dir, planted):
    """Nulls in any column, empty texts, repeated rows, and no rows at all."""
    rows = [(None, None, None, None, None), (1, None, "en", "x", 3), (1, None, "en", "x", 3), (2, "", None, "", 0), (3, " \n\t", "de", None, None)]
    odd = spark.createDataFrame(rows, planted.schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, odd, sf_dir)
        assert kept.columns == odd.columns
        assert name == "simhash_near_dedup" or kept.count() == len(rows)
        assert stage(spark, odd.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd.limit(0), sf_dir).count() == 0


def test_run(spark, sf_dir):
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert pieces.columns[:2] == ["doc_id", "start"] and pieces.count() > 10


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = entry.queries()[name](spark, sf)
    cursor = db.execute(entry.oracle_sql()[name])
    assert [c[0] for c in cursor.description] == found.columns
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(cursor.fetchall(), key=repr)
