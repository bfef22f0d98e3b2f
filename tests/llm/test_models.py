"""Toxicity and language: held-out accuracy, edge cases, and what scores may depend on."""

import zlib

import pytest
from pyspark.sql import functions as F
from verisift.llm import language, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels", "pages")}


def test_held_out_accuracy(tables):
    found = {r["doc_id"]: r for r in toxicity.classify(tables["documents"].select("doc_id", "text"), tables["labels"]).collect()}
    assert len(found) == tables["documents"].count()
    for d, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [(r["toxic"], found[r["doc_id"]]) for r in tables["labels"].collect() if found[r["doc_id"]]["held_out"]]
    assert sum(y == r["predicted"] for y, r in held) >= 0.9 * len(held)


def test_held_out_labels_and_other_columns_do_not_matter(tables):
    labels = tables["labels"]
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.lit(0))
    docs = tables["documents"]
    one = toxicity.classify(docs.select("doc_id", "text"), labels).select("doc_id", "score")
    two = toxicity.classify(docs.withColumn("lang", F.lit("xx")), turned).select("doc_id", "score")
    a, b = ({r["doc_id"]: round(r["score"], 6) for r in x.collect()} for x in (one, two))
    assert a == b


def test_toxicity_of_odd_rows(odd, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = toxicity.classify(odd, none)
    assert found.count() == odd.count() and found.columns == [*odd.columns, "held_out", "predicted"]
    assert {r["predicted"] for r in found.collect()} == {0}
    assert toxicity.classify(no_docs, none).count() == 0
    insult = spark.createDataFrame([(1, "you stupid idiot")], "doc_id long, text string")
    assert toxicity.classify(insult, none).first()["predicted"] == 1
    some = spark.createDataFrame([(1, 1, 1), (1, 1, None), (3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.classify(odd, some).count() == odd.count()


def test_language_accuracy(tables):
    found = language.identify(tables["documents"], tables["pages"])
    want = {r["doc_id"]: r["lang"] for r in tables["documents"].collect()}
    rows = found.collect()
    assert len(rows) == len(want) + tables["pages"].count()
    docs = [r for r in rows if r["doc_id"] is not None]
    assert sum(r["lang"] == want[r["doc_id"]] for r in docs) >= 0.99 * len(docs)


def test_evidence_decides_where_text_is_missing(spark, tables):
    pages = spark.createDataFrame(
        [(k, f"http://a.seite.de/{k}", "<html><body>" + "und der die das nicht eine auf " * 20) for k in range(30)]
        + [(100, "http://a.seite.de/x", ""), (101, None, '<html lang="fr">'), (102, None, None)], "page_id long, url string, html string")
    found = {r["page_id"]: r for r in language.identify(tables["documents"], pages).where("page_id is not null").collect()}
    assert found[0]["lang"] == "de" and found[100]["lang"] == "de" and found[100]["text_lang"] is None
    assert found[101]["lang"] == "fr"
    assert found[102]["lang"] == "en"  # the most frequent language


def test_language_of_odd_rows(odd, no_docs, tables):
    found = language.identify(odd, tables["pages"].limit(0))
    assert found.count() == odd.count()
    assert language.identify(no_docs, tables["pages"].limit(0)).count() == 0
    assert {r["lang"] for r in language.identify(no_docs, tables["pages"].limit(2)).collect()} == {None}


def test_languages_of_few_documents(spark):
    english = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("the people of the town went to the market that day").alias("text"), F.lit("en").alias("lang"))
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto "
    rows = [(40_000 + k, finnish * 10, "fi") for k in range(2)] + [(50_000, "qwx zzyqx kwyjx zzq xwyqz", "zz")]
    documents = english.union(spark.createDataFrame(rows, "doc_id long, text string, lang string")).withColumn("source", F.lit(None).cast("string"))
    pages = spark.createDataFrame([(1, None, f"<html><body>{finnish}</body></html>")], "page_id long, url string, html string")
    found = {r["doc_id"] or r["page_id"]: r["lang"] for r in language.identify(documents, pages).where("doc_id >= 40000 or page_id is not null").collect()}
    assert found == {40_000: "fi", 40_001: "fi", 50_000: language.UNKNOWN, 1: "fi"}


def test_visible_text_of_pages():
    """As by one pattern, and in linear time whatever isn't closed."""
    import random
    import re
    import time
    pattern = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", re.DOTALL | re.IGNORECASE)
    rng = random.Random(1)
    bits = ["<", ">", "<script", "<SCRIPT>", "</script >", "<style a>", "</style>", "<!--", "-->", "&amp;", "&#12;", "&", " ", "a", "é\n", "<b>", "--", "/"]
    for _ in range(20_000):
        page = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        assert language.visible(page) == pattern.sub(" ", page), page
    start = time.perf_counter()
    for bit in ("<", "<script ", "<!--", "<style>", "&a", "&", "<!-- >"):
        language.visible(bit * (1_000_000 // len(bit)))
    assert time.perf_counter() - start < 30
