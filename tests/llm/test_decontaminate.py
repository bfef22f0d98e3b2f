"""Benchmark decontamination against plain containment, and re-parameterised items."""

import re

import pytest
from verisift.llm import decontaminate as dec

ITEM = "Tom has 3 apples and 5 pears in the old basket, and Tom gives 3 apples to Mary before lunch. What remains?"


def found(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string, _th string")
    b = spark.createDataFrame(items, "item_id long, text string")
    out = dec.decontaminate(d, b, **options)
    assert out.columns == ["doc_id", "text", "_th", "contaminated", "item_ids"]
    return {r["doc_id"]: (r["contaminated"], r["item_ids"]) for r in out.collect()}


def test_templates_and_slots(spark):
    docs = [
        (1, "Intro here. " + ITEM + " More follows.", "a"),
        (2, ITEM.replace("Tom", "Ann").replace("3", "7").replace("5", "9").replace("Mary", "Lucy"), "a"),
        (3, "Ann has 7 apples and 9 pears in the old basket, and Bob gives 8 apples to Lucy before lunch. What remains?", "a"),
        (4, "Apples and pears were in another basket, and nobody counted what remained after a very long lunch.", "a"),
        (5, None, None), (6, "", "a"), (8, "so what is the boiling point really", "a"),
        (None, ITEM.replace("3", "7.5"), "a"),
    ]
    got = found(spark, docs, [(1, ITEM), (2, None), (3, "one 2 3"), (4, "what is the boiling point"), (5, "")])
    assert {d for d, (c, _) in got.items() if c} == {1, 2, None, 8}
    assert got[2] == (True, [1]) and got[8] == (True, [4]) and got[5] == (False, [])


RICH = "Paris 12 km 30 min Berlin 44 km 90 min Rome 15 km 70 min Oslo 88 km 20 min Wien 19 km"
NAMED = "Natalia sold 48 clips to her friends in April. Natalia then sold half as many clips in May. How many did she sell altogether?"


def test_items_of_placeholders_are_found_word_for_word(spark):
    other = "Bonn 13 km 31 min Mainz 45 km 91 min Trier 16 km 71 min Ulm 89 km 21 min Köln 20 km"
    got = found(spark, [(1, "See: " + RICH + " and so on", "a"), (2, other, "a"), (3, RICH.lower(), "a"), (4, "12 km 30 min", "a")], [(1, RICH)])
    assert {d for d, (c, _) in got.items() if c} == {1, 3}


def test_names_that_begin_sentences(spark):
    docs = [(1, NAMED.replace("Natalia", "Maria").replace("48", "31"), "a"), (2, "So: " + NAMED.lower(), "a"), (3, NAMED, "a"),
            (4, "Maria wrote 31 letters to the council in March. Nobody there read as many letters. Who would?", "a")]
    got = found(spark, docs, [(7, NAMED)])
    assert {d for d, (c, _) in got.items() if c} == {1, 2, 3} and got[1] == (True, [7])


def test_several_texts_of_an_item_and_items_without_id(spark):
    second = "The old lighthouse keeper counted exactly every passing ship until the winter storms began to rage along the coast."
    third = "Nobody in the village remembered why the narrow bridge had been painted green before the great flood of spring."
    docs = [(1, ITEM, "a"), (2, "x " + second, "a"), (3, third + " y", "a"), (4, "nothing of the kind", "a"), (3, third + " y", "a")]
    got = found(spark, docs, [(5, ITEM), (5, second), (None, third), (5, ITEM)])
    assert got == {1: (True, [5]), 2: (True, [5]), 3: (True, []), 4: (False, [])}


def test_long_text_and_ties(spark):
    long = "filler words go on here and there " * 4000
    docs = [(1, long + ITEM + long, "a"), (2, ITEM + " " + ITEM, "a"), (3, long, "a")]
    got = found(spark, docs, [(1, ITEM), (2, ITEM)])
    assert got == {1: (True, [1, 2]), 2: (True, [1, 2]), 3: (False, [])}


def test_empty_tables(spark):
    assert found(spark, [], [(1, ITEM)]) == {}
    assert found(spark, [(1, ITEM, "a"), (1, ITEM, "a")], []) == {1: (False, [])}


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "benchmark")]


def test_against_containment(tables):
    documents, benchmark = tables

    def norm(text):
        return " ".join(text.split()).lower()

    items = {r["item_id"]: norm(r["text"]) for r in benchmark.collect()}
    got = {r["doc_id"]: r["item_ids"] for r in dec.decontaminate(documents, benchmark).collect()}
    for r in documents.collect():
        assert got[r["doc_id"]] == sorted(i for i, t in items.items() if t in norm(r["text"]))


def test_no_python_in_the_plan(tables):
    plan = dec.decontaminate(*tables)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)


def test_texts_are_rewritten_once(docs):
    for columns in (["canon"], ["canon", "raw"]):
        plan = dec._tokens(docs, "doc_id").select(*columns)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("<unit>") == plan.count("<name>") == 1
