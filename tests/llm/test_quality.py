"""Quality rules against a plain count, word by word."""

import math
import random
import re
from collections import Counter

from verisift.llm import divergence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, repeat = len(words), len(covered)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat,
            n < 20 or 100 * repeat > 30 * n)


def rows(df):
    return df.select("doc_id", *divergence.BASE, "base_failed", "kept", "class_distance").collect()


def test_base_counts(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    found = rows(divergence.quality(docs))
    assert len(found) == len(texts)
    for r in found:
        assert tuple(r[1:7]) == base(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_junk_goes_and_prose_stays(spark, docs):
    plain = [r["text"] for r in docs.where("lang = 'en' and n_chars between 800 and 3000").limit(60).collect()]
    rows_ = [(k, t, "en") for k, t in enumerate(plain)]
    rows_.append((1000, " ".join(f"#{k}%{k * 7}$|{k}" for k in range(200)), "en"))
    judged = {r["doc_id"]: r["kept"] for r in divergence.quality(spark.createDataFrame(rows_, "doc_id long, text string, lang string")).collect()}
    assert not judged[1000]
    sound = [k for k, t in enumerate(plain) if not base(t)[5]]
    assert sum(judged[k] for k in sound) >= 0.9 * len(sound)


def test_texts_without_the_words_of_their_language_go(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    texts = {lang: [r["text"] for r in docs.where(f"lang = '{lang}' and n_chars between 2000 and 9000").orderBy("doc_id").limit(40).collect()]
             for lang in ("en", "de")}
    listed = "|".join(divergence.COMMON_WORDS["en"])
    rng = random.Random(4)
    stripped = [re.sub(rf"(?<!\S)({listed})(?!\S)", "", t) for t in texts["en"]]
    salad = [" ".join("".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(2, 9))) for _ in range(400)) for _ in range(10)]
    odd = [(10**9 + k, t, "en") for k, t in enumerate([*stripped, *texts["de"], *salad])]
    given = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    judged = {r["doc_id"]: r["kept"] for r in divergence.quality(given).collect()}
    assert not any(judged[k] for k, t, _ in odd if len(t.split()) >= 256)
    prose = {r["doc_id"]: r["text"] for r in docs.where("lang = 'en'").collect() if r["text"]}
    common = re.compile(rf"(?<!\S)({listed})(?!\S)")
    usual = [k for k, t in prose.items() if not base(t)[5] and len(common.findall(t)) > 0.12 * len(t.split()) and not re.search("[$%&|]", t)]
    assert len(usual) > 300 and sum(judged[k] for k in usual) >= 0.99 * len(usual)


def test_limits_are_the_quantiles_of_the_language(spark, docs):
    found = divergence.quality(docs).join(docs.select("doc_id", "lang"), "doc_id").where("word_limit is not null").collect()
    groups = {}
    for r in found:
        if not r["base_failed"]:
            groups.setdefault((r["lang"], int(math.log2(r["n_words"]))), []).append(r)
    checked = 0
    for rows_ in groups.values():
        if len(rows_) >= divergence.MIN_DOCUMENTS:
            bins = sorted(math.floor(1000 * r["word_distance"]) for r in rows_)
            middle, low = bins[(len(bins) + 1) // 2 - 1], bins[-(-len(bins) // 10) - 1]
            limit = middle + divergence.SPREADS * max(middle - low, divergence.LEAST_STEP) + 1
            assert all(abs(r["word_limit"] - limit / 1000) < 1e-9 for r in rows_)
            assert all(r["kept"] <= (r["word_distance"] <= r["word_limit"]) for r in rows_)
            checked += 1
    assert checked


def test_odd_rows(odd, no_docs):
    found = rows(divergence.quality(odd))
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert len(found) == odd.count()
    for r in found:
        assert tuple(r[1:7]) == base(texts[r["doc_id"]])
    assert divergence.quality(no_docs).count() == 0


def test_no_python_in_the_plan(docs):
    plan = divergence.features(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
