"""b-bit MinHash components against all pairs of full sets."""

import random

import numpy as np
from pyspark.sql import functions as F
from verisift.llm import bbit


def slow(rows, words=4, similarity=80):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    index = {}
    for k, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(k)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in index[x] if j > i}:
            common = len(s & sets[j])
            if 100 * common >= similarity * len(s | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for k, (d, _) in enumerate(rows):
        known = [v for v in (least.get(find(k)), d) if v is not None]
        least[find(k)] = min(known) if known else None
    return sorted(((d, len(s), least[find(k)], d == least[find(k)]) for k, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def compare(df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in bbit.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)
    assert got == slow(rows)


def test_against_all_pairs(docs):
    compare(docs)


def test_odd_rows(odd, no_docs):
    compare(odd)
    assert bbit.near_duplicates(no_docs).count() == 0


def test_edited_copies_with_and_without_their_base(spark):
    """Copies close to a base but not to one another, chains, families without a base, and copies of a copy."""
    draw = random.Random(5)
    words = [f"w{k}" for k in range(3000)]

    def edited(base, edits):
        out = list(base)
        for at in draw.sample(range(len(out)), edits):
            out[at] = draw.choice(words)
        return out

    texts = []
    for edits, with_base in ((3, True), (4, False), (6, True), (2, False)):
        base = draw.choices(words, k=200)
        texts += [base] if with_base else []
        texts += [edited(base, draw.randint(1, edits)) for _ in range(60)]
    chain = draw.choices(words, k=120)
    for _ in range(30):
        chain = edited(chain, 2)
        texts.append(chain)
    texts += [draw.choices(words, k=draw.randint(1, 12)) for _ in range(40)] + texts[:50]
    order = list(range(len(texts)))
    draw.shuffle(order)
    compare(spark.createDataFrame([(i, " ".join(t)) for i, t in zip(order, texts, strict=True)], "doc_id long, text string"))


def test_pairs_at_the_bound(spark):
    """80 shared shingles of 100 link, 79 of 100 don't."""
    def joined(shared, own):
        return " ".join([f"s{k}" for k in range(shared + 3)] + own)

    rows = [(1, joined(80, [f"a{k}" for k in range(10)])), (2, joined(80, [f"b{k}" for k in range(10)])),
            (3, joined(79, [f"c{k}" for k in range(20)]).replace("s", "t")), (4, joined(79, [f"d{k}" for k in range(1)]).replace("s", "t"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    compare(df)
    assert {r["doc_id"]: r["component_id"] for r in bbit.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_estimate_is_corrected_for_collisions(spark):
    draw = np.random.default_rng(3)
    for shared, own in ((0, 500), (500, 250), (900, 50)):
        common = draw.integers(0, 2**63, shared, np.uint64)
        one, two = (np.concatenate([common, draw.integers(0, 2**63, own, np.uint64)]) for _ in range(2))
        sig = [[int(v) for v in bbit.packed(bbit.minima(s))] for s in (one, two)]
        places = spark.createDataFrame([sig], "x array<long>, y array<long>").select(bbit.agreeing(F.col("x"), F.col("y"))).first()[0]
        found, true = (places / bbit.MINIMA - 0.25) / 0.75, shared / (shared + 2 * own)
        assert abs(found - true) < 0.2
    assert bbit.enough(80) == 85
