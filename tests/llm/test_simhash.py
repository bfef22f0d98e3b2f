"""SimHash links and components against all pairs."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F
from verisift.llm import prefix, simhash
from verisift.llm.components import components, forest


def slow_print(text, words=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + words]), 42) for i in range(max(1, len(w) - words + 1))]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def slow_classes(ids, prints):
    x = np.array(prints, np.uint64)
    parent = list(range(len(x)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1:] ^ x[i]) <= 4) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        c = find(i)
        known = [v for v in (least.get(c), d) if v is not None]
        least[c] = min(known) if known else None
    return [least[find(i)] for i in range(len(x))]


def compare(df):
    texts = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    prints = [slow_print(t) for _, t in texts]
    want = sorted(zip((d for d, _ in texts), (f"{p:016x}" for p in prints), slow_classes([d for d, _ in texts], prints), strict=True), key=repr)
    assert sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=repr) == want


def test_against_all_pairs(docs):
    compare(docs)


def test_odd_rows(odd, no_docs):
    compare(odd)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_dense_groups_are_split_and_kept_whole(monkeypatch):
    rng = np.random.default_rng(0)
    centres = rng.integers(0, 2**63, 3, dtype=np.uint64)
    x = []
    for _ in range(1500):
        v = int(centres[rng.integers(0, 3)])
        for b in rng.choice(64, rng.integers(0, 8), replace=False):
            v ^= 1 << int(b)
        x.append(v)
    x = np.unique(np.array(x, np.uint64))
    i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4, 1))
    want = dict(zip(*(c.tolist() for c in forest(x[i].view(np.int64), x[j].view(np.int64))), strict=True))
    masks = np.array([m for ms in simhash._flips(16, 2) for m in ms], np.uint64)
    sent = pd.DataFrame({"lead": ((x >> np.uint64(48))[:, None] ^ masks[None, :]).ravel().astype(np.int64),
                         "fp": np.repeat(x, len(masks)).view(np.int64)}).sort_values("lead")
    for held in (4_000_000, 20_000):
        monkeypatch.setattr(simhash, "HELD", held)
        batches = iter([pa.RecordBatch.from_pandas(sent.iloc[k:k + 9_000], preserve_index=False) for k in range(0, len(sent), 9_000)])
        out = list(simhash._linker(4, 16)(batches))
        u, v = (np.concatenate([b.column(c).to_numpy() for b in out]) for c in (0, 1))
        assert dict(zip(*(c.tolist() for c in forest(u, v)), strict=True)) == want


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7), (3, 4), (4, 3)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in found} == {**{k: 0 for k in range(1, 41)}, **{100 + k: 100 for k in range(1, 60)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def tasks_of(spark, run):
    """What run() gives, and the tasks that its jobs ran."""
    context, group = spark.sparkContext, f"tasks-{random.getrandbits(64)}"
    names = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    context.setJobGroup(group, group)
    try:
        done = run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    seen = context.statusTracker()
    stages = {s for j in seen.getJobIdsForGroup(group) for s in seen.getJobInfo(j).stageIds}
    return done, sum(info.numCompletedTasks for info in map(seen.getStageInfo, stages) if info)


def test_few_edges_need_few_tasks(spark):
    edges = spark.createDataFrame([(k % 30, k % 30 + 1) for k in range(900)], "a long, b long").repartition(3)
    found, tasks = tasks_of(spark, lambda: components(edges).collect())
    assert {r["node"]: r["root"] for r in found} == {k: 0 for k in range(1, 31)}
    assert tasks < 64


def test_similar_texts_of_a_small_table_need_few_shuffles(spark):
    words = [" ".join(f"w{k}_{j}" for j in range(300)) for k in range(8)]
    rows = [(k, w) for k, w in enumerate([*words, *[w + " more" for w in words]])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    kept, tasks = tasks_of(spark, lambda: simhash.keep_one(df).collect())
    assert sorted(r["doc_id"] for r in kept) == list(range(8))
    assert tasks < 64 * 19


def test_keep_one_against_all_pairs(docs):
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    sets, holders, parent = [simhash.shingles(t, 5) for _, t in rows], {}, list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders.get(x, ())).items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            holders.setdefault(x, []).append(i)
    want = {rows[i][0] for i in range(len(rows)) if find(i) == i}
    kept = {r["doc_id"] for r in simhash.keep_one(docs).select("doc_id").collect()}
    assert want <= kept
    assert len(kept - want) <= 0.1 * (len(rows) - len(want))


def test_keep_one_of_edited_copies(spark, docs):
    texts = [r["text"] for r in docs.where("n_chars between 2000 and 6000").orderBy("doc_id").limit(30).collect()]
    rows = []
    for k, text in enumerate(texts):
        words = text.split(" ")
        edited = " ".join(f"changed{k}" if i % 90 == 45 else w for i, w in enumerate(words))
        rows += [(10 * k, text), (10 * k + 1, edited), (10 * k + 2, " ".join(sorted(words))), (10 * k + 3, text)]
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {10 * k for k in range(len(texts))} | {10 * k + 2 for k in range(len(texts))}
    found = {r[0] for r in rows} - kept
    assert not {r[0] for r in rows if r[0] % 10 == 3} & kept
    assert len(found & {10 * k + 1 for k in range(len(texts))}) >= 0.9 * len(texts)
    assert len(want - kept) <= 8  # some of the documents are copies of each other, and so are their sorted words


def test_copies_that_only_resemble_their_base(spark):
    rng, rows = random.Random(5), []
    for family in range(4):
        words = [f"w{family}x{k}" for k in range(400)]
        rows.append((1000 * family + 500, " ".join(words)))
        for copy in range(60):
            edited = list(words)
            for part in range(6):
                edited[part * 66 + rng.randrange(5, 60)] = f"e{family}x{copy}x{part}"
            rows.append((1000 * family + copy, " ".join(edited)))
    sets = {k: simhash.shingles(t, 5) for k, t in rows}
    alike = [len(sets[k] & sets[500]) / len(sets[k] | sets[500]) for k in range(60)]
    assert min(alike) >= 0.8 and len(sets[0] & sets[1]) < 0.8 * len(sets[0] | sets[1])
    kept = [r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()]
    assert sorted(kept) == [0, 1000, 2000, 3000]


def test_unlinked_pairs_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(prefix, "SALTED", 3)
    rng = random.Random(6)
    frame = [f"f{k}" for k in range(60)]  # shared by families that differ in their other words
    texts = {}
    for node in range(120):
        words = frame + [f"n{node % 12}x{k}" for k in range(24)]
        words[rng.randrange(len(words))] = f"e{node}"
        texts[node] = " ".join(words)
    digests, sets = simhash.digests_of(5), {k: simhash.shingles(t, 5) for k, t in texts.items()}

    def similar(a, b):
        return len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])

    def verify(pairs, given):
        found = [(r["a"], r["b"]) for r in pairs.collect() if similar(r["a"], r["b"])]
        return spark.createDataFrame(found, "u long, v long")

    star = [(0, k) for k in range(1, 120)]
    tried = spark.createDataFrame(star, "a long, b long")
    linked = spark.createDataFrame([p for p in star if similar(*p)], "u long, v long")
    given = spark.createDataFrame(list(texts.items()), "h long, text string")
    done = prefix.finished(tried, linked, given, digests, 0.8, verify)
    roots = dict(map(tuple, components(done).collect()))
    pairs = [(a, b) for a in texts for b in texts if a < b and similar(a, b)]
    want = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert roots == want and len(want) > 80


def test_keep_one(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] for r in kept.select("doc_id").collect()), key=repr) == [1, 2, 5, 6, 7]
    assert kept.where(F.col("doc_id") == 1).count() == 1
