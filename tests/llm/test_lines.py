"""Fuzzy line deduplication against all pairs of lines."""

import random
import re
from collections import Counter

import numpy as np
from verisift.llm import bbit, components, lines

BLANK = " \t\n\x0b\x0c\r"


def norm(x):
    return re.sub(r"[\x20\x09-\x0D]+", " ", x.strip(BLANK)).lower()


def slow(rows):
    """Texts by doc_id without repeated lines, by exact similarity of all pairs of lines."""
    places = [(d, k, norm(x)) for d, t in rows for k, x in enumerate(t.split("\n")) if x.strip(BLANK)]
    texts = sorted({p[2] for p in places})
    sets, holders, parent = [lines._shingles(t, lines.SHINGLE) for t in texts], {}, list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in holders.get(x, ())) if len(texts[i]) >= lines.SHINGLE else {}
        for j, n in common.items():
            if n >= lines.SIMILARITY * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        if len(texts[i]) >= lines.SHINGLE:
            for x in s:
                holders.setdefault(x, []).append(i)
    at, seen, stay = {t: k for k, t in enumerate(texts)}, set(), set()
    for d, k, t in places:
        if (c := find(at[t])) not in seen:
            seen.add(c)
            stay.add((d, k))
    return {d: "\n".join(x for k, x in enumerate(t.split("\n")) if not x.strip(BLANK) or (d, k) in stay) for d, t in rows}


def test_against_all_pairs(docs):
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    found = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs).select("doc_id", "text").collect()}
    want = slow(rows)
    wrong = [d for d in want if found[d] != want[d]]
    assert len(wrong) <= 0.005 * len(want)


def test_large_family_of_near_copies_keeps_one(spark):
    rng = random.Random(4)
    base = [rng.choice("ab cd efg hij klm nop qrs tuv wxyz".split()) + str(rng.randint(0, 99)) for _ in range(60)]
    rows = []
    for k in range(400):
        words = list(base)
        words[rng.randrange(60)] = f"v{k}"
        rows.append((k, " ".join(words)))
    kept = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed = 0").collect()
    assert [r["doc_id"] for r in kept] == [0]


def test_families_of_one_template(spark):
    """Many pairs that share most words with all others: every pair at the bound is linked, as by all pairs."""
    for seed, families, shared, own in ((1, 100, 30, 12), (2, 150, 24, 8), (3, 60, 40, 14)):
        rng = random.Random(seed)
        template = [f"{rng.choice('abcdefgh')}{rng.randint(100, 999)}" for _ in range(shared)]
        rows = []
        for f in range(families):
            mine = [f"q{rng.randint(10_000, 99_999)}" for _ in range(own)]
            for k in range(2):
                words = template + [*mine[:-1], f"z{f}{k}"]
                rows.append((2 * f + k, " ".join(words)))
        found = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert found == slow(rows)


def test_rows_of_large_buckets():
    key = np.array([1, 2, 2, 2] + [3] * 20 + [4] * 16 + [5] * 17)
    sid = np.arange(len(key))
    for step in (1, 7, 100):
        batches = [lines.pa.RecordBatch.from_pydict({"key": key[k:k + step], "h": sid[k:k + step]}) for k in range(0, len(key), step)]
        found = [r for x in lines._candidates(iter(batches)) for r in zip(*(c.to_pylist() for c in x.columns), strict=True)]
        out = [(a, b) for large, a, b in found if large]
        assert {(a, b) for large, a, b in found if not large} == {
            (min(p), max(p)) for p in zip(*(c.tolist() for c in lines._pairs_of(key, sid)), strict=True)}
        assert sorted(out) == [(k, i) for k, i in zip(key.tolist(), sid.tolist(), strict=True) if k in (3, 5)]


def test_pairs_of_buckets():
    key = np.array([1, 2, 2, 2] + [3] * 20)
    h = np.arange(len(key))
    pairs = set(zip(*(c.tolist() for c in lines._pairs_of(key, h)), strict=True))
    assert {(1, 2), (2, 3), (1, 3)} <= pairs
    assert {p for p in pairs if p[0] >= 4} == {(4 + p, j) for p in range(lines.PIVOTS) for j in range(5 + p, 24)}


def test_odd_rows(odd, no_docs):
    found = lines.dedup_lines(odd)
    assert found.columns == [*odd.columns, "n_lines", "n_removed"]
    rows = {(r["doc_id"], r["source"]): r for r in found.collect()}
    assert found.count() == odd.count()
    assert rows[2, None]["text"] is None and rows[3, ""]["text"] == ""
    assert rows[1, "x"]["n_removed"] == 0 and rows[None, "y"]["text"] == ""
    assert rows[4, "x"]["n_lines"] == 0 and rows[4, "x"]["h"] == 3
    assert lines.dedup_lines(no_docs).count() == 0


def test_long_signatures_estimate_the_similarity():
    rng = np.random.default_rng(5)
    for common, own in ((90, 5), (80, 10), (40, 30), (400, 50)):
        every = rng.integers(0, 2**64, common + 2 * own, np.uint64)
        left, right = bbit.long_signature(every[:common + own]), bbit.long_signature(np.r_[every[:common], every[common + own:]])
        apart = sum(int(x).bit_count() for x in (left ^ right).view(np.uint64))
        share = 1 - apart / bbit.LONG_MINIMA
        assert len(left) == bbit.LONG_MINIMA // 64
        assert abs(2 * share - 1 - common / (common + 2 * own)) < bbit.LONG_MARGIN


def test_white_space_of_all_kinds_and_lengths(spark):
    texts = ["a  b\t c", "a b c", " a\x0b\x0cb\rc \n", "\ta b  \t  c\n\n\x0c", "a\n b c", "", "  ", "a\tb c\x0b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted((r["_id"], r["line"], r["norm"]) for r in lines.lines_of(df).collect())
    assert found == [(d, k, norm(x)) for d, t in enumerate(texts) for k, x in enumerate(t.split("\n")) if norm(x)]


def test_documents_are_joined_with_one_copy_of_the_text(docs):
    plan = lines.dedup_lines(docs.select("doc_id", "text"))._jdf.queryExecution().optimizedPlan().toString()
    assert "AS _text#" not in plan and "AS row#" in plan


def test_finished_components_take_no_round(spark, monkeypatch):
    edges = spark.createDataFrame([(k, k % 3) for k in range(3, 60)], "a long, b long").repartition(4)
    want = {(k, k % 3) for k in range(3, 60)}

    def never(_):
        raise AssertionError("a round over stars")

    monkeypatch.setattr(components, "_large_star", never)
    assert {tuple(r) for r in components.components(edges).collect()} == want
    monkeypatch.undo()
    chain = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(9, 9)], "a long, b long").repartition(7)
    assert {tuple(r) for r in components.components(chain).collect()} == {(k, 0) for k in range(1, 51)}


def test_rows_of_buckets_of_one_line_are_dropped_and_others_ordered():
    rng = np.random.default_rng(6)
    key = np.sort(rng.integers(0, 400, 1_000))
    h = rng.integers(0, 3, 1_000) + key % 2
    want = sorted({(k, k ^ x, x) for k, x in zip(key.tolist(), h.tolist(), strict=True) if (key == k).sum() > 1})
    for step in (1, 90, 1_000):
        batches = [lines.pa.RecordBatch.from_pydict({"key": key[k:k + step], "h": h[k:k + step]}) for k in range(0, len(key), step)]
        found = [r for x in lines._ordered(iter(batches)) for r in zip(*(c.to_pylist() for c in x.columns), strict=True)]
        assert found == [(k, x) for k, _, x in want]
    long = [lines.pa.RecordBatch.from_pydict({"key": np.zeros(300_000, np.int64), "h": np.arange(k, k + 300_000) % 7}) for k in range(8)]
    found = {r for x in lines._ordered(iter(long)) for r in zip(*(c.to_pylist() for c in x.columns), strict=True)}
    assert found == {(0, x) for x in range(7)}


def test_pairs_of_open_buckets(spark):
    rows = [(1, s, s % 3, 2, s % 3 == 0) for s in range(9)] + [(2, s, s // 4, 1, s < 4) for s in range(3, 6)]
    df = spark.createDataFrame(rows, "key long, sid long, label long, salts long, in_top boolean")
    found = {tuple(r) for r in lines._met_in(df).collect()}
    assert found == {(min(x[1], y[1]), max(x[1], y[1])) for x in rows for y in rows if x[0] == y[0] and x[2] != y[2]}


def test_few_edges_are_finished_at_once(spark, monkeypatch):
    rng = random.Random(9)
    edges = [(rng.randrange(3_000), rng.randrange(3_000)) for _ in range(2_000)] + [(k, k + 1) for k in range(5_000, 5_200)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(8)
    monkeypatch.setattr(components, "FEW_EDGES", 0)
    want = {tuple(r) for r in components.components(df).collect()}
    monkeypatch.undo()

    def never(_):
        raise AssertionError("a round over stars")

    monkeypatch.setattr(components, "_large_star", never)
    found = components.components(df)
    assert found.columns == ["node", "root"] and {tuple(r) for r in found.collect()} == want and len(want) > 1_000


def test_keys_are_dealt_out_packed_by_range():
    """A task hands on a row for each range of keys, not one for each band of each line, and nothing is lost."""
    rng = random.Random(7)
    texts = [" ".join(rng.choice("ab cd efg hij klm nop".split()) + str(rng.randint(0, 9)) for _ in range(12)) for _ in range(500)]
    batch = lines.pa.RecordBatch.from_pydict({"h": np.arange(500), "norm": texts})
    keys = lines.band_keys(lines.signatures(texts, lines.BANDS * lines.ROWS), lines.BANDS, lines.ROWS).view(np.int64)
    want = {(int(k), h) for h, row in enumerate(keys) for k in row}
    for ranges in (1, 8, 70_000):
        packed = list(lines._banded(lines.BANDS, lines.ROWS, lines.SHINGLE, ranges)(iter([batch, batch])))
        part = np.concatenate([x.column(0).to_numpy() for x in packed])
        assert len(packed) == 1 and len(part) <= min(ranges, len(want)) and (np.diff(part) > 0).all()
        pairs = [np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 2) for x in packed[0].column(1)]
        assert sorted(map(tuple, np.concatenate(pairs).tolist())) == sorted(want)
        bounds = [((p.view(np.uint64)[:, 0] >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32) for p in pairs]
        assert all((b == k).all() for b, k in zip(bounds, part, strict=True))


def test_ranges_of_keys_of_any_size_give_the_same_candidates(monkeypatch):
    """Every pair of a small bucket meets, all rows of a large one go on and its lines are linked, however little a task holds."""
    rng = np.random.default_rng(8)
    sizes = [1, 2, 5, 16, 17, 40, 300] * 3
    rows = np.array([(k, k * 1_000 + s) for k, size in enumerate(sizes) for s in range(size)] * 2)
    rng.shuffle(rows)
    part = rows[:, 0] // 7
    batches = []
    for step in np.array_split(np.argsort(part, kind="stable"), 60):
        cuts = np.split(step, np.flatnonzero(np.diff(part[step])) + 1)
        batches.append(lines.pa.RecordBatch.from_pydict({"part": [int(part[c[0]]) for c in cuts], "rows": [rows[c].tobytes() for c in cuts]}))
    for held in (1_000_000, 100, 1):
        monkeypatch.setattr(lines, "PACKED", held)
        found = {r for x in lines._met(iter(batches)) for r in zip(*(c.to_pylist() for c in x.columns), strict=True)}
        for k, size in enumerate(sizes):
            own = {k * 1_000 + s for s in range(size)}
            pairs = {(a, b) for large, a, b in found if not large and a != b and a in own}
            assert all(b in own for _, b in pairs)
            if size <= lines.SMALL_BUCKET:
                assert pairs == {(a, b) for a in own for b in own if a < b}
                assert not any(large and a == k for large, a, _ in found)
            else:
                assert {b for large, a, b in found if large and a == k} == own
                nodes, roots = components.forest(*map(np.array, zip(*pairs, strict=True)))
                assert set(nodes.tolist()) == own - {k * 1_000} and set(roots.tolist()) == {k * 1_000}


def test_similar_counts_repeated_shingles_once():
    texts = ["abcdefg", "abcdefg" * 40, "a" * 300, "a" * 7, "xyz abcdefg" * 3, "gfedcba hij klm", "abcdefgh"]
    left, right = [a for a in texts for _ in texts], texts * len(texts)
    for bound in (0.1, 0.5, 0.8, 1.0):
        assert lines.similar(left, right, bound, 7).tolist() == [lines._alike(a, b, bound, 7) for a, b in zip(left, right, strict=True)]


def test_texts_are_hashed_once_and_not_for_every_line(docs):
    plan = lines.lines_of(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("AS _th#")
