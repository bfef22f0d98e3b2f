"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most R bits apart have a variant in common that lies within R/2 of both.
Every distinct fingerprint therefore emits all its variants within R/2, and equal variants
link their owners.  A variant is shuffled by its leading `block` bits only: a fingerprint goes
once to each leading block that its variants have (137 of 65,536 for R = 4 and 16 bits, where
2,081 variants stand behind them), and the task that holds the block spells out the rest of the
variants, sorts them and finds the equal ones.  Blocks too large for that are split on by the
next bits, so memory is bounded whatever the fingerprints are.

All owners of one variant lie within R of each other, so linking them to the smallest of them
keeps every component, without all pairs.  Links are verified by their distance.

Defined results: ASCII letters are folded, words end at ASCII white space; a text shorter than
the shingle is one shingle; null and empty texts have fingerprint zero and are linked like any
others; repeated rows are linked like copies; a null doc_id takes part and loses to any other
as the smallest; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.llm.common import broadcast_if_small, settle, text_of, unwrapped, wrapped
from verisift.llm.components import components, forest
from verisift.llm.prefix import finished

WORDS = 4
SEED = 42
RADIUS = 4
BLOCK = 16
# Stages on similar texts: word shingles, their Jaccard similarity, leading bits (two fingerprints
# per text, so shorter blocks than for one)
SIMILAR_WORDS = 5
SIMILARITY = 0.8
SIMILAR_BLOCK = 12
BROADCAST_TEXTS = 1_000_000  # text hashes (8 bytes each) that a semi-join may broadcast
HELD = 1_000_000  # variants that a task spells out at a time


def fingerprint(text: str, words: int = WORDS) -> int:
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined, at, starts = b" ".join(found), 0, []
    for w in found:
        starts.append(at)
        at += len(w) + 1
    ends = [s + len(w) for s, w in zip(starts, found, strict=True)]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1:], strict=False)] or [digest(joined, SEED)]
    ones, rows = np.zeros(64, np.int64), np.array(hashes, np.uint64)
    for k in range(0, len(rows), 65_536):
        ones += np.unpackbits(rows[k:k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint_of(text: Column, words: int = WORDS) -> Column:
    """The fingerprint of a text column as a signed long."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    return of(text)


def _flips(bits: int, most: int) -> list[list[int]]:
    """By number of flipped bits, the masks over so many bits."""
    return [[sum(1 << b for b in c) for c in combinations(range(bits), k)] for k in range(most + 1)]


def blocks_of(fp: Column, half: int, block: int) -> Column:
    """The leading blocks of a fingerprint's variants, as an array."""
    lead = F.shiftrightunsigned(fp, 64 - block)
    return F.transform(F.array(*[F.lit(m) for masks in _flips(block, half) for m in masks]), lambda m: lead.bitwiseXOR(m))


def _spell(x: np.ndarray, left: np.ndarray, free: int) -> tuple[np.ndarray, np.ndarray]:
    """All variants that flip up to `left` of the low `free` bits: (owner's index, variant's low bits)."""
    low = np.uint64((1 << free) - 1)
    owners, variants = [], []
    for k, masks in enumerate(_flips(free, int(left.max(initial=0)))):
        own = np.flatnonzero(left >= k)
        if len(own) and masks:
            owners.append(np.repeat(own, len(masks)))
            variants.append(((x[own] & low)[:, None] ^ np.array(masks, np.uint64)[None, :]).ravel())
    return np.concatenate(owners), np.concatenate(variants)


def _link(x: np.ndarray, left: np.ndarray, free: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among the distinct fingerprints x of one block whose low `free` bits are open."""
    if len(x) < 2:
        return
    count = sum(np.sum(left >= k) * n for k, n in ((0, 1), (1, free), (2, free * (free - 1) // 2)))
    if count > HELD and free > 8:
        step, lead = np.uint64(free - 8), (x >> np.uint64(free - 8)) & np.uint64(255)
        for v in range(256):
            rest = left - np.bitwise_count(lead ^ np.uint64(v)).astype(np.int64)
            own = rest >= 0
            yield from _link(x[own], rest[own], int(step), radius)
        return
    owners, variants = _spell(x, left, free)
    order = np.argsort(variants, kind="stable")
    owners, variants = owners[order], variants[order]
    met = np.flatnonzero(variants[1:] == variants[:-1])
    if len(met) == 0:
        return
    a, b = x[owners[met]], x[owners[met + 1]]
    near = np.bitwise_count(a ^ b) <= radius
    u, v = forest(a[near].view(np.int64), b[near].view(np.int64))
    if len(u):
        yield u, v


def _linker(radius: int, block: int):
    free = 64 - block

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(lead: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
            left = radius // 2 - np.bitwise_count((x >> np.uint64(free)) ^ lead).astype(np.int64)
            # whole blocks together as far as they are few: the leading block is part of the variant
            edges = np.flatnonzero(np.r_[True, lead[1:] != lead[:-1]])
            bounds = np.r_[edges, len(lead)]
            cost = np.where(left == 2, free * (free + 1) // 2 + 1, np.where(left == 1, free + 1, 1)).cumsum()
            start = 0
            while start < len(edges):
                stop, base = start + 1, cost[bounds[start] - 1] if bounds[start] else 0
                stop = max(stop, int(np.searchsorted(cost[bounds[1:] - 1], base + HELD, "right")))
                s = slice(bounds[start], bounds[stop])
                together = stop - start > 1
                found = _several(lead[s], x[s], left[s]) if together else _link(x[s], left[s], free, radius)
                for u, v in found:
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
                start = stop

        def _several(lead: np.ndarray, x: np.ndarray, left: np.ndarray):
            owners, variants = _spell(x, left, free)
            variants |= lead[owners] << np.uint64(free)
            order = np.argsort(variants, kind="stable")
            owners, variants = owners[order], variants[order]
            met = np.flatnonzero(variants[1:] == variants[:-1])
            a, b = x[owners[met]], x[owners[met + 1]]
            near = np.bitwise_count(a ^ b) <= radius
            u, v = forest(a[near].view(np.int64), b[near].view(np.int64))
            if len(u):
                yield u, v

        leads, xs, size = [], [], 0
        for batch in batches:
            leads.append(batch.column(0).to_numpy().astype(np.uint64))
            xs.append(batch.column(1).to_numpy().view(np.uint64))
            size += batch.num_rows
            if size >= 100_000:  # whole blocks so far; the last one may go on
                lead, x = np.concatenate(leads), np.concatenate(xs)
                cut = int(np.searchsorted(lead, lead[-1]))
                if cut:
                    yield from solve(lead[:cut], x[:cut])
                leads, xs, size = [lead[cut:]], [x[cut:]], len(lead) - cut
        if size:
            yield from solve(np.concatenate(leads), np.concatenate(xs))

    return links


def links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) that span the same components as
    all pairs within the radius."""
    return _links_of(prints.select("fp").distinct(), radius, block)


def _links_of(distinct: DataFrame, radius: int, block: int) -> DataFrame:
    """The links between fingerprints (column fp) that occur once."""
    if radius > 5:
        raise ValueError("half the radius must be two bits at most")
    sent = distinct.select(F.explode(blocks_of(F.col("fp"), radius // 2, block)).alias("lead"), "fp")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sent.repartition(parts, "lead").sortWithinPartitions("lead")
    return dealt.mapInArrow(_linker(radius, block), "u long, v long").distinct()


def classes_of(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """root, the smallest fingerprint of its component, for every distinct fingerprint (column fp)."""
    if radius % 2:
        raise ValueError("the radius must be even")
    roots = components(links(prints, radius, block))
    distinct = prints.select("fp").distinct()
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(df: DataFrame, words: int = WORDS, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and component_id, the smallest doc_id reachable by links."""
    prints = settle(df.select("doc_id", fingerprint_of(text_of(), words).alias("fp")))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    placed = settle(least.join(classes_of(prints, radius, block), "fp"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = settle(placed.select("fp", "root").join(smallest, "root").select(F.col("fp").alias("of"), "component_id"))
    return prints.join(classes, F.col("fp") == F.col("of")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def word_fingerprints(text: str) -> tuple[int, int]:
    """Two independent fingerprints of the set of words of a text, as signed longs.

    A changed word leaves all other words of the set alone, where it spoils several shingles, so
    copies with many edits stay within the radius."""
    found = set(text.encode("utf-8", "surrogatepass").lower().split())
    if not found:
        return 0, 0
    ones, count = np.zeros(128, np.int64), 0
    digests = b"".join(map(xxhash.xxh128_digest, found))
    for k in range(0, len(digests), 16 * 65_536):
        rows = np.frombuffer(digests[k:k + 16 * 65_536], np.uint8).reshape(-1, 16)
        ones += np.unpackbits(rows, axis=1).sum(0, np.int64)
        count += len(rows)
    one, two = np.packbits(2 * ones > count).view(np.int64)
    return int(one), int(two)


def shingles(text: str, words: int) -> set[tuple[str, ...]]:
    found = text.lower().split()
    return {tuple(found[k:k + words]) for k in range(max(1, len(found) - words + 1))}


def _verifier(words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, set()
        for b in batches:
            u, v = [], []
            for x, y, s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                if x != last:
                    last, left = x, shingles(s.as_py(), words)
                right = shingles(t.as_py(), words)
                common = len(left & right)
                if common >= similarity * (len(left) + len(right) - common):
                    u.append(x)
                    v.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def digests_of(words: int):
    """The function that gives the distinct shingle hashes of a text."""
    def digests(text: str) -> np.ndarray:
        joined = {" ".join(s).encode("utf-8", "surrogatepass") for s in shingles(text, words)}
        return np.array(sorted({xxhash.xxh64_intdigest(s, SEED) for s in joined}), np.uint64).view(np.int64)

    return digests


def similar_texts(texts: DataFrame, prints: DataFrame, words: int, similarity: float, radius: int, block: int) -> DataFrame:
    """Verified links (u, v) between distinct texts, by their hash th.  prints: th and the array
    fps, a row per text; texts: th and text, repeats allowed.

    Representatives of fingerprints, and fingerprints along a spanning tree of their links, are
    compared first.  Where one of these pairs isn't similar, it stood for others that may be:
    `prefix.finished` compares all texts that such pairs join."""
    pairs = []
    for k in (0, 1):
        own = prints.select(F.get("fps", F.lit(k)).alias("fp"), "th")
        least, most = F.min("th").alias("least"), F.max("th").alias("most")
        stored = settle(own.groupBy("fp").agg(least, most).withColumn("shown", F.array_distinct(F.array("least", "most"))))
        shown = broadcast_if_small(stored)
        pairs.append(own.join(shown, "fp").select(F.explode("shown").alias("a"), F.col("th").alias("b")))
        near = _links_of(stored.select("fp"), radius, block)
        ends = [shown.select(F.col("fp").alias(e), F.explode("shown").alias(n)) for e, n in (("u", "a"), ("v", "b"))]
        pairs.append(near.join(ends[0], "u").join(ends[1], "v").select("a", "b"))
    found = pairs[0]
    for more in pairs[1:]:
        found = found.union(more)
    found = settle(found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = settle(found.select(F.col("a").alias("node")).union(found.select("b")).distinct())
    known = broadcast_if_small(nodes, BROADCAST_TEXTS)
    wanted = settle(texts.join(known, F.col("th") == F.col("node"), "left_semi").groupBy(F.col("th").alias("h")).agg(F.min("text").alias("text")))

    def verify(tried: DataFrame, given: DataFrame) -> DataFrame:
        left = given.select(F.col("h").alias("a"), F.col("text").alias("s"))
        right = given.select(F.col("h").alias("b"), F.col("text").alias("t"))
        both = tried.join(right, "b").join(left, "a").select("a", "b", "s", "t")
        return both.mapInArrow(_verifier(words, similarity), "u long, v long")

    return finished(found, settle(verify(found, wanted)), wanted, digests_of(words), similarity, verify)


def keep_one(df: DataFrame, words: int = SIMILAR_WORDS, similarity: float = SIMILARITY, radius: int = RADIUS,
             block: int = SIMILAR_BLOCK) -> DataFrame:
    """One document of each group of texts whose word shingles have the similarity: the one with
    the smallest doc_id (a null one comes last).

    Candidates are texts that a chain of fingerprints within the radius joins, by one of two
    word-set fingerprints; all of them are compared, by their shingles.  Equal texts are one text until the end, so copies cost
    nothing; of rows that repeat doc_id and text one stays."""
    if radius % 2:
        raise ValueError("the radius must be even")

    @F.pandas_udf("array<long>")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series([list(word_fingerprints(t)) for t in texts])

    keys = {"_a": F.xxhash64("doc_id", text_of()), "_b": F.xxhash64(text_of(), "doc_id")}
    rows = settle(df.select("doc_id", *[k.alias(n) for n, k in keys.items()], F.xxhash64(text_of()).alias("th"),
                            fingerprints(text_of()).alias("fps")))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_a", "_b")
    classes = settle(rows.groupBy("th").agg(F.min(place).alias("place"), F.min("fps").alias("fps")))
    texts = df.select(F.xxhash64(text_of()).alias("th"), text_of().alias("text"))
    roots = components(similar_texts(texts, classes.select("th", "fps"), words, similarity, radius, block))
    placed = settle(classes.select("th", "place").join(roots, F.col("th") == F.col("node"), "left").select(
        "th", "place", F.coalesce("root", "th").alias("root")))
    winners = placed.groupBy("root").agg(F.min("place").alias("winner"))
    judged = rows.join(placed.join(winners, "root").select(F.col("th").alias("of"), "winner"), F.col("th") == F.col("of"))
    losers = judged.where((F.col("_a") != F.col("winner._a")) | (F.col("_b") != F.col("winner._b"))).select("_a", "_b").distinct()
    kept = wrapped(df, **keys).join(broadcast_if_small(settle(losers)), ["_a", "_b"], "left_anti")
    if not rows.groupBy("_a", "_b").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["_a", "_b"])
    return kept.select(*unwrapped(df.columns))
