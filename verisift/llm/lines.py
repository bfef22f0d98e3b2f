"""Fuzzy line deduplication by MinHash: one line of each component stays.

Lines are compared after lower-casing and collapsing white space.  Character shingles are
hashed once and dealt into bins; the smallest hash of each bin is the signature (one-permutation
MinHash, empty bins borrow from the next).  Lines that agree in a whole band are candidates and
are verified by the exact Jaccard similarity of their shingle sets.  Links go through the
distributed union-find of `components`; of each component the first line (by doc_id, then line
number) stays.

With 12 bands of 4 bins a pair at similarity 0.8 is missed with probability 0.002, at 0.9 with
3 in a million.  All pairs of a bucket are candidates if it holds up to 16 distinct lines; in a
larger bucket every line is first compared with three pivots, which differ from band to band, so a
family of near-copies is linked without all its pairs.  Lines of such a bucket that still lie in
different components are then compared with each other, in salted blocks: exactly if at most
FEW_OTHERS lines of the bucket lie outside its largest component, else by long one-bit MinHash
signatures first and exactly where these agree (`bbit`), so no pair of a bucket is left out.

Defined results: lines without a word always stay and are not counted; lines shorter than a
shingle only match equal ones; null text stays null; a null doc_id comes last; rows that repeat
doc_id and text keep the same lines; other columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisift.llm import bbit
from verisift.llm.common import WHITE, batches_of, broadcast_if_small, join_hot, settle, text_of, unwrapped, wrapped
from verisift.llm.components import components
from verisift.session import scratch_path

SHINGLE = 7
BANDS = 12
ROWS = 4
SIMILARITY = 0.8
SMALL_BUCKET = 16
PIVOTS = 3
FEW_OTHERS = 32  # a long signature costs as much as comparing a line with about so many others
PACKED_BATCH = 2_000  # lines, or packed rows of a range of keys, that a worker is given at a time
PACKED = 1_000_000  # keys (16 bytes with their line) that a task gathers before it packs them, and most of a range that are held
RANGE = 200_000  # keys that a range has on average, at most
BROADCAST_LINES = 1_000_000  # line hashes (8 bytes each) that a semi-join may broadcast
PIECE = 50_000  # characters hashed at a time, so that arrays stay in a processor's cache
WHITE_BUT_BREAKS = r"[\x20\x09\x0B-\x0D]+"

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _hashed(texts: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles of texts that are at least one shingle long, and how many each text has."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts])
    ends = sizes.cumsum()
    # a polynomial in the code points: powers of two of the length are built by doubling, the rest from these
    built, step, power, rolled, width = points.astype(np.uint64), 1, _M3, None, 0
    while step <= shingle:
        if shingle & step:
            if rolled is None:
                rolled, width = built, step
            else:
                n = len(points) - width - step + 1
                rolled = rolled[:n] * power
                rolled += built[width:width + n]
                width += step
        if 2 * step <= shingle:
            longer = built[:-step] * power if len(built) > step else built[:0]
            longer += built[step:]
            built = longer
        step, power = 2 * step, np.uint64(int(power) ** 2 % 2**64)
    rolled = rolled ^ (rolled >> np.uint64(32))
    rolled *= _M1
    kept = np.ones(len(rolled), bool)
    for k in range(1, shingle):  # shingles that would reach into the next text
        at = ends[:-1] - k
        kept[at[at >= 0]] = False
    return rolled[kept], sizes - shingle + 1


def shingle_hashes(texts: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of all shingles of texts that are at least one shingle long."""
    hashed, counts = _hashed(texts, shingle)
    return hashed, np.repeat(np.arange(len(texts), dtype=np.int32), counts)


def signatures(texts: list[str], bins: int, shingle: int = SHINGLE) -> np.ndarray:
    """One row of smallest shingle hashes per text (each at least one shingle long)."""
    hashed, counts = _hashed(texts, shingle)
    slot = hashed >> np.uint64(44)
    slot *= np.uint64(bins)
    slot >>= np.uint64(20)
    at = np.repeat(np.arange(len(texts)) * bins, counts)
    at += slot.view(np.int64)
    hashed &= np.uint64((1 << 40) - 1)
    empty = np.uint64(1 << 40)
    out = np.full(len(texts) * bins, empty, np.uint64)
    np.minimum.at(out, at, hashed)
    out = out.reshape(len(texts), bins)
    for step in range(1, bins):  # empty bins take the next filled one, marked by the distance
        holes = out == empty
        if not holes.any():
            break
        ahead = np.roll(out, -step, axis=1)
        out = np.where(holes & (ahead < empty), ahead + np.uint64(step << 41), out)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signature), bands), np.uint64)
    for r in range(rows):
        keys = _mix(keys * _M1 + signature[:, r::rows][:, :bands])
    return _mix(keys + np.arange(bands, dtype=np.uint64)[None, :])


def _packed(key: np.ndarray, h: np.ndarray, ranges: int) -> pa.RecordBatch:
    """A row (number, bytes) for each range of keys that occurs; the bytes are its pairs of key and h, as longs."""
    part = (((key >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.uint16 if ranges <= 1 << 16 else np.uint32)
    order = np.argsort(part, kind="stable")
    part = part[order]
    pairs = np.empty((len(key), 2), np.int64)
    pairs[:, 0], pairs[:, 1] = key.view(np.int64)[order], h[order]
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    ends = (np.r_[starts, len(key)] * 16).astype(np.int32)
    rows = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(pairs)])
    return pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), rows], names=["part", "rows"])


def _banded(bands: int, rows: int, shingle: int, ranges: int):
    """The keys of lines (h, norm) with their h, packed by range of keys, so that Spark deals out few rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # repeated lines of a task go out once
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in batches:
            ids, texts = [], []
            for h, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if h not in seen:
                    seen.add(h)
                    ids.append(h)
                    texts.append(t.as_py())
            if len(seen) > 200_000:
                seen.clear()
            at = 0
            while at < len(ids):  # a bounded number of characters at a time
                stop, chars = at, 0
                while stop < len(ids) and (stop == at or chars + len(texts[stop]) < PIECE):
                    chars += len(texts[stop])
                    stop += 1
                keys = band_keys(signatures(texts[at:stop], bands * rows, shingle), bands, rows)
                held.append((keys.ravel(), np.repeat(np.array(ids[at:stop], np.int64), bands)))
                size += keys.size
                at = stop
                if size >= PACKED:
                    yield _packed(*map(np.concatenate, zip(*held, strict=True)), ranges)
                    held, size = [], 0
        if held:
            yield _packed(*map(np.concatenate, zip(*held, strict=True)), ranges)

    return run


def _pairs_of(key: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of whole buckets, given sorted by key without repeats."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    size, first = np.repeat(sizes, sizes), np.repeat(starts, sizes)
    a, b = [], []
    for d in range(1, SMALL_BUCKET):
        near = np.flatnonzero((size[:-d] <= SMALL_BUCKET) & (key[:-d] == key[d:])) if d < len(key) else np.empty(0, np.int64)
        a.append(h[near])
        b.append(h[near + d])
    for p in range(PIVOTS):
        far = np.flatnonzero((size > SMALL_BUCKET) & (np.arange(len(key)) > first + p))
        a.append(h[first[far] + p])
        b.append(h[far])
    return np.concatenate(a), np.concatenate(b)


def _bucket_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs from (key, h) sorted by key; of a bucket that goes on and on only its
    pivots are held."""
    key, h = np.empty(0, np.int64), np.empty(0, np.int64)

    def out(k: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        fresh = np.r_[True, (k[1:] != k[:-1]) | (v[1:] != v[:-1])]  # equal lines of several tasks are neighbours
        a, b = _pairs_of(k[fresh], v[fresh])
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        if len(lo):
            yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], names=["a", "b"])

    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy()])
        h = np.concatenate([h, batch.column(1).to_numpy()])
        if len(key) < 200_000:
            continue
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield from out(key[:cut], h[:cut])
            key, h = key[cut:], h[cut:]
        elif len(key) > 1_000_000:
            yield from out(key, h)
            distinct = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])[:SMALL_BUCKET + 1]
            key, h = key[distinct], h[distinct]
    if len(key):
        yield from out(key, h)


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of buckets of several distinct lines, once and by h XOR key in each bucket, from (key, h)
    sorted by key; of a bucket that goes on and on, a million rows at a time."""
    held: list[pa.RecordBatch] = []
    size, going = 0, None

    def out(key: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        met = key[1:] == key[:-1]
        several = np.r_[met, False] | np.r_[False, met]
        if going is not None:
            several |= key == going
        key, h = key[several], h[several]
        order = np.lexsort((h ^ key, key))
        key, h = key[order], h[order]
        if len(key):
            fresh = np.r_[True, (key[1:] != key[:-1]) | (h[1:] != h[:-1])]  # equal lines of several tasks are neighbours
            yield pa.RecordBatch.from_arrays([pa.array(key[fresh]), pa.array(h[fresh])], names=["key", "h"])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < 200_000:
            continue
        key, h = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1))
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield from out(key[:cut], h[:cut])
            going = None
        elif size > 1_000_000:
            yield from out(key, h)
            cut, going = len(key), key[-1]
        held = [pa.RecordBatch.from_arrays([pa.array(key[cut:]), pa.array(h[cut:])], names=["key", "h"])]
        size = len(key) - cut
    if size:
        yield from out(*(np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1)))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (large false, a, b) and the rows (large true, key, h) of buckets of more than
    SMALL_BUCKET rows, from (key, h) sorted by key, in one pass."""
    rows: list[pa.RecordBatch] = []
    start: list[int] = []
    held, count = None, 0

    def tapped() -> Iterator[pa.RecordBatch]:
        nonlocal held, count, start
        for batch in batches:
            key, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keys, values = [], []
            edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
            ends = np.r_[edges[1:], len(key)]
            seen = ends - edges > SMALL_BUCKET  # others matter only at the ends, where buckets go on in other batches
            seen[:1] = seen[-1:] = True
            for at, stop in zip(edges[seen], ends[seen], strict=True):
                if key[at] != held:
                    held, count, start = key[at], 0, []
                count += stop - at
                if count > SMALL_BUCKET:
                    values += [np.array(start, np.int64), h[at:stop]]
                    keys.append(np.full(len(start) + stop - at, key[at]))
                    start = []
                else:
                    start += h[at:stop].tolist()
            if keys:
                rows.append(marked(True, np.concatenate(keys), np.concatenate(values)))
            yield batch

    def marked(large: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), large)), pa.array(a), pa.array(b)], names=["large", "a", "b"])

    for pairs in _bucket_pairs(tapped()):
        yield marked(False, pairs.column(0).to_numpy(), pairs.column(1).to_numpy())
        while rows:
            yield rows.pop()
    yield from rows


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What _candidates finds, from packed rows (part, rows) sorted by part; a range of keys at a time.

    Of a range with more than PACKED keys, which only large buckets make, the candidates so far go out, and the
    first SMALL_BUCKET + 1 lines of each bucket stay to meet the lines that follow."""
    held: list[np.ndarray] = []
    size, most, now = 0, PACKED, None

    def by_key(key: np.ndarray, h: np.ndarray, order: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key[order]), pa.array(h[order])], names=["key", "h"])

    def out() -> Iterator[pa.RecordBatch]:
        if held:
            key, h = np.concatenate(held).T.copy()
            yield from _candidates(_ordered(iter([by_key(key, h, np.argsort(key))])))

    for batch in batches:
        for part, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if part != now:
                yield from out()
                held, size, most, now = [], 0, PACKED, part
            held.append(np.frombuffer(packed.as_buffer(), np.int64).reshape(-1, 2))
            size += len(held[-1])
            if size > most:
                key, h = np.concatenate(held).T.copy()
                order = np.lexsort((h ^ key, key))
                key, h = key[order], h[order]
                fresh = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (h[1:] != h[:-1])])
                key, h = key[fresh], h[fresh]
                yield from _candidates(iter([by_key(key, h, np.arange(len(key)))]))
                starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                rank = np.arange(len(key)) - np.repeat(starts, np.diff(np.r_[starts, len(key)]))
                held = [np.stack([key, h], axis=1)[rank <= SMALL_BUCKET]]
                size = len(held[0])
                most = max(PACKED, 2 * size)
    yield from out()


def _signed(bands: int, rows: int, shingle: int):
    """sid, n, the long signature and the keys of lines, from (sid, norm)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            hashed, owner = shingle_hashes(texts, shingle)
            sets = [np.unique(h) for h in np.split(hashed, np.flatnonzero(np.diff(owner)) + 1)] if texts else []
            sigs = pa.array([bbit.long_signature(h) for h in sets], pa.list_(pa.int64()))
            keys = band_keys(signatures(texts, bands * rows, shingle), bands, rows).view(np.int64) if texts else []
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(h) for h in sets], pa.int64()), sigs, pa.array(list(keys), pa.list_(pa.int64()))],
                names=["sid", "n", "sig", "bands"])

    return run


def _shingles(text: str, shingle: int) -> set[str]:
    return {text[k:k + shingle] for k in range(max(1, len(text) - shingle + 1))}


def _alike(s: str, t: str, similarity: float, shingle: int) -> bool:
    left, right = _shingles(s, shingle), _shingles(t, shingle)
    common = len(left & right)
    return common >= similarity * (len(left) + len(right) - common)


def similar(left: list[str], right: list[str], similarity: float, shingle: int) -> np.ndarray:
    """Whether the shingle sets of each pair of texts reach the similarity.

    Sets are compared as sorted hashes, all pairs at once; a pair so close to the bound that a
    collision of hashes could decide it is compared again, by its shingles."""
    n = len(left)
    key, counts = _hashed(left + right, shingle)
    bits = np.uint64(max(1, int(n).bit_length()))
    pair = np.arange(n, dtype=np.uint64) << (np.uint64(64) - bits)
    key >>= bits + np.uint64(1)
    key <<= np.uint64(1)
    key |= np.repeat(np.r_[pair, pair | np.uint64(1)], counts)  # the lowest bit is the side
    key.sort()
    step = key[1:] ^ key[:-1]
    sizes = counts[:n] + counts[n:]
    ends = np.r_[0, sizes.cumsum()] - 1
    # each shingle counts once on each side; of one on both sides the right ones follow the left ones
    total = sizes - np.diff(np.searchsorted(np.flatnonzero(step == 0), ends))
    common = np.diff(np.searchsorted(np.flatnonzero(step == 1), ends))
    gap = common - similarity * (total - common)
    found = gap >= 0
    for k in np.flatnonzero(np.abs(gap) <= 2):
        found[k] = _alike(left[k], right[k], similarity, shingle)
    return found


def _verified(similarity: float, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.add(pc.utf8_length(batch.column(2)), pc.utf8_length(batch.column(3))).to_numpy()
            part = (sizes.cumsum() - sizes) // PIECE  # about so many characters at a time
            for at, stop in zip(bounds := np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), np.r_[bounds[1:], len(part)], strict=True):
                rows = batch.slice(at, stop - at)
                found = pa.array(similar(rows.column(2).to_pylist(), rows.column(3).to_pylist(), similarity, shingle))
                yield pa.RecordBatch.from_arrays([rows.column(0).filter(found), rows.column(1).filter(found)], names=["a", "b"])

    return run


def lines_of(df: DataFrame) -> DataFrame:
    """_id, _th, line (number), norm (normalised text) and h (its hash) of all lines with a word.

    White space is collapsed and letters are folded once per text, before it is split; texts in which
    no blank is doubled and no other white space than breaks occurs have nothing to collapse."""
    # what stands beside posexplode is computed for every line, so texts are hashed before
    texts = df.select(F.col("doc_id").alias("_id"), F.xxhash64(text_of()).alias("_th"), text_of().alias("_text"))
    text = F.col("_text")
    uneven = reduce(or_, [F.contains(text, F.lit(c)) for c in ("  ", *WHITE.replace(" ", "").replace("\n", ""))])
    folded = F.lower(F.when(uneven, F.regexp_replace(text, WHITE_BUT_BREAKS, " ")).otherwise(text))
    split = texts.select("_id", "_th", F.posexplode(F.split(folded, "\n")).alias("line", "raw"))
    return split.select("_id", "_th", "line", F.trim("raw").alias("norm")).where("norm <> ''").withColumn("h", F.xxhash64("norm"))


def _compared(pairs: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs (a, b) of lines that reach the similarity, stored.  A line in many pairs goes to several tasks."""
    heads = settle(pairs.groupBy("a").agg(F.count("*").alias("size")).join(
        texts.select("sid", F.col("norm").alias("s")), F.col("a") == F.col("sid")).select("a", "s", "size"))
    right = pairs.join(texts.select("sid", F.col("norm").alias("t")), F.col("b") == F.col("sid")).select("a", "b", "t")
    both = join_hot(right, ["a"], heads, ["b"]).select("a", "b", "s", "t")
    return settle(both.mapInArrow(_verified(similarity, shingle), "a long, b long"))


def _texts(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """sid (hash) and norm of the lines whose hash is a node, stored."""
    known = broadcast_if_small(settle(nodes.distinct()), BROADCAST_LINES)
    found = lines.join(known, F.col("h") == F.col("node"), "left_semi")
    return settle(found.groupBy(F.col("h").alias("sid")).agg(F.min("norm").alias("norm")))


def _met_in(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of lines that share a bucket and lie in different components, from the rows of open buckets."""
    # of two lines with different labels one has another label than most lines of the bucket
    left = rows.where("not in_top").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"),
                                           F.col("sid").alias("x"), F.col("label").alias("x_label"))
    right = rows.select("key", F.pmod(F.xxhash64("sid"), F.col("salts")).alias("salt"), "sid", "label", "in_top")
    met = left.join(right, ["key", "salt"]).where((F.col("x_label") != F.col("label")) & (F.col("in_top") | (F.col("x") < F.col("sid"))))
    return met.select(F.least("x", "sid").alias("a"), F.greatest("x", "sid").alias("b"))


def links(lines: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """Links (a, b) between hashes of distinct lines that give the components of all verified ones."""
    long_enough = lines.where(F.char_length("norm") >= shingle).select("h", "norm")
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(8 * parts, -(-lines.count() * bands // RANGE))
    banded = long_enough.mapInArrow(_banded(bands, rows, shingle, ranges), "part int, rows binary")
    dealt = banded.repartition(parts, "part").sortWithinPartitions("part")
    found = dealt.mapInArrow(_met, "large boolean, a long, b long").where("large or a <> b")
    with batches_of(lines.sparkSession, PACKED_BATCH):
        met = settle(found.distinct())
    pairs = met.where("not large").select("a", "b")
    texts = _texts(long_enough, pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
    found = _compared(pairs, texts, similarity, shingle)
    large = met.where("large").select(F.col("a").alias("key"), F.col("b").alias("sid"))
    if large.isEmpty():
        return found
    found = components(found)
    open_ = bbit._open_rows(large, found)
    if open_.isEmpty():
        return found
    near = _met_in(open_.where(F.col("others") <= FEW_OTHERS))
    many = open_.where(F.col("others") > FEW_OTHERS)
    if not many.isEmpty():
        # a line of a large bucket has been compared with a pivot or is one, so its text is there
        wanted = broadcast_if_small(settle(many.select(F.col("sid").alias("node")).distinct()), BROADCAST_LINES)
        own = texts.join(wanted, F.col("sid") == F.col("node"), "left_semi")
        signed = settle(own.mapInArrow(_signed(bands, rows, shingle), "sid long, n long, sig array<long>, bands array<long>"))
        near = near.union(bbit._open_pairs(many, signed, round(100 * similarity)).select("a", "b"))
    rest = settle(near.distinct().join(pairs, ["a", "b"], "left_anti"))
    return found if rest.isEmpty() else found.union(_compared(rest, texts, similarity, shingle))


def dedup_lines(df: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """The documents with every column, text without the lines that repeat another, and the
    counts n_lines and n_removed."""
    path = scratch_path(df.sparkSession, "lines")
    # lines hardly repeat within a file, so a dictionary of them is built and given up
    lines_of(df).write.options(**{"compression": "zstd", "parquet.enable.dictionary": "false"}).parquet(path)
    lines = df.sparkSession.read.parquet(path)
    roots = components(links(lines, similarity, bands, rows, shingle))
    place = F.struct(F.col("_id").isNull().alias("none"), "_id", "_th", "line")
    classes = lines.groupBy("h").agg(F.min(place).alias("place"))
    placed = classes.join(roots, F.col("h") == F.col("node"), "left").select(F.coalesce("root", "h").alias("root"), "place")
    first = placed.groupBy("root").agg(F.min("place").alias("place")).select("place.*")
    kept = first.groupBy(F.col("_id").alias("_kid"), F.col("_th").alias("_kth")).agg(F.collect_list("line").alias("_kept"))

    @F.pandas_udf("text string, n_lines long, n_removed long")
    def rebuilt(texts: pd.Series, kept_lines: pd.Series) -> pd.DataFrame:
        out = []
        for text, stay in zip(texts, kept_lines, strict=True):
            stay = set() if stay is None else set(stay)
            parts = text.split("\n")
            worded = [bool(p.strip(WHITE)) for p in parts]
            left = [p for k, (p, w) in enumerate(zip(parts, worded, strict=True)) if not w or k in stay]
            out.append(("\n".join(left), sum(worded), len(parts) - len(left)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_removed"])

    documents = wrapped(df, _id=F.col("doc_id"), _th=F.xxhash64(text_of()))
    same = documents["_id"].eqNullSafe(kept["_kid"]) & (documents["_th"] == kept["_kth"])
    done = documents.join(kept, same, "left").withColumn("_new", rebuilt(text_of("row.text"), F.col("_kept")))
    return done.select(*unwrapped(
        df.columns, text=F.when(F.col("row.text").isNotNull(), F.col("_new.text")),
        n_lines=F.col("_new.n_lines"), n_removed=F.col("_new.n_removed")))
