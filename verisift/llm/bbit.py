"""MinHash near-dedup with b-bit signatures.

A text is the set of its four-word shingles.  128 hash functions give 128 minima.  Bands of
four whole minima make the keys of candidate buckets; what is kept of the signature are the
two low bits of every minimum, packed into four longs.  Two signatures agree in a share P of
their places, of which C = 1/4 agree by chance, so (P - C) / (1 - C) estimates the similarity;
an XOR and two bit counts per pair, without the texts.  Pairs whose estimate is MARGIN below
the bound go no further, all others are confirmed on their full sets.

Texts with equal sets are one set from the start.  In each bucket the most central set (the one
with the fullest buckets) is compared with all others, which settles groups of edited copies
with one comparison per copy.  Sets that share a bucket but no component afterwards get a longer
signature, the lowest bit of 4,096 minima, and are compared by it, bucket by bucket, in salted
blocks: it tells pairs a little below the bound, which groups of heavily edited copies are full
of, from pairs above it.  Of the pairs that pass, the closest of each set are confirmed first, then
all that still lie in different components.  So no pair of a bucket that could reach the bound
is left out, and sets that are linked already aren't compared.

A pair at a similarity of 0.8 shares none of the 32 bands with a probability of 5e-8, and falls
below the margins of 0.25 and 0.05 with one of 1e-7 each; at higher similarities all are smaller.

Defined results: ASCII letters are folded, words end at ASCII white space; a text of fewer words
than a shingle is one shingle; texts without words are linked with nothing; repeated rows are
linked like copies; a null doc_id takes part and loses to any other as the smallest (a group of
nulls only has component null, and is kept); other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.llm.common import broadcast_if_small, join_hot, settle, text_of
from verisift.llm.components import components

WORDS = 4
SIMILARITY = 80  # per cent
BANDS = 32
ROWS = 4
MINIMA = BANDS * ROWS
BITS = 2
MARGIN = 0.25
LONG_MINIMA = 4096
LONG_BITS = 1
LONG_MARGIN = 0.05
BROADCAST_SETS = 1_000_000  # set keys (16 bytes each) that a semi-join may broadcast
VOCABULARY = 300_000        # words whose hashes a task keeps

_ODD, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SALTS = np.random.default_rng(42).integers(0, 2**64, (2, LONG_MINIMA), np.uint64)
_FACTORS, _SHIFTS = _SALTS[0] | np.uint64(1), _SALTS[1]
_SHORT_FACTORS, _SHORT_SHIFTS = ((x >> np.uint64(32)).astype(np.uint32) for x in _SALTS)
_SHORT_FACTORS |= np.uint32(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """128-bit hashes of words, as pairs of longs, kept up to a bounded number of words."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > VOCABULARY:
            self.clear()
        digest = xxhash.xxh128_intdigest(word)
        self[word] = pair = (digest >> 64, digest & (2**64 - 1))
        return pair


def folded_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(found: list[bytes], hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text, as rows of two 64-bit hashes, in order; no words, no rows."""
    if not found:
        return np.empty((0, 2), np.uint64)
    lanes = np.array([hashes[w] for w in found], np.uint64)
    size = min(words, len(found))
    count = len(found) - size + 1
    rolled = np.zeros((count, 2), np.uint64)
    for k in range(size):
        rolled = rolled * _ODD + lanes[k:k + count]
    rolled = _mix(rolled)
    _, first = np.unique(rolled[:, 0], return_index=True)
    return rolled[first]


def minima(one: np.ndarray, count: int = MINIMA) -> np.ndarray:
    """The smallest value of each hash function over the shingles of a set."""
    low = np.full(count, np.uint64(2**64 - 1))
    step = (1 << 18) // count
    for k in range(0, len(one), step):
        low = np.minimum(low, (one[k:k + step, None] * _FACTORS[:count] + _SHIFTS[:count]).min(axis=0))
    return low


def long_signature(one: np.ndarray) -> np.ndarray:
    """The lowest bits of LONG_MINIMA minima over a set's shingles, packed.

    The hash functions work on the upper 32 bits of the shingles, which processors multiply many at
    a time; shingles of a set that agree in these are too rare to move the estimate."""
    short, step = (one >> np.uint64(32)).astype(np.uint32), (1 << 18) // LONG_MINIMA
    low, held = np.full(LONG_MINIMA, np.uint32(2**32 - 1)), np.empty((step, LONG_MINIMA), np.uint32)
    for k in range(0, len(short), step):
        part = short[k:k + step, None]
        values = np.multiply(part, _SHORT_FACTORS, out=held[:len(part)])
        values += _SHORT_SHIFTS
        np.minimum(low, values.min(axis=0), out=low)
    return packed(low.astype(np.uint64), LONG_BITS)


def packed(low: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of the (mixed) minima: the longs of all first bits, then those of the second bits."""
    mixed = _mix(low + _SHIFTS[:len(low)])
    planes = [np.packbits(((mixed >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.int64) for b in range(bits)]
    return np.concatenate(planes)


def bands(low: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        keys = _mix(keys * _ODD + low[r::ROWS])
    return keys.view(np.int64)


_SIGNED = "doc_id long, t1 long, t2 long, n long, s1 long, s2 long, sig array<long>, bands array<long>"


def _signed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, s1, s2, sigs, keys = [], [], [], [], []
            for text in batch.column(3):
                one = shingle_set(folded_words(text.as_py()), hashes, words)
                digest = xxhash.xxh128_intdigest(one.tobytes())
                n.append(len(one))
                s1.append((digest >> 64) - 2**63)
                s2.append((digest & (2**64 - 1)) - 2**63)
                low = minima(one[:, 0]) if len(one) else None
                sigs.append([] if low is None else packed(low))
                keys.append([] if low is None else bands(low))
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array(c, pa.int64()) for c in (n, s1, s2)), pa.array(sigs, lists), pa.array(keys, lists)],
                names=["doc_id", "t1", "t2", "n", "s1", "s2", "sig", "bands"])

    return run


def _text_keys(text: Column) -> dict[str, Column]:
    return {"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(7), text)}


def agreeing(x: Column, y: Column, count: int = MINIMA, bits: int = BITS) -> Column:
    """The number of places in which two packed signatures agree."""
    longs, apart = count // 64, F.lit(0)
    for k in range(longs):
        other = F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))
        for b in range(1, bits):
            at = F.lit(k + b * longs)
            other = other.bitwiseOR(F.get(x, at).bitwiseXOR(F.get(y, at)))
        apart = apart + F.bit_count(other)
    return F.lit(count) - apart


def enough(similarity: int, margin: float = MARGIN, count: int = MINIMA, bits: int = BITS) -> int:
    """The agreeing places of a pair whose collision-corrected estimate lies `margin` below the similarity."""
    chance = 2.0 ** -bits
    return int(np.ceil(count * (chance + (1 - chance) * (similarity / 100 - margin))))


def _alike(s: list[bytes], t: list[bytes], words: int, similarity: int) -> bool:
    left, right = ({tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} for w in (s, t))
    common = len(left & right)
    return 100 * common >= similarity * (len(left) + len(right) - common)


def _verified(words: int, similarity: int):
    """Links (u, v) from (a, salt, kind, b, text): the text of a (kind 0) stands before those compared with it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, head, left = WordHashes(), [], np.empty(0, np.uint64)
        for batch in batches:
            u, v = [], []
            rows = (batch.column(k).to_pylist() for k in (0, 2, 3))
            for a, kind, b, text in zip(*rows, batch.column(4), strict=True):
                found = folded_words(text.as_py())
                one = shingle_set(found, hashes, words)[:, 0]
                if kind == 0:
                    head, left = found, one
                    continue
                common = len(np.intersect1d(left, one, assume_unique=True))
                gap = 100 * common - similarity * (len(left) + len(one) - common)
                if abs(gap) > 400:  # more than a chance collision of hashes could change
                    linked = gap > 0
                else:
                    linked = _alike(head, found, words, similarity)
                if linked:
                    u.append(a)
                    v.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _texts(nodes: DataFrame, sets: DataFrame, df: DataFrame) -> DataFrame:
    """sid and text of the sets of a column `node`, stored."""
    wanted = settle(nodes.join(sets.select("sid", "t1", "t2"), F.col("node") == F.col("sid")).select("sid", "t1", "t2"))
    keys = wanted.select(F.col("t1").alias("k1"), F.col("t2").alias("k2"))
    read = df.select(text_of().alias("text")).select("text", *[c.alias(k) for k, c in _text_keys(F.col("text")).items()])
    found = read.join(broadcast_if_small(keys, BROADCAST_SETS), (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2")), "left_semi")
    once = found.groupBy("t1", "t2").agg(F.min("text").alias("text"))
    return settle(wanted.join(once, ["t1", "t2"]).select("sid", "text"))


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """The pairs (a, b) of sets that reach the similarity on their full sets, stored.  texts: sid and text."""
    unit = 200
    heads = settle(pairs.groupBy("a").agg(F.count("*").alias("met")))
    salts = F.ceil(F.col("met") / unit)
    first = heads.join(texts, F.col("a") == F.col("sid")).select(
        "a", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("a").alias("b"), "text")
    many = heads.where(F.col("met") > unit).select(F.col("a").alias("hot"), salts.alias("salts"))
    dealt = pairs.join(broadcast_if_small(many), F.col("a") == F.col("hot"), "left").withColumn(
        "salt", F.coalesce(F.pmod(F.xxhash64("b"), "salts"), F.lit(0)))
    rest = dealt.join(texts, F.col("b") == F.col("sid")).select("a", "salt", F.lit(1).alias("kind"), "b", "text")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = first.union(rest).repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "kind")
    return settle(ordered.mapInArrow(_verified(words, similarity), "u long, v long"))


def _longer(words: int):
    """sid, n and the long signature of the sets, from (sid, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(folded_words(text.as_py()), hashes, words)[:, 0] for text in batch.column(1)]
            sigs = pa.array([long_signature(one) for one in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(one) for one in sets], pa.int64()), sigs], names=["of", "n", "sig"])

    return run


def _members(sets: DataFrame) -> DataFrame:
    """key, size (of the bucket), sid, sig and weight (sum of the sizes of the set's buckets) of
    all sets in buckets of two or more, stored."""
    every = sets.select("sid", F.explode("bands").alias("key"))
    sizes = settle(every.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    met = join_hot(every, ["key"], sizes.withColumn("met", F.col("size")), ["sid"])
    met = settle(met.select("key", F.col("met").alias("size"), "sid"))
    weights = met.groupBy(F.col("sid").alias("of")).agg(F.sum("size").alias("weight"))
    known = sets.select("sid", "sig").join(weights, F.col("sid") == F.col("of")).select("of", "sig", "weight")
    return settle(met.join(known, F.col("sid") == F.col("of")).drop("of"))


def _central(members: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) of the most central set of each bucket with the others, as far as their signatures agree."""
    centre = members.groupBy("key").agg(F.count("*").alias("size"), F.max(F.struct("weight", "sid", "sig")).alias("top"))
    met = join_hot(members.select("key", "sid", "sig"), ["key"], settle(centre), ["sid"])
    near = met.where((F.col("sid") != F.col("top.sid")) & (agreeing(F.col("sig"), F.col("top.sig")) >= least))
    return near.select(F.col("top.sid").alias("a"), F.col("sid").alias("b")).distinct()


def _labels(links: DataFrame, name: str) -> DataFrame:
    roots = components(links)
    return roots.select(F.col("node").alias(f"{name}_node"), F.col("root").alias(f"{name}_root"))


def _labelled(df: DataFrame, links: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The rows with the component of the sets in some columns."""
    roots = settle(_labels(links, "r"))
    for column, label in columns.items():
        df = df.join(roots, F.col(column) == F.col("r_node"), "left").withColumn(label, F.coalesce("r_root", column)).drop("r_node", "r_root")
    return df


def _open_rows(members: DataFrame, links: DataFrame) -> DataFrame:
    """key, size, others (members with another label than most), sid, label and salts of the members of
    buckets with several components, and whether the label is that of most; stored."""
    now = settle(_labelled(members.select("key", "sid"), links, {"sid": "label"}))
    sizes = now.groupBy("key", "label").agg(F.count("*").alias("met"))
    several = settle(sizes.groupBy("key").agg(
        F.max(F.struct("met", "label")).alias("most"), F.count("*").alias("labels"), F.sum("met").alias("size")).where("labels > 1"))
    known = several.select("key", "size", (F.col("size") - F.col("most.met")).alias("others"), F.col("most.label").alias("top"),
                           F.ceil(F.col("size") / 200).alias("salts"))
    rows = join_hot(now, ["key"], known, ["sid"])
    return settle(rows.withColumn("in_top", F.col("label") == F.col("top")).drop("top"))


def _open_pairs(rows: DataFrame, signed: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) of sets that share a bucket, lie in different components and agree by their long
    signatures, with the number of agreeing places.  signed: sid, n, sig and bands (the buckets' keys)."""
    least = enough(similarity, LONG_MARGIN, LONG_MINIMA, LONG_BITS)
    known = rows.join(signed.withColumnRenamed("sid", "of"), F.col("sid") == F.col("of")).drop("of")
    taken = ("sid", "n", "sig", "label", "bands")
    # of two sets with different labels one has another label than most sets of the bucket
    left = known.where("not in_top").select(
        "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), *[F.col(c).alias(f"x_{c}") for c in taken])
    right = known.select("key", F.pmod(F.xxhash64("sid"), F.col("salts")).alias("salt"), *taken, "in_top")
    fits = 100 * F.least("x_n", "n") >= similarity * F.greatest("x_n", "n")
    places = agreeing(F.col("x_sig"), F.col("sig"), LONG_MINIMA, LONG_BITS)
    # a pair that shares several buckets counts in the first of them
    shared = F.array_position(F.zip_with("x_bands", "bands", lambda a, b: a == b), F.lit(True))
    both = left.join(right, ["key", "salt"]).where(
        (F.col("x_label") != F.col("label")) & (F.col("in_top") | (F.col("x_sid") < F.col("sid"))) & fits & (places >= least)
        & (F.get("bands", (shared - 1).cast("int")) == F.col("key")))
    pair = both.select(F.least("x_sid", "sid").alias("a"), F.greatest("x_sid", "sid").alias("b"), places.alias("places"))
    return pair.distinct()


def links_of(sets: DataFrame, df: DataFrame, words: int, similarity: int) -> DataFrame:
    """Links (u, v) between sets that give the components of all similar pairs."""
    members = _members(sets)
    tried = settle(_central(members, enough(similarity)))
    ends = tried.select(F.col("a").alias("node")).union(tried.select("b")).distinct()
    links = _confirmed(tried, _texts(ends, sets, df), words, similarity)
    rows = _open_rows(members, links)
    if rows.isEmpty():
        return links
    texts = _texts(rows.select(F.col("sid").alias("node")).distinct(), sets, df)
    longer = texts.mapInArrow(_longer(words), "of long, n long, sig array<long>")
    signed = settle(longer.join(sets.select("sid", "bands"), F.col("of") == F.col("sid")).drop("of"))
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = settle(_open_pairs(rows, signed, similarity).join(done, ["a", "b"], "left_anti"))
    if pairs.isEmpty():
        return links
    best = settle(pairs.groupBy("a").agg(F.max_by("b", "places").alias("b")).union(
        pairs.groupBy("b").agg(F.max_by("a", "places").alias("a")).select("a", "b")).distinct())
    links = settle(links.union(_confirmed(best, texts, words, similarity)))
    rest = _labelled(pairs.join(best, ["a", "b"], "left_anti"), links, {"a": "la", "b": "lb"})
    rest = settle(rest.where("la <> lb").select("a", "b"))
    return links if rest.isEmpty() else links.union(_confirmed(rest, texts, words, similarity))


def near_duplicates(df: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and kept."""
    read = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    keyed = read.select("doc_id", *[c.alias(k) for k, c in _text_keys(F.col("text")).items()], "text")
    rows = settle(keyed.mapInArrow(_signed(words), _SIGNED))
    same = rows.where("n > 0").groupBy("s1", "s2").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("size"), F.min(F.struct("t1", "t2")).alias("t"),
        *[F.min(c).alias(c) for c in ("n", "sig", "bands")])
    sets = settle(same.select("s1", "s2", "least", "size", "t.t1", "t.t2", "n", "sig", "bands").withColumn("sid", F.monotonically_increasing_id()))
    roots = components(links_of(sets, df, words, similarity))
    placed = settle(sets.select("s1", "s2", "size", "sid", "least").join(roots, F.col("sid") == F.col("node"), "left").select(
        "s1", "s2", "size", "least", F.coalesce("root", "sid").alias("root"), F.col("node").isNotNull().alias("linked")))
    smallest = placed.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("component_id"))
    classes = settle(placed.join(smallest, F.col("root") == F.col("of")).select("s1", "s2", "size", "component_id"))
    worded = join_hot(rows.where("n > 0").select("doc_id", "n", "s1", "s2"), ["s1", "s2"], classes, ["doc_id"])
    every = worded.select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(
        rows.where("n = 0").select("doc_id", "n", "doc_id"))
    return every.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
