"""Lexical retrieval packing into token sequences of a fixed window.

Documents are tokenized (plus one end id), whole windows are cut off from the front and become
sequences as they are, and the rest of each document is packed by retrieval: rests are dealt to shards
by content, every shard holds a BM25 inverted index of its rests with document frequencies counted
over all documents, and each seed (longest first) asks the index for unused neighbours, which fill
its window in rank order.  The neighbour that no longer fits is cut and its remainder stays in the
index, so that only the last sequence of a shard has padding.

A rest's place is given by terms drawn from it by consistent weighted sampling (weight: the term's part
in a BM25 score), so rests with the same heavy terms are likely to draw the same ones.  Neighbours that
draw others lie in other shards and are not found.
Rests are range-partitioned by these terms and cut into shards of about `shard_docs`; equal ones, however
many, are told apart by their row, so no term fills a shard or task by itself.  The number of shards
grows with the input, the work and memory of a shard do not.  Frequencies are one row per vocabulary
entry (50,257 at most).

Defined results: null reads as empty, an empty document is its end id alone; rows repeating a
doc_id are documents of their own; a null doc_id stays null; other columns are ignored; ties go
by doc_id, then start, then ids; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisift.llm.common import settle, text_of

WINDOW = 1024
SHARD_DOCS = 1024
DRAWS = 4  # terms of 16 bits that make up the place of a rest
WHOLE_SEQUENCES = 1 << 62  # sequences that are whole windows are numbered from here
END_ID = 0
K1, B = 1.2, 0.75
VOCABULARY = 50_257
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50_256


# White space as the vocabulary's pattern knows it, and where the last of several before a word begins
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
TWO_BLANKS = re.compile(f"[{BLANK}][{BLANK}]")
LAST_BLANK = re.compile(f"(?<=[{BLANK}])(?=[{BLANK}][^{BLANK}])")
AHEAD = r"\s+(?!\S)|"
AS_BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5)


def pieces(text: str) -> list[str]:
    """A text cut before the last of several blanks in front of a word.

    In pieces the pattern's only look-ahead (`AHEAD`) never matters, so the pattern without it, which is
    matched much faster, tells the same words."""
    doubled = b"  " in text.encode().translate(AS_BLANKS) if text.isascii() else TWO_BLANKS.search(text)
    return LAST_BLANK.split(text) if doubled else [text]


class Encoder:
    """Ids of the byte-level vocabulary as little-endian 16-bit bytes, of whole texts at once."""

    def __init__(self, ranks_path: str | None = None):
        import public_tokenizers
        import tiktoken

        path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        pattern = public_tokenizers.PATTERN.replace(AHEAD, "")
        if "(?" in pattern:
            raise ValueError(f"the vocabulary's pattern has other look-arounds than {AHEAD}")
        self.words = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def plain(self, text: str) -> list[int]:
        found = [self.words(piece) for piece in pieces(text)]
        return found[0] if len(found) == 1 else [x for ids in found for x in ids]

    def segment(self, text: str) -> bytes:
        return array("H", self.plain(text)).tobytes()

    def ids(self, text: str) -> bytes:
        if SPECIAL not in text:
            return self.segment(text)
        return array("H", [SPECIAL_ID]).tobytes().join(map(self.segment, text.split(SPECIAL)))


_encoders: dict[str | None, Encoder] = {}


def encoder(ranks_path: str | None) -> Encoder:
    """One encoder per Python worker, kept between tasks."""
    if ranks_path not in _encoders:
        _encoders[ranks_path] = Encoder(ranks_path)
    return _encoders[ranks_path]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


BLOCKS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def tokenize(df: DataFrame, window: int = WINDOW, ranks_path: str | None = None) -> DataFrame:
    """The documents in whole windows (with their checksum) and one rest each (with its ids)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path).ids
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(np.frombuffer(encode(text.as_py()), "<u2"), np.uint16(END_ID))
                whole = len(ids) // window * window
                rows += [(doc_id, s, window, crc(ids[s:s + window]), len(ids), None) for s in range(0, whole, window)]
                if whole < len(ids):
                    rows.append((doc_id, whole, len(ids) - whole, None, len(ids), ids[whole:].astype("<u2").tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                             names=[x.split()[0] for x in BLOCKS.split(", ")])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, BLOCKS)


def counted(rests: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, number of the rest, frequency there) for all distinct ids of rests in their order, and the rests' sizes."""
    sizes = np.array([len(r) for r in rests], np.int64)
    key = np.repeat(np.arange(len(rests)) << 16, sizes)
    key |= np.concatenate([*rests, np.empty(0, np.uint16)])
    key.sort()
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
    tf = np.diff(np.r_[at, len(key)])
    return key[at] & 0xFFFF, key[at] >> 16, tf, sizes


def frequencies(blocks: DataFrame) -> tuple[int, float, np.ndarray]:
    """(rests, their mean length, document frequency by id) over all rests."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs, size = np.zeros(65_536, np.int64), 0, 0
        for b in batches:
            terms, _, _, sizes = counted(_ids(b.column(0)))
            seen += np.bincount(terms, minlength=65_536)
            docs += b.num_rows
            size += int(sizes.sum())
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1, -2]), pa.array(np.r_[seen[at], docs, size])], names=["id", "n"])

    sums = blocks.where("ids is not null").select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = {r["id"]: r["n"] for r in sums.collect()}
    docs, size = found.pop(-1, 0), found.pop(-2, 0)
    df = np.zeros(65_536, np.int64)
    for k, n in found.items():
        df[k] = n
    return docs, size / max(docs, 1), df


def _ids(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(cell.as_buffer(), "<u2") for cell in column]


def weight(idf: np.ndarray, tf: np.ndarray, size: int | np.ndarray, mean: float) -> np.ndarray:
    """The part of terms in a BM25 score, given their frequencies in a rest of a size."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / max(mean, 1.0)))


class Index:
    """A BM25 inverted index of one shard."""

    def __init__(self, rests: list[np.ndarray], idf: np.ndarray, mean: float):
        term, doc, tf, sizes = counted(rests)
        weights = weight(idf[term], tf, sizes[doc], mean)
        self.terms = np.split(term, np.searchsorted(doc, np.arange(1, len(rests))))
        order = np.argsort(term.astype(np.uint16), kind="stable")
        self.doc, self.weight = doc[order], weights[order]
        self.bounds = np.r_[0, np.bincount(term, minlength=65_536).cumsum()]
        self.size = len(rests)

    def scores(self, k: int) -> np.ndarray:
        t = self.terms[k]
        lo, hi = self.bounds[t], self.bounds[t + 1]
        n = hi - lo
        at = np.arange(n.sum()) + np.repeat(lo - (n.cumsum() - n), n)
        return np.bincount(self.doc[at], self.weight[at], minlength=self.size)


def pack_shard(rests: list[np.ndarray], idf: np.ndarray, mean: float, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start within its rest, length)."""
    index = Index(rests, idf, mean)
    begin = np.zeros(len(rests), np.int64)
    left = np.array([len(r) for r in rests])
    sequences = []
    for seed in np.argsort(-left, kind="stable"):
        while left[seed]:
            take = int(min(left[seed], window))
            pieces, room = [(int(seed), int(begin[seed]), take)], window - take
            begin[seed] += take
            left[seed] -= take
            if room:
                scores = np.where(left > 0, index.scores(seed), -1.0)
                while room and scores[k := int(np.argmax(scores))] >= 0:  # few are needed; of equal ones the first
                    take = int(min(left[k], room))
                    pieces.append((k, int(begin[k]), take))
                    begin[k] += take
                    left[k] -= take
                    room -= take
                    scores[k] = -1.0
            sequences.append(pieces)
    return sequences


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def waiting_times() -> np.ndarray:
    """One exponential waiting time for each draw and term."""
    return np.random.default_rng(42).exponential(size=(DRAWS, 65_536))


def places(rests: list[np.ndarray], idf: np.ndarray, mean: float, times: np.ndarray) -> np.ndarray:
    """The terms that each rest draws, as one number; a term's time is divided by its weight, and the
    shortest wins (of equal ones the first)."""
    terms, owner, tf, sizes = counted(rests)
    weights = np.maximum(weight(idf[terms], tf, sizes[owner], mean), 1e-9)
    starts = np.searchsorted(owner, np.arange(len(rests)))
    out = np.zeros(len(rests), np.uint64)
    for draw in times:
        waits = draw[terms] / weights
        first = np.flatnonzero(waits == np.minimum.reduceat(waits, starts)[owner])
        drawn = terms[first[np.searchsorted(owner[first], np.arange(len(rests)))]]
        out = (out << np.uint64(16)) | drawn.astype(np.uint64)
    return (out ^ np.uint64(1 << 63)).view(np.int64)


def place(ids: np.ndarray, idf: np.ndarray, mean: float, times: np.ndarray) -> int:
    return int(places([ids], idf, mean, times)[0])


def _placed(idf: np.ndarray, mean: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = waiting_times()
        for b in batches:
            keys = places(_ids(b.column(b.num_columns - 1)), idf, mean, times) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *b.columns], names=["place", *b.schema.names])

    return run


def _packer(idf: np.ndarray, mean: float, window: int, shard_docs: int):
    def pack(rest: list[tuple], sequence: int) -> pa.RecordBatch:
        ids = [np.frombuffer(r[4], "<u2") for r in rest]
        out = []
        for at, pieces in enumerate(pack_shard(ids, idf, mean, window)):
            offset = 0
            for k, start, length in pieces:
                doc_id, base, _, tokens, _ = rest[k]
                out.append((doc_id, base + start, length, crc(ids[k][start:start + length]), tokens, sequence + at, offset))
                offset += length
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)],
                                          names=[x.split()[0] for x in PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sequence = [], TaskContext.get().partitionId() << 40
        for b in batches:
            held += zip(*[c.to_pylist() for c in b.columns], strict=True)
            while len(held) > shard_docs + shard_docs // 2:
                made = pack(sorted(held[:shard_docs], key=_order), sequence)
                yield made
                held, sequence = held[shard_docs:], sequence + made.num_rows
        if held:
            yield pack(sorted(held, key=_order), sequence)

    return run


def _order(row: tuple) -> tuple:
    return row[0] is not None, row[0] or 0, row[1], row[4]


def pack(df: DataFrame, window: int = WINDOW, shard_docs: int = SHARD_DOCS, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    blocks = settle(tokenize(df, window, ranks_path))
    docs, mean, df_by_id = frequencies(blocks)
    idf = np.log1p((docs - df_by_id + 0.5) / (df_by_id + 0.5))
    whole = blocks.where("ids is null").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.monotonically_increasing_id() + WHOLE_SEQUENCES).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rests = blocks.where("ids is not null").select(F.monotonically_increasing_id().alias("row"), "doc_id", "start", "length", "doc_tokens", "ids")
    placed = settle(rests.mapInArrow(_placed(idf, mean), "place long, row long, doc_id long, start long, length long, doc_tokens long, ids binary"))
    parts = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, -(-docs // shard_docs)))
    dealt = placed.repartitionByRange(parts, "place", "row").sortWithinPartitions("place", "row")
    packed = dealt.select("doc_id", "start", "length", "doc_tokens", "ids").mapInArrow(_packer(idf, mean, window, shard_docs), PIECES)
    return packed.union(whole)
