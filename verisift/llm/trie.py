"""Trie of conversation prefixes, by splitters and a skeleton.

A conversation is the sequence of its turns' digests; conversations are put in lexicographic
order, equal ones by id.  Splitters, taken from a sample, cut this order into shards.  A node
is a run of the order, so a node that spans a cut is a prefix of the splitter there: the trie
of the splitters' paths, the skeleton, holds every node that any two shards share.  It is small
and goes to all tasks.  Each shard is read once in order, with the open path on a stack; nodes
off the skeleton are finished there.  For skeleton nodes each shard gives one partial aggregate,
and a reduction combines them.

As equal conversations are ordered by id, a group of copies of any size is cut like the rest
and its path becomes part of the skeleton.  Splitter paths are cut off so that all of them take
SKELETON_BYTES at most (any threshold cuts the order, so results don't depend on it).  The
digest of the ids that end in a node is sequential by definition; shards send such ids of
skeleton nodes as joined texts in order, and one task per node runs through them.

Defined results: turns are ordered by number, null first, equal numbers by the digest of role
and text; null role and text are empty; rows without conv_id belong to no conversation; repeated
rows are turns of their own; other columns are ignored; an empty table has no nodes, not even
a root.  A conversation's path (16 bytes and a word count per turn) has to fit a task.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisift.llm.common import settle, words_of

DIGEST = 16
SAMPLED = 20                # conversations sampled per shard
SKELETON_BYTES = 4_000_000  # of all splitters together
FLUSHED = 20_000            # finished nodes that a task holds, about
JOINED = 4_000              # ids joined into one text

NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string")
_PART = NODE + ", skeleton long, parent_skeleton long, words long, shard long, piece long, ids string"
_SCHEMA = pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in (c.split(" ") for c in _PART.split(", "))])
_NONE = hashlib.sha256(b"").hexdigest()

Splitter = tuple[bytes, int]


def turns_of(df: DataFrame) -> DataFrame:
    """conv_id, turn, digest (of role and text) and words of the rows with a conv_id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat_ws("\n", F.char_length(role), role, text), 256), 1, 2 * DIGEST)
    return df.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), digest.alias("digest"),
        F.size(words_of(text)).cast("long").alias("words"))


def paths_of(turns: DataFrame) -> DataFrame:
    """conv_id and its turns, an array of (digest, words) in order."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "digest", "words")))
    return turns.groupBy("conv_id").agg(ordered.alias("t")).select(
        "conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def _skeleton(splitters: list[Splitter]) -> dict[tuple[int, bytes], int]:
    """Nodes of the splitters' trie: (parent, digest) -> node; the root is 0, parents come first."""
    nodes: dict[tuple[int, bytes], int] = {}
    for path, _ in splitters:
        at = 0
        for k in range(0, len(path), DIGEST):
            at = nodes.setdefault((at, path[k:k + DIGEST]), len(nodes) + 1)
    return nodes


class _Open:
    """A node on the open path of a shard."""

    __slots__ = ("children", "count", "ends", "hash", "held", "leaves", "least", "pieces", "row", "saved", "skeleton", "words")

    def __init__(self, skeleton: int | None, row: int, words: int) -> None:
        self.skeleton, self.row, self.words = skeleton, row, words
        self.least: int | None = None
        self.count = self.children = self.leaves = self.saved = self.ends = self.pieces = 0
        self.hash = None if skeleton is not None else hashlib.sha256()
        self.held: list[str] = []


def _shard_nodes(skeleton: dict[tuple[int, bytes], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []   # rows to send
        local: list[dict] = []  # nodes of the open subtree off the skeleton, whose parents are still open
        stack: list[_Open] = []
        digests: list[bytes] = []
        shard = None

        def joined(node: _Open) -> None:
            out.append({"skeleton": node.skeleton, "shard": shard, "piece": node.pieces, "ids": ",".join(node.held)})
            node.pieces, node.held = node.pieces + 1, []

        def close() -> None:
            node, depth = stack.pop(), len(stack)
            above = stack[-1] if stack else None
            if node.skeleton is not None:
                if node.held:
                    joined(node)
                out.append({"skeleton": node.skeleton, "parent_skeleton": above.skeleton if above else None, "conv_id": node.least,
                            "depth": depth, "n_convs": node.count, "n_children": node.children, "n_leaves": node.leaves,
                            "saved_tokens": node.saved, "words": node.words})
            else:
                node.leaves += node.children == 0
                node.saved += (node.count - 1) * node.words
                local[node.row] = {"conv_id": node.least, "depth": depth, "n_convs": node.count, "n_children": node.children,
                                   "n_leaves": node.leaves, "saved_tokens": node.saved, "ends_sha256": node.hash.hexdigest(),
                                   "above": above.row, "parent_skeleton": above.skeleton}
                above.children += 1
                if above.skeleton is not None:  # a subtree is whole: parents are known now
                    for row in local:
                        up = row.pop("above")
                        row["parent_conv_id"] = local[up]["conv_id"] if row["parent_skeleton"] is None else None
                    out.extend(local)
                    local.clear()
            if above is not None:
                above.count += node.count
                above.least = node.least if above.least is None else min(above.least, node.least)
                if node.skeleton is None:  # sums below skeleton nodes are rolled up once all shards are combined
                    above.leaves += node.leaves
                    above.saved += node.saved

        def push(skeleton_node: int | None, words: int) -> None:
            row = -1
            if skeleton_node is None:
                row = len(local)
                local.append({})
            stack.append(_Open(skeleton_node, row, words))

        def sent(last: bool) -> Iterator[pa.RecordBatch]:
            if out and (last or len(out) >= FLUSHED):
                yield pa.RecordBatch.from_pylist(out, _SCHEMA)
                out.clear()

        for batch in batches:
            for now, path, conv, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(),
                                              batch.column(3).to_pylist(), strict=True):
                turns = [path[k:k + DIGEST] for k in range(0, len(path), DIGEST)]
                same = 0
                if now != shard:
                    while stack:
                        close()
                    shard, digests = now, []
                    push(0, 0)
                else:
                    while same < min(len(turns), len(digests)) and turns[same] == digests[same]:
                        same += 1
                    while len(stack) > same + 1:
                        close()
                for digest, n in zip(turns[same:], words[same:], strict=True):
                    above = stack[-1].skeleton
                    push(None if above is None else skeleton.get((above, digest)), n)
                digests, end = turns, stack[-1]
                end.count += 1
                end.least = conv if end.least is None else min(end.least, conv)
                if end.skeleton is None:
                    end.hash.update(f",{conv}".encode() if end.ends else str(conv).encode())
                    end.ends += 1
                else:
                    end.held.append(str(conv))
                    if len(end.held) >= JOINED:
                        joined(end)
                yield from sent(False)
        while stack:
            close()
        yield from sent(True)

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and the digest of its ids, from (skeleton, shard, piece, ids) in order."""
    node, digest = None, None
    for batch in batches:
        for at, ids in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
            if at != node:
                if node is not None:
                    yield pa.RecordBatch.from_pydict({"node": [node], "sha": [digest.hexdigest()]})
                node, digest = at, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.as_py().encode())
    if node is not None:
        yield pa.RecordBatch.from_pydict({"node": [node], "sha": [digest.hexdigest()]})


def _rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Skeleton nodes with the sums of their subtrees; children come after their parents."""
    rows = {row["skeleton"]: row for batch in batches for row in batch.to_pylist()}
    for row in rows.values():
        row["own"] = 0
    for node in sorted(rows, reverse=True):
        row = rows[node]
        row["saved_tokens"] += (row["n_convs"] - 1) * row["words"]
        row["n_children"] += row["own"]
        row["n_leaves"] += row["n_children"] == 0
        if node:
            above = rows[row["parent_skeleton"]]
            row["parent_conv_id"] = above["conv_id"]
            above["own"] += 1
            above["n_leaves"] += row["n_leaves"]
            above["saved_tokens"] += row["saved_tokens"]
        row["ends_sha256"] = row["ends_sha256"] or _NONE
    if rows:
        yield pa.RecordBatch.from_pylist(list(rows.values()), _SCHEMA)


def _splitters(paths: DataFrame, shards: int) -> list[Splitter]:
    """The cuts between shards, from a bounded sample of cut-off paths."""
    longest = max(1, SKELETON_BYTES // (DIGEST * shards)) * DIGEST
    sample = paths.select(F.substring("path", 1, longest).alias("path"), "conv_id")
    rows = sorted((bytes(r[0]), r[1]) for r in sample.orderBy(F.xxhash64("conv_id"), "conv_id").limit(SAMPLED * shards).collect())
    return sorted({rows[k * len(rows) // shards] for k in range(1, shards)}) if rows else []


def nodes_of(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """The nodes of the trie of conversations given as conv_id and turns, an array of (digest, words)."""
    spark = paths.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = F.unhex(F.array_join(F.col("turns.digest"), "")).alias("path")
    stored = settle(paths.select("conv_id", path, F.col("turns.words").alias("words")))
    splitters = _splitters(stored, shards)
    skeleton = _skeleton(splitters)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True)
            shard = pa.array([bisect_right(splitters, key) for key in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([shard, b.column(1), b.column(0), b.column(2)], names=["shard", "path", "conv_id", "words"])

    rows = stored.mapInArrow(dealt, "shard long, path binary, conv_id long, words array<long>")
    ordered = rows.repartition(shards, "shard").sortWithinPartitions("shard", "path", "conv_id")
    parts = settle(ordered.mapInArrow(_shard_nodes(skeleton), _PART))
    ids = parts.where("ids is not null").select("skeleton", "shard", "piece", "ids")
    ends = ids.repartition("skeleton").sortWithinPartitions("skeleton", "shard", "piece").mapInArrow(_hashed, "node long, sha string")
    combined = parts.where("skeleton is not null and ids is null").groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.max("parent_skeleton").alias("parent_skeleton"),
        F.max("words").alias("words"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    full = combined.join(ends, F.col("skeleton") == F.col("node"), "left").withColumn("ends_sha256", F.col("sha"))
    columns = [F.col(c) if c in full.columns else F.lit(None).cast("string" if c == "ids" else "long").alias(c) for c in _SCHEMA.names]
    # the skeleton has at most SKELETON_BYTES / DIGEST nodes, so one task holds it
    shared = settle(full.select(*columns).repartition(1).mapInArrow(_rolled, _PART))
    finished = parts.where("skeleton is null")
    above = shared.select(F.col("skeleton").alias("_s"), F.col("conv_id").alias("_c"))
    below = finished.join(F.broadcast(above), F.col("parent_skeleton") == F.col("_s"), "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "_c"))
    names = [c.split(" ")[0] for c in NODE.split(", ")]
    return below.select(*names).union(shared.select(*names))


def prefix_trie(df: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per distinct prefix of the conversations (conv_id, turn, role, text)."""
    return nodes_of(paths_of(turns_of(df)), shards)


def rebuilt(paths: DataFrame, group: int = 20, most: int = 3) -> DataFrame:
    """Conversations whose first h turns are those of the conversation that opens their group:
    h = crc32(conv_id) % (most + 1); their own turns follow after the first h."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most + 1)).cast("int")
    stored = settle(paths)
    heads = stored.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("_of"), F.slice("turns", 1, most).alias("_head"))
    own = stored.withColumn("_h", h).withColumn("_first", F.col("conv_id") - F.col("conv_id") % group)
    both = own.join(heads, F.col("_first") == F.col("_of"), "left")
    none = F.slice("turns", 1, 0)
    head = F.coalesce(F.slice("_head", F.lit(1), F.col("_h")), none)
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.lit(0), F.size("turns") - F.col("_h")))
    return both.select("conv_id", F.concat(head, rest).alias("turns"))
