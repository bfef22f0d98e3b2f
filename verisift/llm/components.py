"""Connected components of a graph given as a table of edges.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014) as DataFrame joins and aggregates.  Each round stores its edges,
so a lost executor repeats one round at most.  Before the first round every task replaces its
edges by a spanning forest, which leaves the components as they are and takes away most edges
of dense groups.  What is left goes through rounds, unless it is so little (FEW_EDGES) that one
more forest finishes it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisift.llm.common import broadcast_if_small, join_hot, settle
from verisift.session import release


FEW_EDGES = 200_000  # edges (16 bytes each) that are finished at once, fewer than a task's forest may hold


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for all nodes of the edges a-b that aren't smallest."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, (x, y) = np.arange(len(nodes)), (ends[:len(a)], ends[len(a):])
    while len(x):
        p, q = label[x], label[y]
        open_ = p != q
        x, y, p, q = x[open_], y[open_], p[open_], q[open_]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(up := label[label], label):
            label = up
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of a task's edges, a bounded number of edges at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size > 500_000:
            held = [forest(*map(np.concatenate, zip(*held, strict=True)))]
            size = len(held[0][0])
            if size > 250_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names=["u", "v"])
                held, size = [], 0
    if held:
        u, v = forest(*map(np.concatenate, zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node points to the smallest of the node's neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = settle(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("size")))
    moved = join_hot(both.where("v > u"), ["u"], least, ["v"])
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, point to the smallest of them; edges have u > v."""
    least = settle(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size")))
    moved = join_hot(edges, ["u"], least, ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.union(own).where("u <> v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge at most, to a node without edges to smaller ones.

    Edges have u > v and are distinct.  Two edges of a node or a chain of them give a node that counts twice."""
    ends = edges.groupBy("u").agg(F.count("*").alias("n")).union(
        edges.select("v").distinct().select("v", F.lit(1).cast("long")))
    return ends.groupBy("u").agg(F.sum("n").alias("n")).where("n > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (two long columns) that isn't its component's
    smallest node.  Self-loops and repeated edges are allowed; no edges give no rows.

    Few edges are finished without a shuffle, and few nodes are marked for broadcast: each shuffle costs
    the driver as many tasks as it has partitions, however little there is to deal out."""
    release(edges.sparkSession)
    pairs = edges.toDF("u", "v").where("u <> v")
    current = settle(pairs.mapInArrow(_shrink, "u long, v long"))
    if current.limit(FEW_EDGES + 1).count() <= FEW_EDGES:
        return broadcast_if_small(settle(current.coalesce(1).mapInArrow(_shrink, "u long, v long")).toDF("node", "root"))
    current = settle(current.distinct())
    while not _stars(current):
        current = settle(_small_star(_large_star(current)))
    return current.toDF("node", "root")
