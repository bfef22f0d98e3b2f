"""Exact rest of a similarity join whose first round compared representatives only.

The first round leaves pairs that were compared and the links that held.  Texts that compared
pairs join, but links don't, form open blocks.  Within each open block

- the text whose shingles are the most common there (the base of edited copies) is compared
  with every text it isn't linked to yet;
- every pair that is still not linked is found by an exact prefix filter: sets of n shingles of
  a Jaccard similarity of at least t share one of the n - ceil(t n) + 1 rarest shingles of each,
  rare ones by their count in the block.

Texts that are linked already aren't compared with each other, so a large group of copies costs
a row per shingle and not its square.  A shingle of many texts is dealt to salted blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verisift.llm.common import settle
from verisift.llm.components import components

SALTED = 1024  # texts of a shingle that one salt holds, about

Verify = Callable[[DataFrame, DataFrame], DataFrame]


def _digested(digests: Callable[[str], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [digests(t.as_py()) for t in b.column(3)]
            sizes = np.array([len(h) for h in sets])
            if len(sizes):
                columns = [np.repeat(x, sizes) for x in (*(b.column(k).to_numpy() for k in range(3)), sizes)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (*columns, np.concatenate(sets))], names=["block", "label", "node", "n", "h"])

    return run


def _labelled(df: DataFrame, column: str, roots: DataFrame, name: str) -> DataFrame:
    """The rows with the root of a node column's component."""
    named = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    joined = df.join(named, F.col(column) == F.col("_node"), "left")
    return joined.select(*df.columns, F.coalesce("_root", column).alias(name))


def _members(tried: DataFrame, linked: DataFrame) -> DataFrame | None:
    """node, label (root among the links) and block of all texts in open blocks."""
    roots = components(linked)
    both = _labelled(_labelled(tried.select("a", "b"), "a", roots, "la"), "b", roots, "lb")
    failed = settle(both.where("la <> lb").select("la", "lb").distinct())
    if failed.isEmpty():
        return None
    labels = _labelled(failed.select(F.col("la").alias("of")).union(failed.select("lb")).distinct(), "of", components(failed), "block")
    nodes = tried.select(F.col("a").alias("node")).union(tried.select("b")).distinct()
    return _labelled(nodes, "node", roots, "label").join(labels, F.col("label") == F.col("of")).select("node", "label", "block")


def _prefixes(members: DataFrame, texts: DataFrame, digests: Callable[[str], np.ndarray], similarity: float) -> DataFrame:
    """The rarest shingles h of each text, with n, the size of its set, and weight, the mean count
    of all its shingles in the block."""
    worded = members.join(texts, members["node"] == texts["h"]).select("block", "label", "node", "text")
    every = settle(worded.mapInArrow(_digested(digests), "block long, label long, node long, n long, h long"))
    counts = every.groupBy(F.col("block").alias("_block"), F.col("h").alias("_h")).agg(F.count("*").alias("met"))
    met = every.join(counts, (F.col("block") == F.col("_block")) & (F.col("h") == F.col("_h")))
    own = Window.partitionBy("node", "block")
    placed = met.withColumn("place", F.row_number().over(own.orderBy("met", "h"))).withColumn("weight", F.avg("met").over(own))
    needed = F.ceil(similarity * F.col("n") - 1e-9)
    return placed.where(F.col("place") <= F.col("n") - needed + 1).select("block", "label", "node", "n", "h", "weight")


def _unlinked(prefixes: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of texts that share a prefix shingle, fit in size and aren't linked yet."""
    now = settle(_labelled(prefixes.drop("label", "weight"), "node", roots, "label"))
    sizes = now.groupBy("block", "h", "label").agg(F.count("*").alias("met"))
    shared = sizes.groupBy(F.col("block").alias("_block"), F.col("h").alias("_h")).agg(
        F.max(F.struct("met", "label")).alias("top"), F.count("*").alias("labels"), F.sum("met").alias("met")).where("labels > 1")
    rows = now.join(shared, (F.col("block") == F.col("_block")) & (F.col("h") == F.col("_h"))).select(
        "block", "h", "node", "n", "label", (F.col("label") == F.col("top.label")).alias("most"),
        F.floor(1 + F.col("met") / SALTED).alias("salts"))
    # of two texts with different labels one has another label than most texts of the shingle
    left = rows.where("not most").select(
        "block", "h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"),
        F.col("node").alias("x"), F.col("n").alias("nx"), F.col("label").alias("lx"))
    right = rows.select("block", "h", F.pmod(F.xxhash64("node"), F.col("salts")).alias("salt"),
                        F.col("node").alias("y"), F.col("n").alias("ny"), F.col("label").alias("ly"), "most")
    fits = F.least("nx", "ny") >= similarity * F.greatest("nx", "ny") - 1e-9
    both = left.join(right, ["block", "h", "salt"]).where((F.col("lx") != F.col("ly")) & (F.col("most") | (F.col("x") < F.col("y"))) & fits)
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def finished(tried: DataFrame, linked: DataFrame, texts: DataFrame, digests: Callable[[str], np.ndarray],
             similarity: float, verify: Verify) -> DataFrame:
    """Links that give the components of all similar pairs within the open blocks of `tried`.

    tried: pairs (a, b) compared so far; linked: those (and others) that held, stored; texts: h
    and text, a row per text; digests: the distinct shingle hashes of a text; verify: the links
    among pairs (a, b), given such texts."""
    members = _members(tried, linked)
    if members is None:
        return linked
    members = settle(members)
    opened = settle(texts.join(members.select("node").distinct(), F.col("h") == F.col("node"), "left_semi"))
    prefixes = settle(_prefixes(members, opened, digests, similarity))
    central = prefixes.groupBy(F.col("block").alias("of")).agg(F.max(F.struct("weight", "node", "label")).alias("top"))
    pivoted = members.join(central, (F.col("block") == F.col("of")) & (F.col("label") != F.col("top.label")))
    pairs = pivoted.select(F.least("node", "top.node").alias("a"), F.greatest("node", "top.node").alias("b"))
    linked = linked.union(settle(verify(settle(pairs), opened)))
    pairs = settle(_unlinked(prefixes, components(linked), similarity))
    return linked if pairs.isEmpty() else linked.union(settle(verify(pairs, opened)))
