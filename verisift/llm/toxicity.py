"""Toxicity by weak supervision.

1. Lexicon mining: words and word stems that mark toxic texts, from labelled training rows.
2. Voting: mined features, fixed lexicons and patterns vote on every document.
3. Label model: a generative two-class model of the votes.  Expectation maximisation over all
   documents estimates each voter's rate in either class, with training labels as one more
   near-perfect witness; the correlations of voters within a class are estimated from the
   same statistics, and a voter that repeats what others say counts for less.
4. Classifier: a logistic regression on the model's posterior labels, over words and stems.

Labels are read only for rows whose crc32(doc_id as text) mod 5 is not 0, and only from the
training side; a score depends on the text alone.  Mining and the classifier are fitted on at
most `labelled` + `unlabelled` documents, taken in hash order; votes and the label model cover
all documents.

Defined results: null and empty texts have no features and get the classifier's base score; a
document with several labels is toxic if any says so; null labels are ignored; without toxic
and clean training labels only the fixed lexicons decide; repeated rows give repeated results;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from verisift.llm.common import settle, text_of, unwrapped, wrapped

LABELLED = 12_000
UNLABELLED = 4_000
MINED = 40
VOCABULARY = 4_000
LEAST_RATIO = 30.0  # far beyond what the best of millions of chance features reaches
LABEL_TRUST = 0.98
CORRELATED = 0.25  # weaker correlations within a class are taken for chance
ROUNDS = 12
FOLDS = 5

# Mild insults by theme
LEXICONS = {
    "folly": "idiot moron stupid dumb fool imbecile dunce brainless".split(),
    "contempt": "loser pathetic worthless useless failure nobody".split(),
    "filth": "scum trash garbage filth disgusting vermin pig".split(),
    "mockery": "clown joke freak weirdo crybaby".split(),
    "hostility": "hate kill die shut hurt destroy".split(),
}
_SCORED = [StructField("held_out", BooleanType()), StructField("score", DoubleType()), StructField("predicted", IntegerType())]
PATTERNS = ("shouting", "exclamation", "masked")

_LETTERS = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"[^\W\d_][*#@$]+[^\W\d_]")
STEMS = (4, 5, 6, 7, 8)


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text, mod 5, is 0 (a null id is read as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def stems_of(word: str) -> list[str]:
    """The word itself, and its beginnings with "+" for more letters."""
    return [word, *(word[:k] + "+" for k in STEMS if len(word) > k)]


def words_in(text: str) -> set[str]:
    return set(_LETTERS.findall(text.lower()))


def features_in(text: str) -> list[str]:
    """The distinct words of a text, their stems, and with one more "+" the stems that two or more
    of its words share."""
    counted = Counter(f for w in words_in(text) for f in stems_of(w))
    return [*counted, *(f + "+" for f, n in counted.items() if n > 1)]


class Features:
    """Indexes of a document's features in a fixed vocabulary, with a bounded cache by word."""

    def __init__(self, vocabulary: Iterable[str]):
        self.index = {f: k for k, f in enumerate(vocabulary)}
        self.wanted = {f for f in self.index} | {f[:-1] for f in self.index if f.endswith("++")}
        self.known: dict[str, tuple[str, ...]] = {}

    def of(self, words: set[str]) -> list[int]:
        known, counted = self.known, {}
        for w in words:
            hit = known.get(w)
            if hit is None:
                if len(known) > 200_000:
                    known.clear()
                hit = known[w] = tuple(f for f in stems_of(w) if f in self.wanted)
            for f in hit:
                counted[f] = counted.get(f, 0) + 1
        found = [self.index[f] for f in counted if f in self.index]
        found += [self.index[f + "+"] for f, n in counted.items() if n > 1 and f + "+" in self.index]
        return sorted(found)


def draw(documents: DataFrame, labels: DataFrame, labelled: int, unlabelled: int) -> DataFrame:
    """Up to so many labelled training documents and unlabelled ones: doc_id, toxic (null if
    unlabelled) and text."""
    ids = documents.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().where(~held_out(F.col("doc_id")))
    marked = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(
        "doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    both = ids.join(marked, "doc_id", "left")
    chosen = both.where("toxic is not null").orderBy(*order).limit(labelled).union(
        both.where("toxic is null").orderBy(*order).limit(unlabelled))
    chosen = F.broadcast(settle(chosen.withColumnRenamed("doc_id", "of")))  # labelled + unlabelled rows at most
    texts = documents.select("doc_id", text_of().alias("text")).join(chosen, F.col("doc_id") == F.col("of"))
    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "text")


def count_features(sample: DataFrame) -> DataFrame:
    """feature, bad (toxic documents that hold it) and n (documents that hold it)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counted), pa.string()), pa.array([c[0] for c in counted.values()], pa.int64()),
                 pa.array([c[1] for c in counted.values()], pa.int64())], names=["feature", "bad", "n"])

        for b in batches:
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for f in features_in(text.as_py()):
                    c = counted.setdefault(f, [0, 0])
                    c[0] += toxic
                    c[1] += 1
                if len(counted) > 500_000:
                    yield out()
                    counted.clear()
        if counted:
            yield out()

    parts = sample.where("toxic is not null").select("toxic", "text").mapInArrow(run, "feature string, bad long, n long")
    return parts.groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))


def mine(sample: DataFrame, mined: int, vocabulary: int) -> tuple[list[str], list[str]]:
    """(voting features, classifier vocabulary) by the likelihood ratio of their toxic
    counts against chance."""
    marked = sample.where("toxic is not null")
    total = marked.agg(F.count("*"), F.sum("toxic")).first()
    if not total[0] or not total[1] or total[1] == total[0]:
        return [], []
    share = total[1] / total[0]
    counted = count_features(sample)
    bad, good, n = F.col("bad"), F.col("n") - F.col("bad"), F.col("n")
    ratio = 2 * (F.when(bad > 0, bad * F.log(bad / (n * share))).otherwise(0.0)
                 + F.when(good > 0, good * F.log(good / (n * (1 - share)))).otherwise(0.0))
    scored = settle(counted.withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO))
    strong = scored.where(F.col("bad") >= 0.6 * F.col("n")).orderBy(F.col("ratio").desc(), "feature").limit(20 * mined).collect()
    voters: list[str] = []
    for row in strong:  # one voter for each stem
        stem = row["feature"].rstrip("+")
        if len(voters) < mined and not any(stem.startswith(v.rstrip("+")) or v.rstrip("+").startswith(stem) for v in voters):
            voters.append(row["feature"])
    listed = scored.orderBy(F.col("ratio").desc(), "feature").limit(vocabulary).collect()
    return voters, sorted({r["feature"] for r in listed} | set(voters))


def votes(documents: DataFrame, voters: list[str]) -> DataFrame:
    """doc_id and a bit for every voter that fires: mined features, lexicons, patterns."""
    lexicons = [frozenset(words) for words in LEXICONS.values()]
    count = len(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mined = Features(voters)
        for b in batches:
            out = []
            for cell in b.column(1):
                text = cell.as_py()
                words = words_in(text)
                fired = sum(1 << k for k in mined.of(words))
                fired |= sum(1 << (count + k) for k, words_of in enumerate(lexicons) if not words.isdisjoint(words_of))
                at = count + len(lexicons)
                fired |= (text.isupper() << at) | (("!!" in text) << (at + 1))
                if any(c in text for c in "*#@$") and _MASKED.search(text):
                    fired |= 1 << (at + 2)
                out.append(fired)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], names=["doc_id", "votes"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
        run, "doc_id long, votes long")


class LabelModel:
    """Two-class model of binary votes.  share: of class 1; fires[y, i]: rate of voter i in class
    y; blocks: voters whose votes are correlated within the classes, with the correlation.

    Within a block the strongest vote counts in full and the others count for what the
    correlation leaves of them.  A voter that doesn't fire abstains; only a document without any
    vote counts as evidence of its own."""

    def __init__(self, share: float, fires: np.ndarray, correlation: np.ndarray | None = None):
        count = fires.shape[1]
        self.share, self.fires = share, fires
        self.correlation = np.eye(count) if correlation is None else correlation
        self.blocks = _blocks(self.correlation)
        strongest = np.array([[self.fires[y, b].max() for b, _ in self.blocks] for y in (0, 1)])
        self.silent = float(np.log1p(-strongest[1]).sum() - np.log1p(-strongest[0]).sum())

    def posterior(self, bits: np.ndarray, given: np.ndarray) -> np.ndarray:
        """bits: rows by voters of 0 / 1; given: label 0 / 1, or -1 where unknown."""
        evidence = bits * np.log(self.fires[1] / self.fires[0])
        logit = np.full(len(bits), math.log(self.share / (1 - self.share)))
        for block, rho in self.blocks:
            part = np.where(bits[:, block] > 0, evidence[:, block], -np.inf)
            best = np.where(np.isinf(top := part.max(1)), 0.0, top)
            logit += best + (1 - rho) * (evidence[:, block].sum(1) - best)
        logit += np.where(bits.any(1), 0.0, self.silent)
        trust = 2 * math.log(LABEL_TRUST / (1 - LABEL_TRUST))
        logit += np.where(given == 1, trust, np.where(given == 0, -trust, 0.0))
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def _blocks(correlation: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """Voters linked by clear correlations, with the mean correlation in each block."""
    label = np.arange(len(correlation))
    while True:
        low = np.where(correlation > CORRELATED, label[None, :], len(label)).min(1)
        if np.array_equal(low := np.minimum(low, label), label):
            break
        label = low
    found = []
    for k in np.unique(label):
        block = np.flatnonzero(label == k)
        inner = correlation[np.ix_(block, block)][np.triu_indices(len(block), 1)]
        found.append((block, float(np.clip(inner.mean(), 0, 1)) if len(inner) else 0.0))
    return found


def unpacked(packed: np.ndarray, count: int) -> np.ndarray:
    return ((packed[:, None] >> np.arange(count)[None, :]) & 1).astype(float)


def _statistics(patterns: DataFrame, model: LabelModel, count: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(documents, per class: weight, sums and products of votes), summed over all patterns.
    A task returns two small matrices; there are at most 32 tasks."""
    size = count + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size, size))
        for b in batches:
            for k in range(0, b.num_rows, 50_000):
                part = b.slice(k, 50_000)
                bits = unpacked(part.column(0).to_numpy(), count)
                p = model.posterior(bits, part.column(1).to_numpy())
                n = part.column(2).to_numpy().astype(float)
                full = np.hstack([np.ones((len(bits), 1)), bits])
                for y, w in ((0, n * (1 - p)), (1, n * p)):
                    total[y] += (full * w[:, None]).T @ full
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["sums"])

    rows = patterns.coalesce(32).mapInArrow(run, "sums array<double>").collect()
    total = sum((np.array(r["sums"]) for r in rows), np.zeros(2 * size * size)).reshape(2, size, size)
    return total[:, 0, 0].sum(), total, total[:, 0, 1:]


def fit_label_model(voted: DataFrame, labels: DataFrame, count: int, rounds: int = ROUNDS) -> LabelModel:
    """Fits the model on the votes of all documents; labels of training rows act as a witness."""
    marked = labels.select(F.col("doc_id").cast("long").alias("of"), "toxic").where(
        F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("of").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    given = voted.join(marked, F.col("doc_id") == F.col("of"), "left")
    patterns = settle(given.groupBy("votes", F.coalesce("toxic", F.lit(-1)).cast("int").alias("given")).agg(F.count("*").alias("n")))
    # start: what the labels say, smoothed; voters without labels fire ten times as often on toxic texts
    known = patterns.where("given >= 0")
    flat = LabelModel(0.1, np.vstack([np.full(count, 0.01), np.full(count, 0.1)]))
    n, total, fired = _statistics(known, flat, count)
    model = flat
    # the share of toxic documents is what the labels say; left free it drifts to what patterns single out
    share = float(np.clip(total[1, 0, 0] / n, 1e-4, 0.9)) if n else flat.share
    for k in range(rounds + 1):
        if n:
            weight = total[:, 0, 0][:, None]
            fires = (fired + np.array([[0.1], [1.0]])) / (weight + np.array([[10.0], [10.0]]))
            nxt = LabelModel(share, np.clip(fires, 1e-5, 1 - 1e-3),
                             _correlations(total, count))
            moved = np.abs(nxt.fires - model.fires).max()
            model = nxt
            if k > 1 and moved < 1e-4:
                break
        n, total, fired = _statistics(patterns, model, count)
    return model


def _correlations(total: np.ndarray, count: int) -> np.ndarray:
    """Correlations of votes within the classes (pooled)."""
    pooled = np.zeros((count, count))
    for y in (0, 1):
        w = total[y, 0, 0]
        if w > 1:
            mean = total[y, 0, 1:] / w
            pooled += total[y, 1:, 1:] - w * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    correlation = np.clip(pooled / np.outer(scale, scale), -1, 1)
    np.fill_diagonal(correlation, 1.0)
    return correlation


def fit_classifier(sample: DataFrame, voted: DataFrame, model: LabelModel, vocabulary: list[str], count: int) -> tuple[float, dict[str, float]]:
    """(intercept, weights by feature) of a logistic regression on posterior labels."""
    @F.pandas_udf("double")
    def posterior(packed: pd.Series, given: pd.Series) -> pd.Series:
        return pd.Series(model.posterior(unpacked(packed.to_numpy(), count), given.to_numpy()))

    drawn = F.broadcast(sample.select(F.col("doc_id").alias("of")).distinct())
    known = voted.join(drawn, F.col("doc_id") == F.col("of")).groupBy("of").agg(F.max("votes").alias("votes"))
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Features(vocabulary)
        for b in batches:
            found = [[vocabulary[k] for k in wanted.of(words_in(t.as_py()))] for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.string()))],
                                             names=["doc_id", "toxic", "features"])

    featured = sample.mapInArrow(named, "doc_id long, toxic int, features array<string>")
    rows = featured.join(known, F.col("doc_id") == F.col("of")).withColumn(
        "p", posterior("votes", F.coalesce("toxic", F.lit(-1))))
    counted = CountVectorizerModel.from_vocabulary(vocabulary, "features", "x")
    counted.setBinary(True)
    soft = settle(rows.select("features", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight")))).alias("y")).select("features", "y.*").where("weight > 1e-4"))
    fitted = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", regParam=1e-5, maxIter=100,
                                standardization=False).fit(counted.transform(soft))
    weights = fitted.coefficients.toArray()
    return float(fitted.intercept), {f: float(w) for f, w in zip(vocabulary, weights, strict=True) if w}


def score(documents: DataFrame, intercept: float, weights: dict[str, float]) -> DataFrame:
    """The documents with their columns, and held_out, score and predicted from the text alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sorted(weights)
        linear, values = Features(names), [weights[n] for n in names]
        for b in batches:
            scores = [1 / (1 + math.exp(-max(-500.0, min(500.0, intercept + math.fsum(values[k] for k in linear.of(words_in(t.as_py())))))))
                      for t in b.column(2)]
            held = [zlib.crc32(("" if (v := i.as_py()) is None else str(v)).encode()) % FOLDS == 0 for i in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(held, pa.bool_()), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                names=["row", "held_out", "score", "predicted"])

    rows = wrapped(documents, _id=F.col("doc_id").cast("string"), _text=text_of())
    schema = StructType([rows.schema["row"], *_SCORED])
    return rows.mapInArrow(run, schema).select(*unwrapped(documents.columns, **{f.name: F.col(f.name) for f in _SCORED}))


def fixed_weights() -> tuple[float, dict[str, float]]:
    """Weights of the fixed lexicons alone, for data without usable labels."""
    return -2.0, {w: 4.0 for words in LEXICONS.values() for w in words}


def classify(documents: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED,
             mined: int = MINED, vocabulary: int = VOCABULARY) -> DataFrame:
    """The documents with their columns, and held_out, score (0 to 1) and predicted (score of at least 0.5).

    More labelled documents, features (`vocabulary`) and mined voters fit finer models and cost the
    driver memory in proportion; votes are bits of one long, so 50 voters can be mined at most."""
    if mined > 50:
        raise ValueError("at most 50 voters can be mined")
    sample = settle(draw(documents, labels, labelled, unlabelled))
    voters, listed = mine(sample, mined, vocabulary)
    if not listed:
        return score(documents, *fixed_weights())
    count = len(voters) + len(LEXICONS) + len(PATTERNS)
    voted = settle(votes(documents, voters))
    model = fit_label_model(voted, labels, count)
    return score(documents, *fit_classifier(sample, voted, model, listed, count))
