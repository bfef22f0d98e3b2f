"""Language identification by Bayesian evidence fusion.

The posterior of a record's language combines
- text: a naive Bayes model of hashed character trigrams, counted over all labelled documents,
- the declared language (markup attribute or column),
- the address suffix,
- the host: priors smoothed host -> domain -> suffix -> everything.
Reliabilities of declarations and suffixes, and the host priors, are grouped aggregates over
all records of the posterior that the text alone gives; a record is left out of its own host's
counts.

Defined results: null and empty texts have no text evidence; a missing declaration, suffix or
host adds nothing; without labelled documents there are no languages and lang is null; ties go
to the alphabetically first language; repeated rows give equal results; other columns are
ignored.  A language is known if its documents hold LEAST_TRIGRAMS trigrams, whatever the size
of the table; the documents of all other labels train one class, `unknown`, which exists only
beside known languages and if there are such labels (without known languages, all labels are
known).  The model takes 256 KB a language on the driver and half of that in each Python worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.llm.common import broadcast_if_small, settle, text_of

BUCKETS = 1 << 15
TEMPER = 60.0  # trigrams of a text beyond this many add nothing but weight to their mean
PRIOR_STRENGTH = 5.0  # records that a wider level counts for at the next narrower one
LEAST_TRIGRAMS = 1000  # of a language's documents, for it to be known
UNKNOWN = "unknown"  # the class of all other labels

_MARKUP = re.compile(r"<(script|style)\b|<!--|<|&#?\w+;", re.IGNORECASE)
_END = {kind: re.compile(end, re.IGNORECASE) for kind, end in (
    ("script", r"</script\s*>"), ("style", r"</style\s*>"), ("<!--", "-->"), ("<", ">"))}
_M = np.uint64(0x9E3779B97F4A7C15)


def visible(html: str) -> str:
    """A page with a blank for every script, style sheet, comment, tag and entity.

    What isn't closed is sought once: no later end can be found either, so the time is linear."""
    out, at, look, unclosed = [], 0, 0, set()
    while found := _MARKUP.search(html, look):
        end = found.end() if found[0][0] == "&" else None
        if end is None:
            kind = (found[1] or found[0]).lower()
            for form, start in ((kind, found.end()), ("<", found.start() + 1)):
                if form not in unclosed:
                    if close := _END[form].search(html, start):
                        end = close.end()
                        break
                    unclosed.add(form)
        if end is None:
            look = found.start() + 1
            continue
        out += [html[at:found.start()], " "]
        at = look = end
    return "".join([*out, html[at:]])


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of every character trigram of the lower-cased texts, set off by blanks."""
    padded = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in padded])
    owner = np.repeat(np.arange(len(padded)), sizes)
    if len(points) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = (points[:-2] << np.uint64(42)) ^ (points[1:-1] << np.uint64(21)) ^ points[2:]
    bucket = ((code * _M) >> np.uint64(49)).astype(np.int64)
    inside = owner[:-2] == owner[2:]
    return bucket[inside], owner[:-2][inside]


def _parts(texts: list[str], most: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of a bounded number of characters, with their first index."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) < most):
            size += len(texts[stop])
            stop += 1
        yield at, texts[at:stop]
        at = stop


def _counted(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    """The counts of some languages that aren't zero, by slot."""
    filled = [(k * BUCKETS + (at := np.flatnonzero(n)), n[at]) for k, n in held.items()]
    columns = [np.concatenate([f[c] for f in filled] or [np.empty(0, np.int64)]).astype(np.int64) for c in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["slot", "n"])


def train(documents: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log probability of each bucket by language) from all labelled documents."""
    labelled = documents.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), text_of().alias("text"))
    evidence = settle(labelled.groupBy("lang").agg(F.sum(F.char_length("text")).alias("n")))  # a trigram per character
    known = [r["lang"] for r in evidence.where(F.col("n") >= LEAST_TRIGRAMS).select("lang").collect()]
    if known and not evidence.where(F.col("n") < LEAST_TRIGRAMS).isEmpty():
        known.append(UNKNOWN)
    langs = sorted(set(known or (r["lang"] for r in evidence.select("lang").collect())))
    place = {lang: k for k, lang in enumerate(langs)}
    other = place.get(UNKNOWN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            rows: dict[int, list[str]] = {}
            for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows.setdefault(place.get(x, other), []).append(t)
            for k, own in rows.items():
                for _, texts in _parts(own):
                    held[k] = held.get(k, 0) + np.bincount(trigrams(texts)[0], minlength=BUCKETS)
                if len(held) > 64:
                    yield _counted(held)
                    held = {}
        yield _counted(held)

    if not langs:
        return [], np.zeros((0, BUCKETS))
    summed = labelled.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    counts = np.full(len(langs) * BUCKETS, 0.5)
    for r in summed.toLocalIterator():  # a row per language and bucket at most
        counts[r["slot"]] += r["n"]
    counts = counts.reshape(len(langs), BUCKETS)
    return langs, np.log(counts / counts.sum(1, keepdims=True))


def text_evidence(records: DataFrame, model: np.ndarray) -> DataFrame:
    """The records without their text, with loglik: the tempered log likelihood by language."""
    table = model.T.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [visible(t) if markup else t for t, markup in zip(b.column("text").to_pylist(), b.column("markup").to_pylist(), strict=True)]
            sums, counts = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts))
            for at, part in _parts(texts, 500_000):
                bucket, owner = trigrams(part)
                n = np.bincount(owner, minlength=len(part))
                counts[at:at + len(part)] = n
                for k in range(table.shape[1]):
                    sums[at:at + len(part), k] = np.bincount(owner, table[bucket, k], minlength=len(part))
            counts[[not t.strip() for t in texts]] = 0
            mean = sums / np.maximum(counts, 1)[:, None]
            loglik = np.where(counts[:, None] > 0, mean * np.minimum(counts, TEMPER)[:, None], 0.0)
            keep = [k for k, name in enumerate(b.schema.names) if name not in ("text", "markup")]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keep] + [pa.array(loglik.tolist(), pa.list_(pa.float64()))],
                                             names=[b.schema.names[k] for k in keep] + ["loglik"])

    schema = "doc_id long, page_id long, declared string, host string, domain string, suffix string, loglik array<double>"
    return records.mapInArrow(run, schema)


def records_of(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents (host: their source) and pages as one table of evidence."""
    one = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.col("lang").cast("string").alias("declared"),
        F.col("source").cast("string").alias("host"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("suffix"),
        F.lit(False).alias("markup"), text_of().alias("text"))
    host = F.nullif(F.lower(F.regexp_extract("url", r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    tag = F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1)
    two = pages.select(
        F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), F.nullif(F.lower(tag), F.lit("")).alias("declared"),
        host.alias("host"), F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")).alias("domain"),
        F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit("")).alias("suffix"), F.lit(True).alias("markup"), text_of("html").alias("text"))
    return one.union(two)


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    shifted = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def _sums(df: DataFrame, keys: list[str], width: int, name: str) -> DataFrame:
    """Sums of the posterior arrays (column p) by keys."""
    return df.groupBy(*keys).agg(F.array(*[F.sum(F.get("p", F.lit(k))) for k in range(width)]).alias(name))


def _smooth(counts: Column, wider: Column, strength: float) -> Column:
    """Shares of counts drawn towards the shares of the wider level."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, wider, lambda n, q: (n + strength * q) / (total + strength))


def identify(documents: DataFrame, pages: DataFrame, strength: float = PRIOR_STRENGTH) -> DataFrame:
    """One row per document (page_id null) and page (doc_id null): lang, its posterior
    probability, and the language by text alone (null without text)."""
    langs, model = train(documents)
    if not langs:
        return records_of(documents, pages).select("doc_id", "page_id", *[F.lit(None).cast(t).alias(n) for n, t in (
            ("lang", "string"), ("probability", "double"), ("text_lang", "string"))])
    width = len(langs)
    seen = settle(text_evidence(records_of(documents, pages), model)).withColumn("p", _softmax(F.col("loglik")))
    flat = F.array(*[F.lit(1.0 / width)] * width)
    # levels of the host prior; a level is a row per key
    overall = [x or 0.0 for x in seen.agg(*[F.sum(F.get("p", F.lit(k))) for k in range(width)]).first()]
    everything = F.array(*[F.lit((x + strength / width) / (sum(overall) + strength)) for x in overall])
    hosts = settle(_sums(seen.where("host is not null"), ["host", "domain", "suffix"], width, "host_n"))
    by_suffix = _sums(hosts.where("suffix is not null").withColumnRenamed("host_n", "p"), ["suffix"], width, "suffix_n")
    by_domain = _sums(hosts.where("domain is not null").withColumnRenamed("host_n", "p"), ["domain", "suffix"], width, "domain_n")
    suffixes = broadcast_if_small(settle(by_suffix.select("suffix", "suffix_n", _smooth(F.col("suffix_n"), everything, strength).alias("suffix_prior"))))
    domains = settle(by_domain.join(suffixes, "suffix", "left").select(
        "domain", _smooth(F.col("domain_n"), F.coalesce("suffix_prior", everything), strength).alias("domain_prior")))
    priors = hosts.join(broadcast_if_small(domains), "domain", "left").select(
        F.col("host").alias("of"), "host_n", F.coalesce("domain_prior", everything).alias("wider"))
    priors = broadcast_if_small(settle(priors))
    # how languages declare themselves, and which suffixes they use
    declared = broadcast_if_small(settle(_sums(seen.where("declared is not null"), ["declared"], width, "declared_n")))
    joined = seen.join(priors, seen["host"] == priors["of"], "left").join(declared, "declared", "left").join(
        suffixes.select("suffix", "suffix_n"), "suffix", "left")
    others = F.zip_with("host_n", "p", lambda n, p: F.greatest(n - p, F.lit(0.0)))
    prior = F.coalesce(_smooth(others, F.col("wider"), strength), everything)

    def likelihood(counts: Column) -> Column:
        """log P(value | language), up to a constant, from the posterior mass of the value."""
        share = _smooth(counts, everything, strength)
        return F.coalesce(F.zip_with(share, everything, lambda a, b: F.log(a / b)), F.transform(flat, lambda x: x * 0))

    parts = [F.transform(prior, lambda x: F.log(x)), likelihood(F.col("declared_n")), likelihood(F.col("suffix_n"))]
    logs = F.col("loglik")
    for part in parts:
        logs = F.zip_with(logs, part, lambda a, b: a + b)
    names = F.array(*map(F.lit, langs))
    fused = joined.withColumn("q", _softmax(logs))
    best = F.array_position("q", F.array_max("q")).cast("int") - 1
    spoken = F.array_position("p", F.array_max("p")).cast("int") - 1
    return fused.select("doc_id", "page_id", F.get(names, best).alias("lang"), F.array_max("q").alias("probability"),
                        F.when(F.exists("loglik", lambda x: x != 0), F.get(names, spoken)).alias("text_lang"))
