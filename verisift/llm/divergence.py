"""Quality rules by distribution divergence (native: DataFrame functions only).

Each document's character-class and common-word histograms are compared with the reference of
its language by the Jensen-Shannon distance.  References are the mean histograms of all
documents of a language that pass the base rules, so copies and long texts weigh like any other
document.

Character classes have a fixed limit.  The distance of the common words depends on the share that
they have in a language and on the length of the text (few words, much chance), so its limit comes
from the sound documents of the same language and length class (words, doubling): the median and
`SPREADS` times the step from the lowest tenth to the median.  These are taken from counts of
distances in thousandths, which are small, exact at every size and, unlike a mean and
deviation, aren't widened by the junk that they are to find.

Defined results: a null or empty text has no words and fails the base rules; documents shorter
than `min_words` are not judged by divergence; a language with fewer than `min_documents`
judged documents, or no list of common words, is not judged by the missing histogram; a length
class with fewer takes the limit of the longest one below it that has enough (none: not judged); a
null language is a language of its own; repeated rows give repeated results; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verisift.llm.common import NOT_WHITE, WHITE, broadcast_if_small, settle, text_of, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MIN_DOCUMENTS = 20
MAX_CLASS_DISTANCE = 0.3
SPREADS = 4
LEAST_STEP = 5  # thousandths: texts that hardly differ have no narrower spread than this

# Frequent function words by language
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to in a is that for it as was with be by on not he i this".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au".split(),
}

CLASSES = ("lower", "upper", "digit", "punct", "symbol", "space", "other")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _without(text: Column, pattern: str) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words, the words inside windows that occur twice or more.

    Window hashes show which texts repeat anything at all; only these compare the windows
    themselves, sorted, so that the count is exact."""
    def window(i: Column) -> Column:
        return F.xxhash64(*[F.col("_words")[i + k] for k in range(WINDOW)])

    n = F.size("_words")
    df = df.withColumn("_hashes", F.when(n > WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)))
    df = df.withColumn("_again", F.size(F.array_distinct("_hashes")) < F.size("_hashes"))
    spots = F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.struct(F.array_join(F.slice("_words", i + 1, WINDOW), " ").alias("w"), i.alias("at")))
    df = df.withColumn("_spots", F.when(F.col("_again"), F.sort_array(spots)))

    def met(x: Column, i: Column) -> Column:
        around = F.get("_spots", i - 1)["w"] == x["w"], F.get("_spots", i + 1)["w"] == x["w"]
        return F.coalesce(around[0], F.lit(False)) | F.coalesce(around[1], F.lit(False))

    df = df.withColumn("_at", F.sort_array(F.transform(F.filter("_spots", met), lambda x: x["at"])))
    covered = F.aggregate(
        F.transform("_at", lambda x, i: F.coalesce(F.least(F.get("_at", i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0).cast("long"), lambda total, x: total + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))


def features(df: DataFrame) -> DataFrame:
    """One row per document with the base counts, character-class counts and counts of the
    common words of its language."""
    out = df.select("doc_id", F.col("lang").cast("string").alias("lang"), text_of().alias("_text"))
    out = out.withColumn("_words", words_of(F.col("_text")))
    vocabulary = F.lit(None).cast("array<string>")
    for lang, listed in COMMON_WORDS.items():
        vocabulary = F.when(F.col("lang") == lang, F.array(*map(F.lit, listed))).otherwise(vocabulary)
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(NOT_WHITE))
    out = _repeat_words(out.withColumn("_lines", lines).withColumn("_vocabulary", vocabulary))
    text, size = F.col("_text"), F.char_length("_text")
    word_chars = F.char_length(F.translate(text, WHITE, ""))
    symbols = size - F.char_length(F.translate(text, SYMBOLS, ""))
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": word_chars.cast("long"),
        "n_symbols": symbols.cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_size": size,
        "_lower": _without(text, r"\p{Ll}+"),
        "_upper": _without(text, r"\p{Lu}+"),
        "_digit": _without(text, r"\p{Nd}+"),
        "_punct": _without(text, r"[.,;:!?'\"()-]+"),
        "_hits": F.filter("_words", lambda w: F.array_contains("_vocabulary", w)),
    })
    space = F.col("_size") - F.col("word_chars")
    seen = F.col("_lower") + F.col("_upper") + F.col("_digit") + F.col("_punct") + F.col("n_symbols") + space
    classes = [F.col("_lower"), F.col("_upper"), F.col("_digit"), F.col("_punct"), F.col("n_symbols"), space,
               F.greatest(F.col("_size") - seen, F.lit(0))]
    counts = F.transform("_vocabulary", lambda v: F.size("_hits") - F.size(F.array_remove("_hits", v)))
    return out.select(
        "doc_id", "lang", *BASE,
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        F.array(*[c.cast("long") for c in classes]).alias("classes"),
        F.concat(counts.cast("array<long>"), F.array(F.col("n_words") - F.size("_hits"))).alias("commons"))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(counts, lambda x: x / total)


def references(measured: DataFrame, min_words: int = MIN_WORDS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """One row per language with its mean histograms."""
    sound = measured.where(~F.col("base_failed") & (F.col("n_words") >= min_words)).select(
        "lang", _shares(F.col("classes")).alias("classes"), _shares(F.col("commons")).alias("commons"))
    width = max(map(len, COMMON_WORDS.values())) + 1
    means = sound.groupBy("lang").agg(
        F.count("*").alias("documents"),
        F.array(*[F.avg(F.get("classes", F.lit(i))) for i in range(len(CLASSES))]).alias("class_reference"),
        F.array(*[F.avg(F.get("commons", F.lit(i))) for i in range(width)]).alias("word_reference"))
    return means.where(F.col("documents") >= min_documents).select(
        F.col("lang").alias("of"), "class_reference",
        F.expr("filter(word_reference, x -> x is not null)").alias("word_reference"))


def distance(left: Column, right: Column) -> Column:
    """Jensen-Shannon distance (root of the divergence in bits) of two histograms of shares."""
    def half(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))

    parts = F.zip_with(left, right, lambda p, q: half(p, q) + half(q, p))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def limits(judged: DataFrame, min_documents: int = MIN_DOCUMENTS, spreads: int = SPREADS) -> DataFrame:
    """One row per language with the limits of its length classes, in thousandths."""
    counted = judged.where(~F.col("base_failed") & F.col("word_distance").isNotNull()).groupBy(
        "lang", "length_class", F.floor(1000 * F.col("word_distance")).alias("bin")).agg(F.count("*").alias("n"))
    of = Window.partitionBy("lang", "length_class")
    ranked = counted.withColumns({"upto": F.sum("n").over(of.orderBy("bin")), "total": F.sum("n").over(of)})
    middle = F.min(F.when(2 * F.col("upto") >= F.col("total"), F.col("bin")))
    low = F.min(F.when(10 * F.col("upto") >= F.col("total"), F.col("bin")))
    by_length = ranked.groupBy("lang", "length_class").agg(
        F.max("total").alias("total"), (middle + spreads * F.greatest(middle - low, F.lit(LEAST_STEP)) + 1).alias("limit"))
    return by_length.where(F.col("total") >= min_documents).groupBy(F.col("lang").alias("of")).agg(
        F.collect_list(F.struct("length_class", "limit")).alias("limits"))


def quality(
    df: DataFrame, min_words: int = MIN_WORDS, min_documents: int = MIN_DOCUMENTS,
    max_class_distance: float = MAX_CLASS_DISTANCE, spreads: int = SPREADS,
) -> DataFrame:
    """doc_id, the base counts, base_failed, both distances and the limit of the word distance (null
    where not judged) and kept."""
    measured = settle(features(df))
    known = broadcast_if_small(settle(references(measured, min_words, min_documents)))
    compared = measured.join(known, measured["lang"].eqNullSafe(known["of"]), "left")
    long_enough = F.col("n_words") >= min_words
    judged = settle(compared.select(
        "doc_id", "lang", *BASE, "base_failed", F.floor(F.log2("n_words")).alias("length_class"),
        F.when(long_enough, distance(_shares(F.col("classes")), F.col("class_reference"))).alias("class_distance"),
        F.when(
            long_enough & F.col("commons").isNotNull() & (F.size("word_reference") > 0),
            distance(_shares(F.col("commons")), F.col("word_reference"))).alias("word_distance")))
    allowed = broadcast_if_small(settle(limits(judged, min_documents, spreads)))
    # the largest struct is that of the longest class
    nearest = F.array_max(F.filter("limits", lambda x: x["length_class"] <= F.col("length_class")))["limit"]
    judged = judged.join(allowed, judged["lang"].eqNullSafe(allowed["of"]), "left").withColumn(
        "word_limit", F.when(F.col("word_distance").isNotNull(), nearest / 1000))
    strange = (F.coalesce(F.col("class_distance"), F.lit(0.0)) > max_class_distance) | F.coalesce(
        F.col("word_distance") > F.col("word_limit"), F.lit(False))
    return judged.select("doc_id", *BASE, "base_failed", "class_distance", "word_distance", "word_limit",
                         (~F.col("base_failed") & ~strange).alias("kept"))
