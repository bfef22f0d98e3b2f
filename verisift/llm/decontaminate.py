"""Benchmark decontamination by template canonicalisation (native: DataFrame functions only).

Numbers, names and units become typed placeholders, in documents and benchmark items alike.
Windows of template tokens are hash-joined; a document that shares enough aligned windows with
an item is a candidate, and the values in its slots are checked for consistency: one value of
the item must stand for one value of the document.  That finds items copied word for word and
items asked again with other parameters.

A capitalised word may be a name or just begin a sentence.  Documents have one reading, in which
it is a name; items have that, one without the words that begin sentences, and one in small
letters, so that a copy matches whether the word was replaced, kept or written small.  Windows of few literal tokens say little.  An item that has too few others is also
sought by the tokens as they stand, so an item of numbers, names and units is found when it
is copied word for word.

Defined results: null and empty texts and items have no windows; items with fewer than
SHORTEST tokens match nothing; an item shorter than a window is one window of its own length;
several texts of one item_id are sought each; items without an item_id mark documents but aren't
listed; all other matching items are listed; rows repeating doc_id and text get equal results; a null
doc_id is an id like any other; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.llm.common import broadcast_if_small, settle, text_of, unwrapped, wrapped

WINDOW = 8
SHORTEST = 4
LEAST_LITERALS = 4  # literal tokens of a window that may speak for an item
LEAST_RUN = 6  # aligned windows in a row: 13 tokens
LEAST_SHARE = 0.5  # or this share of the item's windows
MOST_CONFLICTS = 0.1  # slots whose value contradicts another slot
BROADCAST_WINDOWS = 200_000

# Fixed values
UNITS = ("mm cm m km kilometers kilometres miles mile feet foot inch inches yard yards g kg mg gram grams kilogram "
         "kilograms pound pounds ounce ounces lb oz l ml liter liters litre litres gallon gallons s sec second "
         "seconds min minute minutes hour hours day days week weeks month months year years dollar dollars cent "
         "cents euro euros percent degree degrees kmh mph watt watts volt volts").split()
NUMBER_WORDS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
                "sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred "
                "thousand million").split()
NUMBER, UNIT, NAME = "<num>", "<unit>", "<name>"
MARK = "\u0001"  # stands before a word of an item that begins a sentence
TELLING, AS_THEY_STAND = 0, 1  # kinds of windows


def _any_word(words: list[str]) -> str:
    """A pattern for one of the words, as alternatives by first letter, so that a token is tried
    against few of them."""
    groups: dict[str, list[str]] = {}
    for w in words:
        groups.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{c}(?:{'|'.join(sorted(rest))})" for c, rest in sorted(groups.items())) + ")"


def spaced(text: Column, marked: bool = False) -> Column:
    """The tokens of a text between single blanks: runs of letters and digits; a decimal or
    grouped number is one token; if asked for, words that begin a sentence carry a mark."""
    joined = F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(" ")), r"(?<=\p{N})[.,](?=\p{N})", "")
    if not marked:
        return F.trim(F.regexp_replace(joined, r"[^\p{L}\p{N}]+", " "))
    begun = F.regexp_replace(joined, r"(?:^|[.!?:;\n])[^\p{L}\p{N}]*(?=\p{Lu})", " " + MARK)
    return F.trim(F.regexp_replace(begun, rf"[^\p{{L}}\p{{N}}{MARK}]+", " "))


def split_tokens(between_blanks: Column) -> Column:
    return F.when(between_blanks == "", F.array().cast("array<string>")).otherwise(F.split(between_blanks, " "))


def plain(raw: Column) -> Column:
    return F.lower(F.replace(raw, F.lit(MARK), F.lit("")))


def canonical(between_blanks: Column) -> Column:
    """The same tokens with placeholders, lower-cased; whole texts are rewritten at once.  Words with
    a mark aren't taken for names."""
    numbered = F.regexp_replace(between_blanks, rf"(?<![^ ]){MARK}?\p{{N}}[^ ]*", NUMBER)
    named = F.regexp_replace(numbered, r"(?<![^ ])\p{Lu}\p{Ll}[^ ]*", NAME)
    measured = F.regexp_replace(plain(named), rf"(?<![^ ]){_any_word(UNITS)}(?![^ ])", UNIT)
    return F.regexp_replace(measured, rf"(?<![^ ]){_any_word(NUMBER_WORDS)}(?![^ ])", NUMBER)


def _windows(size: int) -> Column:
    """Hashes of the windows of the column canon, by position."""
    def one(i: Column) -> Column:
        return F.xxhash64(*[F.col("canon")[i + k] for k in range(size)])

    n = F.size("canon")
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), one)).otherwise(F.array().cast("array<long>"))


def _tokens(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, canon (template tokens) and raw (tokens as they stand).

    Each text is a column of its own before it is split, as splitting names it twice and would rewrite it twice."""
    texts = df.select(*names, spaced(text_of()).alias("spaced")).select(*names, "spaced", canonical(F.col("spaced")).alias("template"))
    return texts.select(*names, split_tokens(F.col("template")).alias("canon"), split_tokens(F.col("spaced")).alias("raw"))


def item_tokens(benchmark: DataFrame) -> DataFrame:
    """item_id, ikey (a number of its own for every text of an item), canon and raw as for documents, and
    two more readings: begun, in which words that begin sentences aren't names, and small, in which
    no word is; stored."""
    distinct = benchmark.select("item_id", text_of().alias("text")).distinct()
    keyed = settle(distinct.select("item_id", F.monotonically_increasing_id().alias("ikey"), "text"))
    marked = split_tokens(canonical(spaced(F.col("text"), marked=True)))
    small = split_tokens(canonical(F.lower(spaced(F.col("text")))))
    return settle(_tokens(keyed, "item_id", "ikey", "text").withColumn("begun", marked).withColumn("small", small).drop("text"))


def _hash_of(tokens: str, window: int, *more: Column) -> Column:
    """Hash of the tokens of an item's window at ipos, of a size up to the window."""
    hashed = F.lit(None).cast("long")
    for k in range(SHORTEST, window + 1):
        own = F.xxhash64(*more, *[F.get(F.col(tokens), F.col("ipos") + j) for j in range(k)])
        hashed = F.when(F.col("size") == k, own).otherwise(hashed)
    return hashed


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """ikey, kind, ipos, size (tokens) and hash of the windows that speak for an item, and their
    number per item and kind."""
    tokens = items.withColumn("n", F.size("canon")).where(F.col("n") >= SHORTEST)
    sizes = F.least(F.col("n"), F.lit(window))
    plain_raw = F.transform("raw", plain)
    placed = tokens.select("ikey", "canon", "begun", "small", plain_raw.alias("raw"), sizes.alias("size"),
                           F.explode(F.sequence(F.lit(0), F.col("n") - sizes)).alias("ipos"))

    def telling(reading: str) -> DataFrame:
        part = F.slice(reading, F.col("ipos") + 1, F.col("size"))
        literal = F.size(F.filter(part, lambda t: ~t.isin(NUMBER, UNIT, NAME)))
        return placed.where(literal >= F.least(F.lit(LEAST_LITERALS), F.col("size") - 1)).select(
            "ikey", "ipos", "size", _hash_of(reading, window).alias("h"))

    found = telling("canon").union(telling("begun")).union(telling("small")).distinct()
    speaking = found.groupBy("ikey").agg(F.countDistinct("ipos").alias("windows"))
    few = placed.join(speaking.where(F.col("windows") >= LEAST_RUN), "ikey", "left_anti")
    exact = few.select("ikey", "ipos", "size", _hash_of("raw", window, F.lit("raw")).alias("h"))
    whole = exact.groupBy("ikey").agg(F.count("*").alias("windows"))
    return found.join(speaking, "ikey").withColumn("kind", F.lit(TELLING)).unionByName(
        exact.join(whole, "ikey").withColumn("kind", F.lit(AS_THEY_STAND)))


def _placed(tokens: str, kind: int, size: int) -> Column:
    """Kind, size, position and hash of the windows of a document's tokens."""
    more = [F.lit("raw")] if kind == AS_THEY_STAND else []

    def one(i: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(size).alias("size"), i.alias("pos"),
                        F.xxhash64(*more, *[F.col(tokens)[i + k] for k in range(size)]).alias("h"))

    n = F.size(tokens)
    none = F.array().cast("array<struct<kind:int,size:int,pos:int,h:bigint>>")
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), one)).otherwise(none)


def matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, _th (hash of the text), item_id, exact (all slots equal) for contaminated documents."""
    items = item_tokens(benchmark)
    wanted = settle(item_windows(items, window))
    used = sorted((r["kind"], r["size"]) for r in wanted.select("kind", "size").distinct().collect())  # two kinds of `window` sizes
    keyed = documents.select("doc_id", F.xxhash64(text_of()).alias("_th"), "text")
    tokens = _tokens(keyed, "doc_id", "_th")
    if any(kind == AS_THEY_STAND for kind, _ in used):
        tokens = tokens.withColumn("raw", F.transform("raw", plain))
    spots = [_placed("canon" if kind == TELLING else "raw", kind, k) for kind, k in used or [(TELLING, window)]]
    spread = tokens.select("doc_id", "_th", F.explode(F.concat(*spots)).alias("w")).select(
        "doc_id", "_th", "w.kind", "w.pos", "w.size", "w.h")
    hits = spread.join(broadcast_if_small(wanted, BROADCAST_WINDOWS), ["h", "size", "kind"])
    aligned = hits.groupBy("doc_id", "_th", "ikey", "kind", "windows", (F.col("pos") - F.col("ipos")).alias("at")).agg(
        F.count("*").alias("n"), F.collect_set("ipos").alias("places"))
    found = aligned.groupBy("doc_id", "_th", "ikey", "kind", "windows").agg(
        F.max(F.struct(F.col("n"), (-F.col("at")).alias("back"))).alias("best"),
        F.size(F.array_distinct(F.flatten(F.collect_set("places")))).alias("covered"))
    speaks = (F.col("best.n") >= LEAST_RUN) | (F.col("covered") >= LEAST_SHARE * F.col("windows"))
    strong = settle(found.where(speaks).groupBy("doc_id", "_th", "ikey").agg(F.max("best").alias("best")).select(
        "doc_id", "_th", "ikey", (-F.col("best.back")).alias("at")))
    return _consistent(keyed, items, strong)


def _consistent(keyed: DataFrame, items: DataFrame, strong: DataFrame) -> DataFrame:
    """Candidates whose slots agree, by the tokens along the best alignment."""
    chosen = broadcast_if_small(settle(strong.select(F.col("doc_id").alias("_did"), F.col("_th").alias("_dth")).distinct()))
    same = keyed["doc_id"].eqNullSafe(chosen["_did"]) & (keyed["_th"] == chosen["_dth"])
    texts = _tokens(keyed.join(chosen, same, "left_semi"), "doc_id", "_th").dropDuplicates(["doc_id", "_th"]).select(
        F.col("doc_id").alias("_did"), F.col("_th").alias("_dth"), F.col("raw").alias("draw"), F.col("canon").alias("dcanon"))
    both = strong.join(texts, strong["doc_id"].eqNullSafe(texts["_did"]) & (strong["_th"] == texts["_dth"])).join(
        items.select("item_id", "ikey", F.col("raw").alias("iraw"), F.col("canon").alias("icanon")), "ikey")
    pairs = F.transform("icanon", lambda t, i: F.struct(
        t.alias("kind"), (F.coalesce(F.get("dcanon", i + F.col("at")) == t, F.lit(False)) & (i + F.col("at") >= 0)).alias("same"),
        plain(F.get("iraw", i)).alias("asked"), plain(F.get("draw", F.greatest(i + F.col("at"), F.lit(0)))).alias("given")))
    slots = F.filter(pairs, lambda p: p["same"] & p["kind"].isin(NUMBER, UNIT, NAME))
    checked = both.withColumn("slots", slots).withColumn(
        "values", F.size(F.array_distinct(F.transform("slots", lambda p: F.struct(p["kind"], p["asked"]))))).withColumn(
        "mappings", F.size(F.array_distinct(F.transform("slots", lambda p: F.struct(p["kind"], p["asked"], p["given"]))))).withColumn(
        "differ", F.size(F.filter("slots", lambda p: p["asked"] != p["given"])))
    agreed = F.col("mappings") - F.col("values") <= MOST_CONFLICTS * F.size("slots")
    return checked.where(agreed).select("doc_id", "_th", "item_id", (F.col("differ") == 0).alias("exact"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with their columns, contaminated (boolean) and item_ids (sorted, empty if clean)."""
    found = matches(documents, benchmark, window).groupBy(F.col("doc_id").alias("_mid"), F.col("_th").alias("_mth")).agg(
        F.sort_array(F.collect_set("item_id")).alias("_items"))
    found = broadcast_if_small(settle(found))
    keyed = wrapped(documents, _did=F.col("doc_id"), _dth=F.xxhash64(text_of()))
    joined = keyed.join(found, keyed["_did"].eqNullSafe(found["_mid"]) & (keyed["_dth"] == found["_mth"]), "left")
    return joined.select(*unwrapped(
        documents.columns, contaminated=F.col("_items").isNotNull(),
        item_ids=F.coalesce("_items", F.array().cast("array<long>"))))
