"""Personal data, also behind disguises, with offsets into the source text.

Four detectors run on the text as it stands (the base spans).  Texts with signs of a disguise
go through transducers as well: look-alike letters and digits of other scripts become ASCII,
invisible characters vanish, spelled digits become digits, and "at" / "dot" / "plus" disguises
become signs.  Every normalised character keeps the source range it came from, so spans found
in the normalised text are mapped back.

Defined results: null reads as empty and has no spans; repeated rows give repeated results;
other columns are ignored.  Base spans always stay, also those that a disguise cuts short; an
added span may contain or overlap them, but doesn't equal one or lie inside one of its own kind,
nor inside another added span of its kind.  All scans are linear in the length of the text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from verisift.llm.common import text_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

# Letters and digits of other scripts that look like ASCII ones
LOOKALIKES = dict(zip(
    "аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅ" "αορνικτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ı",
    "aeopcyxijsdhqwABEKMHOPCTYXIJS" "aopviktuABEZHIKMNOPTYX" "i", strict=True))
# Fullwidth forms lie at a fixed distance from ASCII
LOOKALIKES |= {chr(code + 0xFEE0): chr(code) for code in range(0x21, 0x7F)}
# Digits of other scripts start at these code points
LOOKALIKES |= {chr(start + k): str(k) for start in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for k in range(10)}
INVISIBLE = "­​‌‍⁠﻿"
DIGIT_WORDS = {w: str(k) for k, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
SIGN_WORDS = {"at": "@", "dot": ".", "plus": "+", "dash": "-", "hyphen": "-", "underscore": "_"}

_ODD = re.compile("[" + "".join(map(re.escape, LOOKALIKES)) + INVISIBLE + "]")
_SPELLED = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
# Signs of a disguise: two spelled digits in a row, a boxed sign, a bare "at" followed by a bare "dot"
_SPELLED_RUN = re.compile(rf"(?:{_SPELLED})[\s-]+(?:(?:{_SPELLED}|dot)\b|[0-9])|[0-9][\s-]+(?:{_SPELLED})\b")
_BOXED = re.compile(r"[\[({<]\s*(?:at|dot|@|\.)\s*[\])}>]")
# A "plus" before a number, or inside the local part of an address
_PLUS_NUMBER = re.compile(rf"plus[\s(]*(?:[0-9]|(?:{_SPELLED})\b)", re.IGNORECASE)
_PLUS_TAG = re.compile(r"plus[ \t]+[a-z0-9._%-]+(?:@|[ \t]+at[ \t]|[ \t]*[\[({<][ \t]*(?:at|@))", re.IGNORECASE)
# A spelled-out address must end in one of these; without a sign, prose reads alike
TOP_LEVEL = frozenset("com org net edu gov info io biz de fr es it uk eu us ch at nl be pl ru cn jp br in ca au".split())
_BARE_AT = re.compile(r"\sat\s", re.IGNORECASE)
_TOKEN = re.compile(
    rf"(?P<boxed>\s*[\[({{<]\s*(?P<inner>at|dot|@|\.)\s*[\])}}>]\s*)|\b(?P<word>{_SPELLED}|{'|'.join(SIGN_WORDS)})\b", re.IGNORECASE)

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]+")


def emails(text: str) -> Iterator[Span]:
    """Each at sign with a domain, extended left over the local part."""
    done = 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            done = m.end()
            yield start, done, "email"


def addresses(text: str) -> Iterator[Span]:
    """Runs of dotted numbers, four at a time."""
    for m in _NUMBERS.finditer(text) if text.count(".") > 2 else ():
        if m.group().count(".") < 3:
            continue
        parts = list(_DIGIT.finditer(text, m.start(), m.end()))
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            if all(len(p.group().lstrip("0")) <= 3 and int(p.group().lstrip("0") or 0) <= 255 for p in four):
                yield four[0].start(), four[3].end(), "ip"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.start(), m.end(), "card"


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(map(len, _DIGIT.findall(m.group()))) <= 15:
            yield m.start(), m.end(), "phone"


def detect(text: str) -> list[Span]:
    """The spans of all kinds in a text, by start and then kind."""
    if not _DIGIT.search(text):
        return list(emails(text))
    found = [*emails(text), *addresses(text), *cards(text), *phones(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


class Tape:
    """A text under rewriting; character k stands for source characters begin[k] to end[k]."""

    def __init__(self, text: str):
        self.text, self.begin, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: Iterable[tuple[int, int, str]]) -> None:
        """Replaces ranges (in order, apart) by other text; each new character stands for the whole range."""
        text, begin, end, at = [], [], [], 0
        for start, stop, new in edits:
            text += [self.text[at:start], new]
            begin += self.begin[at:start] + [self.begin[start]] * len(new)
            end += self.end[at:start] + [self.end[stop - 1]] * len(new)
            at = stop
        self.text = "".join(text) + self.text[at:]
        self.begin, self.end = begin + self.begin[at:], end + self.end[at:]


def fold(tape: Tape) -> None:
    """Look-alikes to ASCII, invisible characters away."""
    tape.rewrite((m.start(), m.end(), LOOKALIKES.get(m.group(), "")) for m in _ODD.finditer(tape.text))


def unspell(tape: Tape) -> None:
    """Spelled digits to digits, at / dot and the like to signs, gaps between them closed.

    A bare "at" or "dot" is a sign only if the same stretch holds the other one or a real sign;
    a gap closes only next to a rewritten word."""
    text, edits, last = tape.text, [], 0
    signed = _signed(text.lower())
    for m in _TOKEN.finditer(text):
        start, stop = m.span()
        if m.group("boxed"):
            inner = m.group("inner").lower()
            new = SIGN_WORDS.get(inner, inner)
        else:
            word = m.group("word").lower()
            new = DIGIT_WORDS.get(word) or SIGN_WORDS[word]
            if word in SIGN_WORDS:
                before, after = start, stop
                while before > 0 and text[before - 1] in " \t":
                    before -= 1
                while after < len(text) and text[after] in " \t":
                    after += 1
                if word == "plus" and _PLUS_NUMBER.match(text, start):
                    stop = after
                elif word == "plus" and not _PLUS_TAG.match(text, start) or word == "at" and not signed:
                    continue
                elif before == start or after == stop:
                    continue
                else:
                    start, stop = before, after
            else:
                after = stop
                while after < len(text) and text[after] in " \t-":
                    after += 1
                if re.match(rf"(?:{_SPELLED})\b|[0-9]", text[after:after + 8], re.IGNORECASE):
                    stop = after
        if start < last:
            start = last
        if start < stop:
            edits.append((start, stop, new))
            last = stop
    tape.rewrite(edits)


def _signed(lower: str) -> bool:
    """Whether a lower-cased text holds signs of a disguise with which a bare "at" counts."""
    words = set(lower.replace("-", " ").split())
    if "dot" in words and not words.isdisjoint(("at", *DIGIT_WORDS)):
        return True
    if "dot" in lower and "@" in lower:
        return True
    if not words.isdisjoint(("dash", "hyphen", "underscore")) or "plus" in words and any(
            _PLUS_TAG.match(lower, m.start()) for m in re.finditer(r"\bplus\b", lower)):
        return True
    if not words.isdisjoint(DIGIT_WORDS) and _SPELLED_RUN.search(lower):
        return True
    return any(c in lower for c in "[({<") and bool(_BOXED.search(lower))


def suspicious(text: str) -> bool:
    """Whether a text may hold a spelled or boxed disguise; cheap tests come first."""
    lower = text.lower()
    return _signed(lower) or "plus" in lower and any(_PLUS_NUMBER.match(lower, m.start()) for m in re.finditer(r"\bplus\b", lower))


def disguised(text: str) -> list[Span]:
    """Spans found only after normalisation, in source offsets."""
    found: set[Span] = set()
    tape = None

    def collect() -> None:
        for start, stop, kind in detect(tape.text):
            span = (tape.begin[start], tape.end[stop - 1], kind)
            bare = kind == "email" and _BARE_AT.search(text, span[0], span[1])
            if not bare or tape.text[start:stop].rpartition(".")[2].lower() in TOP_LEVEL:
                found.add(span)

    if not text.isascii() and _ODD.search(text):
        tape = Tape(text)
        fold(tape)
        collect()
    if suspicious(tape.text if tape else text):
        tape = tape or Tape(text)
        unspell(tape)
        collect()
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans); a span isn't added inside a base or added span of its own kind."""
    base = detect(text)
    added = disguised(text)
    if not added:
        return base, base
    kept = []
    for kind in KINDS:
        spans = sorted((s[0], s[1]) for s in base if s[2] == kind)
        starts, reach = [s for s, _ in spans], [0, *accumulate((stop for _, stop in spans), max)]
        end = 0
        for start, stop, _ in sorted((s for s in added if s[2] == kind), key=lambda s: (s[0], -s[1])):
            if max(end, reach[bisect_right(starts, start)]) < stop:
                kept.append((start, stop, kind))
                end = stop
    return base, sorted(base + kept, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{kind}:{start}:{stop}" for start, stop, kind in spans)


SCHEMA = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
          "spans string, n_added long")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            base, every = find(text.as_py())
            rows.append((*[sum(s[2] == k for s in base) for k in KINDS],
                         hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
            names=["doc_id", *["n_" + k for k in KINDS], "base_sha256", "spans", "n_added"])


def scan(df: DataFrame) -> DataFrame:
    """doc_id, base counts by kind, digest of the base spans, all spans and the number added."""
    return df.select(df["doc_id"].cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(_scan, SCHEMA)
