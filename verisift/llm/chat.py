"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string.  The operator renders
successive prefixes of a conversation: what a prefix adds to the previous output is the span of
its last turn, and an output that does not begin with the previous one shows a template that
rewrites history.  Two probe texts in the place of a turn's text show where the text starts;
an empty one shows what frames it.

Defined results: turns are ordered by turn (nulls first), then role and text; null role and
text read as empty; a null conv_id is a conversation of its own; repeated rows are turns of
their own; an empty table gives no rows; other columns are ignored.  Conversations stream
through a task one at a time, so memory holds one conversation; rendering all prefixes is
quadratic in its turns, which is the price of treating the template as a black box.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

TURN, END = "<|turn|>", "<|end|>"
# Strings that common templates give a meaning; none may stand in a text unescaped
CONTROL = (TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
           "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|begin_of_text|>", "<|eot_id|>")

_MARKS = re.compile(r"\\|" + "|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_HEADER = re.compile(re.escape(TURN) + r"((?:[^\\\n]|\\.)*)\n", re.DOTALL)


def escape(text: str) -> str:
    """Doubles backslashes and puts one behind the first character of each control string."""
    return _MARKS.sub(lambda m: "\\\\" if m.group() == "\\" else m.group()[0] + "\\" + m.group()[1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@lru_cache(maxsize=4096)
def _turn(turn: Turn) -> str:
    role, text = turn
    return f"{TURN}{escape(role).replace(chr(10), chr(92) + chr(10))}\n{escape(text)}{END}\n"


def marked(turns: list[Turn]) -> str:
    """The library's own template.  Turns are kept rendered, as successive prefixes repeat them."""
    return "".join(map(_turn, turns))


def parse(formatted: str) -> list[Turn]:
    """The turns of an output of `marked`."""
    turns, at = [], 0
    while at < len(formatted):
        head = _HEADER.match(formatted, at)
        stop = formatted.index(END, head.end())
        turns.append((unescape(head.group(1)), unescape(formatted[head.end():stop])))
        at = stop + len(END) + 1
    return turns


def spans(turns: list[Turn], render: Template) -> tuple[str, list[tuple[int, int, int, int]], list[int]]:
    """The full output; per turn its start and end and its text's start and end there; the
    indexes of turns that make the template rewrite what it has put out before.

    A text that the template does not put out in one piece gets an empty text span.  After a
    rewrite, earlier spans are cut to what is still common to both outputs."""
    output, found, rewrites = render([]) if turns else "", [], []
    for k, (role, text) in enumerate(turns):
        before, history = output, turns[:k]
        output = render(turns[:k + 1])
        start = len(before)
        if not output.startswith(before):
            rewrites.append(k)
            start = len(commonprefix([before, output]))
            found = [tuple(min(x, start) for x in f) for f in found]
        frame = render([*history, (role, "")])
        at = len(commonprefix([render([*history, (role, "x")]), render([*history, (role, "y")])]))
        stop = at + len(output) - len(frame)
        if at <= stop and output[:at] == frame[:at] and output[stop:] == frame[at:]:
            found.append((start, len(output), at, stop))
        else:
            found.append((start, len(output), start, start))
    return output, found, rewrites


SPANS = pa.list_(pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                            ("text_start", pa.int64()), ("text_end", pa.int64())]))
SCHEMA = ("conv_id long, formatted string, "
          "spans array<struct<role string, start long, end long, text_start long, text_end long>>, rewrites array<int>")


def _formatter(render: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
        ids, texts, where, again, size = [], [], [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(where, SPANS),
                 pa.array(again, pa.list_(pa.int32()))], names=["conv_id", "formatted", "spans", "rewrites"])

        for conv_id, group in groupby(rows, key=lambda r: r[0]):
            turns = [(r[2], r[3]) for r in group]
            output, found, rewrites = spans(turns, render)
            ids.append(conv_id)
            texts.append(output)
            where.append([dict(zip(("role", "start", "end", "text_start", "text_end"), (t[0], *f), strict=True))
                          for t, f in zip(turns, found, strict=True)])
            again.append(rewrites)
            size += len(output)
            if size > 4_000_000:
                yield batch()
                ids, texts, where, again, size = [], [], [], [], 0
        if ids:
            yield batch()

    return run


def format_conversations(df: DataFrame, render: Template = marked) -> DataFrame:
    """One row per conversation: conv_id, formatted, the spans of its turns, and the turns at
    which the template rewrote history."""
    turns = df.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_formatter(render), SCHEMA)


DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for conv_id, formatted, where, _ in zip(*[c.to_pylist() for c in b.columns], strict=True):
            turns = parse(formatted)
            loss = "".join(unescape(formatted[s["text_start"]:s["text_end"]]) for s in where if s["role"] == "assistant")
            told = "".join(f"{role}\n{text}\n" for role, text in turns)
            rows.append((conv_id, len(turns), hashlib.sha256(told.encode("utf-8", "surrogatepass")).hexdigest(), len(loss),
                         hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(formatted)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        names = [part.split()[0] for part in DIGESTS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what can be read from the formatted text and, by the spans, of the text under
    the loss mask (the texts of assistant turns)."""
    return formatted.mapInArrow(_digest, DIGESTS)
