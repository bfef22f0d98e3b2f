"""Trie nodes against a plain trie of Python tuples."""

import hashlib
import re
import zlib

import pytest
from verisift.llm import trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def conversations(df):
    out = {}
    for r in df.where("conv_id is not null").collect():
        out.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    return {c: [t[1:] for t in sorted(v, key=lambda t: (t[0] is not None, t[0] or 0))] for c, v in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def slow(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[b] for b in below) or 1
        words = len(WORD.findall(p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[b] for b in below)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def talks(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_against_a_plain_trie(talks, shards):
    assert rows(trie.prefix_trie(talks, shards)) == slow(conversations(talks))
    paths = trie.rebuilt(trie.paths_of(trie.turns_of(talks)))
    assert rows(trie.nodes_of(paths, shards)) == slow(rebuilt(conversations(talks)))


@pytest.mark.parametrize("kept", [64, 4_000_000])
def test_copies_span_shards(spark, monkeypatch, kept):
    """Many equal conversations, some that go on, and splitters cut off after one turn."""
    monkeypatch.setattr(trie, "SKELETON_BYTES", kept)
    monkeypatch.setattr(trie, "JOINED", 3)
    monkeypatch.setattr(trie, "FLUSHED", 2)
    data = [(c, t, "user", f"same words {t}") for c in range(60) for t in range(4)]
    data += [(c, 9, "assistant", f"own {c % 7}") for c in range(0, 60, 2)] + [(c, t, "user", f"lone {c}") for c in range(60, 70) for t in range(2)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    assert rows(trie.prefix_trie(df, 9)) == slow(conversations(df))


def test_odd_rows(spark):
    data = [(1, None, "user", "first"), (1, 0, None, None), (1, 1, "user", ""), (2, None, "user", "first"), (2, 0, "", None),
            (None, 0, "user", "nobody"), (3, 5, "a\nb", "c"), (4, 5, "a", "b\nc"), (5, 1, "user", "x " * 50_000), (5, 2, "user", "x"),
            (5, 2, "user", "x"), (-3, 1, "user", "first"), (9, 1, "user", "only head")]
    df = spark.createDataFrame([(*r, 7, "z") for r in data], "conv_id long, turn long, role string, text string, depth long, shard string")
    want = slow(conversations(df))
    for shards in (1, 5):
        assert rows(trie.prefix_trie(df, shards)) == want
    assert trie.prefix_trie(df.limit(0)).count() == 0
    long = spark.createDataFrame([(7, k, "user", "w") for k in range(3000)] + [(8, k, "user", "w") for k in range(2999)],
                                 "conv_id long, turn long, role string, text string")
    assert rows(trie.prefix_trie(long, 3)) == slow(conversations(long))


def test_turnless_conversations(spark):
    """Conversations whose head is taken from a conversation that isn't there."""
    data = [(c, 0, "user", f"t{c}") for c in range(21, 60) if c % 20]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    want = slow(rebuilt(conversations(df)))
    assert want[0][1] == 0 or any(not t for t in rebuilt(conversations(df)).values())
    assert rows(trie.nodes_of(trie.rebuilt(trie.paths_of(trie.turns_of(df))), 4)) == want
