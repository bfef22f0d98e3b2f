"""Packed pieces against the tokenizer itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer
from verisift.llm import packing

PARTS = [" ", "  ", "\n", "\t", "a", "Word", "d'é", "'s", "'ll", "1", "23", "!", "?.", "<|endoftext|>", "​", "x,", "the", "\x1c", "　", "é", "日本", "😀", "ſ", "ª"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_the_tokenizers(tokenizer):
    rng, encode = random.Random(5), packing.Encoder().ids
    for _ in range(5_000):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 14)))
        assert np.frombuffer(encode(text), "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def whole(df, tokenizer, **options):
    texts = {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}
    ids = {d: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4") for d, t in texts.items()}
    documents, sequences = {}, {}
    for r in packing.pack(df, **options).collect():
        documents.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(documents) == set(ids)
    for d, pieces in documents.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[d])
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[d][r["start"]:at].tobytes())
        assert at == len(ids[d])
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.WINDOW
        padding += packing.WINDOW - at
    return padding, len(sequences)


def test_every_id_lies_in_one_piece(docs, tokenizer):
    padding, sequences = whole(docs, tokenizer)
    assert padding <= packing.WINDOW and sequences > 10
    padding, sequences = whole(docs, tokenizer, shard_docs=50)
    assert padding < 0.05 * packing.WINDOW * sequences


def neighbour_share(spark, df, shard_docs):
    """Shares of the five best BM25 neighbours that lie in the seed's shard, and of any two rests that do."""
    blocks = packing.tokenize(df).where("ids is not null").select("ids").collect()
    rests = [np.frombuffer(bytes(r["ids"]), "<u2") for r in blocks]
    docs, mean, seen = packing.frequencies(packing.tokenize(df))
    idf = np.log1p((docs - seen + 0.5) / (seen + 0.5))
    times, index = packing.waiting_times(), packing.Index(rests, idf, mean)
    order = np.argsort([packing.place(r, idf, mean, times) for r in rests], kind="stable")
    shard = np.empty(len(rests), np.int64)
    shard[order] = np.arange(len(rests)) // shard_docs
    hits = []
    for k in range(0, len(rests), max(1, len(rests) // 200)):
        scores = index.scores(k)
        scores[k] = -1
        hits.append(np.mean(shard[np.argsort(-scores, kind="stable")[:5]] == shard[k]))
    return np.mean(hits), shard_docs / len(rests)


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_neighbours_meet_more_often_than_by_chance(spark, sf_dir, scale):
    df = spark.read.parquet(f"{sf_dir}/../{scale}/documents.parquet")
    found, chance = neighbour_share(spark, df, df.count() // 10)
    assert found > 2 * chance


def test_neighbours_of_a_topic_share_a_shard(spark):
    rng = random.Random(6)
    topics = [["".join(rng.choices("abcdefghij", k=9)) for _ in range(12)] for _ in range(200)]
    usual = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choices(usual, k=40) + rng.choices(topics[k % 200], k=40))) for k in range(2_000)]
    rng.shuffle(rows)
    found, chance = neighbour_share(spark, spark.createDataFrame(rows, "doc_id long, text string"), 100)
    assert chance == 0.05 and found > 0.5


def test_equal_documents_are_spread(spark):
    df = spark.range(5_000).selectExpr("1L AS doc_id", "'the same words again' AS text")
    pieces = packing.pack(df, shard_docs=500).collect()
    shards = {}
    for r in pieces:
        shards[r["sequence_id"] >> 40] = shards.get(r["sequence_id"] >> 40, 0) + r["length"]
    assert sum(shards.values()) == 5_000 * pieces[0]["doc_tokens"] and max(shards.values()) < 0.3 * sum(shards.values())


def test_odd_rows(odd, no_docs, tokenizer):
    whole(odd.where("doc_id > 1 or doc_id is null"), tokenizer)
    assert sum(r["length"] for r in packing.pack(odd.where("doc_id = 1")).collect()) == 2 * packing.pack(odd.where("doc_id = 1")).first()["doc_tokens"]
    assert packing.pack(no_docs).count() == 0


def test_index_scores_and_neighbours():
    rng = np.random.default_rng(2)
    rests = [rng.integers(0, 40, rng.integers(5, 60)).astype(np.uint16) for _ in range(30)]
    idf = np.zeros(65_536)
    seen = np.bincount(np.concatenate([np.unique(r) for r in rests]), minlength=65_536)
    idf = np.log1p((30 - seen + 0.5) / (seen + 0.5))
    mean = np.mean([len(r) for r in rests])
    index = packing.Index(rests, idf, mean)
    for q in range(30):
        want = [sum(idf[t] * (tf := np.sum(d == t)) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in np.unique(rests[q])) for d in rests]
        assert np.allclose(index.scores(q), want)
    # the seed's likeliest neighbour comes first
    rests = [np.array([1, 2, 3, 4, 5], np.uint16), np.array([9, 8, 7], np.uint16), np.array([1, 2, 3], np.uint16), np.array([7, 7, 7], np.uint16)]
    assert packing.pack_shard(rests, np.ones(65_536), 3.5, 8)[0] == [(0, 0, 5), (2, 0, 3)]


def test_a_text_is_encoded_at_once():
    encode, texts = packing.Encoder(), ["one two  three", "a<|endoftext|>b c", "", " x" * 5_000]
    calls, plain = [], encode.plain
    encode.plain = lambda text: calls.append(text) or plain(text)
    for text in texts:
        encode.ids(text)
    assert calls == [part for text in texts for part in text.split("<|endoftext|>")]


def test_words_are_told_without_looking_ahead():
    encoder = packing.Encoder()
    assert packing.pieces("one two\nthree") == ["one two\nthree"] and packing.pieces("a \n\n b\t\tc  ") == ["a \n\n", " b\t", "\tc  "]
    assert packing.pieces("é　 x") == ["é　", " x"]
    slow = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.words.__self__._mergeable_ranks, special_tokens={})
    rng = random.Random(8)
    for _ in range(5_000):
        text = "".join(rng.choices([*PARTS, "\r\n", "\x0b", "\x0c", "\x1f", "\x85", "\xa0", " ", " ", " ", " ", " "], k=rng.randint(0, 9)))
        assert encoder.plain(text) == slow.encode_ordinary(text)


def test_terms_are_counted_and_drawn_for_many_rests_at_once():
    rng, times = np.random.default_rng(3), packing.waiting_times()
    rests = [rng.integers(0, 300, rng.integers(1, 80)).astype(np.uint16) for _ in range(50)]
    idf = rng.random(65_536)
    term, owner, tf, sizes = packing.counted(rests)
    assert sizes.tolist() == [len(r) for r in rests]
    assert list(zip(owner, term, tf, strict=True)) == [(k, t, n) for k, r in enumerate(rests) for t, n in zip(*np.unique(r, return_counts=True), strict=True)]
    for rest, found in zip(rests, packing.places(rests, idf, 40.0, times), strict=True):
        t, n = np.unique(rest, return_counts=True)
        drawn = t[np.argmin(times[:, t] / packing.weight(idf[t], n, len(rest), 40.0), axis=1)]
        assert int(found) + 2**63 == int.from_bytes(drawn.astype(">u2").tobytes(), "big")
    assert [len(x) for x in packing.counted([])] == [0, 0, 0, 0]
