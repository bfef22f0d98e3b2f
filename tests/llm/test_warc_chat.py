"""Exact round trips of archives and formatted conversations."""

import hashlib
import random

import pytest
from verisift.llm import chat, warc
from verisift.session import scratch_path


def test_archive_round_trip(spark, sf_dir):
    page = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    extra = [(90_001, None, None), (90_002, "u", ""), (90_003, "v\r\nWARC-Type: x", "é" * 60), (90_004, "w", "é" * 60),
             (90_009, "", "x" * 99), (90_010, " a\r", "x"), (90_011, "\n", "x" * 300), (90_012, "é%0A \u2028", "x" * 300),
             (None, "z", "é" * 60), (90_003, "v2", "é" * 60), (90_005, "c", "x" * 99), (90_006, "c", "x" * 99), (90_007, "d", "x" * 100), (90_008, "d", "x" * 100)]
    df = page.union(spark.createDataFrame(extra, page.schema))
    path = scratch_path(spark, "warc")
    warc.write_archive(df, path)
    rows = df.collect()
    back = warc.read_archive(spark, path).collect()
    assert len(back) == len(rows)
    assert spark.read.parquet(f"{path}/payloads").count() == len({r["html"] or "" for r in rows})
    assert sorted((r["page_id"] or 0, repr(r["url"])) for r in back) == sorted((r["page_id"] or 0, repr(r["url"])) for r in rows)
    first = {}
    for r in rows:
        if r["page_id"] is not None and len((r["html"] or "").encode()) >= 100:
            first[r["html"]] = min(r["page_id"], first.get(r["html"], r["page_id"]))
    want = sorted(((r["page_id"], len(b), hashlib.sha256(b).hexdigest(),
                    *(("revisit", first[r["html"]]) if len(b) >= 100 and r["page_id"] != first[r["html"]] else ("response", None)))
                   for r in rows for b in [(r["html"] or "").encode()]), key=repr)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back), key=repr) == want
    for r in back:
        block = bytes(r["payload"]) if r["record_type"] == "response" else b""
        assert bytes(r["record"]) == bytes(r["header"]) + b"\r\n" + block + b"\r\n\r\n"
        fields = bytes(r["header"]).decode().split("\r\n")
        assert fields[0] == "WARC/1.1" and fields[-1] == "" and all(": " in f and "\n" not in f for f in fields[1:-1])
        assert {f"Content-Length: {len(block)}", f"WARC-Date: {warc.DATE}"} <= set(fields)


def test_copied_page_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr("verisift.llm.common.HOT_ROWS", 50)
    df = spark.range(3_000).selectExpr("id AS page_id", "concat('u', id) AS url", "repeat('x', if(id % 3 = 0, 500, 100 + id)) AS html",
                                       "id AS digest", "id AS first", "id AS size", "'a' AS header")
    path = scratch_path(spark, "warc")
    warc.write_archive(df, path, date="2024-02-29T12:00:00Z")
    back = {r["page_id"]: r for r in warc.read_archive(spark, path).collect()}
    assert len(back) == 3_000 and all(r["url"] == f"u{k}" and b"\r\nWARC-Date: 2024-02-29T12:00:00Z\r\n" in bytes(r["header"]) for k, r in back.items())
    for k, r in back.items():
        want = 0 if k % 3 == 0 or k == 400 else k
        assert (r["record_type"], r["refers_to"]) == (("response", None) if want == k else ("revisit", want))


def test_very_long_page(spark):
    df = spark.createDataFrame([(1, "u" * 10_000, "é\n" * 3_000_000), (2, "v", "é\n" * 3_000_000)], "page_id long, url string, html string")
    path = scratch_path(spark, "warc")
    warc.write_archive(df, path)
    back = {r["page_id"]: r for r in warc.read_archive(spark, path).selectExpr("page_id", "refers_to", "url", "length(record) AS n", "payload_bytes").collect()}
    assert back[1]["url"] == "u" * 10_000 and back[1]["n"] > back[1]["payload_bytes"] == 9_000_000
    assert back[2]["refers_to"] == 1 and back[2]["n"] < 1_000


def test_damaged_payload_is_noticed(spark):
    path = scratch_path(spark, "warc")
    warc.write_archive(spark.createDataFrame([(1, "u", "x" * 200)], "page_id long, url string, html string"), path)
    stored = spark.read.parquet(f"{path}/payloads").selectExpr("digest", "encode('other', 'UTF-8') AS payload").collect()
    spark.createDataFrame(stored, "digest string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, path).select("payload_digest").collect()


def test_empty_archive(spark):
    path = scratch_path(spark, "warc")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archive(spark, path).count() == 0


PARTS = ["<", "s", ">", "/", "[", "INST", "]", "\\", "<|end|>", "<|turn|>", "\n", "a", "</s>", "[/INST]", " "]


def test_random_conversations_are_read_back():
    rng = random.Random(3)
    for _ in range(5_000):
        turns = [("".join(rng.choices(PARTS, k=rng.randint(0, 3))), "".join(rng.choices(PARTS, k=rng.randint(0, 8)))) for _ in range(rng.randint(0, 4))]
        output, found, rewrites = chat.spans(turns, chat.marked)
        assert chat.parse(output) == turns and not rewrites
        assert [chat.unescape(output[f[2]:f[3]]) for f in found] == [t for _, t in turns]
        assert [f[0] for f in found] == [0, *(f[1] for f in found)][:len(found)]
        for _, text in turns:
            assert not any(c in chat.escape(text) for c in chat.CONTROL)


def test_template_that_rewrites_history_is_found():
    def render(turns):
        return "".join(f"[{r}]{t if k == len(turns) - 1 else t.strip()}" for k, (r, t) in enumerate(turns)) + "<eos>"

    output, found, rewrites = chat.spans([("user", " a "), ("assistant", "b"), ("user", "c")], render)
    assert rewrites == [0, 1, 2]
    assert output[found[2][2]:found[2][3]] == "c"


def test_conversations(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (None, 0, None, None), (-8, None, "assistant", "x"), (-8, 1, "assistant", "y"), (-8, 1, "assistant", "y")]
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    df = df.union(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    groups = {}
    for r in sorted(df.collect(), key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or "")):
        groups.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    found = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert set(found) == set(groups)
    for conv_id, turns in groups.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        told = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert tuple(found[conv_id])[1:5] == (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
