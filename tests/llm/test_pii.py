"""Personal data against the plain patterns, and behind disguises."""

import hashlib
import random
import re

import pytest
from verisift.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checks(kind, found):
    digits = re.sub(r"[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        total = sum(d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for k, d in enumerate(map(int, reversed(digits))))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def slow(text):
    found = [(m.start(), m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, text) if checks(k, m.group())]
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_random_texts_match_the_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("ab.@@-+1234567890. ()") for _ in range(rng.randint(0, 60)))
        assert pii.detect(text) == slow(text)


def test_documents(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    found = pii.scan(docs).collect()
    assert len(found) == len(texts)
    for r in found:
        base = slow(texts[r["doc_id"]])
        assert [r["n_" + k] for k in pii.KINDS] == [sum(s[2] == k for s in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(pii.joined(base).split(",")) <= set(r["spans"].split(","))


@pytest.mark.parametrize(("text", "hidden", "kind"), [
    ("mail john dot doe at example dot com now", "john dot doe at example dot com", "email"),
    ("write to john (at) example [dot] org.", "john (at) example [dot] org", "email"),
    ("it is jоhn@exаmple.com there", "jоhn@exаmple.com", "email"),
    ("jo​hn@exam​ple.com", "jo​hn@exam​ple.com", "email"),
    ("call plus four nine one five one two three four five six", "plus four nine one five one two three four five six", "phone"),
    ("at one nine two dot one six eight dot zero dot one ok", "one nine two dot one six eight dot zero dot one", "ip"),
    ("card ４１１１ １１１１ １１１１ １１１１", "４１１１ １１１１ １１１１ １１１１", "card"),
])
def test_disguises_map_back(text, hidden, kind):
    base, every = pii.find(text)
    assert base == [] and [(text[a:b], k) for a, b, k in every] == [(hidden, kind)]


@pytest.mark.parametrize("text", ["look at the dot on it", "meet at 5.30 pm", "visit us at example.com", "one two buckle my shoe", "", "at dot"])
def test_prose_is_left_alone(text):
    assert pii.find(text) == ([], [])


@pytest.mark.parametrize(("text", "cut", "whole", "kind"), [
    ("it is jоhn.doe@example.com there", "hn.doe@example.com", "jоhn.doe@example.com", "email"),
    ("it is john@mail.exаmple.com there", "john@mail.ex", "john@mail.exаmple.com", "email"),
    ("it is john dot doe@example.com there", "doe@example.com", "john dot doe@example.com", "email"),
    ("it is john underscore doe@example.com there", "doe@example.com", "john underscore doe@example.com", "email"),
    ("it is john plus tag@example.com there", "tag@example.com", "john plus tag@example.com", "email"),
    ("it is jоhn dot doe@example.com there", "doe@example.com", "jоhn dot doe@example.com", "email"),
])
def test_partly_disguised_spans_stay_beside_base_spans(text, cut, whole, kind):
    base, every = pii.find(text)
    assert [(text[a:b], k) for a, b, k in base] == [(cut, kind)]
    assert set(base) <= set(every) and {(text[a:b], k) for a, b, k in every} == {(cut, kind), (whole, kind)}


def test_plus_before_a_number():
    text = "visit us at example.com or call plus 49 30 1234567 now"
    base, every = pii.find(text)
    assert base == [] and [(text[a:b], k) for a, b, k in every] == [("plus 49 30 1234567", "phone")]


@pytest.mark.parametrize("text", ["c'est plus grand", "two plus two at five", "a dash of salt at home", "john@example.com", "+49 30 1234567"])
def test_nothing_is_added_without_a_disguise(text):
    base, every = pii.find(text)
    assert base == every


def test_odd_rows(odd, no_docs):
    assert pii.scan(odd).count() == odd.count()
    assert {r["spans"] for r in pii.scan(odd).collect()} == {""}
    assert pii.scan(no_docs).count() == 0


def test_long_texts_take_linear_time():
    assert pii.find("a" * 1_000_000 + "1" * 500_000 + "@" * 50_000 + "+1" * 50_000)[0] == []
