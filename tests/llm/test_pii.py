from __future__ import annotations

import random
import re

import pytest
from cases import empty, odd

from sillage.llm import catalog, pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {
        "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in text.split(".")),
        "card": lambda: 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def brute(text):
    found = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if good(k, m[0])]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(4)
    for _ in range(20_000):
        text = "".join(rng.choice("aB9.@-+ 1234(é\n") for _ in range(rng.randrange(60)))
        base, spans = pii.find(text)
        assert base == brute(text) and set(base) <= set(spans)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("IBAN DE89 3704 0044 0532 0130 00.", "iban", "DE89 3704 0044 0532 0130 00"), ("SSN: 078-05-1120", "ssn", "078-05-1120"),
        ("Account no. 12345678", "account", "12345678"), ("joe.x [at] site [dot] com", "spelled_email", "joe.x [at] site [dot] com"),
        ("see https://user:pw@localhost/x", "login", "user:pw"),
    ],
)
def test_cues(text, kind, found):
    base, spans = pii.find(text)
    assert base == [] and [(k, text[a:b]) for k, a, b in spans] == [(kind, found)]


@pytest.mark.parametrize("text", ["IBAN DE89 3704 0044 0532 0130 01.", "on account of 12 cases", "a [at] b", "discount 12345678", "http://host/path"])
def test_no_false_cues(text):
    assert pii.find(text)[1] == []


def test_mask_covers_overlaps():
    text = "ip 4111.1.1.1 card 4111 1111 1111 1111 me@x.org"
    assert pii.mask(text, pii.find(text)[1]) == "ip 4111.1.1.1 card <CARD> <EMAIL>"


@pytest.mark.parametrize(
    ("text", "added", "masked"),
    [
        ("see https://user:pw@example.com/x", [("login", "user:pw")], "see https://<LOGIN>/x"),
        ("ftp://joe.x:s3cret@10.0.0.1/y", [("login", "joe.x:s3cret")], "ftp://<LOGIN>/y"),
        ("IBAN BE69 5390 0754 7016.", [("iban", "BE69 5390 0754 7016")], "IBAN <IBAN>."),
    ],
)
def test_cues_that_overlap_base_spans_stay(text, added, masked):
    base, spans = pii.find(text)
    assert base == brute(text) and base and set(base) <= set(spans)
    assert [(k, text[a:b]) for k, a, b in spans if k not in pii.BASE] == added
    assert pii.mask(text, spans) == masked


def test_whole_table(docs, texts):
    found = pii.spans_of(docs).collect()
    assert {r["doc_id"]: [tuple(s) for s in r["base"]] for r in found} == {i: brute(t) for i, t in texts.items()}


def test_query_digests(shipped, sf_dir, texts):
    import hashlib

    for r in catalog.QUERIES["op6_personal_data"](shipped, sf_dir).collect():
        base = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(b[0] == k for b in base) for k in pii.BASE]


def test_odd_rows(shipped):
    df = odd(shipped)
    found = pii.spans_of(df, masked=True, keep=["text", "_id", "score"])
    assert found.count() == df.count()
    for r in found.collect():
        assert [tuple(s) for s in r["base"]] == brute(r["text"])
        assert r["masked"] == r["text"] or r["spans"]
    assert pii.spans_of(empty(shipped), masked=True).count() == 0
