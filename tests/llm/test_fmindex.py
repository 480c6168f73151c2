from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from cases import empty, odd

from sillage.llm import fmindex

_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_ASCII))


def brute(rows, items):
    windows = {}
    for name, text in items:
        own = words(text)
        for i in range(max(1, len(own) - 12) if own else 0):
            windows.setdefault(tuple(own[i : i + 13]), set()).add(name)
    out = []
    for i, text in rows:
        own, hit, found = words(text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(own) - n + 1):
                names = windows.get(tuple(own[k : k + n]))
                if names:
                    hit.update(range(k, k + n))
                    found |= names
        names = sorted(str(f) for f in found if f is not None)
        sha = hashlib.sha256(",".join(names).encode()).hexdigest()
        out.append((i, len(own), len(hit), len(names), sha, len(hit) > 0 and 20 * len(hit) >= len(own)))
    return sorted(out, key=repr)


def result(docs, benchmark):
    found = fmindex.judge(fmindex.occurrences(docs, benchmark))
    return sorted((tuple(r) for r in found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)


@pytest.fixture
def benchmark(shipped, sf_dir):
    return shipped.read.parquet(f"{sf_dir}/benchmark.parquet")


def test_suffix_order_and_ranks():
    rng = np.random.default_rng(0)
    for size in (1, 2, 50, 400):
        t = np.append(rng.integers(1, 4, size), 0)
        t[: size // 2] = t[size // 2 : size // 2 * 2]
        order = fmindex.suffix_order(t, 2)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        index = fmindex.FmIndex(t, 2, sample=4)
        last = t[order - 1]
        for symbol in range(4):
            at = np.arange(len(t) + 1)
            assert index.rank(np.full(len(at), symbol), at).tolist() == [int((last[:i] == symbol).sum()) for i in at]
        assert index.locate(np.arange(len(t))).tolist() == order.tolist()


def test_whole_table(docs, texts, benchmark):
    items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    assert result(docs, benchmark) == brute(texts.items(), items)


def test_blocks_of_a_large_benchmark(docs, texts, benchmark, monkeypatch):
    monkeypatch.setattr(fmindex, "QUERY_WORDS", 500)
    monkeypatch.setattr(fmindex, "PIECE_WORDS", 7)
    items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    assert result(docs, benchmark) == brute(texts.items(), items)


def test_odd_rows_and_items(shipped):
    df = odd(shipped)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    items = [(1, "one two"), (2, "One, two!"), (2, "a"), (3, None), (4, "..."), (None, "x here"), (5, " ".join(f"word{i}  of{i}" for i in range(15, 40))), (10, "another text here"), (10, "another text here")]
    benchmark = shipped.createDataFrame(items, "item_id long, text string")
    assert result(df, benchmark) == brute(rows, items)
    assert result(empty(shipped), benchmark) == []
    none = shipped.createDataFrame([], "item_id long, text string")
    assert result(df, none) == brute(rows, [])


def test_spans_are_merged():
    starts, ends, owner = fmindex._merge(np.array([5, 0, 3, 0]), np.array([9, 4, 6, 2]), np.array([0, 0, 0, 1]))
    assert (starts.tolist(), ends.tolist(), owner.tolist()) == ([0, 0], [9, 2], [0, 1])


def test_repeated_items_take_one_pass_and_blocks_keep_their_bound(shipped, monkeypatch):
    monkeypatch.setattr(fmindex, "QUERY_WORDS", 500)
    sent = []
    made = fmindex.phrases
    monkeypatch.setattr(fmindex, "phrases", lambda names, words, window: sent.append(sum(map(len, words))) or made(names, words, window))
    text = " ".join(f"w{i}" for i in range(200))
    docs = shipped.createDataFrame([(1, text), (2, "x " + text[:100])], "doc_id long, text string")
    again = shipped.createDataFrame([(1, text)] * 50, "item_id long, text string").repartition(5)
    assert fmindex.judge(fmindex.occurrences(docs, again)).where("n_items = 1").count() == 2
    assert sent == [200]
    sent.clear()
    own = shipped.createDataFrame([(i, f"i{i} " + text) for i in range(50)], "item_id long, text string").repartition(5)
    rows = fmindex.judge(fmindex.occurrences(docs, own)).select("doc_id", "n_items").collect()
    assert sorted(map(tuple, rows)) == [(1, 50), (2, 50)]
    assert sum(sent) == 50 * 201 and max(sent) <= 500 + 201
