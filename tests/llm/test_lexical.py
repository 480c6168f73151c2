from __future__ import annotations

import collections
import math
import re

import numpy as np
import pytest
from cases import empty, odd

from sillage.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k=10):
    held = [(i, w) for i, t in docs if (w := terms(t))]
    n_docs, n_terms = len(held), sum(len(w) for _, w in held)
    df = collections.Counter(t for _, w in held for t in set(w))
    asked = collections.defaultdict(set)
    for item, text in items:
        asked[item].update(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, w in held:
            tf, m = collections.Counter(w), 100 - 90 + 90 * len(w) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in wanted if tf[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def pairs(df):
    return [tuple(r) for r in df.collect()]


def test_whole_tables(shipped, docs, texts, sf_dir):
    items = shipped.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert found(lexical.search(docs, items)) == brute(texts.items(), pairs(items.select("item_id", "text")))


@pytest.mark.parametrize("block_terms", [1, 60])
def test_items_in_blocks(shipped, docs, texts, block_terms, sf_dir):
    items = shipped.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id < 4")
    want = brute(texts.items(), pairs(items.select("item_id", "text")), 3)
    assert found(lexical.search(docs, items, k=3, block_terms=block_terms)) == want


def test_odd_rows(shipped):
    docs = odd(shipped)
    items = shipped.createDataFrame(
        [(1, "ONE two three", "x", 1), (1, "two another", "x", 1), (1, "two another", "x", 1), (None, "a b c", "x", 1), (None, "text", "x", 1), (3, None, "x", 1), (4, " \n", "x", 1), (5, "nowhere", "x", 1), (6, "word1 é İΣ", "x", 1)],
        "item_id long, text string, _row string, _block int",
    )
    want = brute(pairs(docs.select("doc_id", "text")), pairs(items.select("item_id", "text")))
    assert found(lexical.search(docs, items)) == want
    assert {r[0] for r in want} == {1, None, 6}


def test_many_equal_scores(shipped):
    docs = shipped.createDataFrame([(i, "same words here") for i in range(500, 0, -1)] + [(None, "same words here")], "doc_id long, text string").repartition(7)
    items = shipped.createDataFrame([("a", "same"), ("b", "words here")], "item_id string, text string")
    got = found(lexical.search(docs.union(shipped.createDataFrame([(1000, "other")], docs.schema)), items))
    assert sorted(r[:3] for r in got) == [(item, i, i) for item in "ab" for i in range(1, 11)]


def test_empty_tables(shipped, docs, sf_dir):
    items = shipped.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert found(lexical.search(empty(shipped), items)) == []
    assert lexical.search(docs, items.limit(0)).dtypes == lexical.search(docs, items).dtypes
    assert found(lexical.search(docs, items.limit(0))) == []


def test_graph_keeps_sets_and_saves_sums():
    rng = np.random.default_rng(3)
    base = [rng.choice(2000, 12, replace=False) for _ in range(6)]
    sets = [np.unique(np.concatenate((base[rng.integers(6)], base[rng.integers(6)], rng.choice(2000, 4)))).astype(np.uint64) for _ in range(60)]
    graph = lexical.mine(np.arange(60), sets)
    parts = [[int(t)] for t in graph.terms]
    for a, b in zip(graph.left, graph.right):
        assert not set(parts[a]) & set(parts[b])
        parts.append(parts[a] + parts[b])
    at = np.cumsum(graph.sizes) - graph.sizes
    for s, a, n in zip(sets, at, graph.sizes):
        assert sorted(t for node in graph.tops[a : a + n] for t in parts[node]) == s.tolist()
    assert len(graph.left) + (graph.sizes - 1).sum() < 0.5 * sum(len(s) - 1 for s in sets)
    made = set(range(len(graph.terms)))
    for step in graph.levels():
        assert {*graph.left[step].tolist(), *graph.right[step].tolist()} <= made
        made |= set((len(graph.terms) + step).tolist())
    assert len(made) == graph.nodes
