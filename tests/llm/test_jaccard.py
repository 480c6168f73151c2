from __future__ import annotations

import collections
import random
import re

import numpy as np
from cases import empty, odd

from sillage.llm import jaccard

_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(rows):
    out = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_ASCII))
        out.append(frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else []))
    return out


def brute(rows):
    """(id, set size, smallest reachable id) of every row, all pairs compared."""
    sets, holders, parent = sets_of(rows), collections.defaultdict(list), list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        shared = collections.Counter(j for x in s for j in holders[x])
        for j, n in shared.items():
            if 100 * n >= 90 * (len(s) + len(sets[j]) - n):
                parent[max(top(i), top(j))] = min(top(i), top(j))
        for x in s:
            holders[x].append(i)
    members = collections.defaultdict(list)
    for i in range(len(rows)):
        members[top(i)].append(rows[i][0])
    least = {t: min((m for m in ids if m is not None), default=None) for t, ids in members.items()}
    return sorted(((rows[i][0], len(sets[i]), least[top(i)] if sets[i] else rows[i][0]) for i in range(len(rows))), key=repr)


def result(df):
    found = jaccard.jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()
    return sorted((tuple(r) for r in found), key=repr)


def variants(seed):
    """Groups of near copies around the threshold, one of them large, with sets of many sizes."""
    rng = random.Random(seed)
    rows = []
    for size, copies in ((9, 6), (12, 8), (25, 10), (60, 300), (150, 60), (900, 12)):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size + 2)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + size // 25)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.4:
                text = text[: len(text) - rng.randrange(0, 1 + size // 8)]
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    return rows


def test_whole_table(docs, texts):
    assert result(docs) == brute(sorted(texts.items()))


def test_groups_at_the_threshold(shipped):
    rows = variants(1)
    assert result(shipped.createDataFrame(rows, "doc_id long, text string")) == brute(sorted(rows))


def test_large_groups_are_cut_into_blocks(shipped, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_BLOCK", 16)
    monkeypatch.setattr(jaccard, "STAR_BLOCK", 8)
    monkeypatch.setattr(jaccard, "GROUP_SHINGLES", 3000)
    rows = variants(2)
    assert result(shipped.createDataFrame(rows, "doc_id long, text string")) == brute(sorted(rows))


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(0)
    for _ in range(400):
        n = int(rng.integers(9, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        drop = int(rng.integers(0, 1 + n // 10))
        add = int(rng.integers(0, 1 + n // 10))
        b = np.unique(np.concatenate((a[rng.permutation(len(a))[drop:]], rng.integers(0, 2**63, add).astype(np.uint64))))
        shared = len(np.intersect1d(a, b))
        one, two = jaccard.signatures(np.concatenate((a, b)), np.array([len(a), len(b)]), 90, 100)
        if 100 * shared >= 90 * (len(a) + len(b) - shared) and len(a) + len(b) - 2 * shared:
            assert len(np.intersect1d(one, two))


def test_components_of_a_chain(shipped):
    rng = random.Random(3)
    ids = list(range(200))
    rng.shuffle(ids)
    edges = shipped.createDataFrame(list(zip(ids[:-1], ids[1:], strict=True)), "_a long, _b long")
    found = {r["_a"]: r["_label"] for r in jaccard.components(edges).collect()}
    assert found == {i: 0 for i in range(1, 200)}


def test_odd_rows(shipped):
    df = odd(shipped)
    assert result(df) == brute([(r["doc_id"], r["text"]) for r in df.collect()])
    assert result(empty(shipped)) == []


def test_one_of_each(shipped):
    df = odd(shipped)
    kept = jaccard.one_of_each_component(df)
    assert kept.columns == df.columns
    rows = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    worded = [t for _, t in rows if t and t.split()]
    sets = sets_of([(0, t) for t in worded])
    assert len(set(sets)) == len(sets)
    assert (5, "one two") in rows and (7, "ONE two") not in rows and (6, "one two") not in rows
    assert sum(t is None for _, t in rows) == 2
    assert jaccard.one_of_each_component(empty(shipped)).count() == 0
