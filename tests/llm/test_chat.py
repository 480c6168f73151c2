from __future__ import annotations

import random
import re

import pytest

from sillage.llm import chat

SCHEMA = "tree long, id long, parent long, role string, text string, score double"
BITS = ["\\", "#", "##", "###", "</turn>", "</turn>\n", "<", "/", "\n", "### user: ", ": ", ":", " ", "\\n", "é", "\U0001f600", "x", "$1", "<\\/turn>"]


def odd_text(rng):
    return "".join(rng.choice(BITS) for _ in range(rng.randrange(12)))


def trees(rng, n):
    rows = []
    for tree in [*range(n), None]:
        size = rng.randrange(1, 14)
        for i in range(size):
            parent = None if i == 0 or rng.random() < 0.1 else 10 * rng.randrange(i) if rng.random() < 0.95 else 7777
            rows.append((tree, 10 * i, parent, rng.choice(["user", "assistant", "", None, "a: b", ":", "x\\"]), rng.choice([None, "", odd_text(rng)]), rng.choice([None, 0.5, 1.0, rng.random()])))
    return rows


def brute(rows, branches):
    out = {}
    for tree in {r[0] for r in rows}:
        held = {r[1]: r for r in rows if r[0] == tree}
        answered = {r[2] for r in held.values()}
        ranked = []
        for leaf in held.keys() - answered:
            path, at = [], leaf
            while at in held and at not in path:
                path.append(at)
                at = held[at][2]
            if at not in path:
                scores = [held[i][5] or 0.0 for i in path]
                ranked.append((-sum(scores) / len(path), leaf, path[::-1]))
        ranked.sort()
        close = any(abs(a[0] - b[0]) < 1e-9 and a[0] != b[0] for a, b in zip(ranked, ranked[1:]))
        for rank, (_, leaf, path) in enumerate(ranked[:branches], 1):
            out[tree, rank if not close else None, leaf] = [(held[i][3] or "", held[i][4] or "") for i in path]
    return out


@pytest.mark.parametrize("branches", [1, 2, None])
def test_paths_of_trees_and_the_way_back(shipped, branches):
    rows = trees(random.Random(branches or 9), 60)
    found = chat.conversations(shipped.createDataFrame(rows, SCHEMA).repartition(5), branches)
    read = found.select("tree", "branch", "leaf", "formatted", "loss", chat.turns_of(found["formatted"]).alias("turns"), chat.masked(found["formatted"], found["loss"]).alias("learned")).collect()
    want = brute(rows, branches)
    got = {(r["tree"], r["branch"] if (r["tree"], r["branch"], r["leaf"]) in want else None, r["leaf"]): [tuple(t) for t in r["turns"]] for r in read}
    assert got == want
    for r in read:
        assert list(r["learned"]) == [t for role, t in map(tuple, r["turns"]) if role == "assistant"]
        assert r["formatted"].count(chat.END) == r["formatted"].count("</turn>") == len(r["turns"])
        assert len(re.findall("###", r["formatted"])) == len(r["turns"])
        assert all(a["end"] < b["start"] for a, b in zip(r["loss"], r["loss"][1:]))


def test_circles_orphans_and_repeated_shapes(shipped):
    rows = [(1, 1, 2, "u", "a", 0.0), (1, 2, 1, "u", "b", 0.0), (1, 3, 2, "u", "hangs on the circle", 0.0), (1, 4, None, "u", "root", 0.0), (2, 1, 1, "u", "answers itself", 0.0), (3, 1, 99, "u", "orphan", 0.0)]
    found = chat.paths(shipped.createDataFrame(rows, SCHEMA), None)
    assert sorted(map(tuple, found.select("tree", "leaf", "at", "id", "n").collect())) == [(1, 4, 0, 4, 1), (3, 1, 0, 1, 1)]


def test_long_conversations(shipped):
    rows = [(c, t, "user" if t % 2 else "assistant", f"turn {t} of {c} é") for c, n in ((1, 700), (2, 1), (3, 129)) for t in range(n)]
    found = chat.conversations(chat.linear(shipped.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)))
    for r in found.select("tree", chat.turns_of(found["formatted"]).alias("t"), chat.masked(found["formatted"], found["loss"]).alias("m")).collect():
        want = [(role, text) for c, _, role, text in rows if c == r["tree"]]
        assert [tuple(t) for t in r["t"]] == want and list(r["m"]) == [t for role, t in want if role == "assistant"]


def test_odd_rows(shipped):
    rows = [(1, None, "user", "first"), (1, 2, "assistant", None), (1, 1, None, "x" * 300_000), (1, 1, None, "x" * 300_000), (None, 5, "assistant", ""), (None, 1, "user", "a"), (4, None, None, None)]
    df = shipped.createDataFrame([(*r, "z", 1.0, 2) for r in rows], "conv_id long, turn long, role string, text string, tree string, score double, _at int")
    found = chat.conversations(chat.linear(df))
    got = {r["tree"]: [tuple(t) for t in r["t"]] for r in found.select("tree", chat.turns_of(found["formatted"]).alias("t")).collect()}
    assert got == {1: [("user", "first"), ("", "x" * 300_000), ("", "x" * 300_000), ("assistant", "")], None: [("user", "a"), ("assistant", "")], 4: [("", "")]}
    assert chat.conversations(chat.linear(df.limit(0))).count() == 0


def test_plan_is_native(shipped, sf_dir):
    from sillage.llm.catalog import QUERIES

    plan = QUERIES["op12_chat_format"](shipped, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD|NestedLoop|Cartesian", plan)
