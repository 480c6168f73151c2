from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sillage.llm import trie
from sillage.llm.catalog import QUERIES

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = collections.defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children = collections.Counter(n[:-1] for n in members if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for n, held in members.items():
        worth = (len(held) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            saved[n[:d]] += worth
            leaves[n[:d]] += not children[n]
    out = []
    for n, held in members.items():
        ends = ",".join(str(c) for c in held if len(built[c]) == len(n))
        out.append((held[0], len(n), members[n[:-1]][0] if n else None, len(held), children[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    return sorted((tuple(r) for r in QUERIES["op13_prefix_trie"](spark, str(tmp_path)).select(*COLUMNS).collect()), key=repr)


def test_whole_table(shipped, sf_dir):
    rows = [tuple(r) for r in shipped.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op13_prefix_trie"](shipped, sf_dir).select(*COLUMNS).collect()), key=repr)
    assert got == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_turns_nulls_ties_and_missing_bases(shipped, tmp_path, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-60, 400), 260):
        for _ in range(rng.randrange(1, 6)):
            rows.append((c, rng.choice([None, 1, 1, 2, 3, 4]), rng.choice(["user", "assistant", None]), rng.choice([None, "", "a", "a b", "a b c\td"])))
    rows += [(None, 1, "user", "no conversation"), rows[0], rows[0]]
    assert found(shipped, rows, tmp_path) == brute(rows)


def test_long_copies_cross_segments(shipped, tmp_path):
    """Conversations that part after 0 to 600 equal turns, ends exactly at a segment's bound, copies of a whole conversation."""
    rows = [(c, t, "user", f"word {t}" if t < part else f"own {c} {t}") for c, (n, part) in enumerate([(600, 600), (600, 600), (600, 300), (256, 256), (257, 257), (512, 512), (513, 256), (700, 255), (3, 3)] * 2) for t in range(n)]
    assert found(shipped, rows, tmp_path) == brute(rows)


def test_many_children_and_many_copies(shipped, tmp_path):
    rows = [(c, t, "user", "hello there" if t == 0 else f"own {c % 2500}") for c in range(5000) for t in range(5)]
    assert found(shipped, rows, tmp_path) == brute(rows)


def test_more_ranges_than_tasks_that_read(shipped, tmp_path):
    """Ranges of very different sizes, so that their files are not read in the order of the ids."""
    rows = [(c, t, "user", "hello there" if t == 0 else f"own {c % 30} {t}") for c in range(100) for t in range(2 + c * c // 80)]
    rows += [(c, 1, "user", None) for c in range(0, 100, 7)]
    key, kept = "spark.sql.shuffle.partitions", shipped.conf.get("spark.sql.shuffle.partitions")
    shipped.conf.set(key, "16")
    try:
        assert found(shipped, rows, tmp_path) == brute(rows)
    finally:
        shipped.conf.set(key, kept)


def test_empty_and_clashing_columns(shipped, tmp_path):
    assert found(shipped, [], tmp_path / "a") == []
    rows = shipped.createDataFrame([(1, 0, "u", "x", "k", 3)], "conv_id long, turn long, role string, text string, at string, words int")
    convs, turns = trie.rebuilt(rows, F.lit(0), F.col("conv"))
    nodes = trie.prefix_trie(convs, turns).collect()
    assert sorted((r["depth"], r["n_convs"], r["ends"]) for r in nodes) == [(0, 1, ""), (1, 1, "1")]
