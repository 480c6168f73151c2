"""Prefix trie of conversations from vertical bitmaps (operator 13).

Conversations are rows of turns, cut into segments of ``SEGMENT`` positions and dealt to shards by ranges of their
ids. A shard indexes each (position, turn) by the bitset of its conversations that have that turn there. Depth
first, the bitset of a node is intersected with the postings of the next position: each result that is not empty
is a child, its popcount the members, and those that have no further turn are the node's end list. Shards work
apart from each other; their nodes are added up by a 128-bit key of the prefix, so no node is held whole by a task.

A node is named by its smallest member. The nodes named by one conversation are a chain, from where it is first
the smallest to its end; sums over a subtree are therefore sums over chains of members, which a second walk over the
bitmaps adds up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sillage.llm.chat import digest
from sillage.llm.dealing import numbered, partitions
from sillage.session import stage

SEGMENT = 256
#: turns of a shard, and so bounds its bitmaps; the shard's conversations are at most a batch of rows
SHARD_TURNS = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"
#: parents with more than this share of all nodes as children are joined apart; there are fewer than its inverse
_WIDE = 10_000
_SALTS = 16
_NODE = "k1 long, k2 long, p1 long, p2 long, depth long, conv_id long, n_convs long, words long, first_end long, ends string"


def rebuilt(turns: DataFrame, shared: Column, base: Column, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All conversations (``conv``), and their turns (conv, at, digest, words) where each begins with the first ``shared``
    turns of conversation ``base`` (expressions over ``conv``) and goes on with its own turns after its first ``shared``.

    Turns are ordered by ``turn``, null first; turns that tie, by their digest. Null roles and texts are empty, rows
    without conversation are left out. Of a base that is absent or shorter, what there is is taken.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("_turn"), digest(role, text).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    own = stage(numbered(rows, "conv", [F.col("_turn").asc_nulls_first(), F.col("digest").asc()], "turns").drop("_turn").withColumnRenamed("_at", "at"), "own")
    sizes = own.groupBy("conv").agg(F.count("*").alias("_n"))
    named = sizes.select("conv", shared.cast("long").alias("_h"), base.cast("long").alias("_base"))
    bases = sizes.select(F.col("conv").alias("_base"), F.col("_n").alias("_n_base"))
    taken = F.least(F.col("_h"), F.coalesce(F.col("_n_base"), F.lit(0)))
    convs = stage(named.join(bases, "_base", "left").select("conv", "_h", "_base", taken.alias("_taken")), "convs")
    rest = own.join(convs, "conv").where(F.col("at") >= F.col("_h")).select("conv", (F.col("at") - F.col("_h") + F.col("_taken")).alias("at"), "digest", "words")
    # the places taken from a base are listed, so that a long base meets its takers only at these
    wanted = convs.where("_taken > 0").select(F.col("conv").alias("_to"), F.col("_base").alias("conv"), F.explode(F.sequence(F.lit(0), F.col("_taken") - 1)).alias("at"))
    begun = own.join(wanted, ["conv", "at"]).select(F.col("_to").alias("conv"), "at", "digest", "words")
    return convs.select("conv"), begun.union(rest)


def _segments(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """A row per conversation and segment: keys of its turns (two numbers each, position included), their words, the key
    of all before the segment, and whether it ends here. A conversation without turns has one empty segment."""
    mark = [F.xxhash64(F.lit(seed), F.col("at"), F.col("digest")) for seed in (1, 2)]
    rows = turns.select("conv", F.floor(F.col("at") / SEGMENT).alias("segment"), F.struct("at", mark[0].alias("z1"), mark[1].alias("z2"), "words").alias("t"))
    held = rows.groupBy("conv", "segment").agg(F.array_sort(F.collect_list("t")).alias("t"), F.bit_xor(F.col("t.z1")).alias("x1"), F.bit_xor(F.col("t.z2")).alias("x2"))
    none = convs.join(held.select("conv"), "conv", "left_anti")
    none = none.select("conv", F.lit(0).cast("long"), F.array().cast(held.schema["t"].dataType), F.lit(0).cast("long"), F.lit(0).cast("long"))
    along = Window.partitionBy("conv").orderBy("segment")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    return held.union(none).select(
        "segment", "conv", *(F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(s) for x, s in (("x1", "s1"), ("x2", "s2"))),
        F.lead("segment").over(along).isNull().alias("last"), *(F.col(f"t.{c}").alias(c) for c in ("z1", "z2", "words")),
    )


class Shard:
    """Vertical bitmaps of the segments [a, b) of a batch; bit i stands for the conversation of row a + i."""

    def __init__(self, batch: pa.RecordBatch, a: int, b: int):
        column = {n: batch.column(n) for n in batch.schema.names}
        at, ends = column["z1"].offsets.to_numpy()[a : b + 1], column["last"].slice(a, b - a).to_pylist()
        low, high = int(at[0]), int(at[-1])
        z1, z2, words = (column[c].values.to_numpy(zero_copy_only=False)[low:high].tolist() for c in ("z1", "z2", "words"))
        at = (at - low).tolist()
        self.convs = column["conv"].slice(a, b - a).to_pylist()
        self.turns = [list(zip(z1[i:j], z2[i:j], words[i:j])) for i, j in zip(at[:-1], at[1:])]
        self.first = column["segment"][a].as_py() * SEGMENT
        starts: dict[tuple[int, int], int] = {}
        self.ends: dict[int, int] = {}
        self.postings: dict[tuple[int, int], int] = {}
        for i, (key, turns) in enumerate(zip(zip(column["s1"].slice(a, b - a).to_pylist(), column["s2"].slice(a, b - a).to_pylist()), self.turns)):
            starts[key] = starts.get(key, 0) | 1 << i
            for x, y, _ in turns:
                self.postings[x, y] = self.postings.get((x, y), 0) | 1 << i
            if ends[i]:
                self.ends[len(turns)] = self.ends.get(len(turns), 0) | 1 << i
        self.starts = starts

    def walk(self) -> Iterator[tuple[tuple[int, int], tuple[int, int] | None, int, int, int]]:
        """Key, parent's key, depth within the segment, bitset and words of every node below the segment's start, and of the root."""
        stack = [(key, None, 0, members, 0) for key, members in self.starts.items()]
        while stack:
            node = stack.pop()
            key, _, depth, members, _ = node
            if depth or not self.first:
                yield node
            rest = members & ~self.ends.get(depth, 0)
            while rest:
                turns = self.turns[(rest & -rest).bit_length() - 1]
                if depth == len(turns):  # goes on in the next segment
                    rest &= rest - 1
                    continue
                x, y, words = turns[depth]
                child = members & self.postings[x, y]
                stack.append(((key[0] ^ x, key[1] ^ y), key, depth + 1, child, words))
                rest &= ~child


def _bits(members: int) -> Iterator[int]:
    while members:
        low = members & -members
        yield low.bit_length() - 1
        members ^= low


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int]]:
    """Runs of rows of one segment with ``SHARD_TURNS`` turns and one row more at most."""
    for batch in batches:
        at, segment = batch.column("z1").offsets.to_numpy(), batch.column("segment").to_numpy()
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(at, at[a] + SHARD_TURNS, "right")) - 1)
            b = min(b, a + int(np.searchsorted(segment[a:], segment[a], "right")))
            yield batch, a, b
            a = b


def _in_order(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """Segments dealt to tasks by ranges of (segment, conv), ascending in each."""
    return segments.repartitionByRange(partitions(turns), "segment", "conv").sortWithinPartitions("segment", "conv")


def _nodes_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, a, b in _shards(batches):
        shard, out = Shard(batch, a, b), []
        for key, parent, depth, members, words in shard.walk():
            ended = [shard.convs[i] for i in _bits(members & shard.ends.get(depth, 0))]
            least = shard.convs[(members & -members).bit_length() - 1]
            out.append((*key, *(parent or (None, None)), shard.first + depth, least, members.bit_count(), words, ended[0] if ended else None, ",".join(map(str, ended)) if ended else None))
        kinds = [pa.int64()] * 9 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds], [c.split()[0] for c in _NODE.split(", ")])


def _sums_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every node the sums of its members' ``saved`` and ``leaf``."""
    for batch, a, b in _shards(batches):
        shard, out = Shard(batch, a, b), []
        saved, leaf = (batch.column(c).slice(a, b - a).to_pylist() for c in ("saved", "leaf"))
        weighty, leafy = (sum(1 << i for i, x in enumerate(v) if x) for v in (saved, leaf))
        for key, _, _, members, _ in shard.walk():
            if members & (weighty | leafy):
                out.append((*key, sum(saved[i] for i in _bits(members & weighty)), (members & leafy).bit_count()))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], ["k1", "k2", "saved", "leaves"])


def _by_parent(heads: DataFrame, nodes: DataFrame) -> DataFrame:
    """Conversation that names the parent of each head. Parents of many nodes, fewer than ``_WIDE``, are sent to all tasks."""
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    limit = nodes.count() // _WIDE
    wide = F.broadcast(parents.where(F.col("n_children") > max(1000, limit)).drop("n_children"))
    few = parents.where(F.col("n_children") <= max(1000, limit)).drop("n_children")
    key = ["p1", "p2"]
    return heads.join(wide, key).unionByName(heads.join(wide, key, "left_anti").join(few, key, "left")).select("k1", "k2", "parent_conv_id")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per distinct sequence of first turns, the empty one (root) included: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends (string: members that end here, ascending, by commas).

    ``convs`` (conv) lists the members, each once; ``turns`` has conv, at (0, 1, ... of a conversation, each once), digest and
    words. Members without turns end at the root. Without members there is no node.
    """
    segments = stage(_segments(convs, turns), "segments")
    # dealt after the stage: files read back come in any sequence, and a shard's conversations must ascend
    parts = _in_order(segments, turns).mapInArrow(_nodes_task, _NODE)
    # nodes that most shards have are added up in two steps
    ends = F.collect_list(F.when(F.col("first_end").isNotNull(), F.struct("first_end", "ends")))
    same = [F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("words").alias("words")]
    some = parts.groupBy("k1", "k2", (F.spark_partition_id() % _SALTS).alias("salt")).agg(*same, ends.alias("ended"))
    ended = F.array_sort(F.flatten(F.collect_list("ended")))
    merged = some.groupBy("k1", "k2").agg(*same, F.array_join(F.transform(ended, lambda e: e["ends"]), ",").alias("ends"))
    merged = stage(merged, "nodes")
    children = merged.where("p1 IS NOT NULL").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = stage(merged.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")

    # the chain of a conversation: what lies below each of its nodes on the chain, and on the whole of it
    value = (F.col("n_convs") - 1) * F.col("words")
    piece = F.floor(F.col("depth") / SEGMENT)
    chains = nodes.select("conv_id", "depth", "n_children", value.alias("v"), piece.alias("piece"))
    pieces = chains.groupBy("conv_id", "piece").agg(F.sum("v").alias("v"), F.min("depth").alias("head"), F.max_by(F.col("n_children") == 0, "depth").alias("leaf"))
    later = Window.partitionBy("conv_id").orderBy(F.col("piece").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    pieces = pieces.select(
        "conv_id", "piece", F.coalesce(F.sum("v").over(later), F.lit(0)).alias("later"), F.sum("v").over(whole).alias("saved"),
        F.min("head").over(whole).alias("head"), F.max_by("leaf", "piece").over(whole).cast("long").alias("leaf"),
    )
    pieces = stage(pieces, "chains")
    of = pieces.groupBy(F.col("conv_id").alias("conv")).agg(F.first("saved").alias("saved"), F.first("leaf").alias("leaf"))

    weighed = _in_order(segments.join(of, "conv", "left").na.fill(0, ["saved", "leaf"]), turns)
    sums = weighed.mapInArrow(_sums_task, "k1 long, k2 long, saved long, leaves long").groupBy("k1", "k2").agg(F.sum("saved").alias("_saved"), F.sum("leaves").alias("n_leaves"))

    below = Window.partitionBy("conv_id", "piece").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    placed = nodes.withColumn("piece", piece).withColumn("_below", F.sum(value).over(below)).join(pieces, ["conv_id", "piece"])
    placed = placed.join(sums, ["k1", "k2"], "left").na.fill(0, ["_saved", "n_leaves"])
    heads = placed.where("depth = head").select("k1", "k2", "p1", "p2")
    found = placed.join(_by_parent(heads, nodes), ["k1", "k2"], "left")
    parent = F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == F.col("head"), F.col("parent_conv_id")).otherwise(F.col("conv_id"))
    saved = F.col("_saved") - F.col("saved") + F.col("_below") + F.col("later")
    return found.select("conv_id", "depth", parent.cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"), "ends")
