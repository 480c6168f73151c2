"""N-gram Jaccard join by PartEnum signatures (operator 1).

Two texts link when their sets of distinct n-word shingles overlap in at least ``num / den`` of their
union. Equal sets are one *class* and are never compared. Classes are put into bands by set size, such
that linked sets lie in the same band or in neighbours, and within the reach of a band a link bounds
the number k of elements that are in one set only. The domain of shingle hashes is cut into n1 ranges,
of which one holds at most k2 = k / n1 of the differing elements, and each range into n2 parts; the two
sets agree on some n2 - k2 of these parts. The signatures of a set are its projections on all such
choices, so linked sets share one for certain. An empty projection says little and many unrelated
sets have it: it is replaced by its pairs with all signatures of a second, independent partition.

Classes that share a signature meet below the smallest class of that signature, their root. Each member
is held against its root; in groups where some member is not linked with the root, members are held
against each other in pairs of blocks, and only a spanning forest of the links found leaves a task.
Components come from rounds of label passing. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sillage.llm.text import (
    PLAIN,
    Block,
    blocks,
    mix,
    ngram_hashes,
    prefix_sums,
    range_hashes,
    word_hashes,
)
from sillage.session import stage, unstage

#: members and shingles that a block of a group holds on average
GROUP_BLOCK, GROUP_SHINGLES = 256, 1 << 20
#: members that are compared with a copy of their root in one place, and dealt on from there
STAR_BLOCK = 512


def shingle_sets(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after the other, and the set sizes.

    A text of fewer than n words, but not none, is one shingle.
    """
    words, firsts = word_hashes(block, PLAIN)
    grams = ngram_hashes(words, n)
    counts = np.diff(firsts)
    sets = []
    for at, count in zip(firsts[:-1].tolist(), counts.tolist(), strict=True):
        if count >= n:
            own = np.sort(grams[at : at + count - n + 1])
            sets.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif count:
            sets.append(range_hashes(words, np.array([at]), np.array([at + count])))
        else:
            sets.append(words[:0])
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else words[:0]), sizes


def bands(largest: int, num: int, den: int) -> np.ndarray:
    """Lower ends of the size bands up to ``largest``; a band ends at the size its lower end may link with."""
    ends = [1]
    while ends[-1] <= largest:
        ends.append(ends[-1] * den // num + 1)
    return np.array(ends, np.int64)


@lru_cache(maxsize=100_000)
def scheme(differing: int) -> tuple[int, int, tuple[tuple[int, ...], ...]]:
    """n1, n2 and the choices of parts for sets that differ in at most so many elements."""
    k2 = 2 if differing == 2 else 1
    n1 = differing // (k2 + 1) + 1
    n2 = 4 if k2 == 2 else 3 if differing < 8 else 2
    return n1, n2, tuple(itertools.combinations(range(n2), n2 - k2))


def _projections(h: np.ndarray, sizes: np.ndarray, plan: list, seed: int, only: np.ndarray):
    """Signature hashes, their set and whether the projection is empty, for the sets ``only`` (ascending).

    ``h`` holds all sets in one array, each ascending; ``plan`` gives for each of ``only`` its instance
    and scheme. With the first seed parts are ranges of the hash itself, so they are contiguous.
    """
    ends = np.cumsum(sizes)
    picked = np.concatenate([np.arange(ends[i] - sizes[i], ends[i]) for i in only]) if len(only) else np.zeros(0, np.int64)
    own = h[picked]
    place = mix(own ^ np.uint64(seed)) if seed else own
    cuts = np.array([n1 * n2 for _, (n1, n2, _) in plan], np.int64)
    begin = np.concatenate(([0], np.cumsum(cuts)))
    owner = np.repeat(np.arange(len(only)), sizes[only])
    part = ((place >> np.uint64(32)) * cuts[owner].astype(np.uint64)) >> np.uint64(32)
    part = begin[owner] + part.astype(np.int64)
    value = mix(own ^ np.uint64(0xA0761D6478BD642F))
    if seed:
        order = np.argsort(part, kind="stable")
        part, value = part[order], value[order]
    counts = np.bincount(part, minlength=begin[-1])
    edges = np.concatenate(([0], np.cumsum(counts)))
    sums = prefix_sums(value)
    part_sum, part_count = sums[edges[1:]] - sums[edges[:-1]], counts
    for shape in sorted({s for _, s in plan}, key=lambda s: (s[0], s[1])):
        n1, n2, choices = shape
        which = np.array([i for i, (_, s) in enumerate(plan) if s == shape])
        cells = (begin[which][:, None] + np.arange(n1 * n2)).reshape(len(which), n1, n2)
        sig, filled = [], []
        for number, choice in enumerate(choices):
            total = part_sum[cells[:, :, choice]].sum(axis=2, dtype=np.uint64)
            filled.append(part_count[cells[:, :, choice]].sum(axis=2) > 0)
            tag = np.arange(n1, dtype=np.uint64) * np.uint64(64) + np.uint64(number)
            band = np.array([plan[i][0] for i in which], np.uint64)
            where = mix(mix(band + np.uint64(seed))[:, None] + tag[None, :])
            sig.append(mix(total ^ where))
        yield which, np.concatenate(sig, axis=1), np.concatenate(filled, axis=1)


def signatures(h: np.ndarray, sizes: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """The PartEnum signatures of each set; none for sets that can only link with equal ones."""
    ends = bands(int(sizes.max(initial=1)) * den // num + 1, num, den)
    out: list[list[np.ndarray]] = [[] for _ in sizes]
    band = np.searchsorted(ends, sizes, "right") - 1
    reach = np.append(ends[1:] - 1, 0)
    for shift in (0, 1):
        instance = band + shift
        differing = 2 * reach[np.minimum(instance, len(ends) - 2)] * (den - num) // (den + num)
        only = np.flatnonzero((sizes > 0) & (differing > 0))
        plan = [(int(instance[i]), scheme(int(differing[i]))) for i in only]
        if not len(only):
            continue
        empties: dict[int, np.ndarray] = {}
        for which, sig, filled in _projections(h, sizes, plan, 0, only):
            for row, at in enumerate(which):
                out[only[at]].append(sig[row][filled[row]])
                if not filled[row].all():
                    empties[int(at)] = sig[row][~filled[row]]
        if empties:
            again = np.array(sorted(empties))
            second = _projections(h, sizes, [plan[i] for i in again], 0x5851F42D4C957F2D, only[again])
            for which, sig, _ in second:
                for row, at in enumerate(which):
                    first = empties[int(again[at])]
                    out[only[again[at]]].append(mix(first[:, None] ^ mix(sig[row])[None, :]).ravel())
    return [np.unique(np.concatenate(s)) if s else np.zeros(0, np.uint64) for s in out]


def _list_column(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    values = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _describe(n: int, num: int, den: int):
    """Per text: set size, a 128-bit fingerprint of the set, and the signatures."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                h, sizes = shingle_sets(block, n)
                ends = np.cumsum(sizes)
                raw = h.tobytes()
                prints = [hashlib.md5(raw[8 * (e - s) : 8 * e]).digest() for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
                halves = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
                a, b = block.rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(sizes),
                     pa.array(halves[:, 0]), pa.array(halves[:, 1]), _list_column(signatures(h, sizes, num, den))],
                    ["_id", "_text_hash", "_n", "_p1", "_p2", "_sigs"],
                )

    return task


def _sets(n: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                h, sizes = shingle_sets(block, n)
                ends = np.concatenate(([0], np.cumsum(sizes)))
                a, b = block.rows
                parts = [h[ends[i] : ends[i + 1]] for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _list_column(parts)], ["_c", "_set"])

    return task


def _array(column: pa.Array, row: int) -> np.ndarray:
    at = column.offsets
    return column.values.to_numpy(zero_copy_only=False)[at[row].as_py() : at[row + 1].as_py()].view(np.uint64)


def _overlaps(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if len(a) * den < len(b) * num or len(b) * den < len(a) * num:
        return False
    both = np.sort(np.concatenate((a, b)))
    shared = int((both[1:] == both[:-1]).sum())
    return den * shared >= num * (len(a) + len(b) - shared)


def _star(num: int, den: int):
    """Rows sorted by group and with the root first: whether each member links with the root."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, own = None, None
        for batch in batches:
            roots, members = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for row, (r, m) in enumerate(zip(roots, members, strict=True)):
                if r == m:
                    root, own = r, _array(batch.column(3), row).copy()
                elif r == root:
                    other = _array(batch.column(3), row)
                    out.append((r, m, batch.column(2)[row].as_py(), _overlaps(own, other, num, den), len(other)))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["_a", "_b", "_part", "_linked", "_n"]
                )

    return task


def _forest(num: int, den: int):
    """The links between two blocks of one group as a spanning forest.

    Overlaps of all pairs are one product of the 0/1 matrix of members and the elements they share.
    Members that both link with the root are not compared: they are in its component already.
    """

    def task(key: tuple, table: pa.Table) -> pa.Table:
        ids = table["_b"].to_numpy()
        star, side = table["_linked"].to_numpy(), table["_block"].to_numpy()
        column = table["_set"].combine_chunks()
        sets = [_array(column, i) for i in range(len(ids))]
        sizes = np.array([len(s) for s in sets], np.int64)
        elements, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(ids)), sizes)
        keep = often[code] > 1
        rank = np.cumsum(often > 1) - 1
        owner, code = owner[keep], rank[code[keep]]
        width = int((often > 1).sum())
        shared = np.zeros((len(ids), len(ids)), np.int64)
        for low in range(0, width, 4096):
            now = (code >= low) & (code < low + 4096)
            member = np.zeros((len(ids), min(4096, width - low)), np.float32)
            member[owner[now], code[now] - low] = 1
            shared += (member @ member.T).astype(np.int64)
        links = den * shared >= num * (sizes[:, None] + sizes[None, :] - shared)
        links &= ~(star[:, None] & star[None, :])
        if key[1].as_py() != key[2].as_py():
            links &= side[:, None] != side[None, :]
        parent = list(range(len(ids)))

        def top(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        out = []
        for i, j in zip(*np.nonzero(np.triu(links, 1)), strict=True):
            a, b = top(int(i)), top(int(j))
            if a != b:
                parent[b] = a
                out.append((int(ids[i]), int(ids[j])))
        return pa.table({"_a": pa.array([a for a, _ in out], pa.int64()), "_b": pa.array([b for _, b in out], pa.int64())})

    return task


def components(edges: DataFrame) -> DataFrame:
    """The smallest reachable id of every id in ``edges`` (_a, _b), by alternating large-star and small-star rounds.

    Each round is written out; it ends when a round changes nothing. Ids without edges are not in the result.
    """
    edges = stage(edges.where("_a <> _b").select(F.greatest("_a", "_b").alias("_a"), F.least("_a", "_b").alias("_b")).distinct(), "edges")
    while True:
        # large star: every larger neighbour of an id goes to the smallest neighbour
        both = edges.union(edges.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        least = both.groupBy("_a").agg(F.min("_b").alias("_least")).select("_a", F.least("_a", "_least").alias("_least"))
        large = both.join(least, "_a").where("_b > _a").select(F.col("_b").alias("_a"), F.col("_least").alias("_b")).distinct()
        # small star: every smaller neighbour of an id, and the id, go to the smallest of them
        small = large.groupBy("_a").agg(F.min("_b").alias("_least"))
        moved = large.join(small, "_a").select(F.explode(F.array(
            F.struct(F.col("_b").alias("_a"), F.col("_least").alias("_b")), F.struct("_a", F.col("_least").alias("_b"))
        )).alias("e")).select("e.*").where("_a <> _b").distinct()
        after = stage(moved, "edges")
        done = after.count() == edges.count() and after.exceptAll(edges).isEmpty()
        unstage(edges)
        if done:
            return after.select("_a", F.col("_b").alias("_label"))
        edges = after


def _components_of_rows(docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their set's size and fingerprint, and for each fingerprint its component, smallest ids of class and component."""
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_text_hash", F.xxhash64("_text"))
    kind = texts.schema["_id"].dataType.simpleString()
    described = stage(
        texts.mapInArrow(_describe(n, num, den), f"_id {kind}, _text_hash long, _n long, _p1 long, _p2 long, _sigs array<long>"), "sets"
    )
    # one row per distinct set, numbered as it is written
    classes = stage(
        described.where("_n > 0").groupBy("_p1", "_p2")
        .agg(F.min("_id").alias("_rep"), F.min(F.struct("_id", "_text_hash")).alias("_row"), F.first("_sigs").alias("_sigs"))
        .withColumn("_c", F.monotonically_increasing_id()), "classes",
    )
    signed = classes.select("_c", F.explode("_sigs").alias("_sig"))
    roots = signed.groupBy("_sig").agg(F.min("_c").alias("_root"), F.max("_c").alias("_last")).where("_root < _last")
    met = signed.join(roots, "_sig").where("_c > _root").select("_root", "_c").distinct()
    met = stage(met, "met")
    sizes = met.groupBy("_root").agg(F.count("*").alias("_size"))
    # the sets of the classes that met another, from the text of one row each
    needed = met.select("_c").union(met.select(F.col("_root").alias("_c"))).distinct()
    rows = classes.join(needed, "_c", "left_semi").select("_c", F.col("_row._id").alias("_id"), F.col("_row._text_hash").alias("_text_hash"))
    found = texts.join(rows, texts["_id"].eqNullSafe(rows["_id"]) & (texts["_text_hash"] == rows["_text_hash"]))
    found = found.groupBy("_c").agg(F.first("_text").alias("_text"))
    sets = stage(found.mapInArrow(_sets(n), "_c long, _set array<long>"), "shingles")
    # every member against its root; the root goes to each part of a large group
    parts = F.floor(F.col("_size") / STAR_BLOCK).cast("int")
    members = met.join(sizes, "_root").select("_root", "_c", F.pmod(F.xxhash64("_c"), parts + 1).cast("int").alias("_part"))
    heads = sizes.select("_root", F.col("_root").alias("_c"), F.explode(F.sequence(F.lit(0), parts)).alias("_part"))
    star = stage(
        members.union(heads).join(sets, "_c").repartition("_root", "_part")
        .sortWithinPartitions("_root", "_part", F.col("_c") != F.col("_root"))
        .select("_root", "_c", "_part", "_set").mapInArrow(_star(num, den), "_a long, _b long, _part int, _linked boolean, _n long"), "star",
    )
    # groups with a member that its root does not link with: all members, in pairs of blocks
    open_roots = star.groupBy("_a").agg(
        F.count("*").alias("_size"), F.sum("_n").alias("_total"), F.count_if(~F.col("_linked")).alias("_loose")
    ).where("_loose > 0 AND _size > 1")
    # a group's count goes to each of its parts, so that its members do not meet
    open_parts = open_roots.withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor(F.col("_size") / STAR_BLOCK).cast("int"))))
    blocks_of = F.least(F.floor(F.greatest(F.col("_size") / GROUP_BLOCK, F.col("_total") / GROUP_SHINGLES)) + 1, F.col("_size")).cast("int")
    spread = (
        star.join(open_parts, ["_a", "_part"]).withColumn("_blocks", blocks_of)
        .withColumn("_block", F.pmod(F.xxhash64("_b"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select("_a", "_b", "_linked", "_block", F.least("_block", "_other").alias("_low"), F.greatest("_block", "_other").alias("_high"))
    )
    forest = (
        spread.join(sets.withColumnRenamed("_c", "_b"), "_b").groupBy("_a", "_low", "_high").applyInArrow(_forest(num, den), "_a long, _b long")
    )
    labels = components(star.where("_linked").select("_a", "_b").unionByName(forest))
    named = classes.select("_c", "_p1", "_p2", "_rep").join(labels, classes["_c"] == labels["_a"], "left")
    named = named.select("_p1", "_p2", "_rep", F.coalesce("_label", "_c").alias("_label"))
    least = named.groupBy("_label").agg(F.min("_rep").alias("_least"))
    return described, stage(named.join(least, "_label"), "components")


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, num: int = 90, den: int = 100
) -> DataFrame:
    """One row per row of ``docs``: the id, n_shingles, component_id and class_id.

    component_id is the smallest id that is reachable by links, the own id included; class_id is the smallest
    id with the same set. Texts that are null or have no word have an empty set, link with nothing and are
    their own component. Repeated rows are rows of one class. A row without id links like any other; ids that
    are null are not counted as smallest unless a component has no other. Other columns are not read.
    """
    described, named = _components_of_rows(docs, id_col, text_col, n, num, den)
    return described.join(named, ["_p1", "_p2"], "left").select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"),
        F.when(F.col("_n") > 0, F.col("_least")).otherwise(F.col("_id")).alias("component_id"),
        F.when(F.col("_n") > 0, F.col("_rep")).otherwise(F.col("_id")).alias("class_id"),
    )


def one_of_each_component(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, num: int = 90, den: int = 100
) -> DataFrame:
    """``docs`` with one row of each group of linked texts: the one with the smallest id, of rows with that id the
    text with the smallest hash, of repeated rows one. Texts without words link with nothing, so all their rows stay.
    """
    described, named = _components_of_rows(docs, id_col, text_col, n, num, den)
    first = F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_text_hash")).alias("_first")
    kept = described.where("_n > 0").join(named, ["_p1", "_p2"]).groupBy("_label").agg(first)
    kept = kept.select(F.col("_first._id").alias("_kept"), F.col("_first._text_hash").alias("_kept_hash"))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")
    hashed = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), whole)
    rows = hashed.join(kept, F.col("_id").eqNullSafe(F.col("_kept")) & (F.col("_hash") == F.col("_kept_hash")))
    wordless = docs.where(F.col(text_col).isNull() | ~F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
    return rows.dropDuplicates(["_id", "_hash"]).select("_doc.*").unionByName(wordless)
