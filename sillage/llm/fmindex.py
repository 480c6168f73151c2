"""Benchmark decontamination with an FM-index per shard of the training texts (operator 8).

A shard is a run of whole texts. Its words become symbols: one for each word of the benchmark, one for all
others, one for the end of a text. The index is the Burrows-Wheeler transform of the symbols in a wavelet
matrix, whose ranks answer how often a symbol stands before a position. All phrases are searched at once,
from their last word to the first, by narrowing the range of suffixes that begin with the words read so
far. Occurrences are found by walking back to the next suffix whose position was kept, and become spans of
words which are merged by text.

The benchmark is cut into phrases on Spark and sent to the tasks in blocks of at most ``QUERY_WORDS`` words;
a larger benchmark takes several passes, each with the next block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sillage.llm.dealing import blocked
from sillage.llm.text import ALNUM, Block, blocks, ragged, word_hashes
from sillage.session import stage

WINDOW = 13
#: text of one index; its arrays take some forty times as much while it is made
SHARD_BYTES = 2 << 20
SAMPLE = 16
#: words of the benchmark that are held at once, as a row of 13 symbols each
QUERY_WORDS = 1_000_000
PIECE_WORDS = 4_096
_END, _STOP, _OTHER, _FIRST = 0, 1, 2, 3


@dataclass
class Phrases:
    """Distinct phrases as rows of symbols, right-aligned, with the items that hold each."""

    vocabulary: np.ndarray
    symbols: np.ndarray
    lengths: np.ndarray
    item_begin: np.ndarray
    items: np.ndarray
    names: list[str | None]


def phrases(names: list[str | None], pieces: list[np.ndarray], window: int) -> Phrases:
    vocabulary, code = np.unique(np.concatenate(pieces) if pieces else np.zeros(0, np.uint64), return_inverse=True)
    code = code + _FIRST
    known = sorted({n for n in names if n is not None})
    number = {n: i for i, n in enumerate(known)}
    rows, lengths, owners = [], [], []
    at = 0
    for name, piece in zip(names, pieces, strict=True):
        own = code[at : at + len(piece)]
        at += len(piece)
        if not len(own):
            continue
        if len(own) >= window:
            cut = np.lib.stride_tricks.sliding_window_view(own, window)
        else:
            cut = np.concatenate((np.zeros(window - len(own), np.int64), own))[None, :]
        rows.append(cut)
        lengths.append(np.full(len(cut), min(len(own), window)))
        owners.append(np.full(len(cut), number.get(name, -1)))
    if not rows:
        empty = np.zeros(0, np.int64)
        return Phrases(vocabulary, np.zeros((0, window), np.int64), empty, np.zeros(1, np.int64), empty, known)
    symbols, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
    size = np.zeros(len(symbols), np.int64)
    size[which] = np.concatenate(lengths)
    pairs = np.unique(np.stack((which.ravel(), np.concatenate(owners)), axis=1), axis=0)
    pairs = pairs[pairs[:, 1] >= 0]
    return Phrases(vocabulary, symbols, size, np.searchsorted(pairs[:, 0], np.arange(len(symbols) + 1)), pairs[:, 1], known)


def suffix_order(t: np.ndarray, bits: int) -> np.ndarray:
    """Positions of the suffixes of ``t`` in order, by doubling the length they are compared on; ``t`` ends in its only 0."""
    n, take = len(t), max(1, 62 // bits)
    wide = np.concatenate((t, np.zeros(take, np.int64)))
    key = np.zeros(n, np.int64)
    for j in range(take):
        key <<= bits
        key |= wide[j : j + n]
    order = np.argsort(key)
    slots = np.arange(n)
    rank = np.zeros(n + 1, np.int64)
    rank[n] = -1
    key = key[order]
    length = take
    while True:
        fresh = np.ones(len(slots), bool)
        np.not_equal(key[1:], key[:-1], out=fresh[1:])
        begin = np.flatnonzero(fresh)
        size = np.diff(np.append(begin, len(slots)))
        rank[order[slots]] = np.repeat(slots[begin], size)
        slots = slots[np.repeat(size > 1, size)]
        if not len(slots):
            return order
        own = order[slots]
        key = (rank[own] << 32) + rank[np.minimum(own + length, n)] + 1
        best = np.argsort(key)
        order[slots] = own[best]
        key = key[best]
        length *= 2


class FmIndex:
    def __init__(self, t: np.ndarray, bits: int, sample: int = SAMPLE):
        order = suffix_order(t, bits)
        last = t[order - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=1 << bits))))
        self.levels = []
        kept = order % sample == 0
        self.kept = np.concatenate(([0], np.cumsum(kept, dtype=np.int32)))
        self.positions = order[kept]
        x = last
        for level in reversed(range(bits)):
            bit = (x >> level & 1).astype(bool)
            ones = np.zeros(len(x) + 1, np.int32)
            np.cumsum(bit, dtype=np.int32, out=ones[1:])
            self.levels.append((level, ones, len(x) - int(ones[-1])))
            x = np.concatenate((x[~bit], x[bit]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each place."""
        low, high = np.zeros(len(at), np.int64), at
        for level, ones, zeros in self.levels:
            one = (symbol >> level & 1).astype(bool)
            a, b = ones[low], ones[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def symbol(self, at: np.ndarray) -> np.ndarray:
        found = np.zeros(len(at), np.int64)
        for level, ones, zeros in self.levels:
            a = ones[at]
            one = ones[at + 1] > a
            found |= one.astype(np.int64) << level
            at = np.where(one, zeros + a, at - a)
        return found

    def search(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each right-aligned phrase the range of suffixes that begin with it."""
        count, width = symbols.shape
        begin, end = np.zeros(count, np.int64), np.full(count, self.before[-1])
        live = np.arange(count)
        for back in range(1, width + 1):
            live = live[lengths[live] >= back]
            if not len(live):
                break
            s = symbols[live, width - back]
            begin[live] = self.before[s] + self.rank(s, begin[live])
            end[live] = self.before[s] + self.rank(s, end[live])
            live = live[begin[live] < end[live]]
        return begin, end

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Positions in the text of suffixes, given their places in the order."""
        at, steps = at.copy(), 0
        out = np.zeros(len(at), np.int64)
        left = np.arange(len(at))
        while len(left):
            now = at[left]
            known = self.kept[now + 1] > self.kept[now]
            out[left[known]] = self.positions[self.kept[now[known]]] + steps
            left, now = left[~known], now[~known]
            s = self.symbol(now)
            at[left] = self.before[s] + self.rank(s, now)
            steps += 1
        return out


def search_block(block: Block, wanted: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of words by text; start, end and phrase of each occurrence, in words of the block."""
    words, firsts = word_hashes(block, ALNUM)
    counts = np.diff(firsts)
    none = np.zeros(0, np.int64)
    if not len(wanted.vocabulary) or not len(words):
        return counts, none, none, none
    place = np.minimum(np.searchsorted(wanted.vocabulary, words), len(wanted.vocabulary) - 1)
    symbol = np.where(wanted.vocabulary[place] == words, place + _FIRST, _OTHER)
    t = np.insert(symbol, firsts[1:], _STOP)
    t = np.append(t, _END)
    bits = int(len(wanted.vocabulary) + _FIRST - 1).bit_length()
    index = FmIndex(t, bits)
    begin, end = index.search(wanted.symbols, wanted.lengths)
    found = np.flatnonzero(end > begin)
    many = end[found] - begin[found]
    phrase = np.repeat(found, many)
    start = index.locate(ragged(begin[found], many))
    start -= np.searchsorted(firsts[1:] + np.arange(1, len(firsts)), start, "right")
    return counts, start, start + wanted.lengths[phrase], phrase


def _merge(starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of one text that overlap or touch as one; sorted."""
    order = np.lexsort((starts, owner))
    starts, ends, owner = starts[order], ends[order], owner[order]
    if not len(starts):
        return starts, ends, owner
    reach = np.maximum.accumulate(ends + owner * (1 << 40)) - owner * (1 << 40)
    first = np.concatenate(([True], (owner[1:] != owner[:-1]) | (starts[1:] > reach[:-1])))
    last = np.append(first[1:], True)
    return starts[first], reach[last], owner[first]


def _rows(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row of each element, and the elements."""
    offsets = lists.offsets.to_numpy()
    return np.repeat(np.arange(len(lists)), np.diff(offsets)), lists.flatten()


def _search_task(wanted, last: bool):
    """Batches of text, starts, ends, items and whatever is carried along; the last pass drops the text and adds the number of words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0), SHARD_BYTES):
                a, b = block.rows
                counts, starts, ends, phrase = search_block(block, wanted.value)
                firsts = np.concatenate(([0], np.cumsum(counts)))
                owner = np.searchsorted(firsts[1:], starts, "right")
                starts, ends = starts - firsts[owner], ends - firsts[owner]
                pairs = np.unique(np.stack((owner, phrase), axis=1), axis=0)
                at = wanted.value.item_begin
                many = at[pairs[:, 1] + 1] - at[pairs[:, 1]]
                named = np.stack((np.repeat(pairs[:, 0], many), wanted.value.items[ragged(at[pairs[:, 1]], many)]), axis=1)
                named = np.unique(named, axis=0)
                # with what earlier blocks of the benchmark found
                text, *old, rest = (*(batch.column(i).slice(a, b - a) for i in range(4)), [c.slice(a, b - a) for c in batch.columns[4:]])
                row, old_starts = _rows(old[0])
                starts = np.concatenate((starts, old_starts.to_numpy()))
                ends = np.concatenate((ends, _rows(old[1])[1].to_numpy()))
                starts, ends, owner = _merge(starts, ends, np.concatenate((owner, row)))
                row, old_items = _rows(old[2])
                items = list(zip(row.tolist(), old_items.to_pylist(), strict=True))
                items += [(r, wanted.value.names[i]) for r, i in named.tolist()]
                items = sorted(set(items))
                edges = pa.array(np.searchsorted(owner, np.arange(b - a + 1)), pa.int32())
                item_edges = pa.array(np.searchsorted([r for r, _ in items], np.arange(b - a + 1)), pa.int32())
                out = [
                    pa.array(counts, pa.int64()) if last else text,
                    pa.ListArray.from_arrays(edges, pa.array(starts, pa.int64())),
                    pa.ListArray.from_arrays(edges, pa.array(ends, pa.int64())),
                    pa.ListArray.from_arrays(item_edges, pa.array([n for _, n in items], pa.string())), *rest,
                ]
                yield pa.RecordBatch.from_arrays(out, ["_n" if last else "_text", "_starts", "_ends", "_items", *batch.schema.names[4:]])

    return task


def _cut_task(window: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                words, firsts = word_hashes(block, ALNUM)
                names, pieces = [], []
                for row, (low, high) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)):
                    for at in range(low, max(low + 1, high - window + 1), PIECE_WORDS):
                        names.append(batch.column(0)[block.rows[0] + row].as_py())
                        pieces.append(words[at : min(high, at + PIECE_WORDS + window - 1)].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(pieces, pa.list_(pa.int64()))], ["_item", "_words"])

    return task


def occurrences(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, keep: list[str] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: the id, n_words, ``spans`` of words to remove (start, end), ``items``, and the columns ``keep``.

    Words are runs of ASCII letters and digits and of all that is outside ASCII, lower-cased in ASCII. An item is
    found where a window of its words occurs; one of fewer words is one window, one without words is none. Null
    texts have no words. Items of one id count as one; an item without id marks words but is not listed. Repeated
    rows are rows like others. Columns that are not named are not read.
    """
    spark = docs.sparkSession
    pieces = benchmark.select(F.col(item_col).cast("string"), item_text_col).mapInArrow(_cut_task(window), "_item string, _words array<long>")
    # repeated items and repeated passages of an item are looked up once
    pieces = blocked(pieces.where(F.size("_words") > 0).distinct(), F.size("_words"), QUERY_WORDS, "phrases")
    pieces = stage(pieces.select("_block", "_item", "_words"), "phrases")
    passes = int(pieces.agg(F.coalesce(F.max("_block"), F.lit(0))).first()[0]) + 1
    carried = [id_col, *(keep or [])]
    none, no_item = F.array().cast("array<long>"), F.array().cast("array<string>")
    found = docs.select(
        F.col(text_col).alias("_text"), none.alias("_starts"), none.alias("_ends"), no_item.alias("_items"),
        *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carried)),
    )
    kinds = "_starts array<long>, _ends array<long>, _items array<string>"
    kinds += "".join(f", _c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carried))
    for number in range(passes):
        block = pieces.where(F.col("_block") == number).toArrow()
        hashes = [np.array(w, np.int64).view(np.uint64) for w in block["_words"].to_pylist()]
        wanted = spark.sparkContext.broadcast(phrases(block["_item"].to_pylist(), hashes, window))
        last = number == passes - 1
        found = found.mapInArrow(_search_task(wanted, last), f"{'_n long' if last else '_text string'}, {kinds}")
        if not last:
            found = stage(found, "found")
    return found.select(
        *(F.col(f"_c{i}").alias(c) for i, c in enumerate(carried)), F.col("_n").alias("n_words"),
        F.arrays_zip(F.col("_starts").alias("start"), F.col("_ends").alias("end")).alias("spans"), F.col("_items").alias("items"),
    )


def judge(found: DataFrame) -> DataFrame:
    """``occurrences`` with n_hit, n_items, items_sha256 and contaminated: at least one word of 20 is inside an occurrence."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return (
        found.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256))
        .withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))
    )
