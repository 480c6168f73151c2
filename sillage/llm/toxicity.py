"""Toxicity by class-conditional Kneser-Ney models (operator 9).

Word pairs of all labelled training texts are counted by class. A class model discounts its pair counts; what
the discounts take is the count of the next order (Kneser-Ney's, with discounts above one), single words, by
class. These are discounted again, and what is taken now from both classes together is the shared last order.
Discounts are in proportion to a class's size, so an expression must be equally frequent in either to count:
what is rare is left to the shared counts and speaks for neither class. The score compares the length-normalised
log-likelihoods of the two models; next to their difference per word, a logistic calibration on a fold of the training
texts that is not counted weighs what each order adds to it beyond ``MARGIN`` either way.

The difference of two log-likelihoods is a sum over a text's words and pairs, and each of them adds a number of its own:
a word what it is likelier by, a context what it leaves to its words, a pair above its discount what it adds, less what
its context has added. These numbers are made by joins and lie in a staged table, under 64-bit keys; entries of 0 are not
held. Tasks get them in blocks of ``BLOCK_ENTRIES``, one pass over the texts each, and the passes' sums add up, so
memory does not follow the corpus. Nothing is lost by pairs at or below their discount: they say what their context says.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillage.llm import logistic
from sillage.llm.folds import bounded, fold, labelled, sizes, weights
from sillage.llm.text import ALNUM, Block, blocks, mix, word_hashes
from sillage.session import stage

#: entries of the models that are held at once: a key of 8 and two numbers of 4 bytes each
BLOCK_ENTRIES = 4_000_000
#: discounts of pairs, of what a pair leaves to its word, and of words, for the smaller class
PAIR_DISCOUNT, LEFT_DISCOUNT, WORD_DISCOUNT = 8.0, 1.0, 2.0
MARGIN = 1.0
CALIBRATION_PARTS = 8
CALIBRATION_ROWS = 10_000
HELD_OUT_PARTS = 5
CUT = 0.5
_FLUSH = 2_000_000
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_WORDS, _CONTEXTS, _PAIRS = range(3)
_PARTS = 3
_COUNTS = ["after0", "after1", "left0", "left1", "under0", "under1"]


def _tokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, of the word before it (0 for the first of a text), and the index of each text's first."""
    words, firsts = word_hashes(block, ALNUM)
    word = words.view(np.int64)
    before = np.concatenate(([0], word[:-1])) if len(word) else word
    before[firsts[:-1][firsts[:-1] < len(word)]] = 0
    return word, before, firsts


def _pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before.view(np.uint64) * _PAIR + word.view(np.uint64))


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (before, word) of both classes with the number in each."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        before, word, label = (np.concatenate(part) for part in zip(*held, strict=True))
        held.clear()
        _, first, pair = np.unique(_pair_keys(before, word), return_index=True, return_inverse=True)
        counts = [np.bincount(pair[label == c], minlength=len(first)) for c in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (before[first], word[first], *counts)], ["before", "word", "n0", "n1"])

    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int8)
        for block in blocks(batch.column(0)):
            word, before, firsts = _tokens(block)
            held.append((before, word, np.repeat(label[block.rows[0] : block.rows[1]], np.diff(firsts))))
            if sum(len(word) for _, word, _ in held) >= _FLUSH:
                yield flush()
    if held:
        yield flush()


def _entry_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries under their keys: that of the word, or of the pair."""
    for batch in batches:
        kind, at, to = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        key = np.where(kind == _PAIRS, _pair_keys(at, to).view(np.int64), at)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key), batch.column(3), batch.column(4)], ["kind", "key", "v", "g"])


class Entries:
    """A block of entries: by kind sorted keys and their numbers, 0 where a key is not held."""

    def __init__(self, table: pa.Table):
        kind, key = table["kind"].to_numpy(), table["key"].to_numpy()
        values = [np.asarray(table[c].to_numpy(), np.float32) for c in ("v", "g")]
        self.of = []
        for k in (_WORDS, _CONTEXTS, _PAIRS):
            rows = np.flatnonzero(kind == k)
            rows = rows[np.argsort(key[rows])]
            self.of.append((key[rows], *(v[rows] for v in values)))

    def _held(self, kind: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the wanted keys are held, and where."""
        keys = self.of[kind][0]
        if not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == wanted)
        return hit, at[hit]

    def sums(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Words of each text, and for both orders the sum of what is added, of what is above the margin, and of what is below."""
        word, before, firsts = _tokens(block)
        out = np.zeros((block.size, 2 * _PARTS))
        owner = np.repeat(np.arange(block.size), np.diff(firsts))
        for order, kind, wanted in ((0, _WORDS, word), (1, _CONTEXTS, before), (1, _PAIRS, _pair_keys(before, word).view(np.int64))):
            hit, at = self._held(kind, wanted)
            value, less = self.of[kind][1][at].astype(float), self.of[kind][2][at].astype(float)
            for i, (new, old) in enumerate(zip(_parts(value), _parts(less))):
                out[:, order * _PARTS + i] += np.bincount(owner[hit], new - old, block.size)
        return np.diff(firsts), out


def _parts(ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return ratio, np.maximum(ratio - MARGIN, 0), np.minimum(ratio + MARGIN, 0)


@dataclass
class Model:
    """The staged entries (kind, key, v: what it adds, g: what its context has added), the passes they are dealt to, and the calibration."""

    entries: DataFrame
    passes: int
    calibration: np.ndarray

    def block(self, number: int) -> Broadcast:
        table = self.entries.where(F.pmod(F.xxhash64("key"), F.lit(self.passes)) == number).toArrow()
        return self.entries.sparkSession.sparkContext.broadcast(Entries(table))


def _sum_task(entries: Broadcast, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds a block's sums to those of the blocks before; the last pass lets go of the text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0)):
                low, high = block.rows
                _, *rest = (c.slice(low, high - low) for c in batch.columns)
                n, sums = entries.value.sums(block)
                sums += np.array(rest[0].to_pylist(), float).reshape(sums.shape)
                out = [pa.array(n.astype(np.int64)) if last else batch.column(0).slice(low, high - low), pa.array(list(sums), pa.list_(pa.float64())), *rest[1:]]
                yield pa.RecordBatch.from_arrays(out, ["_n" if last else "_text", "_sums", *batch.schema.names[2:]])

    return task


def sums_of(docs: DataFrame, model: Model, text_col: str, keep: list[str]) -> DataFrame:
    """For each row the columns ``keep`` (as _c0, _c1, ...), its number of words (_n), and what they add up to (_sums)."""
    found = docs.select(
        F.col(text_col).alias("_text"), F.array(*[F.lit(0.0)] * 2 * _PARTS).alias("_sums"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(keep))
    )
    carried = "_sums array<double>" + "".join(f", _c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    for number in range(model.passes):
        last = number == model.passes - 1
        found = found.mapInArrow(_sum_task(model.block(number), last), f"{'_n long' if last else '_text string'}, {carried}")
        if not last:
            found = stage(found, "sums")
    return found


def _features() -> list[Column]:
    """The difference of the log-likelihoods per word, then for each order what is beyond the margin, per word and times the root of the length."""
    n = F.greatest(F.col("_n"), F.lit(1)).cast("double")
    mean = [F.get("_sums", F.lit(i)) / n for i in range(2 * _PARTS)]
    out = [mean[0] + mean[_PARTS]]
    for i in (1, 2, _PARTS + 1, _PARTS + 2):
        out += [mean[i], mean[i] * F.sqrt(F.col("_n"))]
    return out


def _over(n: Column, discount: float, scale: float) -> Column:
    return F.greatest(n - discount * scale, F.lit(0.0))


def _spread(scale: dict[int, float]) -> list[Column]:
    """What a pair (before, word, n0, n1) adds to the word before it, to its word, and, above the discount, to itself."""
    n = [F.col(f"n{c}").cast("double") for c in (0, 1)]
    over = [_over(n[c], PAIR_DISCOUNT, scale[c]) for c in (0, 1)]
    under = [F.least(n[c], F.lit(LEFT_DISCOUNT * scale[c])) for c in (0, 1)]
    none = F.lit(0.0)

    def row(word: Column | None, at: Column, *values: Column) -> Column:
        to = F.lit(None).cast("long") if word is None else word
        return F.struct(at.alias("at"), to.alias("to"), *(v.alias(name) for name, v in zip(_COUNTS, values, strict=True)))

    return [
        row(None, F.col("before"), *n, n[0] - over[0], n[1] - over[1], none, none),
        row(None, F.col("word"), none, none, none, none, *under),
        row(F.col("word"), F.col("before"), *over, none, none, none, none),
    ]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> Model:
    """Counts over all labelled rows outside the held-out fold, but for one part of CALIBRATION_PARTS.

    The calibration is fitted on that part, on about CALIBRATION_ROWS of each class at most, weighed by the classes' sizes.
    Null and empty texts have no words. A row of a repeated id or text counts like any other; of labels of one id the
    higher counts. Without labels of both classes the score is the share of the one there is. Other columns are not read.
    """
    known = labelled(docs.select(id_col, text_col).where(fold(id_col, HELD_OUT_PARTS) != 0), labels, label, id_col)
    apart = F.pmod(F.xxhash64(id_col, F.lit("calibration")), F.lit(CALIBRATION_PARTS)) == 0
    size = {r["_label"]: r["n"] or 0 for r in known.groupBy("_label").agg(F.sum(F.octet_length(text_col)).alias("n")).collect()}
    scale = {c: max(1.0, size.get(c, 0) / max(1, min(size.get(0, 0), size.get(1, 0)))) for c in (0, 1)}
    counted = known.where(~apart).select(text_col, "_label").mapInArrow(_count_task, "before long, word long, n0 long, n1 long")
    counted = counted.groupBy("before", "word").agg(*(F.sum(n).alias(n) for n in ("n0", "n1")))
    wide = counted.select(F.explode(F.array(*_spread(scale))).alias("r")).select("r.*").where("to IS NULL OR after0 + after1 > 0")
    wide = stage(wide.groupBy("at", "to").agg(*(F.sum(n).alias(n) for n in _COUNTS)), "counts")
    over = [_over(F.col(f"under{c}"), WORD_DISCOUNT, scale[c]) for c in (0, 1)]
    taken = sum((F.col(f"under{c}") - over[c]) / scale[c] for c in (0, 1)) + 0.5
    words = wide.where("to IS NULL").select("at", *_COUNTS[:4], over[0].alias("over0"), over[1].alias("over1"), taken.alias("taken"))
    # a word that was never counted has the last 0.5
    sums = words.agg(*(F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in ("over0", "over1", "taken"))).first()
    mass, rest = [sums["over0"], sums["over1"]], sums["taken"] + 0.5
    passed_on = rest / (sum(mass[c] / scale[c] for c in (0, 1)) + rest)
    alone = [(1 - passed_on) * F.col(f"over{c}") / max(1.0, mass[c]) + passed_on * F.col("taken") / rest for c in (0, 1)]
    # what a context leaves to its words, all of it where no class has seen the context
    leaves = [F.when(F.col(f"after{c}") > 0, F.ln(F.col(f"left{c}") / F.col(f"after{c}"))).otherwise(0.0) for c in (0, 1)]
    words = words.select("at", *_COUNTS[:4], alone[0].alias("p0"), alone[1].alias("p1"), (leaves[1] - leaves[0]).alias("g"))
    words = stage(words.withColumn("v", F.when(F.col("p0") == F.col("p1"), 0.0).otherwise(F.ln("p1") - F.ln("p0"))), "words")
    kept = wide.where("to IS NOT NULL").select("at", "to", F.col("after0").alias("n0"), F.col("after1").alias("n1"))
    paired = kept.join(words.select("at", *_COUNTS[:4], "g"), "at").join(words.select(F.col("at").alias("to"), "p0", "p1", "v"), "to")
    likely = [
        F.when(F.col(f"after{c}") > 0, F.ln((F.col(f"n{c}") + F.col(f"left{c}") * F.col(f"p{c}")) / F.col(f"after{c}"))).otherwise(F.ln(f"p{c}")) for c in (0, 1)
    ]
    nothing, no_word = F.lit(0.0).alias("g"), F.lit(0).cast("long").alias("to")
    listed = (
        words.where("v <> 0").select(F.lit(_WORDS).alias("kind"), "at", no_word, "v", nothing)
        .unionByName(words.where("g <> 0").select(F.lit(_CONTEXTS).alias("kind"), "at", no_word, F.col("g").alias("v"), nothing))
        .unionByName(paired.select(F.lit(_PAIRS).alias("kind"), "at", "to", (likely[1] - likely[0] - F.col("v")).alias("v"), "g"))
    )
    listed = listed.select("kind", "at", "to", F.col("v").cast("float"), F.col("g").cast("float"))
    entries = stage(listed.mapInArrow(_entry_task, "kind int, key long, v float, g float"), "entries")
    model = Model(entries, max(1, -(-entries.count() // BLOCK_ENTRIES)), np.zeros(10))
    part = known.where(apart)
    counts = sizes(part, "_label")
    sample = bounded(part, "_label", CALIBRATION_ROWS, id_col, counts=counts)
    rows = sums_of(sample, model, text_col, ["_label"]).select(F.array(*_features()).alias("x"), F.col("_c0").alias("y")).toArrow()
    x = np.array(rows["x"].to_pylist(), np.float64).reshape(rows.num_rows, 9)
    y = rows["y"].to_numpy()
    model.calibration = logistic.fit(x, y.astype(float), weight=weights(y, counts))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per row: the id, held_out, score, predicted, and the columns ``keep``.

    Null and empty texts get the calibrated score of a ratio of 0. Rows with equal ids or texts are scored each
    for itself. Columns that are not named are not read.
    """
    carried = [id_col, *(keep or [])]
    weight = [float(w) for w in model.calibration]
    z = sum((w * x for w, x in zip(weight[1:], _features())), F.lit(weight[0]))
    out = sums_of(docs, model, text_col, carried).select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(carried)), (1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-40.0)), F.lit(40.0))))).alias("_score"))
    return out.select(
        *carried, (fold(id_col, HELD_OUT_PARTS) == 0).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= CUT).cast("int").alias("predicted"),
    )
