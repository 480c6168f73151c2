"""Language identification (operator 4).

Sparse multinomial logistic regression on TF-IDF of character n-grams, trained with follow-the-regularised-leader
and elastic-net penalties; a temperature fitted on texts kept apart calibrates the probabilities. Document
frequencies are counted over all rows that may be learned from; the regression learns from at most ``SAMPLE_ROWS``
of each language. N-grams of one to three letters, with all else as a space, are hashed to ``FEATURE_BITS`` bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sillage.llm.bpe import char_classes, runs_of_texts
from sillage.llm.folds import bounded, fold

FEATURE_BITS = 15
ORDERS = (1, 2, 3)
SAMPLE_ROWS = 800
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.001
SCALE = 100.0
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
_SIZE = 1 << FEATURE_BITS
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature of every n-gram of a run of texts, by order; where each text's begin, how many it has, and whether it has a letter."""
    lowered = [t.lower() for t in texts]
    # one space is counted, the others keep its n-grams inside the text
    pad = max(ORDERS)
    codes = np.frombuffer("".join(t + " " * pad for t in lowered).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t) for t in lowered], np.int64)
    ends = np.cumsum(lengths + 1)
    begins = np.concatenate(([0], ends[:-1]))
    counted = np.ones(len(codes), bool)
    for back in range(1, pad):
        counted[np.cumsum(lengths + pad) - back] = False
    letter = char_classes()[codes] == 1
    counts = np.concatenate(([0], np.cumsum(letter[counted])))
    codes = np.where(letter, codes, 32).astype(np.uint64)
    hashed = np.empty((len(ORDERS), len(codes)), np.uint16)
    for row, n in enumerate(ORDERS):
        h = np.full(len(codes), n, np.uint64)
        for j in range(n):
            h[: len(codes) - j] += codes[j:] * np.uint64(_FACTORS[j])
        hashed[row] = (h * np.uint64(_FACTORS[0])) >> np.uint64(64 - FEATURE_BITS)
    return hashed[:, counted], begins, ends - begins, counts[ends] - counts[begins] > 0


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(_SIZE, np.int64), 0
    for batch in batches:
        for _, texts in runs_of_texts(batch.column(0)):
            hashed, begins, sizes, _ = features(texts)
            for at, size in zip(begins.tolist(), sizes.tolist(), strict=True):
                seen = np.zeros(_SIZE, bool)
                seen[hashed[:, at : at + size]] = True
                total += seen
            rows += len(texts)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], rows))], ["feature", "n"])


def _sparse(idf: np.ndarray):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in runs_of_texts(batch.column(0)):
                hashed, begins, sizes, known = features(texts)
                at, value = [], []
                for a, size, good in zip(begins.tolist(), sizes.tolist(), known.tolist(), strict=True):
                    f, n = np.unique(hashed[:, a : a + size], return_counts=True)
                    at.append(f.astype(np.int32) if good else f[:0].astype(np.int32))
                    value.append((SCALE * n * idf[f] / (size * len(ORDERS)))[: len(at[-1])])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(first, len(texts)), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float64()))], ["lang", "at", "value"]
                )

    return task


@dataclass
class Model:
    languages: list[str]
    #: idf times weight, by language and feature, and the bias by language
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, hashed: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.empty((len(begins), len(self.languages)))
        for column, weight in enumerate(self.weights):
            total = weight[hashed].sum(axis=0, dtype=np.float64)
            out[:, column] = np.add.reduceat(total, begins)
        return SCALE * out / (sizes * len(ORDERS))[:, None] + self.bias


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def follow_the_leader(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (class by feature) and biases, by FTRL-proximal steps with elastic-net penalties over the rows in turn."""
    z, n = np.zeros((classes, _SIZE + 1)), np.zeros((classes, _SIZE + 1))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        own, seen = z[:, at], n[:, at]
        return np.where(np.abs(own) > L1, -(own - np.sign(own) * L1) / ((BETA + np.sqrt(seen)) / ALPHA + L2), 0)

    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            label, at, value = rows[i]
            at, value = np.append(at, _SIZE), np.append(value, 1.0)
            w = weights(at)
            error = _softmax(w @ value)
            error[label] -= 1
            g = error[:, None] * value
            sigma = (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) / ALPHA
            z[:, at] += g - sigma * w
            n[:, at] += g * g
    w = weights(slice(None))
    return w[:, :-1], w[:, -1]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """From rows outside the held-out fold that have a text and a language, at most about SAMPLE_ROWS of each language.

    Document frequencies count all such rows. Every fifth row of the sample sets the temperature; where none is left
    beside it, the model is fitted on it too. Repeated rows count each for itself. Without a row that has a letter no
    language is learned. Other columns are not read.
    """
    known = docs.where((fold(id_col, FOLDS) != HELD_OUT) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counted = known.select(text_col).mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    feature, count = counted["feature"].to_numpy(), counted["n"].to_numpy()
    total = int(count[feature < 0].sum())
    frequency = np.zeros(_SIZE)
    frequency[feature[feature >= 0]] = count[feature >= 0]
    idf = np.log((1 + total) / (1 + frequency)) + 1
    sample = bounded(known.select(id_col, text_col, lang_col), lang_col, SAMPLE_ROWS, id_col)
    table = sample.select(text_col, lang_col).mapInArrow(_sparse(idf), "lang string, at array<int>, value array<double>").toArrow()
    names = sorted(set(table["lang"].to_pylist()))
    index = {name: i for i, name in enumerate(names)}
    rows = [
        (index[lang], np.array(at, np.int64), np.array(value))
        for lang, at, value in sorted(zip(*(table[c].to_pylist() for c in ("lang", "at", "value")), strict=True)) if at
    ]
    apart, rest = rows[::5], [r for i, r in enumerate(rows) if i % 5] or rows
    if not rest:
        return Model([], np.zeros((0, _SIZE), np.float32), np.zeros(0), 1.0)
    weights, bias = follow_the_leader(rest, len(names))
    logits = np.array([weights[:, at] @ value + bias for _, at, value in apart])
    truth = np.array([label for label, _, _ in apart])
    grid = np.exp(np.linspace(-3, 3, 241))
    loss = [-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    return Model(names, (weights * idf).astype(np.float32), bias, float(grid[int(np.argmin(loss))]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: the id, held_out, lang_pred and score, the calibrated probability of the prediction.

    Texts that are null or have no letter, and all texts if no language was learned, are ``und`` with score 0. Rows
    with equal ids or texts are predicted each for itself; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            for first, texts in runs_of_texts(batch.column(1)):
                hashed, begins, sizes, known = features(texts)
                if model.languages:
                    p = _softmax(model.logits(hashed, begins, sizes) / model.temperature)
                    best, score = np.where(known, p.argmax(axis=1), len(names) - 1), np.where(known, p.max(axis=1), 0.0)
                else:
                    best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(names[best].tolist(), pa.string()), pa.array(score)], ["_id", "_lang", "_score"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(task, f"_id {kind}, _lang string, _score double").withColumnRenamed("_id", id_col)
    return out.select(id_col, (fold(id_col, FOLDS) == HELD_OUT).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
