"""Quality by a linear-chain conditional random field over lines (operator 7).

Every line with a word is good or bad; its evidence is its own features and those of the lines before and
after, and neighbouring labels hold together by learned transitions. Forward and backward messages of two
labels are one log-odds each, so a whole block of texts takes one step per line number; what ``SEGMENT`` lines do to
a message is one 2 by 2 matrix, so a long text takes few steps more than a segment has lines. A text's quality is
the mean of the marginals weighed by line length, calibrated on texts kept apart. Lines are trained with the
label of their text, on at most ``SAMPLE_ROWS`` labelled texts of each class, weighed by the classes' sizes, and at
most ``SAMPLE_LINES`` consecutive lines from the middle of each; scores are of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sillage.llm import logistic
from sillage.llm.folds import bounded, fold, labelled, sizes, weights
from sillage.llm.text import PLAIN, Block, blocks, inside_texts, mix, ngram_hashes, ragged, range_hashes

SAMPLE_ROWS = 3_000
SAMPLE_LINES = 100
SEGMENT = 256
BATCH_TEXTS, EPOCHS, RATE = 128, 12, 0.05
RIDGE = 1e-3
FOLDS, HELD_OUT = 4, 2
CUT = 0.7


def _class(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(chars))


#: shares of a line's bytes
_CLASSES = [
    _class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class(b"0123456789"), _class(b"#*$%&|<>"), _class(b"!?"), _class(b".,;:"),
    _class(b"()[]{}\"'"), _class(b"/\\@_=+~^"), np.arange(256) >= 0x80,
]
_STOPS = _class(b".!?:;\"')")
FEATURES = len(_CLASSES) + 12


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occurred before."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:]] = keys[order][1:] == keys[order][:-1]
    return out


def lines(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line that has a word, its text, and its length in word bytes; in order."""
    starts, ends, firsts = block.words(PLAIN)
    breaks = np.flatnonzero(block.data == 0x0A)
    begin = np.unique(np.concatenate((block.offsets[:-1], breaks + 1)))
    begin = begin[begin < len(block.data)]
    stop = np.append(begin[1:], len(block.data))
    low, high = np.searchsorted(starts, begin), np.searchsorted(starts, stop)
    begin, stop, low, high = (x[high > low] for x in (begin, stop, low, high))
    owner = block.text_of(begin)
    words = range_hashes(block.data, starts, ends)
    size = _sums(ends - starts)
    length, count = size[high] - size[low], (high - low).astype(np.float64)
    of = np.repeat(np.arange(block.size), np.diff(firsts)).astype(np.uint64)
    same = np.concatenate(([False], (words[1:] == words[:-1]) & (of[1:] == of[:-1]))) if len(words) else np.zeros(0, bool)
    seen = _repeats(mix(words ^ mix(of)))
    triples = np.zeros(len(words), bool)
    inside = inside_texts(firsts, 3)
    triples[inside] = _repeats(mix(ngram_hashes(words, 3)[inside] ^ mix(of[inside])))
    columns = [(_sums(c[block.data])[stop] - _sums(c[block.data])[begin]) / np.maximum(length, 1) for c in _CLASSES]
    line_keys = range_hashes(block.data, starts[low], ends[high - 1]) if len(low) else np.zeros(0, np.uint64)
    last = block.data[ends[high - 1] - 1] if len(low) else np.zeros(0, np.uint8)
    first = block.data[starts[low]] if len(low) else np.zeros(0, np.uint8)
    alone = _sums(~PLAIN[block.data])
    per_text = np.bincount(owner, minlength=block.size)[owner]
    columns += [
        np.log1p(length), np.log1p(count), length / np.maximum(count, 1), (_sums(same)[high] - _sums(same)[low]) / np.maximum(count, 1),
        (_sums(seen)[high] - _sums(seen)[low]) / np.maximum(count, 1), (_sums(triples)[high] - _sums(triples)[low]) / np.maximum(count, 1),
        _repeats(mix(line_keys ^ mix(owner.astype(np.uint64)))).astype(float), _STOPS[last].astype(float), _CLASSES[0][first].astype(float),
        (alone[stop] - alone[begin]) / np.maximum(length, 1), np.log1p(per_text), (_sums(ends - starts == 1)[high] - _sums(ends - starts == 1)[low]) / np.maximum(count, 1),
    ]
    return (np.column_stack(columns) if len(owner) else np.zeros((0, FEATURES))), owner, length


def with_neighbours(x: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and after in its text, and whether there is none."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    joined = owner[1:] == owner[:-1]
    before[1:][joined], after[:-1][joined] = x[:-1][joined], x[1:][joined]
    edge = np.zeros((len(x), 2))
    if len(x):
        edge[0, 0] = edge[-1, 1] = 1
        edge[1:, 0], edge[:-1, 1] = ~joined, ~joined
    return np.hstack((x, before, after, edge))


def _grid(counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For line number 0, 1, ...: the texts that have it and the position of that line."""
    order = np.argsort(-counts, kind="stable")
    first = np.cumsum(counts) - counts
    sizes = counts[order]
    out = []
    for step in range(int(counts.max(initial=0))):
        texts = order[: np.searchsorted(-sizes, -step, "left")]
        out.append((texts, first[texts] + step))
    return out


def _passed(odds: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log-odds of a line's label from those of the line before."""
    return np.logaddexp(odds + t[1, 1], t[0, 1]) - np.logaddexp(odds + t[1, 0], t[0, 0])


def _along(evidence: np.ndarray, counts: np.ndarray, t: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Log-odds that reach every line of runs of lines; ``begin`` is what reaches their first ones."""
    out = np.zeros(len(evidence))
    for step, (runs, at) in enumerate(_grid(counts)):
        out[at] = _passed(out[at - 1] + evidence[at - 1], t) if step else begin[runs]
    return out


def _products(evidence: np.ndarray, counts: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Logarithms, up to a constant, of the matrix by which each run of lines changes what reaches it: to label, from label."""
    product = np.full((len(counts), 2, 2), -np.inf)
    product[:, 0, 0] = product[:, 1, 1] = 0
    for runs, at in _grid(counts):
        bad, good = product[runs, 0], product[runs, 1] + evidence[at][:, None]
        new = np.stack([np.logaddexp(bad + t[0, label], good + t[1, label]) for label in (0, 1)], axis=1)
        product[runs] = new - new.max(axis=(1, 2), keepdims=True)
    return product


def incoming(evidence: np.ndarray, counts: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log-odds that reach every line from those before it in its text. Segments of long texts go side by side."""
    if counts.max(initial=0) <= SEGMENT:
        return _along(evidence, counts, t, np.zeros(len(counts)))
    parts = np.maximum(-(-counts // SEGMENT), 1)
    first = np.cumsum(parts) - parts
    sizes = np.full(parts.sum(), SEGMENT)
    sizes[first + parts - 1] = counts - (parts - 1) * SEGMENT
    products = _products(evidence, sizes, t)
    begin = np.zeros(len(sizes))
    for _, at in _grid(parts)[1:]:
        p, odds = products[at - 1], begin[at - 1]
        begin[at] = np.logaddexp(p[:, 1, 0], p[:, 1, 1] + odds) - np.logaddexp(p[:, 0, 0], p[:, 0, 1] + odds)
    return _along(evidence, sizes, t, begin)


def messages(evidence: np.ndarray, counts: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of good from the lines up to each, its own included, and from those after it. ``t`` is a 2 by 2 matrix."""
    return evidence + incoming(evidence, counts, t), incoming(evidence[::-1], counts[::-1], t.T)[::-1]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    transitions: np.ndarray
    calibration: np.ndarray

    def quality(self, x: np.ndarray, owner: np.ndarray, length: np.ndarray, texts: int) -> np.ndarray:
        """Mean marginal of good by text, weighed by line length, and the mean of its log-odds; 0 without lines."""
        wide = with_neighbours((x - self.mean) / self.scale, owner)
        evidence = wide @ self.weights[1:] + self.weights[0]
        ahead, back = messages(evidence, np.bincount(owner, minlength=texts), self.transitions)
        odds = ahead + back
        total = np.maximum(np.bincount(owner, length, texts), 1e-9)
        return np.column_stack((
            np.bincount(owner, length * logistic.sigmoid(odds), texts) / total, np.bincount(owner, length * np.clip(odds, -10, 10), texts) / total
        ))

    def score(self, block: Block) -> np.ndarray:
        x, owner, length = lines(block)
        return logistic.apply(self.calibration, self.quality(x, owner, length, block.size))


def fit_chain(x: np.ndarray, counts: np.ndarray, label: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights (bias first) and transitions that make the texts' labels likely on all their lines, by Adam over batches of texts.

    ``share`` is what each text weighs, 1 in the mean.
    """
    size = x.shape[1] + 1
    theta = np.zeros(size + 4)
    first = np.cumsum(counts) - counts
    m, v, step = np.zeros_like(theta), np.zeros_like(theta), 0
    for epoch in range(EPOCHS):
        order = np.random.default_rng(epoch).permutation(len(counts))
        for low in range(0, len(order), BATCH_TEXTS):
            texts = order[low : low + BATCH_TEXTS]
            own = counts[texts]
            rows = np.concatenate([np.arange(first[i], first[i] + counts[i]) for i in texts])
            wide, truth = x[rows], np.repeat(label[texts], own).astype(float)
            t = theta[size:].reshape(2, 2)
            evidence = wide @ theta[1:size] + theta[0]
            ahead, back = messages(evidence, own, t)
            marginal = logistic.sigmoid(ahead + back)
            weight = np.repeat(share[texts] / own, own) / len(texts)
            gradient = np.zeros_like(theta)
            rest = (truth - marginal) * weight
            gradient[0], gradient[1:size] = rest.sum(), wide.T @ rest
            owner = np.repeat(np.arange(len(own)), own)
            left = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else owner
            pair = np.zeros((len(left), 2, 2))
            pair += t
            pair[:, 1, :] += ahead[left][:, None]
            pair[:, :, 1] += (evidence + back)[left + 1][:, None]
            pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True))
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            seen = np.zeros((len(left), 2, 2))
            seen[np.arange(len(left)), truth[left].astype(int), truth[left + 1].astype(int)] = 1
            gradient[size:] = ((seen - pair) * weight[left][:, None, None]).sum(axis=0).ravel()
            gradient -= RIDGE * theta
            step += 1
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            theta += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:size], theta[size:].reshape(2, 2)


def _line_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(0)):
            x, owner, length = lines(block)
            edges = np.searchsorted(owner, np.arange(block.size + 1))
            count = np.diff(edges)
            kept = np.minimum(count, SAMPLE_LINES)
            at = ragged(edges[:-1] + (count - kept) // 2, kept)
            ends = np.concatenate(([0], np.cumsum(kept)))
            low, high = block.rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1).slice(low, high - low), pa.ListArray.from_arrays(pa.array(ends * FEATURES, pa.int32()), pa.array(x[at].ravel())),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(length[at], pa.float64())),
                ],
                ["y", "x", "length"],
            )


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> Model:
    """From labelled rows outside the held-out fold; every fifth of the sampled texts is for the calibration.

    Null, empty and wordless texts have no line and only take part in the calibration. Repeated rows count each for
    itself; of a very long text the lines in its middle are learned from. Of several labels of one id 1 wins. Without
    rows, or with one label only, the chain stays at 0 and the score is the share of the labels. Columns other than
    the named ones are not read.
    """
    known = labelled(docs.select(id_col, text_col).where(fold(id_col, FOLDS) != HELD_OUT), labels, label, id_col)
    sizes_of = sizes(known, "_label")
    sample = bounded(known, "_label", SAMPLE_ROWS, id_col, counts=sizes_of)
    table = sample.orderBy(F.xxhash64(id_col), id_col).select(text_col, "_label").mapInArrow(_line_task, "y int, x array<double>, length array<double>").toArrow()
    y = table["y"].to_numpy().astype(int)
    weight = weights(y, sizes_of)
    counts = np.array([len(n) for n in table["length"].to_pylist()], np.int64)
    x = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
    length = table["length"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(counts)), counts)
    mean, scale = (x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    model = Model(mean, scale, np.zeros(3 * FEATURES + 3), np.zeros((2, 2)), np.zeros(3))
    if len(x) and y.min() < y.max():
        fitted = (np.arange(len(y)) % 5 != 0) & (counts > 0)
        rows = fitted[owner]
        model.weights, model.transitions = fit_chain(with_neighbours((x - mean) / scale, owner)[rows], counts[fitted], y[fitted], weight[fitted] / weight[fitted].mean())
    apart = (np.arange(len(y)) % 5 == 0) if len(y) else np.zeros(0, bool)
    quality = model.quality(x, owner, length, len(counts))
    model.calibration = logistic.fit(quality[apart], y[apart].astype(float), weight=weight[apart])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: the id, held_out, score and predicted.

    Texts that are null or have no word have no line: their score is the calibrated one of a quality of 0. Rows with
    equal ids or texts are scored each for itself; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                low, high = block.rows
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(sent.value.score(block))], ["_id", "_score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(task, f"_id {kind}, _score double").withColumnRenamed("_id", id_col)
    return out.select(
        id_col, (fold(id_col, FOLDS) == HELD_OUT).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= CUT).cast("int").alias("predicted")
    )
