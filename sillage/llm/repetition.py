"""Quality rules on repetition coverage (operator 5).

For several lengths n, every window of n words gets a rolling hash; windows that occurred before in the text
cover words, and the characters of covered words are set against all. Lines are treated likewise. The
shares that reject a text are those published for the Gopher corpus, which do not count first occurrences;
a text below ``MIN_WORDS`` or with too many words in repeated windows, the first included, is rejected before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sillage.llm.text import PLAIN, Block, blocks, inside_texts, mix, ngram_hashes, range_hashes

#: largest share of characters inside duplicated windows of so many words
WINDOW_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: largest share of repeated lines, for texts of so many lines at least: one heading below a short text is no sign
LINE_LIMIT, LINE_LIMIT_FROM = 0.30, 5
LINE_CHARS_LIMIT = 0.20
MIN_WORDS = 10
REPEATED_PERCENT = 20
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "dup_line_chars"]


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(values, dtype=np.int64)))


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occurred before, and which occur more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    before, often = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order[1:]] = same
    often[order[1:]] = same
    often[order[:-1]] |= same
    return before, often


def _covered(count: int, at: np.ndarray, n: int) -> np.ndarray:
    """Which of ``count`` words lie in a window of n that begins at one of ``at``."""
    steps = np.zeros(count + 1, np.int64)
    steps[at] += 1
    steps[at + n] -= 1
    return np.cumsum(steps)[:-1] > 0


def measure(block: Block) -> dict[str, np.ndarray]:
    """All counts, and the characters covered for each window length, by text."""
    starts, ends, firsts = block.words(PLAIN)
    n_words = np.diff(firsts)
    points = _sums((block.data & 0xC0) != 0x80)
    chars = _sums(points[ends] - points[starts])
    out = {"n_words": n_words, "word_chars": chars[firsts[1:]] - chars[firsts[:-1]], "n_symbols": np.diff(_sums(SYMBOLS[block.data])[block.offsets])}

    words = range_hashes(block.data, starts, ends)
    candidates = inside_texts(firsts, min(WINDOW_LIMITS))
    for n in WINDOW_LIMITS:
        grams = ngram_hashes(words, n)
        # a window of n words can only repeat where the one of n - 1 words does
        at = candidates[candidates < len(grams)]
        owner = np.searchsorted(firsts, at, "right") - 1
        at, owner = at[at + n <= firsts[owner + 1]], owner[at + n <= firsts[owner + 1]]
        before, often = _repeated(mix(grams[at] ^ mix(owner.astype(np.uint64))))
        candidates = at[often]
        if n == min(WINDOW_LIMITS):
            out["n_repeat_words"] = np.diff(_sums(_covered(len(words), candidates, n))[firsts])
        covered = _covered(len(words), at[before], n)
        inside = _sums(np.where(covered, np.diff(chars), 0))
        out[f"chars_{n}"] = inside[firsts[1:]] - inside[firsts[:-1]]

    breaks = np.flatnonzero(block.data == 0x0A)
    begin = np.unique(np.concatenate((block.offsets[:-1], breaks + 1)))
    begin = begin[begin < len(block.data)]
    stop = np.append(begin[1:], len(block.data))
    stop = np.where((stop > begin) & (block.data[np.maximum(stop - 1, 0)] == 0x0A), stop - 1, stop) if len(begin) else stop
    low, high = np.searchsorted(starts, begin), np.searchsorted(starts, stop)
    begin, stop, low, high = (x[high > low] for x in (begin, stop, low, high))
    owner = block.text_of(begin)
    again, _ = _repeated(mix(range_hashes(block.data, begin, stop) ^ mix(owner.astype(np.uint64))))
    out["n_lines"] = np.bincount(owner, minlength=block.size)
    out["n_dup_lines"] = np.bincount(owner[again], minlength=block.size)
    out["dup_line_chars"] = np.bincount(owner[again], (chars[high] - chars[low])[again], block.size).astype(np.int64)
    return out


def _task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [*_COUNTS, *(f"chars_{n}" for n in WINDOW_LIMITS)]
    for batch in batches:
        for block in blocks(batch.column(1)):
            found = measure(block)
            a, b = block.rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), *(pa.array(found[n].astype(np.int64)) for n in names)], ["_id", *names]
            )


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: the counts, base_failed, and kept, which is false too where a share passes its limit.

    A null or empty text has no words: all counts are 0 and it is not kept. Rows with equal ids are judged
    each for itself; other columns are not read.
    """
    names = [*_COUNTS, *(f"chars_{n}" for n in WINDOW_LIMITS)]
    schema = f"_id {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names)
    found = docs.select(id_col, text_col).mapInArrow(_task, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    many_lines = (F.col("n_lines") >= LINE_LIMIT_FROM) & (F.col("n_dup_lines") > LINE_LIMIT * F.col("n_lines"))
    over = many_lines | (F.col("dup_line_chars") > LINE_CHARS_LIMIT * F.col("word_chars"))
    for n, limit in WINDOW_LIMITS.items():
        over |= F.col(f"chars_{n}") > limit * F.col("word_chars")
    return found.withColumnRenamed("_id", id_col).withColumn("base_failed", failed).withColumn("kept", ~failed & ~over)
