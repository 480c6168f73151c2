"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

An Arrow string column is one byte buffer with offsets, so a block of texts needs no Python
string: bytes are classed by a table, words are the runs of word bytes inside a text, and the hash
of any byte range is a difference of prefix sums. A byte of 0x80 and above belongs to a code point
outside ASCII and counts as a word byte in every class used here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 21


def _table(bounds: list[tuple[int, int]], inside: bool) -> np.ndarray:
    table = np.full(256, not inside)
    for low, high in bounds:
        table[low : high + 1] = inside
    return table


#: words [^\x20\x09-\x0D]+
PLAIN = _table([(0x20, 0x20), (0x09, 0x0D)], inside=False)
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of a lower-cased text
ALNUM = _table([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)], inside=True)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SAME = np.arange(256, dtype=np.uint8)

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^0..P^(n-1) modulo 2^64, and their inverses; kept between calls up to a block's size."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    both = []
    for base in (_P, _P_INV):
        p = np.ones(1, np.uint64)
        while len(p) < n:
            p = np.concatenate((p, p * np.uint64(pow(base, len(p), 1 << 64))))
        both.append(p)
    if n <= 2 * BLOCK_BYTES:
        _powers = (both[0], both[1])
    return both[0][:n], both[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(x: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... elements, modulo 2^64."""
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, dtype=np.uint64, out=out[1:])
    return out


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each range; equal ranges hash alike wherever they lie."""
    p, inverse = powers(len(values))
    sums = prefix_sums((values.astype(np.uint64) + np.uint64(1)) * p)
    inside = np.minimum(starts, max(len(values) - 1, 0))
    h = (sums[ends] - sums[starts]) * (inverse[inside] if len(values) else np.uint64(1))
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each range, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


@dataclass
class Block:
    """Texts rows[0]..rows[1]-1 of a batch: their bytes, one after the other, and where each begins."""

    rows: tuple[int, int]
    data: np.ndarray
    offsets: np.ndarray

    @property
    def size(self) -> int:
        return self.rows[1] - self.rows[0]

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        """The text, counted within the block, that each byte position lies in."""
        return np.searchsorted(self.offsets, positions, "right") - 1

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of every word, and the index of its first word for each text (one more at the end)."""
        member = table[self.data]
        begins = self.offsets[:-1][self.offsets[:-1] < len(self.data)]
        first = member.copy()
        first[1:] &= ~member[:-1]
        first[begins] = member[begins]
        last = member.copy()
        last[:-1] &= ~member[1:]
        last[begins[begins > 0] - 1] = member[begins[begins > 0] - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of a column in runs of about ``limit`` bytes, at least one whole text each; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield Block((row, end), raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


def word_hashes(block: Block, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word lower-cased in ASCII, and the index of each text's first word."""
    starts, ends, firsts = block.words(table)
    return range_hashes(LOWER[block.data], starts, ends), firsts


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on, also across texts; the caller leaves those out."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    h = words[:count].copy()
    for j in range(1, n):
        h *= np.uint64(_P)
        h += words[j : j + count]
    return mix(h)


def inside_texts(firsts: np.ndarray, n: int) -> np.ndarray:
    """Positions of all n-word windows that lie within one text."""
    counts = np.maximum(np.diff(firsts) - n + 1, 0)
    return ragged(firsts[:-1], counts)
