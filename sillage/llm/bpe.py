"""BPE encoding and decoding with a segment tree over adjacent pair ranks (operator 2).

A word begins as one symbol per byte. The leaves of the tree hold the rank of each adjacent pair with
its position, so the root is the lowest rank and, among equals, the leftmost pair. A merge changes
three leaves (the pair, the one before it, the one that is gone) and the nodes above them; it goes on
until no pair has a rank. Many words run side by side, one row of a matrix each, with one tree per row;
longer words run alone. Words are cut from whole blocks of texts with arrays of code points, and a worker
keeps the ids of the words it has seen up to ``KEEP_WORDS``: a space of memory, results do not depend on it.

Files are those of the ``tokenizers`` library with a BPE model on bytes, a suffix at word ends, the
normalizer NFC + white space + lower case, and no decoder: decoding joins the tokens with a space.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sillage.llm.text import ragged, range_hashes

BLOCK_CHARS = 1 << 19
KEEP_WORDS = 1_000_000
LANES = 1 << 12
WIDEST = 64
UNKNOWN = 4
_NONE = np.int64(1) << np.int64(62)

#: fixed values: white space of the file's patterns
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: fixed values: letters after an apostrophe that form a word of their own
CONTRACTIONS_1 = "stmd"
CONTRACTIONS_2 = ("re", "ve", "ll")


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other, 4 not known to this Python's Unicode, by code point."""
    # in runs, as a million small objects at once would stay in the worker's memory
    table = np.empty(0x110000, np.uint8)
    for low in range(0, len(table), 1 << 14):
        names = "".join(map(unicodedata.category, map(chr, range(low, min(low + (1 << 14), len(table))))))
        first, second = np.frombuffer(names.encode(), np.uint8).reshape(-1, 2).T
        unknown = (first == ord("C")) & (second == ord("n"))
        table[low : low + (1 << 14)] = np.select([first == ord("L"), first == ord("N"), unknown], [1, 2, UNKNOWN], 3)
    table[WHITE_SPACE] = 0
    return table


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def normalize(text: str) -> str:
    """NFC and lower case, each code point for itself; white space only parts words and stays."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        self.path, self.kinds = path, char_classes().copy()
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        # a pair listed twice keeps its last rank, as in the library's table
        order = np.lexsort((-np.arange(len(keys)), keys))
        order = order[np.concatenate(([True], keys[order][1:] != keys[order][:-1]))]
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        names = {i: t for t, i in (vocab | self.special).items()}
        tokens = [(" " + names[i]).encode() if i in names else b"" for i in range(max(names) + 1)]
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_lengths = np.array([len(t) for t in tokens], np.int64)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.forget()

    # characters newer than this Python's Unicode

    @cached_property
    def file_tokenizer(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def _ask(self, letter: str) -> int:
        """The class the library's pattern puts a character in."""

        def joins(neighbour: str) -> bool:
            return [at for _, at in self.file_tokenizer.pre_tokenizer.pre_tokenize_str(neighbour + letter)] == [(0, 2)]

        if joins("a"):
            return 1
        if joins("!"):
            return 3
        return 2 if self.file_tokenizer.pre_tokenizer.pre_tokenize_str(letter) else 0

    def _relearned(self, pieces: list[str], raw: list[str]) -> list[str]:
        """Normalized texts; those with characters that Python does not know, from the library's normalizer, which may.

        Such characters are classed by the library when they are first met.
        """
        out = list(pieces)
        for i, piece in enumerate(pieces):
            if not piece.isascii() and (char_classes()[_codes(piece)] == UNKNOWN).any():
                out[i] = self.file_tokenizer.normalizer.normalize_str(raw[i])
                codes = _codes(out[i])
                for code in np.unique(codes[self.kinds[codes] == UNKNOWN]).tolist():
                    self.kinds[code] = self._ask(chr(code))
        return out

    # words

    def forget(self) -> None:
        # hashes of the words seen, ascending, and which of the following each is
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[where] == key, self.ranks[where] << 32 | at, _NONE)

    def _merge_side_by_side(self, symbols: np.ndarray, lengths: np.ndarray) -> None:
        """Merges each row of ``symbols`` (-1 behind its end and where a symbol is gone) in place."""
        count, width = symbols.shape
        column = np.arange(width)
        after = np.where(column + 1 < lengths[:, None], column + 1, -1)
        before = np.where(column < lengths[:, None], column - 1, -1)
        tree = np.full((count, 2 * width), _NONE)
        pairs = column[None, :-1] + 1 < lengths[:, None]
        row, col = np.nonzero(pairs)
        tree[row, width + col] = self._leaves(symbols[row, col], symbols[row, col + 1], col)
        low = width // 2
        while low:
            np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2], out=tree[:, low : 2 * low])
            low //= 2
        flat = tree.reshape(-1)
        row = np.flatnonzero(tree[:, 1] < _NONE)
        while len(row):
            root = flat[row * (2 * width) + 1]
            at, new = root & 0xFFFFFFFF, self.merged[root >> 32]
            gone = after[row, at]
            right, left = after[row, gone], before[row, at]
            symbols[row, at] = new
            symbols[row, gone] = -1
            after[row, at] = right
            has = right >= 0
            before[row[has], right[has]] = at[has]
            base = row * (2 * width)
            flat[base + width + gone] = _NONE
            flat[base + width + at] = np.where(has, self._leaves(new, symbols[row, np.maximum(right, 0)], at), _NONE)
            back = left >= 0
            flat[(base + width + left)[back]] = self._leaves(symbols[row[back], left[back]], new[back], left[back])
            node = np.concatenate((gone, at, np.where(back, left, at))) + width
            base = np.tile(base, 3)
            while node[0] > 1:
                node >>= 1
                flat[base + node] = np.minimum(flat[base + 2 * node], flat[base + 2 * node + 1])
            row = row[flat[row * (2 * width) + 1] < _NONE]

    def _merge_alone(self, symbols: list[int]) -> list[int]:
        """The same for one word of any length."""
        count = len(symbols)
        width = 1 << (count - 1).bit_length()
        none = int(_NONE)
        after, before = [*range(1, count), -1], [*range(-1, count - 1)]
        rank_of, merged = self.rank_of, self.merged

        def leaf(i: int) -> int:
            rank = rank_of.get(symbols[i] << 32 | symbols[after[i]]) if after[i] >= 0 else None
            return none if rank is None else rank << 32 | i

        tree = [none] * width + [leaf(i) for i in range(count)] + [none] * (width - count)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: int) -> None:
            node = width + i
            tree[node] = value
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while tree[1] < none:
            at = tree[1] & 0xFFFFFFFF
            gone = after[at]
            symbols[at], symbols[gone] = int(merged[tree[1] >> 32]), -1
            after[at] = after[gone]
            if after[at] >= 0:
                before[after[at]] = at
            put(gone, none)
            put(at, leaf(at))
            if before[at] >= 0:
                put(before[at], leaf(before[at]))
        return [s for s in symbols if s >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and their number for each word."""
        lengths = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        symbols = self.inner[data]
        symbols[ends - 1] = self.final[data[ends - 1]]
        parts, owners = [], []
        width = 1
        while width <= WIDEST:
            chosen = np.flatnonzero((lengths <= width) & (lengths > width // 2))
            for some in np.array_split(chosen, len(chosen) // LANES + 1):
                if not len(some):
                    continue
                lanes = np.full((len(some), max(width, 2)), -1, np.int64)
                row = np.repeat(np.arange(len(some)), lengths[some])
                at = ragged((ends - lengths)[some], lengths[some])
                lanes[row, at - (ends - lengths)[some][row]] = symbols[at]
                self._merge_side_by_side(lanes, lengths[some])
                row, col = np.nonzero(lanes >= 0)
                parts.append(lanes[row, col])
                owners.append(some[row])
            width *= 2
        for i in np.flatnonzero(lengths > WIDEST):
            ids = self._merge_alone(symbols[ends[i] - lengths[i] : ends[i]].tolist())
            parts.append(np.array(ids, np.int64))
            owners.append(np.full(len(ids), i))
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(parts)[order].astype(np.int32), np.bincount(owner, minlength=len(words))

    # texts

    def _cut(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words in an array of code points that ends in white space."""
        kind = self.kinds[codes]
        start = kind > 0
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        quotes = np.flatnonzero(start & (codes == ord("'")))
        if len(quotes):
            wide = np.append(codes, [0x20, 0x20])
            one, two = wide[quotes + 1], wide[quotes + 2]
            taken = np.isin(one, [ord(c) for c in CONTRACTIONS_1]).astype(np.int64)
            for a, b in CONTRACTIONS_2:
                taken[(one == ord(a)) & (two == ord(b))] = 2
            quotes, taken = quotes[taken > 0], taken[taken > 0]
            start[quotes + 1] = False
            behind = quotes + 1 + taken
            start[behind] |= kind[behind] == 1
        stop = kind > 0
        stop[:-1] &= start[1:] | (kind[1:] == 0)
        return np.flatnonzero(start), np.flatnonzero(stop) + 1

    def _ids_of(self, joined: str, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For normalized texts joined by line feeds: ids, their number by word, and where each word starts."""
        starts, ends = self._cut(codes)
        hashes = range_hashes(codes, starts, ends)
        order = np.argsort(hashes)
        new = np.concatenate(([True], hashes[order][1:] != hashes[order][:-1])) if len(order) else np.zeros(0, bool)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        example = order[new]
        distinct = hashes[example]
        if len(self.hashes) + len(distinct) > KEEP_WORDS:
            self.forget()
        at = np.searchsorted(self.hashes, distinct)
        seen = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        seen[inside] = self.hashes[at[inside]] == distinct[inside]
        place = np.empty(len(distinct), np.int64)
        place[seen] = self.place[at[seen]]
        fresh = np.flatnonzero(~seen)
        if len(fresh):
            where = example[fresh]
            words = [joined[a:b].encode() for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
            ids, lengths = self.encode_words(words)
            place[fresh] = np.arange(len(fresh)) + len(self.starts)
            self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(lengths) - lengths))
            self.lengths = np.concatenate((self.lengths, lengths))
            self.ids = np.concatenate((self.ids, ids))
            self.hashes = np.insert(self.hashes, at[fresh], distinct[fresh])
            self.place = np.insert(self.place, at[fresh], place[fresh])
        word = place[which]
        return self.ids[ragged(self.starts[word], self.lengths[word])], self.lengths[word], starts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and their number for each text."""
        raw, owner, fixed = [], [], {}
        for i, text in enumerate(texts):
            if self.special and any(s in text for s in self.special):
                for part in self.special_pattern.split(text):
                    if part in self.special:
                        fixed[len(raw)] = self.special[part]
                        part = ""
                    raw.append(part)
                    owner.append(i)
            else:
                raw.append(text)
                owner.append(i)
        pieces = [normalize(part) for part in raw]
        joined = "\n".join(pieces) + "\n"
        codes = _codes(joined)
        if (char_classes()[codes] == UNKNOWN).any():
            pieces = self._relearned(pieces, raw)
            joined = "\n".join(pieces) + "\n"
            codes = _codes(joined)
        ids, by_word, starts = self._ids_of(joined, codes)
        begins = np.cumsum([0] + [len(p) + 1 for p in pieces])
        by_word = np.concatenate(([0], np.cumsum(by_word)))
        edges = by_word[np.searchsorted(starts, begins)]
        if fixed:
            parts = np.split(ids, edges[1:-1])
            for i, special in fixed.items():
                parts[i] = np.array([special], np.int32)
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts])
        else:
            counts = np.diff(edges)
        return ids, np.bincount(np.array(owner, np.int64), weights=counts, minlength=len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts, one after the other, and their number for each text; unknown ids are left out."""
        known = (ids >= 0) & (ids < len(self.token_lengths))
        known[known] &= self.token_lengths[ids[known]] > 0
        owner = np.repeat(np.arange(len(counts)), counts)[known]
        ids = ids[known]
        starts, lengths = self.token_starts[ids], self.token_lengths[ids]
        first = np.concatenate(([True], owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, bool)
        starts, lengths = starts + first, lengths - first
        sizes = np.bincount(owner, weights=lengths, minlength=len(counts)).astype(np.int64)
        return self.token_bytes[ragged(starts, lengths)], sizes


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts))).astype(np.int64)


def runs_of_texts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """First row and texts of each run of about BLOCK_CHARS characters; null is empty."""
    first, texts, size = 0, [], 0
    for row, text in enumerate(column):
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= BLOCK_CHARS:
            yield first, texts
            first, texts, size = row + 1, [], 0
    if texts:
        yield first, texts


def _encode_task(path: str, decoded: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for first, texts in runs_of_texts(batch.column(1)):
                ids, counts = bpe.encode(texts)
                out = [batch.column(0).slice(first, len(texts)), pa.ListArray.from_arrays(pa.array(_offsets(counts), pa.int32()), pa.array(ids))]
                if decoded:
                    data, sizes = bpe.decode(ids, counts)
                    offsets = pa.py_buffer(_offsets(sizes).astype(np.int32))
                    out.append(pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer(data)))
                yield pa.RecordBatch.from_arrays(out, ["_id", "_ids", "_decoded"][: len(out)])

    return task


def _decode_task(path: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            lists = batch.column(1).fill_null([])
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            counts = np.diff(lists.offsets.to_numpy())
            data, sizes = bpe.decode(ids, counts)
            text = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(_offsets(sizes)), pa.py_buffer(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), text.cast(pa.string())], ["_id", "_decoded"])

    return task


def _kind(docs: DataFrame, name: str) -> str:
    return docs.schema[name].dataType.simpleString()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: the id and ``ids``. Null and empty texts have an empty list; other columns are not read."""
    out = docs.select(id_col, text_col).mapInArrow(_encode_task(path, False), f"_id {_kind(docs, id_col)}, _ids array<int>")
    return out.select(F.col("_id").alias(id_col), F.col("_ids").alias("ids"))


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: the id and ``decoded``. A null list and an empty list give an empty text."""
    out = tokens.select(id_col, ids_col).mapInArrow(_decode_task(path), f"_id {_kind(tokens, id_col)}, _decoded string")
    return out.select(F.col("_id").alias(id_col), F.col("_decoded").alias("decoded"))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``encode`` and ``decode`` in one pass: the id, ``ids``, ``decoded`` and the columns ``keep``."""
    carried = [id_col, *(keep or [])]
    read = docs.select(F.struct(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(carried))).alias("_id"), F.col(text_col).alias("_text"))
    out = read.mapInArrow(_encode_task(path, True), f"_id {_kind(read, '_id')}, _ids array<int>, _decoded string")
    return out.select(*(F.col(f"_id._c{i}").alias(c) for i, c in enumerate(carried)), F.col("_ids").alias("ids"), F.col("_decoded").alias("decoded"))
