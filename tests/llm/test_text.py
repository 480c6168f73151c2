from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sillage.llm.text import ALNUM, PLAIN, blocks, ngram_hashes, word_hashes

_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_TEXTS = st.lists(st.none() | st.text(st.sampled_from("aB \t\n\x0b\x1cé0/:@[`{~ \U0001f600"), max_size=30), max_size=12)


@settings(deadline=None, max_examples=200)
@given(_TEXTS, st.integers(1, 60))
def test_words_are_those_of_the_patterns(texts, limit):
    for table, pattern in ((PLAIN, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        found = []
        for block in blocks(pa.array(texts, pa.string()), limit):
            raw = bytes(block.data)
            starts, ends, firsts = block.words(table)
            for low, high in zip(firsts[:-1], firsts[1:], strict=True):
                found.append([raw[a:b].decode().translate(_ASCII) for a, b in zip(starts[low:high], ends[low:high], strict=True)])
        assert found == [re.findall(pattern, (t or "").translate(_ASCII)) for t in texts]


def test_equal_words_hash_alike_anywhere():
    block = next(blocks(pa.array(["one two One", "xx two", None, "two"])))
    h, firsts = word_hashes(block, PLAIN)
    assert firsts.tolist() == [0, 3, 5, 5, 6]
    assert h[0] == h[2] and h[1] == h[4] == h[5] and len(set(h.tolist())) == 3
    pairs = ngram_hashes(np.array([1, 2, 1, 2], np.uint64), 2)
    assert pairs[0] == pairs[2] != pairs[1]
