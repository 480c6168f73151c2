from __future__ import annotations

import collections
import re

from cases import empty, odd

from sillage.llm import repetition
from sillage.llm.repetition import WINDOW_LIMITS

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def brute(i, text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    chars = sum(map(len, words))

    def covered(n, first_too=False):
        windows = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
        many, seen, out = collections.Counter(windows), set(), set()
        for k, w in enumerate(windows):
            if w in seen or first_too and many[w] > 1:
                out.update(range(k, k + n))
            seen.add(w)
        return out

    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    again = [line for k, line in enumerate(lines) if line in lines[:k]]
    repeated = len(covered(5, first_too=True))
    failed = len(words) < 10 or 100 * repeated > 20 * len(words)
    over = len(lines) >= 5 and len(again) > 0.3 * len(lines) or sum(len("".join(re.findall(r"[^\x20\x09-\x0D]+", a))) for a in again) > 0.2 * chars
    over |= any(sum(len(words[j]) for j in covered(n)) > limit * chars for n, limit in WINDOW_LIMITS.items())
    return i, len(words), chars, sum(c in "#*$%&|<>" for c in text), len(again), repeated, failed, not failed and not over


def rows(df):
    return sorted((tuple(r) for r in repetition.judge(df).select(*COLUMNS).collect()), key=repr)


def test_whole_table(docs, texts):
    assert rows(docs) == sorted((brute(*x) for x in texts.items()), key=repr)


def test_odd_rows(shipped):
    df = odd(shipped)
    assert rows(df) == sorted((brute(r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    assert rows(empty(shipped)) == []
