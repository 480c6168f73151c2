from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from cases import ODD_TEXTS, empty, odd
from tokenizers import Tokenizer

from sillage.llm import bpe, tokenfiles

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module", params=[bpe.load, tokenfiles.load], ids=["own", "library words"])
def model(request):
    return request.param(PATH)


def agree(model, library, texts):
    ids, counts = model.encode(texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == want
    data, sizes = model.decode(ids, counts)
    decoded = [bytes(p).decode() for p in np.split(data, np.cumsum(sizes)[:-1])]
    assert decoded == [library.decode(w, skip_special_tokens=False) for w in want]


def test_equal_to_the_library_on_documents(model, library, texts):
    agree(model, library, list(texts.values()))


def test_equal_to_the_library_on_odd_texts(model, library):
    rng = random.Random(7)
    alphabet = "abcXYZ 's're'll 'd \t\n12³½éÉeé́ΣσßİĳК日本\u0085 \u001c​😀👍🏽-_.!?\"<|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(3000)]
    agree(model, library, texts + [t or "" for t in ODD_TEXTS] + ["<|startoftext|>", "A<|startoftext|>'S <|endoftext|><|endoftext|> b"])


def test_forgetting_words_changes_nothing(library, texts, monkeypatch):
    monkeypatch.setattr(bpe, "KEEP_WORDS", 50)
    agree(bpe.Bpe(PATH), library, list(texts.values())[:20])


def test_one_word_alone_equals_words_side_by_side(monkeypatch):
    words = [w.encode() for w in ("international", "tokenization", "zzzzzzzzzz", "thethethe", "日本語", "a")]
    side, lengths = bpe.load(PATH).encode_words(words)
    monkeypatch.setattr(bpe, "WIDEST", 0)
    alone, same = bpe.load(PATH).encode_words(words)
    assert side.tolist() == alone.tolist() and lengths.tolist() == same.tolist()


def test_on_tables(shipped, library):
    df = odd(shipped)
    want = sorted(((r["doc_id"], library.encode(r["text"] or "", add_special_tokens=False).ids) for r in df.collect()), key=repr)
    tokens = bpe.encode(df, PATH)
    assert sorted(((r["doc_id"], r["ids"]) for r in tokens.collect()), key=repr) == want
    texts = sorted(((r["doc_id"], r["decoded"]) for r in bpe.decode(tokens, PATH).collect()), key=repr)
    assert texts == sorted(((i, library.decode(ids, skip_special_tokens=False)) for i, ids in want), key=repr)
    both = bpe.round_trip(df, PATH, keep=["_id", "score"])
    assert both.columns == ["doc_id", "_id", "score", "ids", "decoded"] and both.count() == df.count()
    assert bpe.encode(empty(shipped), PATH).count() == 0 and bpe.decode(bpe.encode(empty(shipped), PATH), PATH).count() == 0


def test_every_code_point(model, library):
    """Letters, numbers and lower case are those of the library, also where Python's Unicode is older."""
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}B {chr(c)}1{chr(c)}!{chr(c)} " for c in codes[k : k + 256]) for k in range(0, len(codes), 256)]
    for k in range(0, len(texts), 256):
        agree(model, library, texts[k : k + 256])
