from __future__ import annotations

import hashlib

import public_tokenizers
import test_fmindex
import test_jaccard
from cases import empty, odd
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from sillage.llm import pii


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_against_brute_force(docs, shipped, sf_dir):
    stage = dict(pipeline.STAGES)
    before = docs.select(*pipeline.COLUMNS)
    kept = stage["toxicity"](shipped, before, sf_dir)
    assert kept.columns == pipeline.COLUMNS and set(rows(kept)) <= set(rows(before))

    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    groups = {i: least for i, _, least in test_jaccard.brute(sorted(texts.items()))}
    assert rows(stage["ngram_jaccard"](shipped, before, sf_dir)) == [r for r in rows(before) if groups[r[0]] == r[0]]

    items = [tuple(r) for r in shipped.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in test_fmindex.brute(texts.items(), items) if r[-1]}
    assert bad and rows(stage["decontamination"](shipped, before, sf_dir)) == [r for r in rows(before) if r[0] not in bad]

    masked = {i: pii.mask(t, pii.find(t)[1]) for i, t in texts.items()}
    after = rows(stage["personal_data"](shipped, before, sf_dir))
    assert after == sorted(((i, masked[i], lang, source, len(masked[i]) if masked[i] != t else n) for i, t, lang, source, n in rows(before)), key=repr)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in stage["bpe"](shipped, before, sf_dir).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert hashlib.sha256(r["decoded"].encode()).digest() == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).digest()


def test_run_is_the_stages_in_turn(shipped, sf_dir):
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "personal_data", "bpe"]
    found = pipeline.run(shipped, sf_dir)
    ids = [r["doc_id"] for r in found.select("doc_id").collect()]
    assert 0 < len(ids) < 200 and len(set(ids)) == len(ids)


def test_odd_rows(shipped, sf_dir):
    for df in (odd(shipped), empty(shipped)):
        for name, stage in pipeline.STAGES:
            out = stage(shipped, df, sf_dir)
            if name != "bpe":
                assert out.columns == pipeline.COLUMNS
            if name in ("personal_data", "bpe"):
                assert out.count() == df.count()
            out.collect()
