from __future__ import annotations

import glob
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from cases import empty, odd
from tokenizers import Tokenizer

from sillage.llm import tokenfiles
from sillage.session import shared_dir

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    library, start, out = Tokenizer.from_file(PATH), 0, []
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_hold_every_document_in_order(shipped, docs, texts):
    out = shared_dir(shipped, "tokens")
    tokenfiles.write(docs, out, PATH)
    found = tokenfiles.checksums(tokenfiles.read(shipped, out)).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == expected(sorted(texts.items()))
    files = sorted(glob.glob(out.removeprefix("file:") + "/part-*"))
    in_order = [i for f in files for i in pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist()]
    assert in_order == sorted(texts)
    column = {c.path_in_schema: c for c in (pq.ParquetFile(files[0]).metadata.row_group(0).column(i) for i in range(5))}
    assert "DELTA_BINARY_PACKED" in column["doc_id"].encodings and "DELTA_BINARY_PACKED" in column["shard_start"].encodings
    assert any("DICTIONARY" in e for e in column["ids.list.element"].encodings) and column["doc_id"].has_column_index


def test_reads_are_selective(shipped, docs):
    out = shared_dir(shipped, "tokens")
    tokenfiles.write(docs, out, PATH)
    plan = tokenfiles.read(shipped, out).where("doc_id = 7").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,7)" in plan and "ids" not in plan.split("ReadSchema")[1]


def test_odd_rows(shipped):
    for df in (odd(shipped), empty(shipped)):
        out = shared_dir(shipped, "tokens")
        tokenfiles.write(df, out, PATH)
        rows = [tuple(r) for r in tokenfiles.checksums(tokenfiles.read(shipped, out)).orderBy("start").collect()]
        assert [r[0] for r in rows] == sorted((r["doc_id"] for r in df.collect()), key=lambda i: -1 if i is None else i)
        assert [r[1] for r in rows] == list(np.cumsum([0] + [r[2] for r in rows])[:-1])
        want = sorted((n, crc) for _, _, n, crc in expected([(0, r["text"]) for r in df.collect()]))
        assert sorted(r[2:] for r in rows) == want
