"""Token ids in Parquet files that can be read in part (operator 3).

Texts are put into ascending id order by a range shuffle, encoded, closed with an end id and written as
list columns. Token ids are dictionary encoded; document ids and positions, which only grow, are delta
packed; row groups and pages are bounded and Parquet's page index is written, so a reader that wants
lengths and positions reads no token, and one that wants some documents reads their pages only.

Words are cut with arrays as in ``bpe``; each word that a worker has not met yet goes to the ``tokenizers``
library, and a text's ids are those of its words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from sillage.llm.bpe import Bpe, runs_of_texts

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
#: words of one library call; its result holds texts and offsets besides ids, so a block in one call costs much memory
CALL_WORDS = 4_096


class LibraryWords(Bpe):
    """Words encoded by the library, many in one call; they are parted again after each token that ends a word.

    The words are normalized and cut already, so the library's own tokenizer is told to part them at spaces.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.normalizer = normalizers.Sequence([])
        at_spaces = pre_tokenizers.Split(" ", "removed")
        self.library.pre_tokenizer = pre_tokenizers.Sequence([at_spaces, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ends = [t.endswith("</w>") for t, _ in sorted(self.library.get_vocab().items(), key=lambda x: x[1])]
        self.ends_word = np.array(ends)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for low in range(0, len(words), CALL_WORDS):
            text = b" ".join(words[low : low + CALL_WORDS]).decode()
            parts.append(np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32))
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        return ids, np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1)


@lru_cache(maxsize=2)
def load(path: str) -> LibraryWords:
    return LibraryWords(path)


def _write_task(path: str, end_id: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, shard, start = load(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, texts in runs_of_texts(batch.column(1)):
                ids, counts = bpe.encode(texts)
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(texts), shard, np.int32)), pa.array(start + ends - counts),
                        batch.column(0).slice(first, len(texts)), pa.array(counts),
                        pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids)),
                    ],
                    ["shard", "shard_start", "_id", "n_tokens", "ids"],
                )
                start += int(ends[-1])

    return task


def write(docs: DataFrame, out: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes ``docs`` into files below ``out``, in ascending id order from file to file and within each.

    Null and empty texts are written with the end id alone. Rows with the same id stay all; their order is as
    read. Rows without an id come first. Other columns are not written.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    order = ["_id", "_row"]  # the row parts a hot id
    keyed = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    sorted_rows = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "_text")
    schema = f"shard int, shard_start long, _id {kind}, n_tokens long, ids array<int>"
    tokens = sorted_rows.mapInArrow(_write_task(path, end_id), schema).withColumnRenamed("_id", id_col)
    (
        tokens.write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", str(ROW_GROUP_BYTES)).option("parquet.page.size", str(PAGE_BYTES))
        .option("parquet.page.row.count.limit", str(PAGE_ROWS)).option("parquet.enable.dictionary", "true")
        .option(f"parquet.enable.dictionary#{id_col}", "false").option("parquet.enable.dictionary#shard_start", "false")
        .option("compression", "zstd").parquet(out)
    )


def read(spark: SparkSession, out: str) -> DataFrame:
    """The files' rows; select columns and filter ids as of any table, both reach the files."""
    return spark.read.parquet(out)


def positions(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows with ``start``, the number of ids in all documents before; reads lengths only to find it.

    One total per file is added up in one place and goes to every task: as many rows as files were written.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = tokens.groupBy("shard").agg(F.sum("n_tokens").alias("_total"))
    offsets = totals.select("shard", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    return tokens.join(F.broadcast(offsets), "shard").withColumn("start", F.col("_before") + F.col("shard_start")).drop("_before")


def _crc_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        ends = lists.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(), "<u4").view(np.uint8))
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["_id", "start", "n_tokens", "ids_crc32"])


def checksums(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The id, start, n_tokens and the unsigned CRC-32 of the ids as little-endian 32-bit numbers."""
    kind = tokens.schema[id_col].dataType.simpleString()
    placed = positions(tokens, id_col).select(id_col, "start", "n_tokens", "ids")
    out = placed.mapInArrow(_crc_task, f"_id {kind}, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("_id", id_col)
