"""The registered queries of this folder: each applies one operator to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sillage.llm import bpe, chat, fmindex, jaccard, langid, lexical, linecrf, pii, repetition, secrets, tokenfiles, toxicity, trie
from sillage.llm.oracles import CHAT, DECONTAMINATION, JACCARD, LEXICAL, REPETITION, TRIE
from sillage.llm.ship import ship
from sillage.session import shared_dir

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
#: a text that holds the control strings of the chat template
MARKS = "\\### Assistant: </turn> ok"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {
    "op1_jaccard_join": JACCARD, "op5_repetition": REPETITION, "op8_decontamination": DECONTAMINATION,
    "op11_lexical_search": LEXICAL, "op12_chat_format": CHAT, "op13_prefix_trie": TRIE,
}


def _register(query: Query) -> Query:
    QUERIES[query.__name__] = lambda spark, sf_dir: query(ship(spark), sf_dir)
    return query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


@_register
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


@_register
def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.round_trip(_table(spark, sf_dir, "documents"), TOKENIZER)
    return tokens.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@_register
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "tokens")
    tokenfiles.write(_table(spark, sf_dir, "documents"), out, TOKENIZER, END_ID)
    return tokenfiles.checksums(tokenfiles.read(spark, out))


@_register
def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge(_table(spark, sf_dir, "documents"))


@_register
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fmindex.occurrences(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return fmindex.judge(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@_register
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans_of(_table(spark, sf_dir, "documents"))
    counts = [_count("base", kind) for kind in pii.BASE]
    return found.select(
        "doc_id", *counts, F.sha2(pii.listed("base").cast("binary"), 256).alias("base_sha256"), pii.listed("spans").alias("spans")
    )


@_register
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(docs))
    counts = [_count("base", kind) for kind in secrets.BASE]
    return found.select(
        "doc_id", *counts, F.sha2(secrets.listed("base").cast("binary"), 256).alias("base_sha256"), secrets.listed("spans").alias("spans")
    )


@_register
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


@_register
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


@_register
def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return linecrf.score(docs, linecrf.train(docs, _table(spark, sf_dir, "labels")))


@_register
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_register
def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(MARKS).alias("text"),
    )
    found = chat.conversations(chat.linear(turns.unionByName(marks)))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = found.select(
        F.col("tree").alias("conv_id"), chat.turns_of(F.col("formatted")).alias("turns"),
        F.array_join(chat.masked(F.col("formatted"), F.col("loss")), "").alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(said, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


@_register
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(4))
    nodes = trie.prefix_trie(*trie.rebuilt(_table(spark, sf_dir, "conversations"), shared, F.expr("conv - conv % 20")))
    return nodes.withColumn("ends_sha256", F.sha2(F.col("ends").cast("binary"), 256)).drop("ends")
