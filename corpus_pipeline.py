"""A training corpus from raw documents: five stages of the llm operators, each written out and reread.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before has kept; all but the last
return the columns of ``documents``. No stage needs a column to be filled: rows with nulls or empty texts pass
the stages that find nothing in them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sillage.llm import bpe, fmindex, jaccard, pii, toxicity
from sillage.llm.ship import ship
from sillage.session import remove, scratch, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CARRIED = COLUMNS[1:]
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are scored as toxic go."""
    ship(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, keep=CARRIED).where("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    ship(spark)
    return jaccard.one_of_each_component(docs.select(*COLUMNS))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words one in 20 or more lies in a benchmark passage go; the others stay as they are."""
    ship(spark)
    found = fmindex.occurrences(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=CARRIED)
    return fmindex.judge(found).where("NOT contaminated").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data in its text is replaced by the kind, and n_chars follows."""
    ship(spark)
    found = pii.spans_of(docs, masked=True, keep=["lang", "source", "n_chars"])
    length = F.when(F.size("spans") > 0, F.length("masked").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", F.col("masked").alias("text"), "lang", "source", length.alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, and the text they stand for."""
    ship(spark)
    found = bpe.round_trip(docs, TOKENIZER, keep=["lang", "source"])
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", toxic_documents),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", benchmark_passages),
    ("personal_data", personal_data),
    ("bpe", tokens),
]

#: SQL has no form for the models and the tokenizer; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn. What a stage has read and staged is removed once its result is written."""
    ship(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS), None
    for name, stage in STAGES:
        path = shared_dir(spark, name)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
