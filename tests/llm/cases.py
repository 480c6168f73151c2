"""Rows that every operator must take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _text string, score double, ids string, _label int"
LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(60_000))
ODD_TEXTS = [
    None, "", " ", "\n\n", "a", "one two", "one two", "ONE two", "é", " ", "x" * 70_000, LONG, "a b c d e f g h i j a b c d e f g h i j",
    "don't 'rest 're <|endoftext|>x", "mail me@x.org +1 555 123 4567 10.0.0.1", "token=abcdef0123", "line\nline\nline\nline", "\U0001f600 İΣ ok",
]


def odd(spark: SparkSession) -> DataFrame:
    """Null, empty and very long texts, ties, repeated rows, rows without id, and extra columns whose names operators use."""
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(5, "one two"), (5, "one two"), (5, "another text here"), (None, "no id here"), (None, None)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", 0.5, "z", 1) for i, t in rows], SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def no_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
