"""Merged deliveries that grow: rows on disk once, however often and in whatever columns they are delivered.

The table is partitioned by a place that follows from the row alone: the value of a column where deliveries are
known to share one (a month, a bimester), else a part of the row's fingerprint. A delivery reads the fingerprints of
the places it touches, two numbers a row, and appends what is new; other places and all other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sillage.session import stage, unstage
from sillage.sources.csvfiles import align_all

PLACE, MARKS = "_place", ("_mark1", "_mark2")
BUCKETS = 256


def fingerprint(columns: Sequence[str]) -> list[Column]:
    """128 bits of a row of texts. Only values that are there count, under their names in order, so a row is the same
    row in a table with more columns."""
    filled = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("c"), F.col(c).alias("v"))) for c in sorted(columns)]))
    return [F.xxhash64(F.lit(seed), filled) for seed in range(1, len(MARKS) + 1)]


def _marked(frames: Sequence[DataFrame], by: Column | None, buckets: int) -> DataFrame:
    relaxed = align_all([f.select(*[F.col(c).cast("string").alias(c) for c in f.columns]) for f in frames])
    marks = dict(zip(MARKS, fingerprint(relaxed.columns)))
    rows = relaxed.withColumns(marks)
    place = F.pmod(F.col(MARKS[0]), F.lit(buckets)).cast("string") if by is None else F.coalesce(by.cast("string"), F.lit(""))
    return rows.withColumn(PLACE, place).dropDuplicates(list(MARKS))


def _known(spark: SparkSession, path: str) -> DataFrame | None:
    """Fingerprints and places of the stored rows; no file is opened to learn its columns."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(", ".join([*(f"{m} long" for m in MARKS), f"{PLACE} string"])).parquet(path)


def append_new(frames: Sequence[DataFrame], path: str, by: Column | None = None, buckets: int = BUCKETS) -> None:
    """Adds the rows of deliveries to the table at ``path`` that it does not hold yet; columns may differ and come anew.

    ``by``, an expression over the delivered columns, must be the same each time. The driver learns the places a
    delivery touches, which are folders of the table. A delivery that was cut short can be given again: what it has
    written is known by its fingerprints.
    """
    spark = frames[0].sparkSession
    fresh = stage(_marked(frames, by, buckets), "delivery")
    known, new = _known(spark, path), fresh
    if known is not None:
        touched = [r[0] for r in fresh.select(PLACE).distinct().collect()]
        new = fresh.join(known.where(F.coalesce(PLACE, F.lit("")).isin(touched)), list(MARKS), "left_anti")
    new.hint("rebalance", F.col(PLACE)).write.mode("append").option("compression", "zstd").partitionBy(PLACE).parquet(path)
    unstage(fresh)


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the table, under all columns that any delivery had."""
    return spark.read.option("mergeSchema", "true").parquet(path).drop(PLACE, *MARKS)
