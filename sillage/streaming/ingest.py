"""Incremental ingest: new files in, a merged fact out.

A batch is written as its own ``lot=<stream>-<batch id>`` folder, where the stream is
named by its checkpoint. Writing a batch again after a failure replaces that folder, so
nothing is counted twice, and streams with other checkpoints keep theirs beside it. Which row of a key
counts is decided when the fact is read, by a column of the data (the delivery
number), not by arrival: the final state is the same however files fall into batches.
``compact`` turns the batches into one plain fact. ``merge_into`` keeps a merged fact
instead: each batch rewrites only the partitions it touches, and merging a batch once more
changes nothing, so reading costs the fact and not its history.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sillage.session import stage, unstage

LOT = "lot"
#: rows of a merged fact that a task writes, about; a file each
TASK_ROWS = 1_000_000


def read_new_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", max_files: int | None = None, **options: str) -> DataFrame:
    """Stream of the files below a folder that its checkpoint has not seen."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.options(**options).load(path)


def append_lot(path: str, checkpoint: str, conform: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Batch function that cleans a micro-batch and writes it as its own lot."""
    def write(batch: DataFrame, batch_id: int) -> None:
        conform(batch).write.mode("overwrite").parquet(f"{path}/{LOT}={_stream_id(checkpoint)}-{batch_id}")

    return write


def _stream_id(checkpoint: str) -> str:
    return hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def upsert(key: Sequence[str], version: str, value: str = "volume") -> Callable[[DataFrame], DataFrame]:
    """Of each grain the latest version stays."""
    return lambda rows: rows.groupBy(*key).agg(F.max_by(F.struct(version, value, LOT), F.struct(version, value)).alias("_r")).select(*key, "_r.*")


def replace_by_date(key: Sequence[str], version: str, date: str = "date", value: str = "volume") -> Callable[[DataFrame], DataFrame]:
    """Of each date the latest version stays as a whole; what its lots say adds up when the fact is read."""
    def combine(rows: DataFrame) -> DataFrame:
        newest = rows.groupBy(date).agg(F.max(version).alias(version))
        return rows.join(newest, [date, version], "left_semi").groupBy(*key, version, LOT).agg(F.max(value).alias(value))

    return combine


def provisional(key: Sequence[str], confirmed: str, value: str = "volume") -> Callable[[DataFrame], DataFrame]:
    """A confirmed volume replaces a provisional one, which stays marked until then."""
    return lambda rows: rows.groupBy(*key).agg(F.max_by(F.struct(confirmed, value, LOT), F.struct(confirmed, value)).alias("_r")).select(*key, "_r.*")


def merge_into(path: str, checkpoint: str, combine: Callable[[DataFrame], DataFrame], conform: Callable[[DataFrame], DataFrame],
               partition: str = "annee", date: str = "date") -> Callable[[DataFrame, int], None]:
    """Batch function that merges a micro-batch into a fact partitioned by year.

    ``conform`` sums a batch to its grain. ``combine`` sees the stored rows of the touched
    partitions and the batch; as it picks rows and adds none up, a repeated batch changes
    nothing, also after a write that was cut short. One stream at a time writes a fact.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = conform(batch).withColumn(partition, F.year(date)).withColumn(LOT, F.lit(f"{_stream_id(checkpoint)}-{batch_id}"))
        rows = batch_rows = stage(rows, "batch")
        names = [r[0] for r in rows.select(partition).distinct().collect()]
        stored = _stored(batch.sparkSession, path)
        if stored is not None:
            hit = F.col(partition).isin([n for n in names if n is not None])
            rows = stored.where(hit | F.col(partition).isNull() if None in names else hit).select(*rows.columns).unionByName(rows)
        merged = stage(combine(rows).withColumn(partition, F.year(date)), "merge")
        # tasks of so many rows, whatever a partition holds: a writer sorts its rows by partition
        tasks = merged.count() // TASK_ROWS + 1
        even = merged.repartitionByRange(tasks, F.col(partition), F.xxhash64(*merged.columns))
        even.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        unstage(batch_rows, merged)

    return write


def ingest_fact(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    """Process everything that is new with a batch function and stop."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest(stream: DataFrame, path: str, checkpoint: str, conform: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Process everything that is new and stop; run it again for the next delivery."""
    ingest_fact(stream, checkpoint, append_lot(path, checkpoint, conform))


def read_lots(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def latest(lots: DataFrame, key: Sequence[str], version: str, value: str = "volume") -> DataFrame:
    """Upsert: the latest version of each grain counts."""
    newest = F.struct(F.col(version), F.col(value))
    return lots.groupBy(*key).agg(F.max_by(value, newest).alias(value))


def latest_dates(lots: DataFrame, key: Sequence[str], version: str, date: str = "date", value: str = "volume") -> DataFrame:
    """Replace by date: of each date only its latest version counts, as a whole."""
    newest = lots.groupBy(date).agg(F.max(version).alias(version))
    current = lots.join(newest, [date, version], "left_semi")
    return current.groupBy(*key).agg(F.sum(value).alias(value))


def provisional_state(lots: DataFrame, key: Sequence[str], confirmed: str, value: str = "volume") -> DataFrame:
    """Provisional rows until a confirmed one arrives; the confirmed volume then counts."""
    best = F.struct(F.col(confirmed), F.col(value))
    return lots.groupBy(*key).agg(
        F.max_by(value, best).alias(value), (~F.bool_or(confirmed)).alias("is_provisional")
    )


def compact(state: DataFrame, path: str, by: str = "date") -> None:
    """The merged state as one fact, sorted by date inside its files, in a new folder."""
    state.sortWithinPartitions(by).write.mode("errorifexists").parquet(path)
