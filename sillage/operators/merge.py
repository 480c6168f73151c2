"""Merging a batch into a table that is keyed by its grain.

Each mode stacks target and batch and aggregates by the key: one shuffle, partial
results before it, and no join that a heavy key could unbalance. The result is a
new DataFrame; ``merge_partitions_into`` puts it on disk for the partitions a batch touches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sillage.session import remove, stage, unstage

_SIDE = "_side"


def _stack(target: DataFrame, src: DataFrame) -> DataFrame:
    return target.withColumn(_SIDE, F.lit(0)).unionByName(
        src.withColumn(_SIDE, F.lit(1)), allowMissingColumns=True
    )


def _values(df: DataFrame, key: Sequence[str], order: str | None) -> list[str]:
    return [c for c in df.columns if c not in key and c != order]


def _rank(order: str | None, values: list[str]) -> Column:
    """Total order among rows of a key: side, then batch order, then the values themselves."""
    parts = [F.col(_SIDE)] + ([F.col(order)] if order else []) + [F.col(v) for v in values]
    return F.struct(*parts)


def merge_overwrite(target: DataFrame, src: DataFrame, key: Sequence[str], order: str | None = None) -> DataFrame:
    """The batch wins; inside the batch the row latest by ``order``."""
    values = _values(target, key, order)
    best = F.max_by(F.struct(*values), _rank(order, values)).alias("_row")
    return _stack(target, src).groupBy(*key).agg(best).select(*key, "_row.*")


def merge_keep(target: DataFrame, src: DataFrame, key: Sequence[str], order: str | None = None) -> DataFrame:
    """What is there stays; of new keys the row first by ``order``."""
    values = _values(target, key, order)
    best = F.min_by(F.struct(*values), _rank(order, values)).alias("_row")
    return _stack(target, src).groupBy(*key).agg(best).select(*key, "_row.*")


def merge_add(target: DataFrame, src: DataFrame, key: Sequence[str], col: str = "volume") -> DataFrame:
    """Volumes of equal keys add up."""
    return target.unionByName(src).groupBy(*key).agg(F.sum(col).alias(col))


def merge_flag(
    target: DataFrame, src: DataFrame, key: Sequence[str], col: str = "volume",
    flag: str = "is_provisional",
) -> DataFrame:
    """Keep the stored volume, mark every key of the batch as provisional."""
    staged = src.withColumn(flag, F.lit(True))
    rank = F.struct(F.col(_SIDE), F.col(col))
    return _stack(target, staged).groupBy(*key).agg(
        F.min_by(col, rank).alias(col), F.bool_or(flag).alias(flag)
    )


def merge_dim(target: DataFrame, src: DataFrame, key: str) -> DataFrame:
    """Attributes of the batch replace stored ones, except where the batch has null."""
    cols = [c for c in target.columns if c != key]
    newest = [
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(F.col(_SIDE), F.col(c)))).alias(c)
        for c in cols
    ]
    return _stack(target, src).groupBy(key).agg(*newest)


def replace_dates(target: DataFrame, src: DataFrame, date: str = "date") -> DataFrame:
    """Every date of the batch is replaced as a whole."""
    return target.join(src.select(date).distinct(), date, "left_anti").unionByName(src)


def purge_between(df: DataFrame, start, end, date: str = "date") -> DataFrame:
    return df.where(~F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def purge_year(df: DataFrame, year: int, date: str = "date") -> DataFrame:
    return purge_between(df, f"{year}-01-01", f"{year}-12-31", date)


def drop_year(spark: SparkSession, table: str, year: int, partition: str = "annee") -> None:
    """Purge of a catalog table that is partitioned by year: the partition goes, no row is read."""
    spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({partition} = {int(year)})")


def purge_report(df: DataFrame, year: int, date: str = "date") -> DataFrame:
    """Rows a purge of the year removes, quarter by quarter."""
    hit = F.col(date).between(F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year}-12-31").cast("date"))
    return df.where(hit).groupBy(F.quarter(date).alias("trimestre")).agg(F.count(F.lit(1)).alias("lignes"))


def retain(df: DataFrame, col: str, days: int, asof) -> DataFrame:
    """Rows at most ``days`` older than the as-of date."""
    return df.where(F.col(col) >= F.date_sub(F.lit(asof).cast("date"), days))


def drop_loaded_on(df: DataFrame, col: str, asof) -> DataFrame:
    return df.where(F.col(col).cast("date") != F.lit(asof).cast("date"))


def after_cutoff(df: DataFrame, col: str, cutoff) -> DataFrame:
    return df.where(F.col(col) > F.lit(cutoff).cast("date"))


def cutoff_report(df: DataFrame, col: str, cutoff) -> DataFrame:
    late = F.col(col) > F.lit(cutoff).cast("date")
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(late).alias("gardees"),
        F.count_if(F.coalesce(~late, F.lit(True))).alias("retirees"),
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def difference(a: DataFrame, b: DataFrame, key: str | list[str]) -> DataFrame:
    cols = [key] if isinstance(key, str) else key
    return a.select(*cols).distinct().join(b.select(*cols), cols, "left_anti")


def key_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).unionByName(b.select(key)).distinct()


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in set(b.columns)]


def write_fact(df: DataFrame, path: str, partition: str = "annee", date: str = "date") -> None:
    """Fact on disk by year, sorted by zone inside the files so that row groups can be skipped.

    The rebalance lets AQE cut a year that outgrows a task and join years that are small.
    """
    if partition not in df.columns:
        df = df.withColumn(partition, F.year(date))
    (
        df.hint("rebalance", F.col(partition))
        .sortWithinPartitions(partition, "zone", date)
        .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(partition)
        .option("compression", "zstd").parquet(path)
    )


def replace_all(df: DataFrame, path: str, *partitions: str) -> None:
    """The whole table replaced, partitions that the new rows lack included; one file per partition that fits a task.

    The old rows go before the new ones are written; ``publish`` keeps them until then.
    """
    if partitions:
        df = df.hint("rebalance", *[F.col(p) for p in partitions])
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


# --- a table that readers see whole ------------------------------------------------------
_VERSION = "v="


def _versions(spark: SparkSession, root: str) -> list[tuple[int, bool]]:
    """Numbers of the versions below a folder and whether each was written to its end."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(root)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    named = [f.getPath() for f in store.listStatus(folder) if f.getPath().getName().startswith(_VERSION)]
    return sorted((int(p.getName().removeprefix(_VERSION)), store.exists(hadoop.Path(p, "_SUCCESS"))) for p in named)


def current_version(spark: SparkSession, root: str) -> str | None:
    """Folder of the latest whole version of a table."""
    whole = [number for number, done in _versions(spark, root) if done]
    return f"{root.rstrip('/')}/{_VERSION}{whole[-1]}" if whole else None


def publish(df: DataFrame, root: str, *partitions: str, view: str | None = None, keep: int = 2) -> str:
    """The whole table replaced by a new version in a folder of its own.

    A version counts once its job has ended, which is one step: a job that fails leaves the version before, and the
    rows may be made of that version. ``view`` names a view that is switched to the new version. Of the whole
    versions the last ``keep`` stay, for readers that still read them.
    """
    spark = df.sparkSession
    there = _versions(spark, root)
    path = f"{root.rstrip('/')}/{_VERSION}{there[-1][0] + 1 if there else 0}"
    if partitions:
        df = df.hint("rebalance", *[F.col(p) for p in partitions])
    writer = df.write.mode("errorifexists").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    if view:
        spark.read.parquet(path).createOrReplaceTempView(view)
    whole = [number for number, done in there if done]
    for number, done in there:
        if not done or number not in whole[len(whole) - keep + 1:]:
            remove(spark, f"{root.rstrip('/')}/{_VERSION}{number}")
    return path


def read_current(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(current_version(spark, root))


# --- additive merge that may be repeated --------------------------------------------------
LEDGER = "_batches"


def add_batch_into(path: str, src: DataFrame, key: Sequence[str], batch: str, col: str = "volume", partition: str = "annee") -> None:
    """Adds a batch's volumes to a partitioned table, once, however often the batch is given.

    Each partition carries the names of the batches it holds, in the column ``LEDGER`` of its rows, which are replaced
    together with the volumes they belong to. A merge that was cut short between partitions, or is run again as a
    whole, adds the batch only where its name is missing. The driver learns the partitions a batch touches.
    """
    spark = src.sparkSession
    src = stage(src, "batch")
    names = [row[0] for row in src.select(partition).distinct().collect()]

    def among(values: list) -> Column:
        listed = F.col(partition).isin([v for v in values if v is not None])
        return listed | F.col(partition).isNull() if None in values else listed

    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    stored = spark.read.parquet(path) if there else None
    if stored is None:
        held: dict = {}
    elif LEDGER in stored.columns:
        held = {r[0]: list(r[1] or []) for r in stored.where(among(names)).groupBy(partition).agg(F.first(LEDGER)).collect()}
    else:
        stored, held = stored.withColumn(LEDGER, F.array().cast("array<string>")), {}
    pending = [n for n in names if batch not in held.get(n, [])]
    if pending:
        fresh = src.where(among(pending)).select(*key, col)
        rows = fresh if stored is None else stored.where(among(pending)).select(*key, col).unionByName(fresh)
        sums = rows.groupBy(*key).agg(F.sum(col).alias(col))
        ledgers = spark.createDataFrame([(n, sorted({*held.get(n, []), batch})) for n in pending], f"_of {src.schema[partition].dataType.simpleString()}, {LEDGER} array<string>")
        merged = stage(sums.join(F.broadcast(ledgers), F.col(partition).eqNullSafe(F.col("_of"))).drop("_of"), "merge")
        (
            merged.hint("rebalance", F.col(partition)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy(partition).parquet(path)
        )
        unstage(merged)
    unstage(src)


def merge_partitions_into(path: str, src: DataFrame, key: Sequence[str], mode: str = "overwrite", partition: str = "annee") -> None:
    """Merge a batch into a partitioned table, reading and writing only the partitions it touches.

    Their names come to the driver, which lists the partitions of the table anyway,
    so that the scan is pruned before it starts; rows without a partition value are
    one partition more. The merged rows are written to a
    fresh folder first, since a plan must not overwrite what it reads; a lost
    executor then only repeats tasks of one write. A merge that was cut short can be
    run again, except in mode ``add``: see ``add_batch_into``.
    """
    spark = src.sparkSession
    # read twice below
    src = stage(src, "batch")
    names = [row[0] for row in src.select(partition).distinct().collect()]
    hit = F.col(partition).isin([n for n in names if n is not None])
    if None in names:
        hit = hit | F.col(partition).isNull()
    touched = spark.read.parquet(path).where(hit).select(*src.columns)
    if mode == "replace":
        merged = replace_dates(touched, src)
    else:
        merged = {"overwrite": merge_overwrite, "keep": merge_keep, "add": merge_add}[mode](touched, src, key)
    merged = stage(merged, "merge")
    (
        merged.hint("rebalance", F.col(partition)).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition).parquet(path)
    )
    unstage(src, merged)
