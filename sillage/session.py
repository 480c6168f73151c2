"""Session settings and the shared work folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# work folders of this driver, in the order in which they were named
_made: list[str] = []

# what the jobs count on; all of it can be set on a running session
_RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join even where that costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings for a session that somebody else has built."""
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "sillage", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs are written for; ``conf`` uses ``__`` for dots.

    Sizes that follow the cluster (shuffle partitions, bytes per partition) are the caller's: see the README.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        **_RUNTIME,
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder the cluster names in ``spark.checkpoint.dir``.

    Where none is set, the folder lies below ``spark.sql.warehouse.dir``, which executors share as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read back.

    For what several steps read: it is computed once, its lineage ends there, and a
    lost executor costs a re-read instead of a recomputation.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged._staged_path = path
    return staged


def remove(spark: SparkSession, path: str) -> None:
    """A work folder that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the work folders named inside at its end, when the result has been written elsewhere."""
    mark = len(_made)
    try:
        yield
    finally:
        for path in _made[mark:]:
            remove(spark, path)
        del _made[mark:]


def unstage(*frames: DataFrame) -> None:
    """Gives the space of staged frames back, once all that reads them has been written."""
    for frame in frames:
        remove(frame.sparkSession, frame._staged_path)
