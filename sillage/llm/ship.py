"""The package for the executors' Python."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from sillage.session import shared_dir

_shipped: set[str] = set()
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def ship(spark: SparkSession) -> SparkSession:
    """Have Spark hand the package's source to every Python worker, once per application.

    Task functions import their modules by name, so what a worker keeps between tasks (tables, words
    already encoded) stays there. The archive lies in the shared work folder. Texts go to the workers in
    batches of few rows, as they may be long.
    """
    for key, value in _BATCHES.items():
        spark.conf.set(key, value)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package, archive = Path(__file__).resolve().parent.parent, io.BytesIO()
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark, 'code')}/{package.name}.zip")
        target = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        target.write(archive.getvalue())
        target.close()
        spark.sparkContext.addPyFile(path.toString())
        _shipped.add(app)
    return spark
