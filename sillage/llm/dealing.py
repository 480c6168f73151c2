"""Places and blocks of rows without a task that sees a whole table or a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sillage.session import stage


def partitions(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered(rows: DataFrame, key: str, order: list[Column], name: str = "numbered") -> DataFrame:
    """``rows`` with ``_at``, the place 0, 1, ... of each row among those of its key.

    The rows are cut into ranges of (key, order), so that one key may hold any share of them; a row's place is its
    place in its range behind the sizes of the ranges before. Rows without a key are one group. Rows that tie in
    all of ``order`` get places in any sequence.
    """
    ranged = rows.repartitionByRange(partitions(rows), F.col(key), *order).withColumn("_part", F.spark_partition_id())
    staged = stage(ranged, name)
    sizes = staged.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_of")).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_key", "_of", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = staged.withColumn("_at", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)) - 1)
    return (
        inside.join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")))
        .withColumn("_at", F.col("_before") + F.col("_at")).drop("_key", "_of", "_before", "_part")
    )


def blocked(rows: DataFrame, size: Column, most: int, name: str = "blocked") -> DataFrame:
    """``rows`` with ``_block`` and ``_row``, a number of its own: rows of one block weigh ``most`` and one row more at most.

    Sizes add up inside the partitions the rows lie in, and the partitions' totals in one place.
    """
    staged = stage(rows.select("*", size.cast("long").alias("_size"), F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")), name)
    sizes = staged.groupBy(F.col("_part").alias("_of")).agg(F.sum("_size").alias("_n"))
    earlier = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_of", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.sum("_size").over(Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    at = staged.withColumn("_inside", inside).join(before, F.col("_part") == F.col("_of"))
    return at.withColumn("_block", F.floor((F.col("_before") + F.col("_inside")) / most)).drop("_of", "_before", "_inside", "_part", "_size")
