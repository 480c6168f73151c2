"""Pages of an ordered table, also far back.

``topk.page`` lets every task hand over all rows before the page, which suits first pages. ``PagedRows`` lays the rows
out once in ranges of the order and counts them; a page then reads the ranges it lies in.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillage.session import shared_dir

RANGE = "_range"


@dataclass(frozen=True)
class PagedRows:
    """Rows in ranges of their order: where they lie, which columns order them (a leading ``-`` for descending), and how
    many rows lie before each range."""

    rows: DataFrame
    order: tuple[str, ...]
    before: tuple[tuple[int, int, int], ...]

    @property
    def total(self) -> int:
        return sum(n for _, _, n in self.before)

    def _sorting(self) -> list[Column]:
        return [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in self.order]

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows offset to offset + limit - 1 of the order; no range before the page is read."""
        hit = [(number, start) for number, start, n in self.before if start < offset + limit and offset < start + n]
        if not hit:
            return self.rows.drop(RANGE).limit(0)
        inside = self.rows.where(F.col(RANGE).isin([number for number, _ in hit]))
        return inside.orderBy(*self._sorting()).offset(offset - hit[0][1]).limit(limit).drop(RANGE)

    def after(self, last: Sequence, limit: int) -> DataFrame:
        """The rows that follow the row whose ordering values are ``last``: the next page without counting."""
        names = [c.lstrip("-") for c in self.order]
        same = [F.col(n).eqNullSafe(F.lit(v)) for n, v in zip(names, last)]
        # nulls come first where values ascend, last where they descend
        beyond = [
            (F.col(n).isNotNull() if v is None else F.col(n) > F.lit(v)) if n == c else (F.lit(False) if v is None else F.col(n).isNull() | (F.col(n) < F.lit(v)))
            for c, n, v in zip(self.order, names, last)
        ]
        follows = [reduce(lambda a, b: a & b, [*same[:i], beyond[i]]) for i in range(len(names))]
        return self.rows.where(reduce(lambda a, b: a | b, follows)).orderBy(*self._sorting()).limit(limit).drop(RANGE)


def paged(df: DataFrame, order: Sequence[str], ranges: int) -> PagedRows:
    """Lays ``df`` out in about ``ranges`` ranges of a total order (columns that tell all rows apart).

    The driver learns the size of each range. Choose so many ranges that a task can sort one.
    """
    spark = df.sparkSession
    sorting = [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order]
    path = shared_dir(spark, "pages")
    laid = df.repartitionByRange(ranges, *sorting).withColumn(RANGE, F.spark_partition_id()).sortWithinPartitions(*sorting)
    laid.write.partitionBy(RANGE).parquet(path)
    rows = spark.read.parquet(path).select(*df.columns, RANGE)
    before, start = [], 0
    for number, n in sorted(tuple(r) for r in rows.groupBy(RANGE).agg(F.count("*").alias("n")).collect()):
        before.append((number, start, n))
        start += n
    return PagedRows(rows, tuple(order), tuple(before))
