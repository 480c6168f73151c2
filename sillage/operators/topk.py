"""Ordering, limits and ranks.

Ranks over everything are taken after the limit, and ranks per group carry their
bound in the filter, so Spark prunes each partition to k rows before it shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def ranked_top_k(df: DataFrame, order: Sequence[Column], k: int, name: str = "rang") -> DataFrame:
    """First k rows with their rank; the rank sees k rows only."""
    return top_k(df, order, k).withColumn(name, F.row_number().over(W.orderBy(*order)))


def top_with_total(
    sums: DataFrame, by: Sequence[str], values: Sequence[str], order: Sequence[Column], k: int,
    listed: Column | None = None, name: str = "rang",
) -> DataFrame:
    """First k rows of per-member sums, and the total over all members as rank k + 1.

    The total travels as one more row of the same aggregate, so the sums behind it are
    computed once; what follows sees k + 1 rows. ``listed`` says which members may be
    ranked, the total counts all of them.
    """
    rolled = sums.groupingSets([list(by), []], *by).agg(
        *[F.sum(v).alias(v) for v in values], (F.grouping_id() > 0).alias("_total")
    )
    if listed is not None:
        rolled = rolled.where(F.col("_total") | listed)
    ranking = [F.desc("_total"), *order]
    kept = rolled.orderBy(*ranking).limit(k + 1)
    place = F.row_number().over(W.orderBy(*ranking)) - 1
    return kept.withColumn(name, F.when(F.col("_total"), F.lit(k + 1)).otherwise(place))


def top_k_per(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "rang"
) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) <= k)


def sum_top_k(df: DataFrame, order: Sequence[Column], k: int, col: str, name: str) -> DataFrame:
    return top_k(df, order, k).agg(F.coalesce(F.sum(col), F.lit(0).cast("long")).alias(name))


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """One page under a total order; only offset + limit rows leave a partition."""
    return df.orderBy(*order).offset(offset).limit(limit)


def pad_to_k(df: DataFrame, k: int, rank: str = "rang") -> DataFrame:
    """Ranks 1..k, with null columns where the report has fewer rows."""
    ranks = df.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias(rank))
    return ranks.join(df, rank, "left")


def custom_order(col: Column, values: Sequence[str]) -> Column:
    """Position in a given list; values outside it come last."""
    pos = F.array_position(F.array(*[F.lit(v) for v in values]), col)
    return F.when(pos > 0, pos).otherwise(F.lit(len(values) + 1).cast("long"))


def order_custom(df: DataFrame, col: str, values: Sequence[str], *then: str, name: str = "ordre") -> DataFrame:
    """Rows in the order of a given list, then by further columns; the position is kept."""
    return df.withColumn(name, custom_order(F.col(col), values)).orderBy(name, *then)


def order_multi(df: DataFrame, descending: Sequence[str], *then: str) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in descending], *then)


def first_by_priority(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row of each key that comes first under ``order``.

    An aggregate rather than a window: each partition keeps one row per key before
    the shuffle, so a key that holds a third of the rows costs no more than the rest.
    """
    values = [c for c in df.columns if c not in key]
    best = F.min_by(F.struct(*values), F.struct(*order)).alias("_row")
    return df.groupBy(*key).agg(best).select(*key, "_row.*")


def argmax(df: DataFrame, key: Sequence[str], value: str, by: Sequence[Column], name: str | None = None) -> DataFrame:
    return df.groupBy(*key).agg(F.max_by(F.col(value), F.struct(*by)).alias(name or value))


def next_value(df: DataFrame, group: Sequence[str], order: Sequence[Column], col: str, name: str) -> DataFrame:
    return df.withColumn(name, F.lead(col).over(W.partitionBy(*group).orderBy(*order)))


def prev_value(df: DataFrame, group: Sequence[str], order: Sequence[Column], col: str, name: str) -> DataFrame:
    return df.withColumn(name, F.lag(col).over(W.partitionBy(*group).orderBy(*order)))


def count_rows(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))
