"""Sums, profiles and peaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillage.functions import dates


def sum_or_zero(col: str | Column, name: str) -> Column:
    return F.coalesce(F.sum(col), F.lit(0).cast("long")).alias(name)


def preagg(df: DataFrame, keys: Sequence[str], col: str = "volume") -> DataFrame:
    """One row per fact grain."""
    return df.groupBy(*keys).agg(F.sum(col).alias(col))


def total(df: DataFrame, col: str = "volume", name: str = "total") -> DataFrame:
    return df.agg(sum_or_zero(col, name))


def by_dim(df: DataFrame, dim: str, col: str = "volume") -> DataFrame:
    return preagg(df, [dim], col).orderBy(F.desc(col), dim)


def split_sum(df: DataFrame, keys: Sequence[str], flag: str = "is_provisional", col: str = "volume") -> DataFrame:
    """All, main and provisional volumes side by side."""
    return df.groupBy(*keys).agg(
        sum_or_zero(col, "total"),
        sum_or_zero(F.when(~F.col(flag), F.col(col)), "principal"),
        sum_or_zero(F.when(F.col(flag), F.col(col)), "provisoire"),
    )


def profile(df: DataFrame, flag: str = "is_provisional", col: str = "volume", distinct: str = "date") -> DataFrame:
    return df.groupBy(flag).agg(
        F.count(F.lit(1)).alias("lignes"),
        F.sum(col).alias("total"),
        F.avg(col).alias("moyenne"),
        F.min(col).alias("mini"),
        F.max(col).alias("maxi"),
        F.countDistinct(distinct).alias("distincts"),
    )


def daily(df: DataFrame) -> DataFrame:
    return split_sum(df, ["date"])


def weighted_mean(df: DataFrame, n: str, v: str, keys: Sequence[str] = (), name: str = "moyenne") -> DataFrame:
    """Mean of ``n`` weighted by ``v``. A null ``n`` weighs in the denominator only."""
    return df.groupBy(*keys).agg(weighted_mean_column(F.col(n), F.col(v)).alias(name))


def weighted_mean_column(n: Column, v: Column) -> Column:
    return F.round(F.sum(n * v) / F.nullif(F.sum(v), F.lit(0)), 2)


def concat_ordered(
    df: DataFrame, keys: Sequence[str], col: str, order: str | None = None,
    name: str = "liste", descending: bool = False,
) -> DataFrame:
    """Distinct values of a column per key as one text, ordered by ``order`` or by themselves.

    Values are made distinct before they are gathered, so what a key gathers is the
    members of a dimension (names of periods, years), however many rows it has.
    """
    outermost = F.max if descending else F.min
    members = df.groupBy(*keys, F.col(col).alias("_v")).agg(outermost(order or col).alias("_o"))
    pairs = F.sort_array(F.collect_list(F.struct("_o", "_v")), asc=not descending)
    return members.groupBy(*keys).agg(
        F.array_join(F.transform(pairs, lambda p: p["_v"].cast("string")), ", ").alias(name)
    )


def rollup_region(fact: DataFrame, departements: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Department fact -> region fact, summed per department before the lookup."""
    return (
        preagg(fact, [*keys, "departement"])
        .join(departements.select("departement", "region"), "departement")
        .groupBy(*keys, "region").agg(F.sum("volume").alias("volume"))
    )


def build_calendar(df: DataFrame, flags: Sequence[str] = ("vacances_a", "vacances_b", "vacances_c", "ferie")) -> DataFrame:
    """One row per date seen: a flag is set if any row sets it."""
    out = df.where(F.col("date").isNotNull()).groupBy("date").agg(
        *[F.max(F.coalesce(F.col(f), F.lit(0))).alias(f) for f in flags],
        F.min("jour_semaine").alias("jour_semaine"),
    )
    return out.withColumns(dates.calendar_parts(F.col("date")))


def first_known(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """A non-null value of each column per key: the smallest, so that it is always the same."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.min(c).alias(c) for c in cols])


def epci_of_commune(fact: DataFrame) -> DataFrame:
    """Lowest known EPCI of each commune, 0 where the facts know none."""
    known = F.min(F.when(F.col("id_epci") != 0, F.col("id_epci")))
    return fact.groupBy("id_commune").agg(F.coalesce(known, F.lit(0)).alias("id_epci"))


def by_month(df: DataFrame, date: str = "date") -> DataFrame:
    return df.groupBy(F.date_format(date, "yyyy-MM").alias("mois")).agg(F.count(F.lit(1)).alias("lignes"))


def years(df: DataFrame, date: str = "date") -> DataFrame:
    return df.select(F.year(date).alias("annee")).distinct().orderBy(F.desc("annee"))


def bounds(df: DataFrame, date: str = "date") -> DataFrame:
    return df.agg(F.min(date).alias("date_min"), F.max(date).alias("date_max"))


def peak_day(df: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Day with the largest volume; among equal days the earliest."""
    per_day = preagg(df, [*group, "date"])
    order = F.struct(F.col("volume"), -F.unix_date("date"))
    return per_day.groupBy(*group).agg(
        F.max_by("date", order).alias("date"), F.max("volume").alias("volume")
    )
