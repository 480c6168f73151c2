"""Joins of facts with dimensions, calendars and periods.

Small sides are left to the optimiser, which broadcasts what it measures to be
small and splits skewed partitions of what it must shuffle. Intervals are turned
into days (or months), so every join here is an equi join.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def star_join(fact: DataFrame, dims: Mapping[str, DataFrame], how: str = "inner") -> DataFrame:
    """Fact with the attributes of its dimensions; the mapping is key column -> dimension."""
    for key, dim in dims.items():
        fact = fact.join(dim, key, how)
    return fact


def with_calendar(fact: DataFrame, cal: DataFrame) -> DataFrame:
    return fact.join(cal, "date")


def lookup(df: DataFrame, dim: DataFrame, key: str | list[str]) -> DataFrame:
    """Attributes of a dimension unique on ``key``; unmatched rows keep nulls."""
    return df.join(dim, key, "left")


def only_ids(df: DataFrame, ids: DataFrame, key: str | list[str]) -> DataFrame:
    return df.join(ids.select(*([key] if isinstance(key, str) else key)), key, "left_semi")


def new_members(df: DataFrame, dim: DataFrame, key: str | list[str]) -> DataFrame:
    """Distinct keys that the dimension does not hold yet."""
    cols = [key] if isinstance(key, str) else list(key)
    return df.select(*cols).na.drop(subset=cols).distinct().join(dim.select(*cols), cols, "left_anti")


def zones_without(zones: DataFrame, facts: Iterable[DataFrame], start, end) -> DataFrame:
    """Zones that none of the facts mentions inside the window."""
    seen = None
    for fact in facts:
        part = (
            fact.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
            .select("zone").distinct()
        )
        seen = part if seen is None else seen.unionByName(part)
    return zones.join(seen, "zone", "left_anti")


def ab_merge(a: DataFrame, b: DataFrame, key: str, value: str = "volume") -> DataFrame:
    """Both sides by key, 0 where one side lacks it.

    The sides are stacked and summed rather than outer-joined: one shuffle, with the
    partial sums made before it.
    """
    zero = F.lit(0).cast("long")
    stacked = a.select(key, F.col(value).alias("a"), zero.alias("b")).unionByName(
        b.select(key, zero.alias("a"), F.col(value).alias("b"))
    )
    return stacked.groupBy(key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def mobility_geo(fact: DataFrame, communes: DataFrame, departements: DataFrame) -> DataFrame:
    """Commune -> department -> region, volumes summed per commune before the joins."""
    return (
        fact.groupBy("id_commune").agg(F.sum("volume").alias("volume"))
        .join(communes, "id_commune")
        .join(departements, "id_departement", "left")
    )


def with_total(df: DataFrame, col: str, name: str = "total") -> DataFrame:
    """Every row with the sum over all rows, as a scalar subquery.

    The frame is read twice, so stage it first where it is costly to compute.
    """
    return df.withColumn(name, df.agg(F.sum(col).alias(name)).scalar())


def period_days(periods: DataFrame, *keep: str, start: str = "date_debut", end: str = "date_fin") -> DataFrame:
    """One row per period and day, both ends included."""
    return (
        periods.where(F.col(end) >= F.col(start))
        .select(*keep, F.explode(F.sequence(F.col(start), F.col(end))).alias("date"))
    )


def in_period(fact: DataFrame, periods: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Volume per period (``keys`` name it) and fact column ``by``.

    The first and the last day of all periods bound the scan of the fact, which is summed
    per day first: what meets the periods is days, not rows.
    """
    span = periods.agg(F.min("date_debut").alias("a"), F.max("date_fin").alias("b")).first()
    daily = fact.where(F.col("date").between(F.lit(span["a"]).cast("date"), F.lit(span["b"]).cast("date"))).groupBy("date", *by).agg(F.sum("volume").alias("volume"))
    return (
        daily.join(period_days(periods, *keys), "date")
        .groupBy(*keys, *by).agg(F.sum("volume").alias("volume"))
    )


def period_months(df: DataFrame, keep: list[str], start: str, end: str) -> DataFrame:
    """One row per interval and month it touches."""
    first = F.date_trunc("MM", F.col(start)).cast("date")
    months = F.sequence(first, F.col(end), F.expr("interval 1 month"))
    return df.where(F.col(end) >= F.col(start)).select(*keep, start, end, F.explode(months).alias("_month"))


def overlap_days(
    a: DataFrame, b: DataFrame, a_keys: list[str], b_keys: list[str],
    a_span: tuple[str, str], b_span: tuple[str, str],
) -> DataFrame:
    """Days shared by each pair of intervals that do overlap.

    Both sides are cut at month borders and joined on the month; the days of the
    cuts add up to the overlap. Column names of the two sides must differ.
    """
    cut = F.least(F.col(a_span[1]), F.col(b_span[1]), F.last_day("_month"))
    begin = F.greatest(F.col(a_span[0]), F.col(b_span[0]), F.col("_month"))
    return (
        period_months(a, a_keys, *a_span)
        .join(period_months(b, b_keys, *b_span), "_month")
        .select(*a_keys, *b_keys, (F.datediff(cut, begin) + 1).alias("jours"))
        .where(F.col("jours") > 0)
        .groupBy(*a_keys, *b_keys)
        .agg(F.sum("jours").alias("jours"))
    )


def max_overlap(
    a: DataFrame, b: DataFrame, a_key: str, b_key: str,
    a_span: tuple[str, str], b_span: tuple[str, str],
) -> DataFrame:
    """For each interval of ``a`` the interval of ``b`` sharing most days; ties go to the
    one that starts first."""
    pairs = overlap_days(a, b, [a_key], [b_key], a_span, b_span)
    begins = b.select(b_key, F.unix_date(F.col(b_span[0])).alias("_begin"))
    pairs = pairs.join(begins, b_key)
    best = F.struct(F.col("jours"), -F.col("_begin"), -F.col(b_key))
    return pairs.groupBy(a_key).agg(
        F.max_by(F.col(b_key), best).alias(b_key), F.max("jours").alias("jours")
    )


def overlap_counts(periods: DataFrame, key: str = "id_periode") -> DataFrame:
    """How many other periods of the same year each period overlaps.

    Counted, not paired: those that start by my end, minus those that ended before my
    start, minus myself. The running counts live on the days of one year, so the work
    grows with the periods and not with their pairs.
    """
    p = periods.where(F.col("date_fin") >= F.col("date_debut")).select(
        key, "annee", "date_debut", "date_fin"
    )
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    marks = p.select("annee", F.explode(F.array(
        F.struct(F.col("date_debut").alias("jour"), one.alias("debuts"), zero.alias("fins")),
        F.struct(F.col("date_fin").alias("jour"), zero.alias("debuts"), one.alias("fins")),
    )).alias("m")).select("annee", "m.*")
    per_day = marks.groupBy("annee", "jour").agg(
        F.sum("debuts").alias("debuts"), F.sum("fins").alias("fins")
    )
    upto = W.partitionBy("annee").orderBy("jour")
    before = upto.rowsBetween(W.unboundedPreceding, -1)
    running = per_day.select(
        "annee", "jour",
        F.sum("debuts").over(upto.rowsBetween(W.unboundedPreceding, 0)).alias("commences"),
        F.coalesce(F.sum("fins").over(before), zero).alias("finis"),
    )
    started = running.select("annee", F.col("jour").alias("date_fin"), "commences")
    ended = running.select("annee", F.col("jour").alias("date_debut"), "finis")
    return (
        p.join(started, ["annee", "date_fin"]).join(ended, ["annee", "date_debut"])
        .select(key, "annee", (F.col("commences") - F.col("finis") - 1).alias("nb_conflits"))
    )


def conflicts_with(periods: DataFrame, year: int, start, end, exclude_id=None, key: str = "id_periode") -> DataFrame:
    """Periods of a year that a proposed window would overlap."""
    hit = (
        (F.col("annee") == year)
        & (F.col("date_debut") <= F.lit(end).cast("date"))
        & (F.col("date_fin") >= F.lit(start).cast("date"))
    )
    if exclude_id is not None:
        hit = hit & (F.col(key) != exclude_id)
    return periods.where(hit)


def four_metrics(dim: DataFrame, nights: DataFrame, days: DataFrame, windows, key: str) -> DataFrame:
    """Nights and day visits per member for N and N-1, each fact summed before it is joined."""
    def summed(fact: DataFrame, name: str) -> DataFrame:
        return fact.where(windows.any_hit(F.col("date"))).groupBy(key).agg(*[
            F.sum(F.when(w.hit(F.col("date")), F.col("volume"))).alias(f"{name}_n{w.offset}")
            for w in windows
        ])

    out = dim.select(key).join(summed(nights, "nuitees"), key, "left").join(summed(days, "presences"), key, "left")
    return out.na.fill(0)
