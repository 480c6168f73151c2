"""Comparisons of two freely chosen periods, and what they say about places."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sillage import fixed_values as fv
from sillage.functions.change import pct_change, size_bucket, trend_class
from sillage.operators.aggregates import sum_or_zero
from sillage.operators.topk import top_k_per, top_with_total
from sillage.plans.windows import Windows


@dataclass(frozen=True)
class Selection:
    """One side of a comparison: a zone and its window."""

    zone: str
    start: str
    end: str

    @property
    def condition(self) -> Column:
        return (F.col("zone") == self.zone) & F.col("date").between(
            F.lit(date.fromisoformat(self.start)), F.lit(date.fromisoformat(self.end))
        )


def _sides(fact: DataFrame, a: Selection, b: Selection, by: Sequence[str] = ()) -> DataFrame:
    """Volumes of both sides in one scan."""
    return fact.where(a.condition | b.condition).groupBy(*by).agg(
        sum_or_zero(F.when(a.condition, F.col("volume")), "a"),
        sum_or_zero(F.when(b.condition, F.col("volume")), "b"),
    )


def window_pair(fact: DataFrame, windows: Windows, key: str) -> DataFrame:
    """Volume per place now (a) and before (b), out of one scan."""
    date = F.col("date")
    now, before = windows[0], windows[1]
    return fact.where(windows.first(2).any_hit(date)).groupBy(key).agg(
        sum_or_zero(F.when(now.hit(date), F.col("volume")), "a"),
        sum_or_zero(F.when(before.hit(date), F.col("volume")), "b"),
    )


def compare_ab(facts: dict[str, DataFrame], a: Selection, b: Selection) -> DataFrame:
    """Figures of A and B with difference and evolution, one row per named fact."""
    out = None
    for name, fact in facts.items():
        row = _sides(fact, a, b).select(
            F.lit(name).alias("indicateur"), "a", "b", (F.col("a") - F.col("b")).alias("difference"),
            pct_change(F.col("a"), F.col("b"), "D").alias("evolution_pct"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def compare_departments(fact: DataFrame, a: Selection, b: Selection, k: int) -> DataFrame:
    """k departments by their larger side, with both volumes and the overall totals."""
    sides = _sides(fact, a, b, ["departement"])
    order = [F.desc(F.greatest("a", "b")), F.col("departement")]
    kept = top_with_total(sides, ["departement"], ["a", "b"], order, k)
    total = {c: F.max(F.when(F.col("_total"), F.col(c))).over(W.partitionBy()) for c in ("a", "b")}
    return kept.withColumns({"total_a": total["a"], "total_b": total["b"]}).where(~F.col("_total")).select(
        "rang", "departement", "a", "b", (F.col("a") - F.col("b")).alias("difference"),
        pct_change(F.col("a"), F.col("b"), "C").alias("evolution_pct"), "total_a", "total_b",
    )


def trends(pair: DataFrame) -> DataFrame:
    """Places with their change and trend class; ``pair`` has a (now) and b (before)."""
    cur, prev = F.col("a"), F.col("b")
    kind = trend_class(cur, prev)
    change = (
        F.when(kind == "nouveau", F.lit(100.0)).when(kind == "disparu", F.lit(-100.0))
        .otherwise(pct_change(cur, prev, "A"))
    )
    return pair.select("*", kind.alias("tendance"), change.alias("evolution")).where(F.col("tendance").isNotNull())


def size_buckets(pair: DataFrame) -> DataFrame:
    """Places of each size class: number, volumes, mean evolution."""
    return (
        pair.where(F.col("a") > 0).withColumn("taille", size_bucket(F.col("a")))
        .groupBy("taille").agg(
            F.count(F.lit(1)).alias("destinations"), F.sum("a").alias("a"), F.sum("b").alias("b"),
            # decimals add up the same in any order
            F.round(F.avg(pct_change(F.col("a"), F.col("b"), "D").cast("decimal(20,1)")).cast("double"), 1)
            .alias("evolution_moyenne"),
        )
    )


def emerging(trend: DataFrame, minimum: int = fv.EMERGING_MIN) -> DataFrame:
    return trend.where((F.col("tendance") == "nouveau") & (F.col("a") > minimum))


def losses(trend: DataFrame, minimum: int = fv.LOSS_MIN) -> DataFrame:
    big = (F.col("a") > minimum) | (F.col("b") > minimum)
    return trend.where(F.col("tendance").isin("fort_declin", "disparu") & big)


def _direction(change: Column) -> Column:
    return F.when(change > 0, "hausse").when(change < 0, "baisse").otherwise("stable")


def direction_counts(pair: DataFrame) -> DataFrame:
    change = pct_change(F.col("a"), F.col("b"), "C")
    return (
        pair.where((F.col("a") > 0) | (F.col("b") > 0))
        .groupBy(_direction(change).alias("sens")).agg(F.count(F.lit(1)).alias("destinations"))
    )


def gainers_losers(pair: DataFrame, key: str, k: int = 5) -> DataFrame:
    """k strongest rises and k strongest falls."""
    change = pct_change(F.col("a"), F.col("b"), "C")
    rows = pair.select(key, "a", "b", change.alias("evolution"), _direction(change).alias("sens"))
    rows = rows.where(F.col("sens") != "stable")
    return top_k_per(rows, ["sens"], [F.desc(F.abs("evolution")), F.col(key)], k)
