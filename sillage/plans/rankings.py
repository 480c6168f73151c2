"""Rankings of origins and destinations against the previous year.

A ranking sums its fact once, per member, for both windows. Grand totals ride along
as one more row of those sums, so nothing behind them is computed twice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sillage.functions.change import pct_change, share
from sillage.functions.text import to_csp
from sillage.operators.aggregates import preagg
from sillage.operators.filters import drop_sentinels, not_sentinel
from sillage.operators.topk import pad_to_k, ranked_top_k, top_k_per, top_with_total
from sillage.plans.windows import Windows


def two_windows(fact: DataFrame, windows: Windows, by: Sequence[str]) -> DataFrame:
    """Sums per member in N and N-1; null where a window has no row of the member."""
    pair = windows.first(2)
    return fact.where(pair.any_hit(F.col("date"))).groupBy(*by).agg(*[
        F.sum(F.when(w.hit(F.col("date")), F.col("volume"))).alias(f"n{w.offset}") for w in pair
    ])


def _order(member: str) -> list[Column]:
    return [F.desc("n0"), F.col(member)]


def comparison_table(fact: DataFrame, windows: Windows, member: str, k: int) -> DataFrame:
    """k ranked members of N with their N-1, padded to k rows, and a row for the rest."""
    return compare_sums(two_windows(fact, windows, [member]), member, k)


def compare_sums(sums: DataFrame, member: str, k: int) -> DataFrame:
    zero = F.lit(0).cast("long")
    kept = top_with_total(sums, [member], ["n0", "n1"], _order(member), k, F.col("n0").isNotNull())
    # k ranks and the total, also where there are fewer members: k + 1 rows from here on
    rows = pad_to_k(kept, k + 1).select(
        "rang", member, (F.col("rang") == k + 1).alias("_autre"), F.col("_total").isNotNull().alias("_reel"),
        F.coalesce("n0", zero).alias("n0"), F.coalesce("n1", zero).alias("n1"),
    )
    together = W.partitionBy()
    cells = []
    for n in ("n0", "n1"):
        total = F.max(F.when(F.col("_autre"), F.col(n))).over(together)
        top = F.coalesce(F.sum(F.when(~F.col("_autre"), F.col(n))).over(together), zero)
        rest = F.greatest(total - top, zero)
        cells += [F.when(F.col("_autre"), rest).otherwise(F.col(n)).alias(n), total.alias(f"t_{n}")]
    label = (
        F.when(F.col("_autre"), "Autre").when(~F.col("_reel"), "Données N/A")
        .otherwise(F.coalesce(F.nullif(F.col(member), F.lit("")), F.lit("Inconnu")))
    )
    filled = rows.select("rang", "_autre", (F.col("_reel") | F.col("_autre")).alias("_reel"), label.alias(member), *cells)
    return filled.select(
        F.when(F.col("_autre"), "Autre").otherwise(F.col("rang").cast("string")).alias("rang"), member, "n0", "n1",
        F.when(F.col("_reel"), pct_change(F.col("n0"), F.col("n1"), "B")).alias("delta_pct"),
        share(F.col("n0"), F.col("t_n0")).alias("part_pct"),
        share(F.col("n1"), F.col("t_n1")).alias("part_pct_n1"),
    )


def rank_members(fact: DataFrame, windows: Windows, member: str, k: int) -> DataFrame:
    """Comparison table of a dimension, its sentinel members left out."""
    return comparison_table(drop_sentinels(fact, member), windows, member, k)


def rank_regions(fact: DataFrame, windows: Windows, k: int, regions: DataFrame | None = None) -> DataFrame:
    """Regions from their own fact, or rolled up from the department fact."""
    if regions is not None:
        fact = (
            preagg(fact, ["date", "departement"])
            .join(regions.select("departement", "region"), "departement")
        )
    return rank_members(fact, windows, "region", k)


def rank_csp(fact: DataFrame, windows: Windows, k: int = 3, group: Column | None = None) -> DataFrame:
    """Socio-professional groups: segments are summed first, then mapped and summed."""
    sums = two_windows(drop_sentinels(fact, "segment"), windows, ["segment"])
    csp = to_csp(F.col("segment")) if group is None else group
    grouped = sums.withColumn("csp", csp).where(F.col("csp").isNotNull()).groupBy("csp").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")
    )
    return compare_sums(grouped, "csp", k)


def origins(
    fact: DataFrame, windows: Windows, by: Sequence[str], k: int, *,
    share_of: str = "all", digits: int = 1, policy: str = "A", keep: str = "current",
    with_sentinels: bool = False,
) -> DataFrame:
    """Top k origins of N with N-1, change and share.

    ``share_of`` all rows or the ``returned`` ones; ``keep`` members with volume in
    the ``current`` window or in ``either``; ``with_sentinels`` counts the pre-summed
    members in the denominator though they are never listed.
    """
    member = by[0]
    zero = F.lit(0).cast("long")
    sums = two_windows(fact if with_sentinels else drop_sentinels(fact, member), windows, by)
    alive = F.coalesce(F.col("n0") > 0, F.lit(False))
    if keep == "either":
        alive = alive | F.coalesce(F.col("n1") > 0, F.lit(False))
    if with_sentinels:
        alive = alive & not_sentinel(F.col(member))
    sums = sums.select(*by, F.coalesce("n0", zero).alias("n0"), F.coalesce("n1", zero).alias("n1"))
    kept = top_with_total(sums, by, ["n0", "n1"], _order(member), k, alive)
    counted = F.col("_total") if share_of == "all" else ~F.col("_total")
    whole = F.sum(F.when(counted, F.col("n0"))).over(W.partitionBy())
    return kept.withColumn("t", whole).where(~F.col("_total")).select(
        "rang", *by, "n0", "n1",
        pct_change(F.col("n0"), F.col("n1"), policy).alias("delta_pct"),
        share(F.col("n0"), F.col("t"), digits).alias("part_pct"),
    )


def destinations(fact: DataFrame, windows: Windows, k: int, member: str = "commune") -> DataFrame:
    """Communes most visited, against the year before; the unknown commune is no destination."""
    return origins(
        fact.where(F.col("id_commune") > 0), windows, [member], k, share_of="returned", policy="E"
    )


def top_destinations(fact: DataFrame, by: Sequence[str], level: str, k: int = 10) -> DataFrame:
    """First k places of a level inside each group of ``by``."""
    sums = preagg(fact, [*by, level])
    order = [F.desc("volume"), F.col(level)]
    return top_k_per(sums, by, order, k) if by else ranked_top_k(sums, order, k)


def top_members(fact: DataFrame, member: str, k: int) -> DataFrame:
    return ranked_top_k(preagg(fact, [member]), [F.desc("volume"), F.col(member)], k)


def stay_distribution(stays: DataFrame, windows: Windows, by: Sequence[str] = ()) -> DataFrame:
    """Volume, share and change per length of stay, within each group of ``by``.

    Shares divide by the group's total over its lengths of stay, a short list.
    """
    return _lengths(two_windows(stays, windows, [*by, "nb_nuits"]), by)


def stay_distributions(stays: DataFrame, windows: Windows, groups: Mapping[str, Column], member: str = "provenance") -> DataFrame:
    """``stay_distribution`` of several groups of visitors in one scan; ``groupe`` names the group.

    A group is a condition on ``member``, and groups may overlap: sums per member and length, a short list,
    are dealt to all groups they belong to.
    """
    sums = two_windows(stays, windows, [member, "nb_nuits"])
    belongs = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in groups.items())))
    dealt = sums.select(F.explode(belongs).alias("groupe"), "nb_nuits", "n0", "n1")
    return _lengths(dealt.groupBy("groupe", "nb_nuits").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), ["groupe"])


def _lengths(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """Shares and changes of sums per length of stay."""
    sums = sums.where(F.col("n0").isNotNull())
    total = F.sum("n0").over(W.partitionBy(*by))
    prev = F.coalesce("n1", F.lit(0).cast("long"))
    return sums.withColumn("_t", total).select(
        *by, "nb_nuits", F.col("n0").alias("volume"), prev.alias("volume_n1"),
        share(F.col("n0"), F.col("_t"), empty=None).alias("part_pct"),
        pct_change(F.col("n0"), prev, "A").alias("delta_pct"),
    )


def stay_combined(distribution: DataFrame, side: str, national: str, foreign: str, k: int = 5) -> DataFrame:
    """Both sides of a distribution next to each other: the k lengths with the largest
    summed share, and the others."""
    zero = F.lit(0).cast("long")

    def cells(member: str, name: str) -> list[Column]:
        mine = F.col(side) == member
        return [
            F.sum(F.when(mine, F.col("part_pct"))).alias(f"part_{name}"),
            F.sum(F.when(mine, F.col("volume")).otherwise(zero)).alias(f"volume_{name}"),
            F.sum(F.when(mine, F.col("volume_n1")).otherwise(zero)).alias(f"volume_n1_{name}"),
        ]

    both = distribution.where(F.col(side).isin(national, foreign))
    merged = both.groupBy("nb_nuits").agg(*cells(national, "fr"), *cells(foreign, "intl"))
    score = F.coalesce("part_fr", F.lit(0.0)) + F.coalesce("part_intl", F.lit(0.0))
    # lengths of stay are a short list, so they can be ranked together
    place = F.row_number().over(W.orderBy(F.desc("score"), "nb_nuits"))
    ranked = merged.withColumn("score", F.round(score, 1)).withColumn("rang", place)
    lines = ranked.withColumn("duree", F.when(F.col("rang") > k, "Autres").otherwise(F.col("nb_nuits").cast("string")))
    sums = lines.groupBy("duree").agg(
        F.min("rang").alias("rang"),
        *[F.round(F.sum(F.coalesce(f"part_{s}", F.lit(0.0))), 1).alias(f"part_{s}") for s in ("fr", "intl")],
        *[F.sum(f"{v}_{s}").alias(f"{v}_{s}") for v in ("volume", "volume_n1") for s in ("fr", "intl")],
    )
    return sums.select(
        "duree", F.least("rang", F.lit(k + 1)).alias("rang"), "part_fr", "part_intl",
        "volume_fr", "volume_intl",
        pct_change(F.col("volume_fr"), F.col("volume_n1_fr"), "A").alias("delta_fr"),
        pct_change(F.col("volume_intl"), F.col("volume_n1_intl"), "A").alias("delta_intl"),
    )


def origins_all(regions: DataFrame, countries: DataFrame) -> DataFrame:
    """Regions and countries in one list: (origine, valeur)."""
    return (
        regions.select(F.col("region").alias("origine"), F.col("n0").alias("valeur"))
        .unionByName(countries.select(F.col("pays").alias("origine"), F.col("n0").alias("valeur")))
        .orderBy(F.desc("valeur"), "origine")
    )


def load_profile(fact: DataFrame, dim: str) -> DataFrame:
    return fact.groupBy(dim).agg(F.count(F.lit(1)).alias("lignes"), F.sum("volume").alias("volume"))


def daily_average(fact: DataFrame, windows: Windows) -> DataFrame:
    """Volume per day of each window, to the unit."""
    return fact.where(windows.any_hit(F.col("date"))).agg(*[
        F.round(F.coalesce(F.sum(F.when(w.hit(F.col("date")), F.col("volume"))), F.lit(0)) / F.lit(w.days))
        .cast("long").alias(f"n{w.offset}")
        for w in windows
    ])


__all__ = [
    "comparison_table", "compare_sums", "daily_average", "destinations", "load_profile", "origins",
    "origins_all", "rank_csp", "rank_members", "rank_regions", "stay_combined", "stay_distribution", "stay_distributions",
    "top_destinations", "top_members", "two_windows",
]
