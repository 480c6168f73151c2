"""Key figures for a window and the same window in earlier years.

Facts come with their dimension names. Every figure is a conditional sum, so one
scan answers all years, and several figures over the same fact share that scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sillage.functions.change import pct_change
from sillage.operators.aggregates import sum_or_zero, weighted_mean_column
from sillage.operators.filters import Roles, provenance_rule
from sillage.operators.joins import period_days
from sillage.operators.topk import top_k_per
from sillage.plans.rankings import stay_distributions
from sillage.plans.windows import Windows
from sillage.session import stage

DATE, VOLUME = "date", "volume"


def value_columns(windows: Windows) -> list[str]:
    return [f"n{w.offset}" for w in windows]


def _in_windows(fact: DataFrame, windows: Windows) -> DataFrame:
    return fact.where(windows.any_hit(F.col(DATE)))


def yearly_sums(windows: Windows, condition: Column | None = None, prefix: str = "n") -> list[Column]:
    cells = []
    for w in windows:
        hit = w.hit(F.col(DATE)) if condition is None else w.hit(F.col(DATE)) & condition
        cells.append(sum_or_zero(F.when(hit, F.col(VOLUME)), f"{prefix}{w.offset}"))
    return cells


def kpi_total(fact: DataFrame, windows: Windows) -> DataFrame:
    """Volume per window: one row, one column per offset."""
    return _in_windows(fact, windows).agg(*yearly_sums(windows))


@dataclass(frozen=True)
class Figure:
    number: int
    label: str
    condition: Column
    unit: str = "Nuitées"
    note: str = ""


def kpi_totals(fact: DataFrame, windows: Windows, figures: Sequence[Figure], by: Sequence[str] = ("provenance",)) -> DataFrame:
    """Several figures over one fact in one scan: (numero, indicateur, n0.., unite, remarque).

    The rows are summed per day and per column the conditions look at; the many
    conditional sums then read those few rows.
    """
    wanted = _in_windows(fact, windows).where(reduce(lambda a, b: a | b, [f.condition for f in figures]))
    sums = wanted.groupBy(DATE, *by).agg(F.sum(VOLUME).alias(VOLUME))
    cells = [c for i, f in enumerate(figures) for c in yearly_sums(windows, f.condition, f"f{i}_")]
    return _figure_rows(sums.agg(*cells), windows, figures)


def _figure_rows(wide: DataFrame, windows: Windows, figures: Sequence[Figure]) -> DataFrame:
    rows = [
        F.struct(
            F.lit(f.number).alias("numero"), F.lit(f.label).alias("indicateur"),
            *[F.col(f"f{i}_{w.offset}").alias(f"n{w.offset}") for w in windows],
            F.lit(f.unit).alias("unite"), F.lit(f.note).alias("remarque"),
        )
        for i, f in enumerate(figures)
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def long_by_offset(df: DataFrame, windows: Windows, keys: Sequence[str]) -> DataFrame:
    """(keys, offset, volume) out of one column per offset."""
    cells = F.array(*[F.struct(F.lit(w.offset).alias("offset"), F.col(f"n{w.offset}").alias(VOLUME)) for w in windows])
    return df.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")


def kpi_topk_sum(fact: DataFrame, windows: Windows, member: str, k: int) -> DataFrame:
    """Sum over the k largest members, found anew in every window."""
    per_member = _in_windows(fact, windows).groupBy(member).agg(*yearly_sums(windows))
    ranked = top_k_per(
        long_by_offset(per_member, windows, [member]), ["offset"], [F.desc(VOLUME), F.col(member)], k
    )
    return ranked.agg(*[
        sum_or_zero(F.when(F.col("offset") == w.offset, F.col(VOLUME)), f"n{w.offset}") for w in windows
    ])


def kpi_period(fact: DataFrame, periods: DataFrame, codes: Sequence[str], year: int, back: int = 4) -> DataFrame:
    """Volume inside named periods, per code, for a year and those before it.

    The outermost dates of each year, a handful, bound the scan of the fact, which is
    summed per day before it meets the days of the periods; a code without a period or
    without visits shows 0.
    """
    spark = fact.sparkSession
    wanted = periods.where(F.col("code_periode").isin(*codes) & F.col("annee").between(year - back, year))
    days = period_days(wanted, "code_periode", "annee")
    spans = wanted.groupBy("annee").agg(F.min("date_debut").alias("a"), F.max("date_fin").alias("b")).where("a <= b").collect()
    inside = reduce(lambda x, y: x | y, [F.col(DATE).between(F.lit(s["a"]), F.lit(s["b"])) for s in spans], F.lit(False))
    daily = fact.where(inside).groupBy(DATE).agg(F.sum(VOLUME).alias(VOLUME))
    found = daily.join(days, DATE).groupBy("code_periode").agg(*[
        sum_or_zero(F.when(F.col("annee") == year - k, F.col(VOLUME)), f"n{k}") for k in range(back + 1)
    ])
    asked = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in codes])).alias("code_periode"))
    return asked.join(found, "code_periode", "left").na.fill(0)


def _daily(fact: DataFrame, windows: Windows) -> DataFrame:
    return _in_windows(fact, windows).groupBy(DATE).agg(F.sum(VOLUME).alias(VOLUME))


def peak_cells(windows: Windows, prefix: str = "") -> list[Column]:
    """Largest day of each window and its date, over daily sums."""
    cells = []
    for w in windows:
        best = F.struct(F.col(VOLUME), (-F.unix_date(DATE)).alias("tot"))
        peak = F.max(F.when(w.hit(F.col(DATE)), best))
        cells.append(F.coalesce(peak[VOLUME], F.lit(0).cast("long")).alias(f"{prefix}n{w.offset}"))
        cells.append(F.date_from_unix_date(-peak["tot"]).alias(f"{prefix}date{w.offset}"))
    return cells


def day_cells(days: dict[int, date | None], prefix: str = "") -> list[Column]:
    """Volume on one day per offset; null where the offset has no such day."""
    cells = []
    for offset, day in days.items():
        value = (
            F.coalesce(F.sum(F.when(F.col(DATE) == F.lit(day), F.col(VOLUME))), F.lit(0).cast("long"))
            if day is not None else F.max(F.lit(None).cast("long"))
        )
        cells.append(value.alias(f"{prefix}n{offset}"))
    return cells


def _on_days(fact: DataFrame, days: dict[int, date | None]) -> DataFrame:
    asked = [d for d in days.values() if d is not None]
    rows = fact.where(F.col(DATE).isin(*[F.lit(d) for d in asked]) if asked else F.lit(False))
    dates = [F.lit(d).cast("date").alias(f"date{o}") for o, d in days.items()]
    return rows.agg(*day_cells(days)).select("*", *dates)


def kpi_day(fact: DataFrame, windows: Windows, month: int, day: int) -> DataFrame:
    """Volume on a fixed day of the year, for the windows that hold it."""
    return _on_days(fact, {w.offset: w.fixed_day(month, day) for w in windows})


def kpi_saturday(fact: DataFrame, windows: Windows, n: int) -> DataFrame:
    """Volume on the n-th Saturday of each window."""
    return _on_days(fact, {w.offset: w.nth_saturday(n) for w in windows})


def kpi_peak(fact: DataFrame, windows: Windows) -> DataFrame:
    """Largest day of each window with its date; among equal days the earliest."""
    return _daily(fact, windows).agg(*peak_cells(windows))


@dataclass(frozen=True)
class DayFigure:
    """A figure that needs only the sums per day: the total, the peak or given days."""

    number: int
    label: str
    days: dict[int, date | None] | None = None
    peak: bool = False

    def cells(self, windows: Windows, prefix: str) -> list[Column]:
        if self.peak:
            return peak_cells(windows, prefix)
        if self.days is not None:
            return day_cells(self.days, prefix)
        return yearly_sums(windows, prefix=f"{prefix}n")

    def date_column(self, offset: int, prefix: str) -> Column:
        if self.peak:
            return F.col(f"{prefix}date{offset}")
        return F.lit(self.days[offset] if self.days else None).cast("date")


def day_figures(fact: DataFrame, windows: Windows, figures: Sequence[DayFigure]) -> DataFrame:
    """Figures out of one pass over the fact: (numero, indicateur, n0, date0, n1, ...).

    The fact is summed per day once; everything else reads those few rows. The days
    of a figure lie inside the windows.
    """
    wide = _daily(fact, windows).agg(*[c for i, f in enumerate(figures) for c in f.cells(windows, f"f{i}_")])
    rows = [
        F.struct(
            F.lit(f.number).alias("numero"), F.lit(f.label).alias("indicateur"),
            *[F.col(f"f{i}_n{w.offset}").alias(f"n{w.offset}") for w in windows],
            *[f.date_column(w.offset, f"f{i}_").alias(f"date{w.offset}") for w in windows],
        )
        for i, f in enumerate(figures)
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def mean_cells(windows: Windows, condition: Column | None = None, prefix: str = "n") -> list[Column]:
    cells = []
    for w in windows:
        hit = w.hit(F.col(DATE)) if condition is None else w.hit(F.col(DATE)) & condition
        mean = weighted_mean_column(F.when(hit, F.col("nb_nuits")), F.when(hit, F.col(VOLUME)))
        cells.append(F.coalesce(mean, F.lit(0.0)).alias(f"{prefix}{w.offset}"))
    return cells


def kpi_mean_stay(stays: DataFrame, windows: Windows) -> DataFrame:
    """Mean nights weighted by volume, per window."""
    return _in_windows(stays, windows).agg(*mean_cells(windows))


def kpi_mean_stays(stays: DataFrame, windows: Windows, figures: Sequence[Figure], by: Sequence[str] = ("provenance",)) -> DataFrame:
    """Mean stays of several groups of visitors in one scan, summed per day and length first."""
    sums = _in_windows(stays, windows).groupBy(DATE, *by, "nb_nuits").agg(F.sum(VOLUME).alias(VOLUME))
    cells = [c for i, f in enumerate(figures) for c in mean_cells(windows, f.condition, f"f{i}_")]
    return _figure_rows(sums.agg(*cells), windows, figures)


def evolution(df: DataFrame, windows: Windows, baseline: str = "reference") -> DataFrame:
    """Percent change columns next to the values n0..nk.

    ``reference`` compares the reference year with each earlier year, ``chained``
    each year with the one before it.
    """
    values = value_columns(windows)
    for i, earlier in enumerate(values[1:]):
        later = values[0] if baseline == "reference" else values[i]
        df = df.withColumn(f"evolution_{i + 1}", pct_change(F.col(later), F.col(earlier), "A"))
    return df


def evolution_long(yearly: DataFrame, keys: Sequence[str] = (), value: str = VOLUME) -> DataFrame:
    """Chained change over (keys, annee, value) rows, a few years per key."""
    previous = F.lag(value).over(W.partitionBy(*keys).orderBy("annee"))
    return yearly.withColumn("precedent", previous).withColumn(
        "evolution", pct_change(F.col(value), F.col("precedent"), "A")
    )


def labelled(df: DataFrame, windows: Windows, number: int, label: str, unit: str, note: str = "") -> DataFrame:
    """A one-row figure in the shape of the indicator table."""
    return as_indicators(df.withColumns({
        "numero": F.lit(number), "indicateur": F.lit(label), "unite": F.lit(unit), "remarque": F.lit(note),
    }), windows)


def as_indicators(df: DataFrame, windows: Windows) -> DataFrame:
    """Figures of any kind in the shape of the indicator table."""
    day = F.col("date0") if "date0" in df.columns else F.lit(None).cast("date")
    return df.select(
        "numero", "indicateur", *[F.col(c).cast("double").alias(c) for c in value_columns(windows)],
        "unite", "remarque", day.alias("date"),
    )


def indicator_table(figures: Sequence[DataFrame], windows: Windows, baseline: str = "reference") -> DataFrame:
    """Figures under each other with their evolutions."""
    rows = reduce(lambda a, b: a.unionByName(b), figures)
    return evolution(rows, windows, baseline)


def _distribution_rows(stays: DataFrame, windows: Windows, blocks: Mapping[str, Column]) -> DataFrame:
    """Lengths of stay with their share and change for the visitors of each block, in the shape of the indicator table."""
    lengths = stay_distributions(stays, windows, blocks)
    values = {c: F.lit(None).cast("double") for c in value_columns(windows)}
    values |= {"n0": F.col("volume").cast("double"), "n1": F.col("volume_n1").cast("double")}
    changes = {f"evolution_{i}": F.lit(None).cast("double") for i in range(1, len(windows))} | {"evolution_1": F.col("delta_pct")}
    return lengths.select(
        F.col("groupe").alias("block"), F.lit(None).cast("int").alias("numero"), F.col("nb_nuits").cast("string").alias("indicateur"),
        *[v.alias(c) for c, v in values.items()], F.lit("Nuitées").alias("unite"), F.lit("").alias("remarque"),
        F.lit(None).cast("date").alias("date"), *[v.alias(c) for c, v in changes.items()], "part_pct",
    )


def block_a(nights: DataFrame, day_visits: DataFrame, windows: Windows, roles: Roles) -> DataFrame:
    """Dashboard block A in long form: ``block`` tells the indicators from the three distributions of stays.

    Each fact is scanned once: the nights (with departement, pays and nb_nuits) are summed per day and
    member and staged, the day visits are summed per day, and all figures read those sums.
    """
    national, foreign = provenance_rule("national", roles), provenance_rule("foreign", roles)
    outside = provenance_rule("not_local", roles)
    sums = _in_windows(nights, windows).groupBy(DATE, "provenance", "departement", "pays", "nb_nuits").agg(F.sum(VOLUME).alias(VOLUME))
    nights = stage(sums, "nights")
    guests = day_figures(day_visits.where(outside), windows, [
        DayFigure(10, "Excursionnistes, pic", peak=True),
        DayFigure(16, "Excursionnistes totaux"),
        DayFigure(17, "Présences 2e samedi", {w.offset: w.nth_saturday(2) for w in windows}),
        DayFigure(18, "Présences 3e samedi", {w.offset: w.nth_saturday(3) for w in windows}),
    ]).withColumns({"unite": F.lit("Présences"), "remarque": F.lit("")})
    figures = [
        as_indicators(kpi_totals(nights, windows, [
            Figure(1, "Nuitées totales", provenance_rule("visitors", roles)),
            Figure(2, "Nuitées françaises", national),
            Figure(3, "Nuitées internationales", foreign),
        ]), windows),
        labelled(kpi_topk_sum(nights.where(national), windows, "departement", 15), windows, 4, "Départements, top 15", "Nuitées"),
        labelled(kpi_topk_sum(nights.where(foreign), windows, "pays", 5), windows, 5, "Pays, top 5", "Nuitées"),
        as_indicators(guests, windows),
        as_indicators(kpi_mean_stays(nights, windows, [
            Figure(21, "Durée moyenne totale", outside, "Nuits"),
            Figure(22, "Durée moyenne française", national, "Nuits"),
            Figure(23, "Durée moyenne internationale", foreign, "Nuits"),
        ]), windows),
    ]
    indicators = indicator_table(figures, windows).withColumns({"block": F.lit("indicateurs"), "part_pct": F.lit(None).cast("double")})
    blocks = {"durees": outside, "durees_fr": national, "durees_intl": foreign}
    return indicators.unionByName(_distribution_rows(nights, windows, blocks))


def block_d7(day_visits: DataFrame, windows: Windows, fixed_days: Sequence[tuple[int, int]] = ()) -> DataFrame:
    """Day-visit block: total, peak, first three Saturdays and fixed days, N and N-1."""
    pair = windows.first(2)
    figures = [DayFigure(1, "Total"), DayFigure(2, "Pic activité", peak=True)]
    for n in (1, 2, 3):
        figures.append(DayFigure(len(figures) + 1, f"{n}e samedi", {w.offset: w.nth_saturday(n) for w in pair}))
    for month, day in fixed_days:
        figures.append(DayFigure(len(figures) + 1, f"{day:02d}/{month:02d}", {w.offset: w.fixed_day(month, day) for w in pair}))
    return day_figures(day_visits, pair, figures).select(
        F.col("indicateur").alias("rang"), F.col("date0").alias("date"), "n0", F.col("date1").alias("date_n1"), "n1",
        pct_change(F.col("n0"), F.col("n1"), "B").alias("delta_pct"),
    )
