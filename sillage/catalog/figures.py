"""K: key figures over five summers."""

from __future__ import annotations

from sillage.catalog.base import (
    EXCURSIONISTS, FOREIGN, NATIONAL, OUTSIDE, SUMMER, TOURISTS, VISITORS, ZONE, R, big, change, hit, part, register,
    rnd, with_visits, yearly,
)
from sillage.operators.filters import provenance_rule, where_dims
from sillage.plans import kpi
from sillage.plans.windows import Windows
from sillage.sources.binding import OFFICIAL_SQL, official_periods, visits

YEAR = Windows.yearly("2000-01-01", "2000-12-31", back=4)
CODES = ("weekend_paques", "weekend_ascension", "weekend_pentecote")


def nights(spark, sf, rule: str | None = "visitors", *extra):
    fact = where_dims(visits(spark, sf, "date", "zone", "categorie", "provenance", "volume", *extra), ZONE, R.touriste)
    return fact.where(provenance_rule(rule, R)) if rule else fact


def day_visits(spark, sf, rule: str | None = "not_local", *extra):
    fact = where_dims(visits(spark, sf, "date", "zone", "categorie", "provenance", "volume", *extra), ZONE, R.excursionniste)
    return fact.where(provenance_rule(rule, R)) if rule else fact


def _total_sql(who: str) -> str:
    return with_visits(f"SELECT {yearly()} FROM visits WHERE {who}")


@register("K01_kpi_nights", _total_sql(f"{TOURISTS} AND {VISITORS}"))
def _(spark, sf):
    return kpi.kpi_total(nights(spark, sf), SUMMER)


@register("K02_kpi_nights_french", _total_sql(f"{TOURISTS} AND {NATIONAL}"))
def _(spark, sf):
    return kpi.kpi_total(nights(spark, sf, "national"), SUMMER)


@register("K03_kpi_nights_foreign", _total_sql(f"{TOURISTS} AND {FOREIGN}"))
def _(spark, sf):
    return kpi.kpi_total(nights(spark, sf, "foreign"), SUMMER)


def topk_sum_sql(member: str, k: int, who: str, windows=SUMMER) -> str:
    cells = ", ".join(
        f"{big(f'(SELECT coalesce(sum(v), 0) FROM (SELECT sum(volume) AS v FROM visits WHERE {who} AND {hit(w.offset, windows)} GROUP BY {member} ORDER BY v DESC, {member} LIMIT {k}))')} AS n{w.offset}"
        for w in windows
    )
    return f"SELECT {cells}"


@register("K04_kpi_top_departments", with_visits(topk_sum_sql("departement", 15, f"{TOURISTS} AND {NATIONAL}")))
def _(spark, sf):
    return kpi.kpi_topk_sum(nights(spark, sf, "national", "departement"), SUMMER, "departement", 15)


@register("K05_kpi_top_countries", with_visits(topk_sum_sql("pays", 5, f"{TOURISTS} AND {FOREIGN}")))
def _(spark, sf):
    return kpi.kpi_topk_sum(nights(spark, sf, "foreign", "pays"), SUMMER, "pays", 5)


def period_sql(who: str) -> str:
    codes = ", ".join(f"('{c}')" for c in CODES)
    cells = ", ".join(f"{big(f'coalesce(sum(CASE WHEN annee = {2000 - k} THEN volume END), 0)')} AS n{k}" for k in range(5))
    return with_visits(
        f"""SELECT c.code_periode, {cells} FROM (VALUES {codes}) c(code_periode)
        LEFT JOIN ({OFFICIAL_SQL}) p ON p.code_periode = c.code_periode AND annee BETWEEN 1996 AND 2000
        LEFT JOIN (SELECT date, volume FROM visits WHERE {who}) v ON v.date BETWEEN date_debut AND date_fin
        GROUP BY c.code_periode"""
    )


@register("K06_kpi_period_nights", period_sql(f"{TOURISTS} AND {VISITORS}"))
def _(spark, sf):
    return kpi.kpi_period(nights(spark, sf), official_periods(spark, sf), CODES, 2000)


def days_sql(who: str, days: dict[int, object]) -> str:
    cells = ", ".join(
        (f"{big(f'''coalesce(sum(CASE WHEN date = DATE '{d}' THEN volume END), 0)''')} AS n{o}, DATE '{d}' AS date{o}"
         if d else f"max(CAST(NULL AS BIGINT)) AS n{o}, CAST(NULL AS DATE) AS date{o}")
        for o, d in days.items()
    )
    return with_visits(f"SELECT {cells} FROM visits WHERE {who}")


@register("K07_kpi_day_may", days_sql(f"{TOURISTS} AND {VISITORS}", {k: f"{2000 - k}-05-01" for k in range(5)}))
def _(spark, sf):
    return kpi.kpi_day(nights(spark, sf), YEAR, 5, 1)


PEAK_SQL = ", ".join(
    f"""{big(f'coalesce((SELECT max(v) FROM days WHERE {hit(w.offset)}), 0)')} AS n{w.offset},
    (SELECT date FROM days WHERE {hit(w.offset)} ORDER BY v DESC, date LIMIT 1) AS date{w.offset}"""
    for w in SUMMER
)


def peak_sql(who: str) -> str:
    return with_visits(
        f", days AS (SELECT date, sum(volume) AS v FROM visits WHERE {who} GROUP BY date) SELECT {PEAK_SQL}"
    )


@register("K10_kpi_peak", peak_sql(f"{EXCURSIONISTS} AND {OUTSIDE}"))
def _(spark, sf):
    return kpi.kpi_peak(day_visits(spark, sf), SUMMER)


@register("K15_kpi_daytrips", with_visits(" UNION ALL ".join(
    f"SELECT CAST({n} AS INT) AS numero, '{label}' AS indicateur, {yearly(condition=cond)}, 'Présences' AS unite, '' AS remarque "
    f"FROM visits WHERE {EXCURSIONISTS}"
    for n, label, cond in ((11, "Excursionnistes français", NATIONAL), (15, "Excursionnistes internationaux", FOREIGN))
)))
def _(spark, sf):
    return kpi.kpi_totals(day_visits(spark, sf, None), SUMMER, [
        kpi.Figure(11, "Excursionnistes français", provenance_rule("national", R), "Présences"),
        kpi.Figure(15, "Excursionnistes internationaux", provenance_rule("foreign", R), "Présences"),
    ])


@register("K16_kpi_daytrips_total", _total_sql(f"{EXCURSIONISTS} AND {OUTSIDE}"))
def _(spark, sf):
    return kpi.kpi_total(day_visits(spark, sf), SUMMER)


# second and third Saturday of 21 June .. 22 September, 2000 back to 1996
SECOND = {0: "2000-07-01", 1: "1999-07-03", 2: "1998-07-04", 3: "1997-06-28", 4: "1996-06-29"}
THIRD = {0: "2000-07-08", 1: "1999-07-10", 2: "1998-07-11", 3: "1997-07-05", 4: "1996-07-06"}


@register("K17_kpi_saturday_2", days_sql(f"{EXCURSIONISTS} AND {OUTSIDE}", SECOND))
def _(spark, sf):
    return kpi.kpi_saturday(day_visits(spark, sf), SUMMER, 2)


@register("K18_kpi_saturday_3", days_sql(f"{EXCURSIONISTS} AND {OUTSIDE}", THIRD))
def _(spark, sf):
    return kpi.kpi_saturday(day_visits(spark, sf), SUMMER, 3)


@register("K19_kpi_period_daytrips", period_sql(f"{EXCURSIONISTS} AND {OUTSIDE}"))
def _(spark, sf):
    return kpi.kpi_period(day_visits(spark, sf), official_periods(spark, sf), CODES, 2000)


@register("K23_kpi_fixed_days", days_sql(
    f"{EXCURSIONISTS} AND {OUTSIDE}", {k: f"{2000 - k}-08-15" for k in range(5)}
))
def _(spark, sf):
    return kpi.kpi_day(day_visits(spark, sf), SUMMER, 8, 15)


@register("K23_kpi_fixed_days_july", days_sql(f"{EXCURSIONISTS} AND {OUTSIDE}", {k: f"{2000 - k}-07-14" for k in range(5)}))
def _(spark, sf):
    return kpi.kpi_day(day_visits(spark, sf), SUMMER, 7, 14)


@register("K19_kpi_day_may", days_sql(f"{EXCURSIONISTS} AND {OUTSIDE}", {k: f"{2000 - k}-05-01" for k in range(5)}))
def _(spark, sf):
    return kpi.kpi_day(day_visits(spark, sf), YEAR, 5, 1)


def mean_sql(who: str) -> str:
    ratio = "sum(CASE WHEN {h} THEN nb_nuits * volume END) / nullif(sum(CASE WHEN {h} THEN volume END), 0)"
    cells = ", ".join(f"coalesce({rnd(ratio.format(h=hit(w.offset)), 2)}, 0.0::DOUBLE) AS n{w.offset}" for w in SUMMER)
    return with_visits(f"SELECT {cells} FROM visits WHERE {TOURISTS} AND {who}")


@register("K25_kpi_mean_stay", mean_sql(OUTSIDE))
def _(spark, sf):
    return kpi.kpi_mean_stay(nights(spark, sf, "not_local", "nb_nuits"), SUMMER)


@register("K25_kpi_mean_stay_french", mean_sql(NATIONAL))
def _(spark, sf):
    return kpi.kpi_mean_stay(nights(spark, sf, "national", "nb_nuits"), SUMMER)


@register("K25_kpi_mean_stay_foreign", mean_sql(FOREIGN))
def _(spark, sf):
    return kpi.kpi_mean_stay(nights(spark, sf, "foreign", "nb_nuits"), SUMMER)


def evolutions(baseline: str = "reference", windows=SUMMER) -> str:
    out = []
    for k in range(1, len(windows)):
        later = "n0" if baseline == "reference" else f"n{k - 1}"
        out.append(f"{change(later, f'n{k}', 'A')} AS evolution_{k}")
    return ", ".join(out)


def figure_sql(number: int, label: str, unit: str, inner: str, dated: bool = False) -> str:
    cells = ", ".join(f"CAST(n{k} AS DOUBLE) AS n{k}" for k in range(5))
    day = "date0" if dated else "CAST(NULL AS DATE)"
    return (
        f"SELECT CAST({number} AS INT) AS numero, '{label}' AS indicateur, {cells}, '{unit}' AS unite, "
        f"'' AS remarque, {day} AS date FROM ({inner})"
    )


TABLE_SQL = " UNION ALL ".join([
    figure_sql(1, "Nuitées totales", "Nuitées", _total_sql(f"{TOURISTS} AND {VISITORS}")),
    figure_sql(10, "Excursionnistes, pic", "Présences", peak_sql(f"{EXCURSIONISTS} AND {OUTSIDE}"), dated=True),
    figure_sql(25, "Durée moyenne", "Nuits", mean_sql(OUTSIDE)),
])


@register("K30_indicator_table", f"SELECT *, {evolutions()} FROM ({TABLE_SQL})")
def _(spark, sf):
    return kpi.indicator_table([
        kpi.labelled(kpi.kpi_total(nights(spark, sf), SUMMER), SUMMER, 1, "Nuitées totales", "Nuitées"),
        kpi.labelled(kpi.kpi_peak(day_visits(spark, sf), SUMMER), SUMMER, 10, "Excursionnistes, pic", "Présences"),
        kpi.labelled(kpi.kpi_mean_stay(nights(spark, sf, "not_local", "nb_nuits"), SUMMER), SUMMER, 25, "Durée moyenne", "Nuits"),
    ], SUMMER)


def _guests(extra: str) -> str:
    return f"{EXCURSIONISTS} AND {extra}"


BLOCK_A_SQL = " UNION ALL ".join([
    figure_sql(1, "Nuitées totales", "Nuitées", _total_sql(f"{TOURISTS} AND {VISITORS}")),
    figure_sql(2, "Nuitées françaises", "Nuitées", _total_sql(f"{TOURISTS} AND {NATIONAL}")),
    figure_sql(3, "Nuitées internationales", "Nuitées", _total_sql(f"{TOURISTS} AND {FOREIGN}")),
    figure_sql(4, "Départements, top 15", "Nuitées", with_visits(topk_sum_sql("departement", 15, f"{TOURISTS} AND {NATIONAL}"))),
    figure_sql(5, "Pays, top 5", "Nuitées", with_visits(topk_sum_sql("pays", 5, f"{TOURISTS} AND {FOREIGN}"))),
    figure_sql(10, "Excursionnistes, pic", "Présences", peak_sql(_guests(OUTSIDE)), dated=True),
    figure_sql(16, "Excursionnistes totaux", "Présences", _total_sql(_guests(OUTSIDE))),
    figure_sql(17, "Présences 2e samedi", "Présences", days_sql(_guests(OUTSIDE), SECOND), dated=True),
    figure_sql(18, "Présences 3e samedi", "Présences", days_sql(_guests(OUTSIDE), THIRD), dated=True),
    figure_sql(21, "Durée moyenne totale", "Nuits", mean_sql(OUTSIDE)),
    figure_sql(22, "Durée moyenne française", "Nuits", mean_sql(NATIONAL)),
    figure_sql(23, "Durée moyenne internationale", "Nuits", mean_sql(FOREIGN)),
])


def _distribution_sql(block: str, who: str) -> str:
    cells = f"{big(f'sum(CASE WHEN {hit(0)} THEN volume END)')} AS n0, {big(f'coalesce(sum(CASE WHEN {hit(1)} THEN volume END), 0)')} AS n1"
    return f"""SELECT '{block}' AS block, CAST(NULL AS INT) AS numero, CAST(nb_nuits AS VARCHAR) AS indicateur, CAST(n0 AS DOUBLE) AS n0, CAST(n1 AS DOUBLE) AS n1,
      {', '.join(f'CAST(NULL AS DOUBLE) AS n{k}' for k in range(2, 5))}, 'Nuitées' AS unite, '' AS remarque, CAST(NULL AS DATE) AS date, {change('n0', 'n1', 'A')} AS evolution_1,
      {', '.join(f'CAST(NULL AS DOUBLE) AS evolution_{k}' for k in range(2, 5))}, {part('n0', 't', empty='NULL')} AS part_pct
      FROM (SELECT *, CAST(sum(n0) OVER () AS BIGINT) AS t FROM ({with_visits(f"SELECT nb_nuits, {cells} FROM visits WHERE {TOURISTS} AND {who} GROUP BY nb_nuits")}) WHERE n0 IS NOT NULL)"""


@register("K31_block_a", f"""SELECT 'indicateurs' AS block, *, {evolutions()}, CAST(NULL AS DOUBLE) AS part_pct FROM ({BLOCK_A_SQL})
  UNION ALL BY NAME {_distribution_sql('durees', OUTSIDE)} UNION ALL BY NAME {_distribution_sql('durees_fr', NATIONAL)} UNION ALL BY NAME {_distribution_sql('durees_intl', FOREIGN)}""")
def _(spark, sf):
    return kpi.block_a(nights(spark, sf, None, "departement", "pays", "nb_nuits"), day_visits(spark, sf, None), SUMMER, R)


def _d7_row(label: str, inner: str, dated: bool) -> str:
    d0, d1 = ("date0", "date1") if dated else ("CAST(NULL AS DATE)", "CAST(NULL AS DATE)")
    return f"SELECT '{label}' AS rang, {d0} AS date, n0, {d1} AS date_n1, n1, {change('n0', 'n1', 'B')} AS delta_pct FROM ({inner})"


_GUESTS = f"{EXCURSIONISTS} AND {OUTSIDE}"
FIRST = {0: "2000-06-24", 1: "1999-06-26"}


@register("K32_block_d7", " UNION ALL ".join([
    _d7_row("Total", _total_sql(_GUESTS), False),
    _d7_row("Pic activité", peak_sql(_GUESTS), True),
    _d7_row("1e samedi", days_sql(_GUESTS, FIRST), True),
    _d7_row("2e samedi", days_sql(_GUESTS, SECOND), True),
    _d7_row("3e samedi", days_sql(_GUESTS, THIRD), True),
    _d7_row("14/07", days_sql(_GUESTS, {0: "2000-07-14", 1: "1999-07-14"}), True),
    _d7_row("15/08", days_sql(_GUESTS, {0: "2000-08-15", 1: "1999-08-15"}), True),
    _d7_row("01/05", days_sql(_GUESTS, {0: None, 1: None}), True),
]))
def _(spark, sf):
    return kpi.block_d7(day_visits(spark, sf), SUMMER, [(7, 14), (8, 15), (5, 1)])
