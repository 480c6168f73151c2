"""A: sums, profiles, peaks and the like over the visitor fact."""

from __future__ import annotations

from pyspark.sql import functions as F

from sillage.catalog.base import OUTSIDE, TOURISTS, big, register, rnd, with_raw, with_visits
from sillage.catalog.figures import nights
from sillage.functions.dates import parse_iso
from sillage.functions.text import clean_weekday, numeric_flag, parse_flag
from sillage.operators import aggregates as agg
from sillage.operators.filters import having
from sillage.sources import binding
from sillage.sources.binding import raw_rows, visits

GRAIN = ["date", "zone", "provenance", "categorie"]


@register("A01_preagg", with_visits(
    "SELECT date, zone, provenance, categorie, CAST(sum(volume) AS BIGINT) AS volume FROM visits GROUP BY ALL"
))
def _(spark, sf):
    return agg.preagg(visits(spark, sf, *GRAIN, "volume"), GRAIN)


@register("A02_total", with_visits(f"SELECT {big('coalesce(sum(volume), 0)')} AS total FROM visits WHERE {TOURISTS} AND {OUTSIDE}"))
def _(spark, sf):
    return agg.total(nights(spark, sf, "not_local"))


@register("A03_by_dim", with_visits(
    f"SELECT departement, CAST(sum(volume) AS BIGINT) AS volume FROM visits WHERE {TOURISTS} GROUP BY departement"
))
def _(spark, sf):
    return agg.by_dim(nights(spark, sf, None, "departement"), "departement")


_SPLIT = """CAST(coalesce(sum(volume), 0) AS BIGINT) AS total, CAST(coalesce(sum(volume) FILTER (NOT is_provisional), 0) AS BIGINT) AS principal,
  CAST(coalesce(sum(volume) FILTER (is_provisional), 0) AS BIGINT) AS provisoire"""


@register("A04_split_sum", with_visits(f"SELECT categorie, provenance, {_SPLIT} FROM visits GROUP BY ALL"))
def _(spark, sf):
    return agg.split_sum(visits(spark, sf, "categorie", "provenance", "is_provisional", "volume"), ["categorie", "provenance"])


@register("A05_profile", with_visits("""SELECT is_provisional, count(*) AS lignes, CAST(sum(volume) AS BIGINT) AS total,
  avg(volume) AS moyenne, min(volume) AS mini, max(volume) AS maxi, count(DISTINCT date) AS distincts FROM visits GROUP BY ALL"""))
def _(spark, sf):
    return agg.profile(visits(spark, sf, "date", "is_provisional", "volume"))


@register("A06_daily", with_visits(f"SELECT date, {_SPLIT} FROM visits GROUP BY date"))
def _(spark, sf):
    return agg.daily(visits(spark, sf, "date", "is_provisional", "volume"))


@register("A07_weighted_mean", with_visits(
    f"SELECT zone, {rnd('sum(nb_nuits * volume) / nullif(sum(volume), 0)', 2)} AS moyenne FROM visits GROUP BY zone"
))
def _(spark, sf):
    return agg.weighted_mean(visits(spark, sf, "zone", "nb_nuits", "volume"), "nb_nuits", "volume", ["zone"])


@register("A08_concat_ordered", with_visits("""SELECT departement, string_agg(CAST(annee AS VARCHAR), ', ' ORDER BY annee DESC) AS liste
  FROM (SELECT DISTINCT departement, year(date) AS annee FROM visits) GROUP BY departement"""))
def _(spark, sf):
    years = visits(spark, sf, "date", "departement").select("departement", F.year("date").alias("annee"))
    return agg.concat_ordered(years, ["departement"], "annee", descending=True)


@register("A08_concat_by_order", with_visits("""SELECT zone, string_agg(departement, ', ' ORDER BY v DESC, departement DESC) AS liste
  FROM (SELECT zone, departement, sum(volume) AS v FROM visits GROUP BY ALL) GROUP BY zone"""))
def _(spark, sf):
    sums = agg.preagg(visits(spark, sf, "zone", "departement", "volume"), ["zone", "departement"])
    return agg.concat_ordered(sums, ["zone"], "departement", "volume", descending=True)


@register("A09_having", with_visits(
    "SELECT id_commune, CAST(sum(volume) AS BIGINT) AS volume FROM visits GROUP BY id_commune HAVING sum(volume) > 15000"
))
def _(spark, sf):
    return having(agg.preagg(visits(spark, sf, "id_commune", "volume"), ["id_commune"]), F.col("volume") > 15000)


@register("A10_rollup_region", with_visits(
    "SELECT date, zone, region, CAST(sum(volume) AS BIGINT) AS volume FROM visits GROUP BY ALL"
))
def _(spark, sf):
    fact = visits(spark, sf, "date", "zone", "departement", "volume")
    return agg.rollup_region(fact, binding.departements(spark, sf), ["date", "zone"])


CALENDAR_COLUMNS = ("Date", "VacancesA", "VacancesB", "VacancesC", "Ferie", "JourDeLaSemaine")
_NUM = 'coalesce(CAST(trunc(TRY_CAST("{c}" AS DOUBLE)) AS INT), 0)'
WEEKDAY_CASE = (
    "CASE upper(trim(\"JourDeLaSemaine\")) " + " ".join(
        f"WHEN '{a}' THEN '{b}'" for a, b in (
            ("LUN", "LUNDI"), ("MER", "MERCREDI"), ("VEN", "VENDREDI"), ("SAM", "SAMEDI"), ("DIM", "DIMANCHE"),
        )
    ) + " ELSE upper(trim(\"JourDeLaSemaine\")) END"
)
CALENDAR_SQL = f"""SELECT date, max({_NUM.format(c='VacancesA')}) AS vacances_a, max({_NUM.format(c='VacancesB')}) AS vacances_b,
  max({_NUM.format(c='VacancesC')}) AS vacances_c,
  max(CASE WHEN lower(trim("Ferie")) IN ('1', 'true', 'yes', 'on', 'y') THEN 1 ELSE 0 END) AS ferie,
  min({WEEKDAY_CASE}) AS jour_semaine, CAST(month(date) AS INT) AS mois, CAST(year(date) AS INT) AS annee,
  CAST(quarter(date) AS INT) AS trimestre, CAST(weekofyear(date) AS INT) AS semaine
  FROM (SELECT *, TRY_CAST("Jour" AS DATE) AS date FROM raw) WHERE date IS NOT NULL GROUP BY date"""


def calendar_rows(spark, sf):
    raw = raw_rows(spark, sf, *CALENDAR_COLUMNS)
    return raw.select(
        parse_iso(F.col("Date")).alias("date"),
        *[numeric_flag(F.col(c)).alias(f"vacances_{c[-1].lower()}") for c in ("VacancesA", "VacancesB", "VacancesC")],
        parse_flag(F.col("Ferie")).alias("ferie"), clean_weekday(F.col("JourDeLaSemaine")).alias("jour_semaine"),
    )


@register("A11_build_calendar", with_raw(CALENDAR_SQL, *CALENDAR_COLUMNS))
def _(spark, sf):
    return agg.build_calendar(calendar_rows(spark, sf))


@register("A12_first_known", with_visits("""SELECT id_commune, min(departement) AS departement, min(region) AS region,
  min(nb_nuits) AS nb_nuits FROM visits WHERE id_commune IS NOT NULL GROUP BY id_commune"""))
def _(spark, sf):
    fact = visits(spark, sf, "id_commune", "departement", "region", "nb_nuits")
    return agg.first_known(fact, "id_commune", ["departement", "region", "nb_nuits"])


# an EPCI id per row, unknown for half of the communes
_EPCI = "CASE WHEN id_commune % 2 = 0 THEN 0 ELSE nb_nuits END"


@register("A13_epci_of_commune", with_visits(
    f"SELECT id_commune, coalesce(min(nullif({_EPCI}, 0)), 0) AS id_epci FROM visits GROUP BY id_commune"
))
def _(spark, sf):
    fact = visits(spark, sf, "id_commune", "nb_nuits").withColumn("id_epci", F.expr(_EPCI))
    return agg.epci_of_commune(fact)


@register("A14_by_month", with_visits("SELECT strftime(date, '%Y-%m') AS mois, count(*) AS lignes FROM visits GROUP BY ALL"))
def _(spark, sf):
    return agg.by_month(visits(spark, sf, "date"))


@register("A15_years", with_visits("SELECT DISTINCT CAST(year(date) AS INT) AS annee FROM visits"))
def _(spark, sf):
    return agg.years(visits(spark, sf, "date"))


@register("A15_bounds", with_visits("SELECT min(date) AS date_min, max(date) AS date_max FROM visits"))
def _(spark, sf):
    return agg.bounds(visits(spark, sf, "date"))


@register("A16_peak_day", with_visits("""SELECT zone, date, volume FROM (
  SELECT zone, date, CAST(sum(volume) AS BIGINT) AS volume, row_number() OVER (PARTITION BY zone ORDER BY sum(volume) DESC, date) AS r
  FROM visits GROUP BY zone, date) WHERE r = 1"""))
def _(spark, sf):
    return agg.peak_day(visits(spark, sf, "zone", "date", "volume"), ["zone"])

