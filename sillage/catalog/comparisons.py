"""C: change policies, shares, two chosen periods, trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from sillage.catalog.base import (
    NATIONAL, SUMMER, TOURISTS, VISITORS, R, big, change, part, register, rnd, with_visits, yearly,
)
from sillage.catalog.figures import evolutions, nights
from sillage.catalog.rankings import sums_sql
from sillage.functions.change import pct_change, poisson_significance, share
from sillage.operators.aggregates import preagg
from sillage.plans import compare, kpi
from sillage.plans.rankings import two_windows
from sillage.plans.windows import Windows
from sillage.session import stage
from sillage.sources.binding import visits

# communes by day: sums small enough that some are missing in one of the two weeks
PAIR_SQL = f"""pairs AS (SELECT id_commune, {big("coalesce(sum(CASE WHEN date BETWEEN DATE '2000-07-01' AND DATE '2000-07-21' THEN volume END), 0)")} AS a,
  {big("coalesce(sum(CASE WHEN date BETWEEN DATE '1999-07-01' AND DATE '1999-07-21' THEN volume END), 0)")} AS b
  FROM visits WHERE date BETWEEN DATE '2000-07-01' AND DATE '2000-07-21' OR date BETWEEN DATE '1999-07-01' AND DATE '1999-07-21'
  GROUP BY id_commune)"""


JULY = Windows.yearly("2000-07-01", "2000-07-21")


def week(spark, sf, year: int):
    fact = visits(spark, sf, "date", "id_commune", "volume")
    days = F.col("date").between(F.lit(f"{year}-07-01").cast("date"), F.lit(f"{year}-07-21").cast("date"))
    return preagg(fact.where(days), ["id_commune"])


def pair(spark, sf):
    return compare.window_pair(visits(spark, sf, "date", "id_commune", "volume"), JULY, "id_commune")


def _changes(policy: str) -> tuple:
    # day sums per department: zero in some years, so every branch of a policy is met
    sql = with_visits(f"""SELECT departement, jour, a, b, {change('a', 'b', policy)} AS delta_pct FROM (
      SELECT departement, strftime(date, '%m-%d') AS jour,
        {big("coalesce(sum(CASE WHEN year(date) = 2000 THEN volume END), 0)")} AS a,
        {big("coalesce(sum(CASE WHEN year(date) = 1999 THEN volume END), 0)")} AS b
      FROM visits WHERE date BETWEEN DATE '1999-01-01' AND DATE '2000-12-31' AND categorie = '{R.touriste}' GROUP BY ALL)""")

    def query(spark, sf):
        fact = visits(spark, sf, "date", "departement", "categorie", "volume").where(
            (F.col("categorie") == R.touriste)
            & F.col("date").between(F.lit("1999-01-01").cast("date"), F.lit("2000-12-31").cast("date"))
        )
        zero = F.lit(0).cast("long")
        sums = fact.groupBy("departement", F.date_format("date", "MM-dd").alias("jour")).agg(
            F.coalesce(F.sum(F.when(F.year("date") == 2000, F.col("volume"))), zero).alias("a"),
            F.coalesce(F.sum(F.when(F.year("date") == 1999, F.col("volume"))), zero).alias("b"),
        )
        return sums.withColumn("delta_pct", pct_change(F.col("a"), F.col("b"), policy))

    return sql, query


for _number, _policy in enumerate("ABCDE", start=1):
    _sql, _query = _changes(_policy)
    register(f"C{_number:02d}_pct_change_{_policy}", _sql)(_query)


def _total_by_department() -> str:
    return f"SELECT departement, {yearly()} FROM visits WHERE {TOURISTS} AND {VISITORS} GROUP BY departement"


def _by_department(spark, sf):
    return nights(spark, sf, "visitors", "departement").groupBy("departement").agg(*kpi.yearly_sums(SUMMER))


@register("C06_evolution_reference", with_visits(f"SELECT *, {evolutions()} FROM ({_total_by_department()})"))
def _(spark, sf):
    return kpi.evolution(_by_department(spark, sf), SUMMER)


@register("C07_evolution_chained", with_visits(f"SELECT *, {evolutions('chained')} FROM ({_total_by_department()})"))
def _(spark, sf):
    return kpi.evolution(_by_department(spark, sf), SUMMER, "chained")


@register("C07_evolution_long", with_visits(f"""SELECT *, {change('volume', 'precedent', 'A')} AS evolution FROM (
  SELECT departement, annee, volume, lag(volume) OVER (PARTITION BY departement ORDER BY annee) AS precedent FROM (
    SELECT departement, CAST(year(date) AS INT) AS annee, CAST(sum(volume) AS BIGINT) AS volume FROM visits GROUP BY ALL))"""))
def _(spark, sf):
    fact = visits(spark, sf, "date", "departement", "volume")
    per_year = fact.groupBy("departement", F.year("date").alias("annee")).agg(F.sum("volume").alias("volume"))
    return kpi.evolution_long(per_year, ["departement"])


# the pre-summed member of the benchmark tables is played by the last department
_SUMMED = "NATION_24"


@register("C08_share", with_visits(f""", sums AS ({sums_sql('departement', f'{TOURISTS} AND {NATIONAL}')}),
  listed AS (SELECT departement, n0 FROM sums WHERE departement <> '{_SUMMED}' AND n0 IS NOT NULL),
  top AS (SELECT * FROM listed ORDER BY n0 DESC, departement LIMIT 10),
  t AS (SELECT (SELECT {big('sum(n0)')} FROM listed) AS lignes, (SELECT {big('sum(n0)')} FROM sums) AS tout, (SELECT {big('sum(n0)')} FROM top) AS rendues)
  SELECT departement, n0, {part('n0', 'lignes')} AS part_lignes, {part('n0', 'tout')} AS part_tout, {part('n0', 'rendues')} AS part_rendues FROM top, t"""))
def _(spark, sf):
    sums = stage(two_windows(nights(spark, sf, "national", "departement"), SUMMER, ["departement"]), "sums")
    listed = sums.where((F.col("departement") != _SUMMED) & F.col("n0").isNotNull())
    top = listed.orderBy(F.desc("n0"), "departement").limit(10)

    def whole(df):
        return df.agg(F.sum("n0")).scalar()

    return top.withColumns({"l": whole(listed), "t": whole(sums), "r": whole(top)}).select(
        "departement", "n0", share(F.col("n0"), F.col("l")).alias("part_lignes"),
        share(F.col("n0"), F.col("t")).alias("part_tout"), share(F.col("n0"), F.col("r")).alias("part_rendues"),
    )


SIDE_A = compare.Selection("EUROPE", "2000-07-01", "2000-08-31")
SIDE_B = compare.Selection("ASIA", "1998-02-01", "1998-04-15")


def _side_sql(s: compare.Selection) -> str:
    return f"zone = '{s.zone}' AND date BETWEEN DATE '{s.start}' AND DATE '{s.end}'"


def _ab(where: str, by: str = "") -> str:
    return f"""SELECT {by + ', ' if by else ''}{big(f'coalesce(sum(CASE WHEN {_side_sql(SIDE_A)} THEN volume END), 0)')} AS a,
      {big(f'coalesce(sum(CASE WHEN {_side_sql(SIDE_B)} THEN volume END), 0)')} AS b FROM visits
      WHERE {where} AND (({_side_sql(SIDE_A)}) OR ({_side_sql(SIDE_B)})) {'GROUP BY ' + by if by else ''}"""


@register("C09_compare_ab", with_visits(" UNION ALL ".join(
    f"SELECT '{n}' AS indicateur, a, b, a - b AS difference, {change('a', 'b', 'D')} AS evolution_pct FROM ({_ab(f'''categorie = '{c}' AND {VISITORS}''')})"
    for n, c in (("nuitees", R.touriste), ("presences", R.excursionniste))
)))
def _(spark, sf):
    fact = visits(spark, sf, "date", "zone", "categorie", "provenance", "volume").where(
        F.col("provenance").isin(R.nonlocal_, R.etranger)
    )
    return compare.compare_ab({
        "nuitees": fact.where(F.col("categorie") == R.touriste),
        "presences": fact.where(F.col("categorie") == R.excursionniste),
    }, SIDE_A, SIDE_B)


@register("C10_compare_departments", with_visits(f""", sides AS ({_ab(f"categorie = '{R.touriste}'", 'departement')})
  SELECT CAST(row_number() OVER (ORDER BY greatest(a, b) DESC, departement) AS INT) AS rang, departement, a, b, a - b AS difference,
    {change('a', 'b', 'C')} AS evolution_pct, {big('(SELECT sum(a) FROM sides)')} AS total_a, {big('(SELECT sum(b) FROM sides)')} AS total_b
  FROM sides ORDER BY greatest(a, b) DESC, departement LIMIT 10"""))
def _(spark, sf):
    fact = visits(spark, sf, "date", "zone", "categorie", "departement", "volume").where(F.col("categorie") == R.touriste)
    return compare.compare_departments(fact, SIDE_A, SIDE_B, 10)


_PCT = rnd("(a - b) * 100.0::DOUBLE / nullif(b, 0)", 1)
TREND_SQL = f"""trends AS (SELECT id_commune, a, b, CASE WHEN b = 0 AND a > 0 THEN 'nouveau' WHEN a = 0 AND b > 0 THEN 'disparu'
    WHEN {_PCT} >= 20 THEN 'forte_croissance' WHEN {_PCT} >= 5 THEN 'croissance' WHEN {_PCT} >= -5 THEN 'stable'
    WHEN {_PCT} >= -20 THEN 'declin' ELSE 'fort_declin' END AS tendance,
    CASE WHEN b = 0 THEN 100.0::DOUBLE WHEN a = 0 THEN -100.0::DOUBLE ELSE {_PCT} END AS evolution FROM pairs WHERE a > 0 OR b > 0)"""


@register("C11_trend_class", with_visits(f", {PAIR_SQL}, {TREND_SQL} SELECT * FROM trends"))
def _(spark, sf):
    return compare.trends(pair(spark, sf))


# class borders are absolute, so the buckets are tried on sums that cross them at any scale
@register("C12_size_buckets", with_visits(f""", pairs AS (
    SELECT departement, {big("coalesce(sum(CASE WHEN year(date) = 2000 THEN volume END), 0)")} AS a,
      {big("coalesce(sum(CASE WHEN year(date) = 1999 THEN volume END), 0)")} AS b FROM visits GROUP BY departement)
  SELECT CASE WHEN a < 10000 THEN 'petites' WHEN a < 50000 THEN 'moyennes' WHEN a < 100000 THEN 'grandes' ELSE 'tres_grandes' END AS taille,
    count(*) AS destinations, {big('sum(a)')} AS a, {big('sum(b)')} AS b,
    {rnd(f"avg({change('a', 'b', 'D')})", 1)} AS evolution_moyenne FROM pairs WHERE a > 0 GROUP BY ALL"""))
def _(spark, sf):
    whole_year = Windows.yearly("2000-01-01", "2000-12-31")
    return compare.size_buckets(compare.window_pair(visits(spark, sf, "date", "departement", "volume"), whole_year, "departement"))


@register("C13_emerging", with_visits(f", {PAIR_SQL}, {TREND_SQL} SELECT * FROM trends WHERE tendance = 'nouveau' AND a > 20"))
def _(spark, sf):
    return compare.emerging(compare.trends(pair(spark, sf)), minimum=20)


@register("C13_losses", with_visits(
    f", {PAIR_SQL}, {TREND_SQL} SELECT * FROM trends WHERE tendance IN ('fort_declin', 'disparu') AND (a > 100 OR b > 100)"
))
def _(spark, sf):
    return compare.losses(compare.trends(pair(spark, sf)), minimum=100)


_C = change("a", "b", "C")
_SENS = f"CASE WHEN {_C} > 0 THEN 'hausse' WHEN {_C} < 0 THEN 'baisse' ELSE 'stable' END"


@register("C14_gainers_losers", with_visits(f""", {PAIR_SQL} SELECT id_commune, a, b, evolution, sens, CAST(rang AS INT) AS rang FROM (
    SELECT *, row_number() OVER (PARTITION BY sens ORDER BY abs(evolution) DESC, id_commune) AS rang FROM (
      SELECT id_commune, a, b, {_C} AS evolution, {_SENS} AS sens FROM pairs) WHERE sens <> 'stable') WHERE rang <= 5"""))
def _(spark, sf):
    return compare.gainers_losers(pair(spark, sf), "id_commune", 5)


@register("C14_direction_counts", with_visits(
    f", {PAIR_SQL} SELECT {_SENS} AS sens, count(*) AS destinations FROM pairs WHERE a > 0 OR b > 0 GROUP BY ALL"
))
def _(spark, sf):
    return compare.direction_counts(pair(spark, sf))


_Z = "(a - b) / sqrt(greatest(a + b, 1))"


@register("C15_poisson_significance", with_visits(f""", {PAIR_SQL} SELECT id_commune, a, b, {rnd(_Z, 6)} AS z, 1.96::DOUBLE AS threshold,
  abs({_Z}) >= 1.96 AS is_significant,
  CASE WHEN {_Z} >= 1.96 THEN 'increase' WHEN {_Z} <= -1.96 THEN 'decrease' ELSE 'stable' END AS direction FROM pairs"""))
def _(spark, sf):
    rows = pair(spark, sf).withColumn("p", poisson_significance(F.col("a"), F.col("b")))
    return rows.select(
        "id_commune", "a", "b", F.round("p.z", 6).alias("z"),
        F.col("p.threshold").cast("double").alias("threshold"), "p.is_significant", "p.direction",
    )


