"""J: joins of facts with dimensions, calendars and periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from sillage.catalog.base import EXCURSIONISTS, R, TOURISTS, ZONE, SUMMER, big, hit, part, register, with_periods, with_visits
from sillage.catalog.comparisons import PAIR_SQL, week
from sillage.catalog.figures import day_visits, nights
from sillage.catalog.rankings import origins_sql
from sillage.functions.change import share
from sillage.functions.dates import calendar_extra, calendar_parts
from sillage.operators import joins
from sillage.operators.aggregates import preagg
from sillage.plans import calendar, rankings
from sillage.session import stage
from sillage.sources import binding
from sillage.sources.binding import OFFICIAL_SQL, SEASON_STARTS_SQL, order_periods, season_starts, table, visits


@register("J01_star_join", with_visits("""SELECT commune, departement, segment, CAST(sum(volume) AS BIGINT) AS volume
  FROM visits WHERE categorie = 'A' GROUP BY ALL"""))
def _(spark, sf):
    fact = visits(spark, sf, "id_commune", "id_departement", "segment", "categorie", "volume").where(F.col("categorie") == R.touriste)
    sums = preagg(fact, ["id_commune", "id_departement", "segment"])
    dims = {
        "id_commune": binding.communes(spark, sf).drop("id_departement"),
        "id_departement": binding.departements(spark, sf).drop("region"),
    }
    return preagg(joins.star_join(sums, dims), ["commune", "departement", "segment"])


@register("J02_with_calendar", with_visits("""SELECT CAST(isodow(date) >= 6 AS BOOLEAN) AS est_weekend, CAST(quarter(date) AS INT) AS trimestre,
  CAST(year(date) AS INT) AS annee, CAST(sum(volume) AS BIGINT) AS volume FROM visits GROUP BY ALL"""))
def _(spark, sf):
    fact = preagg(visits(spark, sf, "date", "volume"), ["date"])
    day = F.col("date")
    cal = fact.select("date").distinct().withColumns({**calendar_parts(day), **calendar_extra(day)})
    return preagg(joins.with_calendar(fact, cal), ["est_weekend", "trimestre", "annee"])


@register("J03_lookup", """SELECT o_orderkey AS id, c_name AS nom FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""")
def _(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cle"))
    known = table(spark, sf, "customer").where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("cle"), F.col("c_name").alias("nom"))
    return joins.lookup(orders, known, "cle").select("id", "nom")


@register("J04_topk_with_prior", origins_sql("id_commune", EXCURSIONISTS, 10, share_of="returned", policy="E"))
def _(spark, sf):
    return rankings.origins(day_visits(spark, sf, None, "id_commune"), SUMMER, ["id_commune"], 10, share_of="returned", policy="E")


@register("J05_dim_with_two", origins_sql("departement", TOURISTS, 20, policy="C", keep="either"))
def _(spark, sf):
    return rankings.origins(nights(spark, sf, None, "departement"), SUMMER, ["departement"], 20, policy="C", keep="either")


def _metric(name: str, code: str, offset: int) -> str:
    return big(f"coalesce((SELECT sum(volume) FROM visits v WHERE v.departement = d.departement AND zone = '{ZONE}' AND categorie = '{code}' AND {hit(offset)}), 0)") + f" AS {name}_n{offset}"


@register("J06_four_metrics", with_visits(
    "SELECT departement, " + ", ".join(_metric(n, c, o) for n, c in (("nuitees", R.touriste), ("presences", R.excursionniste)) for o in (0, 1))
    + " FROM (SELECT n_name AS departement FROM nation) d"
))
def _(spark, sf):
    dim = binding.departements(spark, sf)
    return joins.four_metrics(
        dim, nights(spark, sf, None, "departement"), day_visits(spark, sf, None, "departement"), SUMMER.first(2), "departement"
    )


@register("J07_with_total", with_visits(f""", s AS (SELECT pays, CAST(sum(volume) AS BIGINT) AS volume FROM visits GROUP BY pays)
  SELECT pays, volume, total, {part('volume', 'total')} AS part_pct FROM s, (SELECT CAST(sum(volume) AS BIGINT) AS total FROM s)"""))
def _(spark, sf):
    sums = stage(preagg(visits(spark, sf, "pays", "volume"), ["pays"]), "sums")
    sums = joins.with_total(sums, "volume")
    return sums.withColumn("part_pct", share(F.col("volume"), F.col("total")))


@register("J08_in_period", with_visits(f"""SELECT code_periode, annee, categorie, CAST(sum(volume) AS BIGINT) AS volume
  FROM ({OFFICIAL_SQL}) p JOIN visits ON date BETWEEN date_debut AND date_fin GROUP BY ALL"""))
def _(spark, sf):
    fact = visits(spark, sf, "date", "categorie", "volume")
    return joins.in_period(fact, binding.official_periods(spark, sf), ["code_periode", "annee"], ["categorie"])


SEASONS_SQL = f"""SELECT CAST(row_number() OVER (ORDER BY date_debut) AS INT) AS id, annee, saison, date_debut,
  coalesce(lead(date_debut) OVER (ORDER BY date_debut) - 1, make_date(annee, 12, 31)) AS date_fin FROM ({SEASON_STARTS_SQL})"""


def seasons(spark, sf):
    return calendar.number_seasons(calendar.season_bounds(season_starts(spark, sf)))


BEST_SEASON_SQL = f"""SELECT id_periode, id_saison, jours FROM (
  SELECT p.id_periode, s.id AS id_saison, CAST(least(p.date_fin, s.date_fin) - greatest(p.date_debut, s.date_debut) + 1 AS BIGINT) AS jours,
    row_number() OVER (PARTITION BY p.id_periode ORDER BY least(p.date_fin, s.date_fin) - greatest(p.date_debut, s.date_debut) DESC, s.date_debut, s.id) AS r
  FROM periods p JOIN ({SEASONS_SQL}) s ON p.date_debut <= s.date_fin AND p.date_fin >= s.date_debut) WHERE r = 1"""


@register("J09_max_overlap", with_periods(BEST_SEASON_SQL))
def _(spark, sf):
    named = seasons(spark, sf).select(
        F.col("id").alias("id_saison"), F.col("date_debut").alias("s_debut"), F.col("date_fin").alias("s_fin")
    )
    return joins.max_overlap(
        order_periods(spark, sf), named, "id_periode", "id_saison", ("date_debut", "date_fin"), ("s_debut", "s_fin")
    )


CONFLICTS_SQL = """SELECT a.id_periode, a.annee, count(b.id_periode) AS nb_conflits FROM periods a LEFT JOIN periods b
  ON a.annee = b.annee AND a.id_periode <> b.id_periode AND a.date_debut <= b.date_fin AND b.date_debut <= a.date_fin GROUP BY ALL"""


@register("J10_overlaps", with_periods(CONFLICTS_SQL))
def _(spark, sf):
    return joins.overlap_counts(order_periods(spark, sf))


@register("J11_zones_without", with_visits("""SELECT s_name AS zone FROM supplier WHERE s_name NOT IN (
  SELECT commune FROM visits WHERE date BETWEEN DATE '2000-07-14' AND DATE '2000-07-14' AND categorie IN ('A', 'R'))"""))
def _(spark, sf):
    fact = visits(spark, sf, "date", "commune", "categorie").withColumnRenamed("commune", "zone")
    zones = binding.communes(spark, sf).select(F.col("commune").alias("zone"))
    facts = [fact.where(F.col("categorie") == c) for c in (R.touriste, R.excursionniste)]
    return joins.zones_without(zones, facts, "2000-07-14", "2000-07-14")


@register("J12_new_members", """SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey NOT IN
  (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def _(spark, sf):
    seen = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    known = table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("id"))
    return joins.new_members(seen, known, "id")


@register("J13_only_ids", """SELECT l_suppkey AS id, count(*) AS lignes FROM lineitem WHERE l_suppkey IN
  (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) GROUP BY l_suppkey""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"))
    ids = table(spark, sf, "supplier").where(F.col("s_acctbal") > 5000).select(F.col("s_suppkey").alias("id"))
    return joins.only_ids(rows, ids, "id").groupBy("id").agg(F.count(F.lit(1)).alias("lignes"))


@register("J14_ab_merge", with_visits(f", {PAIR_SQL} SELECT * FROM pairs"))
def _(spark, sf):
    return joins.ab_merge(week(spark, sf, 2000), week(spark, sf, 1999), "id_commune")


@register("J15_mobility_geo", """SELECT l_suppkey AS id_commune, s_name AS commune, n_nationkey AS id_departement, n_name AS departement,
  r_name AS region, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def _(spark, sf):
    fact = visits(spark, sf, "id_commune", "volume")
    return joins.mobility_geo(fact, binding.communes(spark, sf), binding.departements(spark, sf))


@register("J16_dedupe", """SELECT o_custkey AS client, o_orderpriority AS priorite, min(o_orderkey) AS id, arg_min(o_totalprice, o_orderkey) AS montant
  FROM orders GROUP BY ALL""")
def _(spark, sf):
    from sillage.operators.conform import dedupe

    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("client"), F.col("o_orderpriority").alias("priorite"),
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("montant"),
    )
    return dedupe(rows, ["client", "priorite"], "id")


@register("J17_scalar_lookup", """SELECT o_orderkey AS id, (SELECT c_mktsegment FROM customer WHERE c_custkey = o_custkey) AS segment FROM orders""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cle"))
    dim = table(spark, sf, "customer").select(F.col("c_custkey").alias("cle"), F.col("c_mktsegment").alias("segment"))
    return joins.lookup(rows, dim, "cle").select("id", "segment")


