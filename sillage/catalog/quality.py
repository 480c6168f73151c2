"""V04-V17: loads, migration, coverage, mappings and logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sillage import fixed_values as fv
from sillage.catalog.base import big, register, rnd, with_raw, with_visits
from sillage.catalog.cleaning import ALIAS_VALUES, label
from sillage.catalog.filters import quoted
from sillage.functions.text import normalize_label
from sillage.operators import joins
from sillage.operators.aggregates import preagg
from sillage.operators.zones import alias_frame
from sillage.plans import quality
from sillage.sources import binding, manifest
from sillage.sources.binding import raw_rows, table, visits

GRAIN = ["date", "zone", "departement"]
_SUMS = "SELECT date, zone, departement, CAST(sum(volume) AS BIGINT) AS volume FROM visits WHERE {c} GROUP BY ALL"


def sums(spark, sf, category: str):
    fact = visits(spark, sf, *GRAIN, "categorie", "volume").where(F.col("categorie") == category)
    return preagg(fact, GRAIN)


@register("V04_migrate", with_visits(f""", main AS ({_SUMS.format(c="categorie = 'A'")}), staging AS ({_SUMS.format(c="categorie = 'R'")})
  SELECT date, zone, departement, coalesce(m.volume, s.volume) AS volume, s.volume IS NOT NULL AS is_provisional
  FROM main m FULL JOIN staging s USING (date, zone, departement)"""))
def _(spark, sf):
    main = sums(spark, sf, "A").withColumn("is_provisional", F.lit(False))
    staging = sums(spark, sf, "R").withColumn("source", F.lit("lot"))
    return quality.migrate(staging, main, GRAIN)


# the ten facts, each with the labels of the visits that stand for the ids of its grain beyond date and zone
_GRAINS = {
    f"fact_{kind}{suffix}": {"id_provenance": "provenance", "id_categorie": "pays", **more}
    for kind in ("nuitees", "diurnes")
    for suffix, more in (
        ("", {}), ("_departements", {"id_departement": "departement"}), ("_pays", {"id_pays": "pays"}), ("_age", {"id_age": "is_provisional"}), ("_geolife", {"id_geolife": "nb_nuits"}),
    )
}


def _migrated_sql(name: str, cols: dict[str, str]) -> str:
    grain = ", ".join(["date", "zone", *dict.fromkeys(cols.values())])
    stays = "nb_nuits > 1" if name.startswith("fact_nuitees") else "nb_nuits = 1"
    one = f"SELECT {grain}, CAST(sum(volume) AS BIGINT) AS volume FROM visits WHERE {stays} AND categorie = '{{c}}' GROUP BY ALL"
    return f"""SELECT '{name}' AS fait, count(*) AS lignes, CAST(coalesce(sum(coalesce(m.volume, s.volume)), 0) AS BIGINT) AS volume, count(s.volume) AS provisoires
      FROM ({one.format(c='A')}) m FULL JOIN ({one.format(c='R')}) s USING ({grain})"""


@register("V04_migrate_all", with_visits(" UNION ALL ".join(_migrated_sql(n, c) for n, c in _GRAINS.items())))
def _(spark, sf):
    fact = visits(spark, sf, "date", "zone", "departement", "pays", "provenance", "categorie", "volume", "nb_nuits", "is_provisional")

    def summed(who: str, name: str):
        cols = _GRAINS[name]
        stays = F.col("nb_nuits") > 1 if name.startswith("fact_nuitees") else F.col("nb_nuits") == 1
        named = fact.where((F.col("categorie") == who) & stays).select("date", F.col("zone").alias("id_zone"), *(F.col(c).alias(i) for i, c in cols.items()), "volume")
        return preagg(named, ["date", "id_zone", *cols])

    staging = {n: summed("R", n) for n in _GRAINS}
    main = {n: summed("A", n).withColumn("is_provisional", F.lit(False)) for n in _GRAINS}
    counts = [F.count(F.lit(1)).alias("lignes"), F.coalesce(F.sum("volume"), F.lit(0)).alias("volume"), F.count_if("is_provisional").alias("provisoires")]
    parts = [df.agg(*counts).select(F.lit(n).alias("fait"), "*") for n, df in quality.migrate_all(staging, main).items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


_RATE = """SELECT '{n}' AS "table", (SELECT count(*) FROM visits WHERE {w} AND categorie = 'R') AS stage, count(*) AS total,
  count(*) FILTER (is_provisional) AS provisoires FROM visits WHERE {w}"""


@register("V05_migration_rate", with_visits(f"""SELECT *, {rnd('provisoires * 100.0::DOUBLE / nullif(stage, 0)', 1)} AS taux_migration,
  {rnd('provisoires * 100.0::DOUBLE / nullif(total, 0)', 1)} AS part_provisoire FROM ({_RATE.format(n='fact_nuitees', w='nb_nuits > 1')}
  UNION ALL {_RATE.format(n='fact_diurnes', w='nb_nuits = 1')})"""))
def _(spark, sf):
    fact = visits(spark, sf, "nb_nuits", "categorie", "is_provisional")
    main = {"fact_nuitees": fact.where(F.col("nb_nuits") > 1), "fact_diurnes": fact.where(F.col("nb_nuits") == 1)}
    staging = {name: df.where(F.col("categorie") == "R") for name, df in main.items()}
    return quality.migration_rate(staging, main)


@register("V06_drop_provisional", with_visits("SELECT date, zone, categorie, CAST(sum(volume) AS BIGINT) AS volume FROM visits WHERE NOT is_provisional GROUP BY ALL"))
def _(spark, sf):
    rows = quality.drop_provisional(visits(spark, sf, "date", "zone", "categorie", "is_provisional", "volume"))
    return preagg(rows, ["date", "zone", "categorie"])


@register("V06_removed_counts", with_visits("""SELECT count(*) AS avant, count(*) FILTER (is_provisional) AS retirees,
  count(*) FILTER (NOT is_provisional) AS restantes FROM visits"""))
def _(spark, sf):
    return quality.removed_counts(visits(spark, sf, "is_provisional"))


# one load result per order: family by priority, failed where the priority is not specified and the key is odd
@register("V07_load_stats", f"""SELECT famille, count(*) AS fichiers, count(*) FILTER (charge) AS charges, {big('sum(lignes)')} AS lignes,
  {rnd('count(*) FILTER (charge) * 100.0::DOUBLE / count(*)', 1)} AS taux_succes FROM (SELECT o_orderpriority AS famille,
    NOT (o_orderpriority = '4-NOT SPECIFIED' AND o_orderkey % 2 = 1) AS charge, o_orderkey % 900 AS lignes FROM orders) GROUP BY famille""")
def _(spark, sf):
    failed = (F.col("o_orderpriority") == "4-NOT SPECIFIED") & (F.col("o_orderkey") % 2 == 1)
    results = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("famille"), (~failed).alias("charge"), (F.col("o_orderkey") % 900).alias("lignes")
    )
    return quality.load_stats(results)


_STATS = """SELECT o_custkey AS client, CAST(10 AS BIGINT) AS attendus, count(*) AS presents, count(*) FILTER (o_orderstatus <> 'P') / count(*) * 100 AS taux_succes
  FROM orders GROUP BY o_custkey"""
_HEALTH = """CASE WHEN presents = 0 THEN 'critical' WHEN presents < attendus AND attendus - presents > attendus / 2 THEN 'warning' WHEN presents < attendus THEN 'partial'
  WHEN taux_succes < 50 THEN 'processing_error' WHEN taux_succes >= 90 THEN 'healthy' ELSE 'operational' END"""


@register("V08_health_status", f"""SELECT *, CASE statut WHEN 'critical' THEN 'critical' WHEN 'warning' THEN 'high' WHEN 'partial' THEN 'medium' WHEN 'processing_error' THEN 'medium' ELSE 'low' END AS gravite,
  statut IN ('healthy', 'operational') AS pret FROM (SELECT *, {_HEALTH} AS statut FROM ({_STATS}))""")
def _(spark, sf):
    ok = F.count_if(F.col("o_orderstatus") != "P")
    stats = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("client")).agg(
        F.lit(10).cast("long").alias("attendus"), F.count(F.lit(1)).alias("presents"),
        (ok / F.count(F.lit(1)) * 100).alias("taux_succes"),
    )
    return quality.health_status(stats)


# files delivered by one customer each; the first names of the list come from even keys only
_FILES = list(fv.STAGING_FILES)
_FILE_CASE = "CASE o_custkey % 7 " + " ".join(f"WHEN {i} THEN {quoted(f)}" for i, f in enumerate(_FILES[:7])) + " END"


@register("V09_missing_files", "SELECT f AS fichier FROM (VALUES " + ", ".join(f"({quoted(f)})" for f in _FILES)
          + f") x(f) WHERE f NOT IN (SELECT {_FILE_CASE} FROM orders)")
def _(spark, sf):
    present = table(spark, sf, "orders").select(F.expr(_FILE_CASE).alias("fichier")).distinct()
    return quality.missing_files(manifest.expected_files(spark), present)


_LINE = """CASE o_orderkey % 11 WHEN 0 THEN '❌ ZoneObservation ' || o_orderkey || ' non trouvé' WHEN 1 THEN '⚠️ Provenance X non trouvée' WHEN 2 THEN '❌ pays Y NON TROUVÉ: non trouvé'
  WHEN 3 THEN '❌ NomDepartement Z non trouvé' WHEN 4 THEN '⚠️ CategorieVisiteur non trouvé' WHEN 5 THEN '❌ DureeSejour 9N non trouvé' WHEN 6 THEN '❌ Colonne Volume manquante'
  WHEN 7 THEN '❌ Fichier introuvable' WHEN 8 THEN '❌ erreur inattendue' WHEN 9 THEN 'Provenance X non trouvé' ELSE '✅ ok' END"""
_LOG_CASE = " ".join(f"WHEN regexp_matches(value, '(?i){p}') THEN {quoted(n)}" for p, n in fv.LOG_PATTERNS)


@register("V10_classify_log", f"""SELECT CASE {_LOG_CASE} ELSE 'Autre' END AS type, count(*) AS lignes FROM (SELECT {_LINE} AS value FROM orders)
  WHERE contains(value, '❌') OR contains(value, '⚠️') GROUP BY ALL""")
def _(spark, sf):
    return quality.classify_log(table(spark, sf, "orders").select(F.expr(_LINE).alias("value")))


@register("V11_zone_labels", """SELECT trim("ZoneObservation") AS libelle, fichier, count(*) AS occurrences FROM raw_files GROUP BY ALL""".replace(
    "raw_files", f"(SELECT {binding.RAW_COLUMNS['ZoneObservation']} AS \"ZoneObservation\", o_orderpriority AS fichier FROM orders)"))
def _(spark, sf):
    rows = raw_rows(spark, sf, "ZoneObservation", "Age").withColumnRenamed("Age", "fichier")
    return quality.zone_labels(rows)


@register("V11_zone_label_totals", f"""SELECT libelle, {big('sum(n)')} AS occurrences, count(*) AS nb_fichiers FROM (SELECT trim({binding.RAW_COLUMNS['ZoneObservation']}) AS libelle,
  o_orderpriority AS fichier, count(*) AS n FROM orders GROUP BY ALL) GROUP BY libelle""")
def _(spark, sf):
    rows = raw_rows(spark, sf, "ZoneObservation", "Age").withColumnRenamed("Age", "fichier")
    return quality.zone_label_totals(quality.zone_labels(rows))


LABELS_SQL = 'SELECT "ZoneObservation" AS libelle, count(*) AS volume FROM raw WHERE "ZoneObservation" IS NOT NULL GROUP BY ALL'
COVERAGE_SQL = f"""SELECT count(*) AS libelles, count(b) AS mappes, {big('sum(volume)')} AS volume, {big('coalesce(sum(volume) FILTER (b IS NOT NULL), 0)')} AS volume_mappe
  FROM ({LABELS_SQL}) LEFT JOIN (VALUES {ALIAS_VALUES}) t(a, b) ON a = {label('libelle')}"""


def zone_volumes(spark, sf):
    rows = raw_rows(spark, sf, "ZoneObservation").where(F.col("ZoneObservation").isNotNull())
    return rows.groupBy(F.col("ZoneObservation").alias("libelle")).agg(F.count(F.lit(1)).alias("volume"))


@register("V12_mapping_coverage", with_raw(
    f"SELECT *, {rnd('(volume - volume_mappe) * 100.0::DOUBLE / nullif(volume, 0)', 2)} AS perte_pct FROM ({COVERAGE_SQL})", "ZoneObservation"
))
def _(spark, sf):
    return quality.mapping_coverage(zone_volumes(spark, sf), alias_frame(spark))


@register("V13_mapping_score", with_raw(f"""SELECT fichiers, libelles, mappes, CAST({len(fv.ZONE_EXPECTED)} AS BIGINT) AS attendues, CAST({len(fv.ZONE_EXPECTED)} AS BIGINT) AS justes,
  CAST(CAST(fichiers >= 3 AS INT) + CAST(mappes = libelles AS INT) + 1 + CAST(volume_mappe = volume AS INT) AS INT) AS score
  FROM ({COVERAGE_SQL}), (SELECT count(DISTINCT o_orderpriority) AS fichiers FROM orders)""", "ZoneObservation"))
def _(spark, sf):
    expected = alias_frame(spark, fv.ZONE_EXPECTED).select(
        normalize_label(F.col("alias")).alias("alias"), F.col("base").alias("base_attendue")
    )
    files = raw_rows(spark, sf, "Age").distinct()
    coverage = quality.mapping_coverage(zone_volumes(spark, sf), alias_frame(spark))
    return quality.mapping_score(coverage, alias_frame(spark), expected, files)


@register("V14_zones_without_data", with_visits("""SELECT s_name AS zone FROM supplier WHERE s_name NOT IN (
  SELECT commune FROM visits WHERE date BETWEEN DATE '1995-03-05' AND DATE '1995-03-06')"""))
def _(spark, sf):
    fact = visits(spark, sf, "date", "commune", "nb_nuits").withColumnRenamed("commune", "zone")
    # six facts, told apart by length of stay
    facts = [fact.where(F.col("nb_nuits") == n) for n in range(1, 6)] + [fact.where(F.col("nb_nuits") > 5)]
    zones = binding.communes(spark, sf).select(F.col("commune").alias("zone"))
    return joins.zones_without(zones, facts, "1995-03-05", "1995-03-06")


@register("V15_coverage_by_year", with_visits("""SELECT CAST(year(date) AS INT) AS annee, count(*) AS lignes, count(DISTINCT date) AS jours,
  CAST(sum(volume) AS BIGINT) AS volume FROM visits GROUP BY ALL"""))
def _(spark, sf):
    return quality.coverage_by_year(visits(spark, sf, "date", "volume"))


@register("V15_slice_stats", with_visits("""SELECT count(*) AS lignes, CAST(sum(volume) AS BIGINT) AS volume, min(date) AS premiere, max(date) AS derniere
  FROM visits WHERE zone = 'ASIA' AND categorie = 'R' AND year(date) = 1999"""))
def _(spark, sf):
    fact = visits(spark, sf, "date", "zone", "categorie", "volume").where(
        (F.col("zone") == "ASIA") & (F.col("categorie") == "R") & F.col("date").between("1999-01-01", "1999-12-31")
    )
    return quality.slice_stats(fact)


@register("V16_availability", with_visits("""SELECT zone, count(*) AS lignes, count(DISTINCT id_commune) AS membres, CAST(sum(volume) AS BIGINT) AS volume
  FROM visits GROUP BY zone"""))
def _(spark, sf):
    return quality.availability(visits(spark, sf, "zone", "id_commune", "volume"), by=["zone"])


_HEADER = "CASE o_orderkey % 4 WHEN 0 THEN 'Date;Zone;Volume' WHEN 1 THEN 'Dates;Zone' WHEN 2 THEN chr(65279) || 'Date;Volume' ELSE 'Zone;Date' END"
_NAME = "CASE o_custkey % 3 WHEN 0 THEN 'Nuitee.csv' WHEN 1 THEN 'Diurne.csv' ELSE 'Autre.csv' END"


@register("V17_check_headers", f"""SELECT * FROM (SELECT fichier, concat_ws(' et ', CASE WHEN NOT regexp_matches(replace(entete, chr(65279), ''), '^Date\\b') THEN 'pas d''en-tête Date' END,
  CASE WHEN fichier NOT IN ('Nuitee.csv', 'Diurne.csv') THEN 'non listé' END) AS motif FROM (SELECT {_NAME} AS fichier, {_HEADER} AS entete FROM orders)) WHERE motif <> ''""")
def _(spark, sf):
    key = F.col("o_orderkey") % 4
    header = (
        F.when(key == 0, "Date;Zone;Volume").when(key == 1, "Dates;Zone").when(key == 2, "﻿Date;Volume").otherwise("Zone;Date")
    )
    headers = table(spark, sf, "orders").select(F.expr(_NAME).alias("fichier"), header.alias("entete"))
    return quality.check_headers(headers, ["Nuitee.csv", "Diurne.csv"])


