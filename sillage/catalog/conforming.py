"""D and V01-V03: members, ids, rejects and duplicates of the delivered rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sillage import fixed_values as fv
from sillage.catalog.aggregates import CALENDAR_COLUMNS, CALENDAR_SQL, calendar_rows
from sillage.catalog.base import register, rnd, with_raw
from sillage.catalog.cleaning import ALIAS_VALUES, label, synonyms
from sillage.catalog.scans import write_deliveries
from sillage.functions import text
from sillage.operators import aggregates as agg
from sillage.operators import conform
from sillage.operators.zones import alias_frame
from sillage.plans import load
from sillage.session import shared_dir
from sillage.sources.binding import raw_rows, table


def literal_frame(spark, columns: str, rows: list[tuple]):
    return spark.createDataFrame(rows, columns)


def key(expr: str) -> str:
    return f"strip_accents(upper(CAST({expr} AS VARCHAR)))"


def get_or_create_sql(dim: str, seen: str, name: str, id_name: str) -> str:
    """``dim`` is SQL for (id, name), ``seen`` SQL for (name). Ids as the library deals
    them out: by hash bucket of the key, then by key."""
    return f"""dim AS ({dim}), new AS (SELECT {key(name)} AS cle, min({name}) AS {name} FROM ({seen}) WHERE {name} IS NOT NULL
        AND {key(name)} NOT IN (SELECT {key(name)} FROM dim) GROUP BY 1),
      members AS (SELECT {id_name}, {name} FROM dim UNION ALL SELECT CAST((SELECT coalesce(max({id_name}), 0) FROM dim)
        + row_number() OVER (ORDER BY substr(md5(cle), 1, 3), cle) AS BIGINT), {name} FROM new)"""


# the known half of the customer names; the others are new members
@register("D01_get_or_create", "WITH " + get_or_create_sql(
    "SELECT c_custkey AS id_zone, c_name AS nom FROM customer WHERE c_acctbal > 2000", "SELECT c_name AS nom FROM customer", "nom", "id_zone"
) + " SELECT id_zone, nom FROM members")
def _(spark, sf):
    customer = table(spark, sf, "customer")
    dim = customer.where(F.col("c_acctbal") > 2000).select(F.col("c_custkey").alias("id_zone"), F.col("c_name").alias("nom"))
    return conform.get_or_create(customer, dim, "c_name", "nom", "id_zone")


# the same member composed, decomposed, in other case, and beyond Latin-1
_SPELLED = "CASE c_custkey % 4 WHEN 0 THEN concat('Ch', chr(226), 'teau ', seg) WHEN 1 THEN concat('Cha', chr(770), 'teau ', seg) WHEN 2 THEN concat('CHATEAU ', upper(seg)) ELSE concat(chr(352), 'koda ', seg) END"


@register("D01_spellings", f"""SELECT c_custkey AS id, CAST(dense_rank() OVER (ORDER BY substr(md5(cle), 1, 3), cle) AS BIGINT) AS id_membre FROM (
  SELECT c_custkey, {key(_SPELLED)} AS cle FROM (SELECT c_custkey, c_mktsegment AS seg FROM customer))""")
def _(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"))
    spelled = (
        F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("Ch\u00e2teau "), "seg")).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("Cha\u0302teau "), "seg"))
        .when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("CHATEAU "), F.upper("seg"))).otherwise(F.concat(F.lit("\u0160koda "), "seg"))
    )
    rows = customer.select(F.col("c_custkey").alias("id"), spelled.alias("nom"))
    none = literal_frame(spark, "id_membre bigint, nom string", [])
    members = conform.get_or_create(rows, none, "nom", "nom", "id_membre")
    return conform.attach_ids(rows, members, "nom", "nom", "id_membre").select("id", "id_membre")


@register("D01_attach_ids", with_raw(f""", rows AS (SELECT id, {synonyms(label('"Provenance"'), fv.PROVENANCE_SYNONYMS)} AS nom FROM raw),
  {get_or_create_sql("SELECT CAST(1 AS BIGINT) AS id_provenance, 'LOCAL' AS nom UNION ALL SELECT 7, 'AILLEURS'", "SELECT nom FROM rows", "nom", "id_provenance")}
  SELECT id, rows.nom, id_provenance FROM rows LEFT JOIN members ON strip_accents(upper(rows.nom)) = strip_accents(upper(members.nom))""", "id", "Provenance"))
def _(spark, sf):
    rows = raw_rows(spark, sf, "id", "Provenance").select("id", text.clean_provenance(F.col("Provenance")).alias("nom"))
    dim = literal_frame(spark, "id_provenance bigint, nom string", [(1, fv.LOCAL), (7, "AILLEURS")])
    dim = conform.get_or_create(rows, dim, "nom", "nom", "id_provenance")
    return conform.attach_ids(rows, dim, "nom", "nom", "id_provenance")


_INSEE = "nullif(trim(\"CodeInsee\"), '')"


def commune_rows(spark, sf):
    return raw_rows(spark, sf, "id", "CodeInsee", "ZoneMobilite", "NomDepartement").select(
        "id", F.nullif(F.trim("CodeInsee"), F.lit("")).alias("code_insee"),
        text.clean_commune(F.col("ZoneMobilite")).alias("nom_commune"),
        text.clean_department(F.col("NomDepartement")).alias("departement"),
    )


@register("D02_conform_communes", with_raw(f""", rows AS (SELECT {_INSEE} AS code_insee, {label('"NomDepartement"')} AS departement FROM raw),
  {get_or_create_sql("SELECT CAST(1 AS BIGINT) AS id_commune, '15001' AS code_insee UNION ALL SELECT 2, '15187'", "SELECT code_insee FROM rows", "code_insee", "id_commune")}
  SELECT id_commune, code_insee, CASE code_insee WHEN '15001' THEN 'A' ELSE min_dep END AS departement FROM members LEFT JOIN (
    SELECT code_insee, min({synonyms('departement', fv.DEPARTMENT_SYNONYMS)}) AS min_dep FROM rows GROUP BY code_insee) USING (code_insee)""", "CodeInsee", "NomDepartement"))
def _(spark, sf):
    columns = "id_commune bigint, code_insee string, nom_commune string, departement string"
    stored = literal_frame(spark, columns, [(1, "15001", "B", "A"), (2, "15187", "C", None)])
    return conform.conform_communes(commune_rows(spark, sf), stored).select("id_commune", "code_insee", "departement")


@register("D03_conform_epci", with_raw(f"""SELECT id, epci, coalesce(n, 0) AS id_epci FROM (SELECT id, {label('"NomEPCI"')} AS epci FROM raw)
  LEFT JOIN (VALUES ('HAUTES TERRES', CAST(11 AS BIGINT)), ('CABA', 12), ('SUMÈNE ARTENSE', 13)) d(m, n) ON m = epci""", "id", "NomEPCI"))
def _(spark, sf):
    rows = raw_rows(spark, sf, "id", "NomEPCI").withColumnRenamed("NomEPCI", "epci")
    dim = literal_frame(spark, "nom_epci string, id_epci bigint", [("HAUTES TERRES", 11), ("CABA", 12), ("SUMÈNE ARTENSE", 13)])
    return conform.conform_epci(rows, dim, "epci")


_STAY = synonyms(r"regexp_replace(" + label('"DureeSejour"') + r", '^([1-9]|1[0-2])N$', '\1 NUITS')", {"1 NUITS": "1 NUIT"})


def stay_rows(spark, sf):
    duree = text.clean_stay(F.col("DureeSejour"))
    return raw_rows(spark, sf, "id", "DureeSejour").select(
        "id", duree.alias("duree"), F.regexp_extract(duree, r"^(\d+)", 1).try_cast("int").alias("nb_nuits")
    )


@register("D04_conform_stays", with_raw(f""", rows AS (SELECT {_STAY} AS duree FROM raw),
  {get_or_create_sql("SELECT CAST(1 AS BIGINT) AS id_duree, '1 NUIT' AS duree UNION ALL SELECT 2, '2 NUITS'", "SELECT duree FROM rows", "duree", "id_duree")}
  SELECT id_duree, duree, CAST(regexp_extract(duree, '^(\\d+)', 1) AS INT) AS nb_nuits FROM members""", "DureeSejour"))
def _(spark, sf):
    stored = literal_frame(spark, "id_duree bigint, duree string, nb_nuits int", [(1, "1 NUIT", 1), (2, "2 NUITS", 2)])
    return conform.conform_stays(stay_rows(spark, sf), stored)


@register("D05_extend_calendar", with_raw(f""", fresh AS ({CALENDAR_SQL}),
  old AS (SELECT * REPLACE (0 AS ferie, 'STOCKÉ' AS jour_semaine) FROM fresh WHERE annee < 1998)
  SELECT * FROM old UNION ALL SELECT * FROM fresh WHERE date NOT IN (SELECT date FROM old)""", *CALENDAR_COLUMNS))
def _(spark, sf):
    fresh = agg.build_calendar(calendar_rows(spark, sf))
    stored = fresh.where(F.col("annee") < 1998).withColumns({"ferie": F.lit(0), "jour_semaine": F.lit("STOCKÉ")})
    return conform.extend_calendar(fresh, stored)


_DEP = synonyms(label('"NomDepartement"'), fv.DEPARTMENT_SYNONYMS)


def department_rows(spark, sf):
    return raw_rows(spark, sf, "NomDepartement", "NomRegion", "NomNouvelleRegion").select(
        text.clean_department(F.col("NomDepartement")).alias("departement"),
        F.col("NomRegion").alias("region"), F.col("NomNouvelleRegion").alias("nouvelle_region"),
    )


@register("D06_enrich_departments", with_raw(f""", seen AS (SELECT {_DEP} AS departement, min({label('"NomRegion"')}) AS region, min({label('"NomNouvelleRegion"')}) AS nouvelle_region
    FROM raw WHERE {_DEP} IS NOT NULL GROUP BY 1),
  dim AS (SELECT 'LOT' AS departement, 'STOCKÉE' AS region, 'STOCKÉE' AS nouvelle_region UNION ALL SELECT 'CANTAL', NULL, 'STOCKÉE' UNION ALL SELECT 'AUTRE 98', 'STOCKÉE', 'STOCKÉE')
  SELECT departement, coalesce(s.region, d.region) AS region, coalesce(s.nouvelle_region, d.nouvelle_region) AS nouvelle_region FROM dim d FULL JOIN seen s USING (departement)""",
    "NomDepartement", "NomRegion", "NomNouvelleRegion"))
def _(spark, sf):
    dim = literal_frame(spark, "departement string, region string, nouvelle_region string", [
        ("LOT", "STOCKÉE", "STOCKÉE"), ("CANTAL", None, "STOCKÉE"), ("AUTRE 98", "STOCKÉE", "STOCKÉE"),
    ])
    return conform.enrich_departments(department_rows(spark, sf), dim)


@register("D07_build_regions", with_raw(
    'SELECT DISTINCT "NomRegion" AS region, "NomNouvelleRegion" AS nouvelle_region FROM raw WHERE "NomRegion" IS NOT NULL AND "NomNouvelleRegion" IS NOT NULL',
    "NomRegion", "NomNouvelleRegion",
))
def _(spark, sf):
    return conform.build_regions(department_rows(spark, sf))


@register("D08_build_members", with_raw(f"""SELECT DISTINCT 'segment' AS dimension, {label('"Geolife"')} AS membre FROM raw WHERE "Geolife" IS NOT NULL
  UNION ALL SELECT DISTINCT 'age', {label('"Age"')} FROM raw WHERE "Age" IS NOT NULL""", "Geolife", "Age"))
def _(spark, sf):
    raw = raw_rows(spark, sf, "Geolife", "Age")
    return conform.build_members(raw, "Geolife").select(F.lit("segment").alias("dimension"), F.col("Geolife").alias("membre")).unionByName(
        conform.build_members(raw, "Age").select(F.lit("age").alias("dimension"), F.col("Age").alias("membre"))
    )


# suppliers as zones: a stored list, and the full list that should be there
@register("D09_add_zones", "WITH " + get_or_create_sql(
    "SELECT s_suppkey AS id_zone, s_name AS zone FROM supplier WHERE s_nationkey < 12", "SELECT s_name AS zone FROM supplier", "zone", "id_zone"
) + " SELECT id_zone, zone FROM members")
def _(spark, sf):
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id_zone"), F.col("s_name").alias("zone"), "s_nationkey")
    stored = supplier.where(F.col("s_nationkey") < 12).select("id_zone", "zone")
    return conform.get_or_create(supplier, stored, "zone", "zone", "id_zone")


HISTORY = ("id", "Date", "ZoneObservation", "Provenance", "CategorieVisiteur", "NomDepartement", "DureeSejour", "Volume")
CLEAN_SQL = f"""SELECT id, jour, coalesce(b, zone) AS zone, provenance, categorie, departement, duree, volume FROM (
  SELECT id, CASE WHEN regexp_matches("Jour", '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN TRY_CAST("Jour" AS DATE) END AS jour, {label('"ZoneObservation"')} AS zone,
    {synonyms(label('"Provenance"'), fv.PROVENANCE_SYNONYMS)} AS provenance, {synonyms(label('"CategorieVisiteur"'), fv.CATEGORY_SYNONYMS)} AS categorie,
    {_DEP} AS departement, {_STAY} AS duree, coalesce(TRY_CAST("Quantite" AS BIGINT), 0) AS volume FROM raw) LEFT JOIN (VALUES {ALIAS_VALUES}) t(a, b) ON a = zone"""


def clean_rows(spark, sf):
    return load.conform_labels(raw_rows(spark, sf, *HISTORY), alias_frame(spark), "id")


def _ids(dim: str) -> str:
    return f"SELECT cle, row_number() OVER (ORDER BY substr(md5(cle), 1, 3), cle) AS id FROM (SELECT DISTINCT {key(dim)} AS cle FROM clean WHERE {dim} IS NOT NULL)"


def _with_id(alias: str, dim: str, how: str = "JOIN") -> str:
    return f"{how} {alias} ON {alias}.cle = {key(dim)}"


HISTORY_SQL = with_raw(f""", clean AS (SELECT * RENAME (jour AS date) FROM ({CLEAN_SQL})),
  z AS ({_ids('zone')}), p AS ({_ids('provenance')}), c AS ({_ids('categorie')}), d AS ({_ids('departement')})
  SELECT date, CAST(z.id AS BIGINT) AS id_zone, CAST(p.id AS BIGINT) AS id_provenance, CAST(c.id AS BIGINT) AS id_categorie, CAST(d.id AS BIGINT) AS id_departement,
    CAST(sum(volume) AS BIGINT) AS volume FROM clean {_with_id('z', 'zone')} {_with_id('p', 'provenance')} {_with_id('c', 'categorie')} {_with_id('d', 'departement')}
  WHERE date IS NOT NULL AND volume > 0 GROUP BY ALL""", *HISTORY)


@register("D10_load_history", HISTORY_SQL)
def _(spark, sf):
    rows = clean_rows(spark, sf)
    return load.load_fact(rows, ("zone", "provenance", "categorie", "departement"))


@register("D10_load_files", HISTORY_SQL)
def _(spark, sf):
    path = write_deliveries(raw_rows(spark, sf, *HISTORY), shared_dir(spark, "history"))
    return load.load_files(spark, path, "Nuitee_Departement", alias_frame(spark))


MOBILITY = ("id", "Date", "JourDeLaSemaine", "ZoneObservation", "Provenance", "CategorieVisiteur", "CodeInsee", "NomEPCI", "Volume")


@register("D11_load_mobility", with_raw(f""", clean AS (SELECT jour AS date, coalesce(b, zone) AS zone, provenance, categorie, js AS jour_semaine, insee, epci, volume FROM (
  SELECT CASE WHEN regexp_matches("Jour", '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN TRY_CAST("Jour" AS DATE) END AS jour, {label('"ZoneObservation"')} AS zone,
    {synonyms(label('"Provenance"'), fv.PROVENANCE_SYNONYMS)} AS provenance, {synonyms(label('"CategorieVisiteur"'), fv.CATEGORY_SYNONYMS)} AS categorie,
    {synonyms(label('"JourDeLaSemaine"'), fv.WEEKDAY_SYNONYMS)} AS js, {_INSEE} AS insee, {label('"NomEPCI"')} AS epci, coalesce(TRY_CAST("Quantite" AS BIGINT), 0) AS volume FROM raw)
    LEFT JOIN (VALUES {ALIAS_VALUES}) t(a, b) ON a = zone),
  z AS ({_ids('zone')}), p AS ({_ids('provenance')}), c AS ({_ids('categorie')}), i AS ({_ids('insee')}), e AS ({_ids('epci')})
  SELECT date, jour_semaine, CAST(z.id AS BIGINT) AS id_zone, CAST(p.id AS BIGINT) AS id_provenance, CAST(c.id AS BIGINT) AS id_categorie,
    CAST(coalesce(e.id, 0) AS BIGINT) AS id_epci, CAST(coalesce(i.id, 0) AS BIGINT) AS id_commune, CAST(sum(volume) AS BIGINT) AS volume
  FROM clean {_with_id('z', 'zone')} {_with_id('p', 'provenance')} {_with_id('c', 'categorie')} {_with_id('i', 'insee', 'LEFT JOIN')} {_with_id('e', 'epci', 'LEFT JOIN')}
  WHERE date IS NOT NULL AND volume > 0 GROUP BY ALL""", *MOBILITY))
def _(spark, sf):
    rows = load.conform_places(raw_rows(spark, sf, *MOBILITY), alias_frame(spark))
    return load.load_fact(rows, ("zone", "provenance", "categorie"), optional=("epci", "commune"), extra=("jour_semaine",))


_SCANNED = ("ZoneObservation", "Provenance", "CategorieVisiteur", "NomDepartement", "Pays", "DureeSejour", "NomEPCI", "CodeInsee")


@register("D12_prescan", with_raw(" UNION ALL ".join(
    f"""SELECT '{c}' AS dimension, {label(f'"{c}"')} AS membre, count(*) AS lignes FROM raw WHERE {label(f'"{c}"')} IS NOT NULL GROUP BY 2""" for c in _SCANNED
), *_SCANNED))
def _(spark, sf):
    return conform.prescan(raw_rows(spark, sf, *_SCANNED), _SCANNED)


@register("V01_require_ids", with_raw(f"""SELECT id FROM ({CLEAN_SQL}) WHERE jour IS NOT NULL AND zone IS NOT NULL AND provenance IS NOT NULL
  AND categorie IS NOT NULL AND departement IS NOT NULL""", *HISTORY))
def _(spark, sf):
    return conform.require(clean_rows(spark, sf), ["date", "zone", "provenance", "categorie", "departement"]).select("id")


_REASONS = "concat_ws(', ', " + ", ".join(
    f"CASE WHEN {c} IS NULL THEN '{n}' END"
    for n, c in (("Date", "jour"), ("ZoneObservation", "zone"), ("Provenance", "provenance"), ("CategorieVisiteur", "categorie"), ("NomDepartement", "departement"))
) + ")"


@register("V02_reject_report", with_raw(f""", r AS (SELECT {_REASONS} AS motif FROM ({CLEAN_SQL}))
  SELECT motif, lignes, {rnd("lignes * 100.0::DOUBLE / (SELECT count(*) FROM r WHERE motif <> '')", 1)} AS part_rejets,
    {rnd("(SELECT count(*) FROM r WHERE motif = '') * 100.0::DOUBLE / (SELECT count(*) FROM r)", 1)} AS taux_mappe
  FROM (SELECT motif, count(*) AS lignes FROM r WHERE motif <> '' GROUP BY motif)""", *HISTORY))
def _(spark, sf):
    checks = {
        "Date": F.col("date").isNotNull(), "ZoneObservation": F.col("zone").isNotNull(),
        "Provenance": F.col("provenance").isNotNull(), "CategorieVisiteur": F.col("categorie").isNotNull(),
        "NomDepartement": F.col("departement").isNotNull(),
    }
    return conform.reject_report(clean_rows(spark, sf), checks)


@register("V03_dedupe_grain", """SELECT date, client, id, montant FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, o_custkey AS client, o_orderkey AS id, o_totalprice AS montant,
  row_number() OVER (PARTITION BY date_trunc('month', o_orderdate), o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.date_trunc("month", "o_orderdate").cast("date").alias("date"), F.col("o_custkey").alias("client"),
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("montant"),
    )
    return conform.dedupe_grain(rows, ["date", "client"], "id")


def _loaded_sql(family: str, label: str, rest: int) -> str:
    """Counts of one family, whose rows are those of every other id."""
    return f"""SELECT *, {rnd('gardees * 100.0::DOUBLE / nullif(lues, 0)', 1)} AS taux_succes FROM (SELECT '{family}' AS famille, count(*) AS lues, count(*) FILTER (NOT manque AND volume > 0) AS gardees,
    count(*) FILTER (NOT manque AND volume <= 0) AS sans_volume, count(*) FILTER (manque) AS rejetees, CAST(coalesce(sum(CASE WHEN NOT manque AND volume > 0 THEN volume END), 0) AS BIGINT) AS volume
    FROM (SELECT jour IS NULL OR zone IS NULL OR provenance IS NULL OR categorie IS NULL OR {label} IS NULL AS manque, volume FROM clean WHERE id % 2 = {rest}))"""


_LOADED = (("Nuitee_Departement", "departement"), ("SejourDuree", "duree"))


@register("V07_load_observed", with_raw(f", clean AS ({CLEAN_SQL}) " + " UNION ALL ".join(_loaded_sql(*f, r) for r, f in enumerate(_LOADED)), *HISTORY))
def _(spark, sf):
    raw, paths = raw_rows(spark, sf, *HISTORY), {}
    for r, family in enumerate(f for f, _ in _LOADED):
        paths[family] = write_deliveries(raw.where(F.col("id") % 2 == r), shared_dir(spark, "family"))
    return load.load_families(spark, paths, alias_frame(spark))[1].drop("manquants")
