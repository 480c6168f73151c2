"""The benchmark tables seen as a star of visitor facts.

Lookups that a report does not ask for are not joined: ask for the columns you use.
All lookups are left joins on a unique key, so the choice never changes the rows.
Codes stay as stored, which lets a filter on a role reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sillage.operators.filters import Roles

ROLES = Roles(local="P", nonlocal_="F", etranger="O", touriste="A", excursionniste="R")

FROM_LINEITEM = {
    "date": "CAST(l_shipdate AS DATE)",
    "categorie": "l_returnflag",
    "is_provisional": "l_linestatus = 'O'",
    "nb_nuits": "l_linenumber",
    "id_commune": "l_suppkey",
    "volume": "CAST(l_quantity AS BIGINT)",
}
FROM_ORDERS = {"provenance": "o_orderstatus", "tranche_age": "o_orderpriority"}
FROM_CUSTOMER = {"segment": "c_mktsegment", "id_departement": "c_nationkey"}
FROM_CUSTOMER_NATION = {"departement": "cn_name", "pays": "cn_name"}
FROM_CUSTOMER_REGION = {"region": "cr_name"}
FROM_SUPPLIER = {"commune": "s_name"}
FROM_SUPPLIER_REGION = {"zone": "sr_name"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def visits(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """The visitor fact, one row per line item, with just the columns asked for."""
    def t(name: str) -> DataFrame:
        return table(spark, sf_dir, name)

    def asks(*groups: dict) -> bool:
        return any(c in group for group in groups for c in cols)

    fact = t("lineitem")
    # places first: they are few, and a filter on the zone thins the rows that meet the orders
    if asks(FROM_SUPPLIER, FROM_SUPPLIER_REGION):
        place = t("supplier")
        if asks(FROM_SUPPLIER_REGION):
            nation = t("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
            region = t("region").select(
                F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("sr_name")
            )
            place = place.join(nation.join(region, "n_regionkey", "left"), "s_nationkey", "left")
        fact = fact.join(place, fact.l_suppkey == place.s_suppkey, "left")
    geo_nation = asks(FROM_CUSTOMER_NATION, FROM_CUSTOMER_REGION)
    customer = geo_nation or asks(FROM_CUSTOMER)
    if customer or asks(FROM_ORDERS):
        orders = t("orders")
        if customer:
            origin = t("customer")
            if geo_nation:
                nation = t("nation").select(
                    F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("cn_name"),
                    F.col("n_regionkey").alias("c_regionkey"),
                )
                if asks(FROM_CUSTOMER_REGION):
                    region = t("region").select(
                        F.col("r_regionkey").alias("c_regionkey"), F.col("r_name").alias("cr_name")
                    )
                    nation = nation.join(region, "c_regionkey", "left")
                origin = origin.join(nation, "c_nationkey", "left")
            orders = orders.join(origin, orders.o_custkey == origin.c_custkey, "left")
        fact = fact.join(orders, fact.l_orderkey == orders.o_orderkey, "left")
    sources = {
        **FROM_LINEITEM, **FROM_ORDERS, **FROM_CUSTOMER, **FROM_CUSTOMER_NATION,
        **FROM_CUSTOMER_REGION, **FROM_SUPPLIER, **FROM_SUPPLIER_REGION,
    }
    return fact.select(*[F.expr(sources[c]).alias(c) for c in cols])


def communes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id_commune"), F.col("s_name").alias("commune"),
        F.col("s_nationkey").alias("id_departement"),
    )


def departements(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation")
    return nation.join(region, nation.n_regionkey == region.r_regionkey, "left").select(
        F.col("n_nationkey").alias("id_departement"), F.col("n_name").alias("departement"),
        F.col("r_name").alias("region"),
    )


def _cycle(key: str, values: list[str | None]) -> str:
    """SQL text, the same in every dialect, that deals the values out by a key."""
    arms = " ".join(
        f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'")
        for i, v in enumerate(values)
    )
    return f"CASE {key} % {len(values)} {arms} END"


_DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
# delivered rows as they look before cleaning, one per order
RAW_COLUMNS = {
    "id": "o_orderkey",
    "Date": f"CASE WHEN o_orderkey % 41 = 0 THEN '' WHEN o_orderkey % 43 = 0 THEN '2024-02-31' ELSE {_DAY} END",
    "VacancesA": _cycle("o_orderkey", ["0", "1", None, "1.0", "o"]),
    "VacancesB": _cycle("o_custkey", ["1", "0", "0", None]),
    "VacancesC": _cycle("o_orderkey", ["true", "0", "no"]),
    "Ferie": _cycle("o_orderkey", ["0", "0", "Yes", "0", " ON ", "y", "0"]),
    "JourDeLaSemaine": _cycle("o_custkey", ["lun", "Mardi", " MER ", "jeudi", "VEN", "sam", "Dim", "Fête"]),
    "ZoneObservation": _cycle("o_custkey", [
        "Pays dAurillac", " Châtaigneraie", "chataigneraie", "Haut  Cantal", "Hautes Terres", "LIORAN",
        "Val Truyere", "Carlades", "Pays de Mauriac ", "St Flour Communaute", "CCSA", "Inconnue", None,
    ]),
    "Provenance": _cycle("o_custkey", [
        "Non Local", "NONLOCAL", "Étranger", "stranger", "International", "Local", "  local", "", None,
    ]),
    "CategorieVisiteur": _cycle("o_orderkey", [
        "Touriste", "touriste ", "Résident", "resident", "Excursionniste", "Excursionniste recurrent",
        "Transit", "Habituellement present", None,
    ]),
    "NomDepartement": _cycle("o_custkey", ["Z_Autre 97", "Autre 98", "puy-de-dôme", "Cantal ", "LOT", "Aveyron", None]),
    "Departement": _cycle("o_orderkey", ["Gard", "Isère", None, "Ain"]),
    "NomRegion": _cycle("o_custkey", ["Outre-mer", "Outre-mer", "Auvergne", "auvergne", "Midi-Pyrénées", None, "Auvergne"]),
    "NomNouvelleRegion": _cycle("o_custkey", ["OM", None, "ARA", "ara ", "Occitanie", "Occitanie", "ARA"]),
    "Pays": _cycle("o_custkey", [
        '"Corée du Sud"', "Guadeloupe; Martinique", "Pays Bas", "  Royaume   Uni ", "Belgique", "“Suisse”", None,
    ]),
    "DureeSejour": _cycle("o_orderkey", ["1 Nuits", "1N", "3N", "3 nuits", "12N", "13 Nuits et plus", "2 NUITS", None]),
    "ZoneMobilite": _cycle("o_custkey", [
        "St Flour", "Ste-Anastasie", "Ostermeier", "ALBARET STE MARIE", "Saint Simon", "Vic sur Est ", "Est St-Paul",
    ]),
    "CodeInsee": _cycle("o_custkey", ["15001", "15002", None, "12176", "15187", "48002", "15216", "", "15012"]),
    "NomEPCI": _cycle("o_orderkey", [" Hautes Terres", "CABA", None, "Sumène  Artense", "Inconnu"]),
    "Age": "o_orderpriority",
    "Geolife": _cycle("o_orderkey", [
        "Urbain Dynamique", "Populaire", "Rural Ouvrier", "Residence secondaire", "NR", "URBAIN DEFAVORISE", "Autre",
        "PERIURBAIN EN CROISSANCE", "CUMUL",
    ]),
    "Volume": (
        "CASE WHEN o_orderkey % 37 = 0 THEN 'n/a' WHEN o_orderkey % 31 = 0 THEN '' "
        "ELSE CAST(o_orderkey % 500 AS STRING) END"
    ),
}


def raw_rows(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Uncleaned delivery rows, derived from every order."""
    names = cols or tuple(RAW_COLUMNS)
    return table(spark, sf_dir, "orders").select(*[F.expr(RAW_COLUMNS[c]).alias(c) for c in names])


# in SQL texts these two are renamed, since names there do not tell case and the results have a date and a volume
SQL_NAMES = {"Date": "Jour", "Volume": "Quantite"}


def raw_sql(*cols: str) -> str:
    names = cols or tuple(RAW_COLUMNS)
    return "SELECT " + ", ".join(f'{RAW_COLUMNS[c]} AS "{SQL_NAMES.get(c, c)}"' for c in names) + " FROM orders"


# one business period per order: a code used by one customer over the years
_BASE = _cycle("o_orderkey", [
    "vacances_hiver", "vacances_paques", "vacances_ete", "vacances_toussaint", "vacances_noel",
    "weekend_paques", "weekend_ascension", "weekend_pentecote", "pont_mai",
])
PERIOD_COLUMNS = {
    "id_periode": "o_orderkey",
    "base": _BASE,
    "code_periode": f"concat({_BASE}, '_', CAST(o_custkey AS STRING))",
    "nom_periode": f"concat('Les ', replace({_BASE}, '_', '-'), ' du ', CAST(o_custkey AS STRING))",
    "annee": "CAST(extract(year FROM o_orderdate) AS INT)",
    "date_debut": "CAST(o_orderdate AS DATE)",
    "duree": "CAST(o_orderkey % 40 AS INT)",
}


def order_periods(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """A period table that grows with the orders; some periods cross the year's end."""
    cols = ["id_periode", "code_periode", "nom_periode", "annee", "date_debut", "duree", *extra]
    out = table(spark, sf_dir, "orders").select(*[F.expr(PERIOD_COLUMNS[c]).alias(c) for c in cols])
    return out.withColumn("date_fin", F.date_add("date_debut", F.col("duree"))).drop("duree")


def order_periods_sql(*extra: str) -> str:
    cols = ["id_periode", "code_periode", "nom_periode", "annee", "date_debut", *extra]
    picked = ", ".join(f"{PERIOD_COLUMNS[c]} AS {c}" for c in cols)
    return f"SELECT {picked}, CAST(o_orderdate AS DATE) + {PERIOD_COLUMNS['duree']} AS date_fin FROM orders"


def official_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine named periods per year, placed from the first order of each kind and year."""
    p = order_periods(spark, sf_dir, "base")
    length = F.when(F.col("code_periode").startswith("weekend"), 2).otherwise(14)
    return (
        p.groupBy(F.col("base").alias("code_periode"), "annee")
        .agg(F.min("date_debut").alias("premier"), F.min("id_periode").alias("id_periode"))
        .select(
            "id_periode", "code_periode",
            F.initcap(F.replace("code_periode", F.lit("_"), F.lit(" "))).alias("nom_periode"), "annee",
            F.date_add("premier", (F.col("id_periode") % 300).cast("int")).alias("date_debut"),
            F.date_add("premier", (F.col("id_periode") % 300).cast("int") + length).alias("date_fin"),
        )
    )


OFFICIAL_SQL = f"""
SELECT id_periode, code_periode,
  upper(code_periode[1]) || split_part(code_periode, '_', 1)[2:] || ' ' ||
  upper(split_part(code_periode, '_', 2)[1]) || split_part(code_periode, '_', 2)[2:] AS nom_periode, annee,
  premier + CAST(id_periode % 300 AS INT) AS date_debut,
  premier + CAST(id_periode % 300 AS INT) + CASE WHEN code_periode LIKE 'weekend%' THEN 2 ELSE 14 END AS date_fin
FROM (SELECT base AS code_periode, annee, min(date_debut) AS premier, min(id_periode) AS id_periode
      FROM ({order_periods_sql('base')}) GROUP BY base, annee)
"""

_STARTS = (("printemps", 3, 20), ("ete", 6, 21), ("automne", 9, 22), ("hiver", 12, 21))


def season_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season starts of every year that has orders."""
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("annee")).distinct()
    starts = F.array(*[
        F.struct(F.lit(s).alias("saison"), F.make_date("annee", F.lit(m), F.lit(d)).alias("date_debut"))
        for s, m, d in _STARTS
    ])
    return years.select("annee", F.explode(starts).alias("s")).select("annee", "s.*")


SEASON_STARTS_SQL = " UNION ALL ".join(
    f"SELECT annee, '{s}' AS saison, make_date(annee, {m}, {d}) AS date_debut "
    "FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS annee FROM orders)"
    for s, m, d in _STARTS
)

VISITS_SQL = """
SELECT CAST(l_shipdate AS DATE) AS date, sr.r_name AS zone, o_orderstatus AS provenance, l_returnflag AS categorie,
  cn.n_name AS departement, cn.n_name AS pays, cr.r_name AS region, l_linenumber AS nb_nuits,
  o_orderpriority AS tranche_age, c_mktsegment AS segment, l_suppkey AS id_commune, s_name AS commune,
  c_nationkey AS id_departement, l_linestatus = 'O' AS is_provisional, CAST(l_quantity AS BIGINT) AS volume
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey
  LEFT JOIN region cr ON cn.n_regionkey = cr.r_regionkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey
  LEFT JOIN region sr ON sn.n_regionkey = sr.r_regionkey
"""
