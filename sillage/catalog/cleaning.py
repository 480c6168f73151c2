"""N: label cleaning over every delivered row, and over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sillage import fixed_values as fv
from sillage.catalog.base import register, with_periods, with_raw
from sillage.catalog.filters import DISPLAY_VALUES, quoted
from sillage.functions import dates, text
from sillage.operators.zones import alias_frame, display_frame, expand_zone, zone_to_base, zone_to_display
from sillage.sources.binding import order_periods, raw_rows, table, visits

# DuckDB's upper() has a capital sharp s, Java's has SS
BLANKS_SQL = r"[\s\x0B\p{Z}]+"


def upper(expr: str) -> str:
    return f"upper(replace({expr}, 'ß', 'ss'))"


def label(expr: str) -> str:
    return f"nullif({upper(f'''trim(regexp_replace({expr}, '{BLANKS_SQL}', ' ', 'g'))''')}, '')"


def synonyms(expr: str, pairs: dict[str, str]) -> str:
    arms = " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in pairs.items())
    return f"CASE {expr} {arms} ELSE {expr} END"


def _cleaner(key: str, source: str, function, sql: str, name: str = "valeur") -> None:
    """A cleaner over one raw column: (id, brut, valeur)."""
    body = with_raw(f'SELECT id, "{source}" AS brut, {sql.replace('{c}', chr(34) + source + chr(34))} AS {name} FROM raw', "id", source)

    @register(key, body)
    def _(spark, sf):
        raw = raw_rows(spark, sf, "id", source)
        return raw.select("id", F.col(source).alias("brut"), function(F.col(source)).alias(name))


@register("N01_normalize_label", f"SELECT doc_id, {label('text')} AS libelle FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.normalize_label(F.col("text")).alias("libelle"))


@register("N02_strip_accents", "SELECT doc_id, strip_accents(text) AS libelle FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.strip_accents(F.col("text")).alias("libelle"))


# composed and decomposed marks, letters beyond Latin-1, and one that has no mark to lose
_MARKED = "concat(n_name, chr(233), 'e', chr(769), chr(352), 'c', chr(780), chr(321))"


@register("N02_marks", f"SELECT n_nationkey AS id, strip_accents({_MARKED}) AS libelle FROM nation")
def _(spark, sf):
    marked = F.concat("n_name", F.lit("\u00e9e\u0301\u0160c\u030c\u0141"))
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), text.strip_accents(marked).alias("libelle"))


# the same name composed and decomposed in three scripts, full-width letters and ligatures
_SCRIPTS = {"\u0419\u043e\u0448\u043a\u0430\u0440": "\u0418\u043e\u0448\u043a\u0430\u0440", "\u0418\u0306\u043e": "\u0418\u043e", "\u0386\u03bd\u03c9": "\u0391\u03bd\u03c9", "\u0391\u0301\u03bd": "\u0391\u03bd",
    "\uff21\uff42\uff43": "Abc", "\ufb01n": "fin", "\u01c6ep": "dzep", "x\u00b2": "x2", "\u1e9e": "\u1e9e", "\u212b": "A"}


def _dealt_scripts(values) -> str:
    return "CASE n_nationkey % 10 " + " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values)) + " END || ' ' || n_name"


@register("N02_scripts", f"SELECT n_nationkey AS id, {_dealt_scripts(_SCRIPTS.values())} AS libelle FROM nation")
def _(spark, sf):
    names = F.expr(_dealt_scripts(_SCRIPTS))
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), text.strip_accents(names).alias("libelle"))


_DECORATE = "concat(replace(replace(text, 'e', 'Æ'), ' a', ' ’œ'), 'Ø')"


@register("N03_transliterate", f"""SELECT conv_id, turn, replace(replace(replace(strip_accents({_DECORATE}), 'Æ', 'AE'), '’', ''''), 'Ø', 'O') AS libelle
  FROM conversations""")
def _(spark, sf):
    decorated = F.concat(
        F.replace(F.replace("text", F.lit("e"), F.lit("Æ")), F.lit(" a"), F.lit(" ’œ")), F.lit("Ø")
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", text.transliterate(decorated).alias("libelle"))


ALIAS_VALUES = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in fv.ZONE_TO_BASE.items())
PRODUCTION_VALUES = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in fv.ZONE_TO_BASE_PRODUCTION.items())


@register("N04_zone_to_base", with_raw(f"""SELECT id, env, coalesce(b, zone) AS base FROM (
    SELECT id, upper(trim("ZoneObservation")) AS zone, CASE WHEN id % 2 = 0 THEN 'dev' ELSE 'prod' END AS env FROM raw) r
  LEFT JOIN (SELECT 'dev' AS e, * FROM (VALUES {ALIAS_VALUES}) t(a, b) UNION ALL SELECT 'prod', * FROM (VALUES {PRODUCTION_VALUES}) t(a, b)) m
    ON m.a = r.zone AND m.e = r.env""", "id", "ZoneObservation"))
def _(spark, sf):
    aliases = alias_frame(spark).withColumn("env", F.lit("dev")).unionByName(
        alias_frame(spark, fv.ZONE_TO_BASE_PRODUCTION).withColumn("env", F.lit("prod"))
    )
    raw = raw_rows(spark, sf, "id", "ZoneObservation")
    even = F.col("id") % 2 == 0
    parts = [
        zone_to_base(raw.where(rows), aliases, "ZoneObservation", env).select("id", F.lit(env).alias("env"), "base")
        for rows, env in ((even, "dev"), (~even, "prod"))
    ]
    return parts[0].unionByName(parts[1])


@register("N05_zone_to_display", with_raw(f"""SELECT DISTINCT coalesce(d.a, z) AS affichage FROM (
    SELECT coalesce(b, zone) AS z FROM (SELECT upper(trim("ZoneObservation")) AS zone FROM raw) r LEFT JOIN (VALUES {ALIAS_VALUES}) t(a, b) ON t.a = r.zone)
  LEFT JOIN (VALUES {DISPLAY_VALUES}) d(b, a) ON d.b = z""", "ZoneObservation"))
def _(spark, sf):
    zones = zone_to_base(raw_rows(spark, sf, "ZoneObservation").distinct(), alias_frame(spark), "ZoneObservation")
    return zone_to_display(zones, display_frame(spark), "base")


@register("N06_expand_zone", with_raw("""SELECT id, unnest(CASE WHEN upper(trim("ZoneObservation")) = 'HAUTES TERRES'
    THEN ['HAUTES TERRES', 'HAUTES TERRES COMMUNAUTE'] ELSE [upper(trim("ZoneObservation"))] END) AS zone FROM raw WHERE "ZoneObservation" IS NOT NULL""",
    "id", "ZoneObservation"))
def _(spark, sf):
    raw = raw_rows(spark, sf, "id", "ZoneObservation").where(F.col("ZoneObservation").isNotNull())
    return expand_zone(raw, "ZoneObservation").select("id", "zone")


_cleaner("N07_clean_provenance", "Provenance", text.clean_provenance, synonyms(label("{c}"), fv.PROVENANCE_SYNONYMS))
_cleaner("N08_clean_category", "CategorieVisiteur", text.clean_category, synonyms(label("{c}"), fv.CATEGORY_SYNONYMS))
_cleaner("N09_clean_department", "NomDepartement", text.clean_department, synonyms(label("{c}"), fv.DEPARTMENT_SYNONYMS))
_cleaner("N10_clean_country", "Pays", text.clean_country, label("replace(translate({c}, '\"“”', ''), ';', ',')"))
_cleaner(
    "N11_clean_stay", "DureeSejour", text.clean_stay,
    synonyms(r"regexp_replace(" + label("{c}") + r", '^([1-9]|1[0-2])N$', '\1 NUITS')", {"1 NUITS": "1 NUIT"}),
)
_cleaner(
    "N12_clean_commune", "ZoneMobilite", text.clean_commune,
    "CASE " + label("{c}") + " " + " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in fv.COMMUNE_SYNONYMS.items())
    + r" ELSE regexp_replace(regexp_replace(" + label("{c}") + r", '(^|[ ''\-])STE([ \-]|$)', '\1SAINTE\2', 'g'), '(^|[ ''\-])ST([ \-]|$)', '\1SAINT\2', 'g') END",
)
_cleaner("N13_clean_weekday", "JourDeLaSemaine", text.clean_weekday, synonyms(label("{c}"), fv.WEEKDAY_SYNONYMS))


@register("N14_parse_flag", with_raw("""SELECT id, CASE WHEN lower(trim("Ferie")) IN ('1', 'true', 'yes', 'on', 'y') THEN 1 ELSE 0 END AS ferie,
  coalesce(CAST(trunc(TRY_CAST("VacancesA" AS DOUBLE)) AS INT), 0) AS vacances_a FROM raw""", "id", "Ferie", "VacancesA"))
def _(spark, sf):
    return raw_rows(spark, sf, "id", "Ferie", "VacancesA").select(
        "id", text.parse_flag(F.col("Ferie")).alias("ferie"), text.numeric_flag(F.col("VacancesA")).alias("vacances_a")
    )


_EXTREME = "CASE o_orderkey % 7 WHEN 0 THEN 'NaN' WHEN 1 THEN '1e20' WHEN 2 THEN '99999999999' WHEN 3 THEN '1.0' WHEN 4 THEN '-Infinity' WHEN 5 THEN 'oui' ELSE '0' END"


@register("N14_numeric_flag_extremes", "SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 3 THEN 1 ELSE 0 END AS drapeau FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), text.numeric_flag(F.expr(_EXTREME)).alias("drapeau"))


@register("N15_first_present", with_raw("""SELECT id, coalesce("NomDepartement", "Departement") AS departement, "NomEPCI" AS epci,
  "CodeInsee" AS insee FROM raw""", "id", "NomDepartement", "Departement", "NomEPCI", "CodeInsee"))
def _(spark, sf):
    raw = raw_rows(spark, sf, "id", "NomDepartement", "Departement", "NomEPCI", "CodeInsee")
    return raw.select(
        "id", text.first_present(raw, fv.DEPARTMENT_COLUMNS).alias("departement"),
        text.first_present(raw, fv.EPCI_COLUMNS).alias("epci"), text.first_present(raw, fv.INSEE_COLUMNS).alias("insee"),
    )


@register("N16_valid_iso_date", with_raw("""SELECT id, coalesce(regexp_matches("Jour", '^\\d{4}-\\d{2}-\\d{2}$') AND TRY_CAST("Jour" AS DATE) IS NOT NULL, FALSE) AS valide
  FROM raw""", "id", "Date"))
def _(spark, sf):
    return raw_rows(spark, sf, "id", "Date").select("id", dates.valid_iso_date(F.col("Date")).alias("valide"))


_DAYS = ", ".join(quoted(d) for d in fv.WEEKDAYS_FR)
_MONTHS = ", ".join(quoted(m) for m in fv.MONTHS_FR)
_SEEN_DAYS = "SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem"


def seen_days(spark, sf):
    return visits(spark, sf, "date").distinct()


@register("N17_weekday_fr", f"SELECT date, list_extract([{_DAYS}], CAST(isodow(date) AS INT)) AS jour FROM ({_SEEN_DAYS})")
def _(spark, sf):
    return seen_days(spark, sf).withColumn("jour", dates.weekday_fr(F.col("date")))


@register("N18_calendar_parts", f"""SELECT date, CAST(month(date) AS INT) AS mois, CAST(year(date) AS INT) AS annee,
  CAST(quarter(date) AS INT) AS trimestre, CAST(weekofyear(date) AS INT) AS semaine FROM ({_SEEN_DAYS})""")
def _(spark, sf):
    return seen_days(spark, sf).withColumns(dates.calendar_parts(F.col("date")))


@register("N19_calendar_extra", f"""SELECT date, CAST(day(date) AS INT) AS jour, CASE WHEN month(date) <= 6 THEN 1 ELSE 2 END AS semestre,
  isodow(date) >= 6 AS est_weekend, list_extract([{_MONTHS}], CAST(month(date) AS INT)) AS nom_mois FROM ({_SEEN_DAYS})""")
def _(spark, sf):
    return seen_days(spark, sf).withColumns(dates.calendar_extra(F.col("date")))


@register("N20_to_csp", with_raw(
    "SELECT csp, count(*) AS lignes FROM (SELECT CASE upper(trim(\"Geolife\")) "
    + " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in fv.SEGMENT_GROUPS.items()) + " END AS csp FROM raw) GROUP BY csp",
    "Geolife",
))
def _(spark, sf):
    return raw_rows(spark, sf, "Geolife").groupBy(text.to_csp(F.col("Geolife")).alias("csp")).agg(F.count(F.lit(1)).alias("lignes"))


@register("N21_parse_dmy", """SELECT o_orderkey AS id, strftime(o_orderdate, '%d/%m/%Y') AS texte, CAST(o_orderdate AS DATE) AS date FROM orders""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), dates.fmt_dmy(F.col("o_orderdate")).alias("texte")
    )
    return rows.withColumn("date", dates.parse_dmy(F.col("texte")))


@register("N22_period_label", with_periods(
    "SELECT id_periode, nom_periode || ' (' || strftime(date_debut, '%d/%m') || ' - ' || strftime(date_fin, '%d/%m') || ')' AS libelle FROM periods"
))
def _(spark, sf):
    return order_periods(spark, sf).select(
        "id_periode", dates.period_label(F.col("nom_periode"), F.col("date_debut"), F.col("date_fin")).alias("libelle")
    )


_STOP = ", ".join(quoted(w) for w in fv.STOP_WORDS)


@register("N23_keywords", with_periods(f"""SELECT DISTINCT id_periode, mot FROM (
  SELECT id_periode, unnest(regexp_split_to_array(lower(code_periode || ' ' || nom_periode), '[_\\-\\s''"]+')) AS mot FROM periods)
  WHERE length(mot) > 2 AND mot NOT IN ({_STOP})"""))
def _(spark, sf):
    words = F.array_union(text.word_list(F.col("code_periode")), text.word_list(F.col("nom_periode")))
    return order_periods(spark, sf).select("id_periode", F.explode(words).alias("mot"))


@register("N24_separator_key", with_periods(
    "SELECT id_periode, lower(replace(replace(nom_periode, '_', ' '), '-', ' ')) AS cle FROM periods"
))
def _(spark, sf):
    return order_periods(spark, sf).select("id_periode", text.separator_key(F.col("nom_periode")).alias("cle"))


_DELIVERY = "'Lot B' || CAST(o_orderkey % 7 AS VARCHAR) || CASE WHEN o_orderkey % 5 = 0 THEN ' sans date' ELSE ' ' || CAST(year(o_orderdate) AS VARCHAR) END"


@register("N25_extract_year", f"""SELECT id, texte, TRY_CAST(nullif(regexp_extract(texte, '(\\d{{4}})', 1), '') AS INT) AS annee,
  coalesce(TRY_CAST(nullif(regexp_extract(texte, 'B(\\d+)', 1), '') AS INT), 0) AS bimestre FROM (SELECT o_orderkey AS id, {_DELIVERY} AS texte FROM orders)""")
def _(spark, sf):
    key, year = F.col("o_orderkey"), F.year("o_orderdate").cast("string")
    rest = F.when(key % 5 == 0, " sans date").otherwise(F.concat(F.lit(" "), year))
    rows = table(spark, sf, "orders").select(
        key.alias("id"), F.concat(F.lit("Lot B"), (key % 7).cast("string"), rest).alias("texte")
    )
    return rows.select("*", text.extract_year(F.col("texte")).alias("annee"), text.extract_bimester(F.col("texte")).alias("bimestre"))


@register("N26_clean_text", "SELECT page_id, trim(replace(replace(html, 'e', chr(65533)), chr(65533), ' ')) AS texte FROM pages")
def _(spark, sf):
    damaged = F.replace("html", F.lit("e"), F.lit("�"))
    return table(spark, sf, "pages").select("page_id", text.clean_text(damaged).alias("texte"))
