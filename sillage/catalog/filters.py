"""F: the row predicates of the reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sillage import fixed_values as fv
from sillage.catalog.base import FOREIGN, NATIONAL, OUTSIDE, VISITORS, ZONE, R, big, register, with_raw, with_visits
from sillage.functions.text import collation_key, equals_ci_ai
from sillage.operators import filters
from sillage.operators.aggregates import preagg
from sillage.operators.zones import display_frame, hidden_frame
from sillage.plans.calendar import visible_zones
from sillage.sources.binding import departements, raw_rows, table, visits

_BY_DAY = "SELECT date, categorie, CAST(sum(volume) AS BIGINT) AS volume FROM visits"


@register("F01_in_window", with_visits(f"{_BY_DAY} WHERE date BETWEEN DATE '1999-12-20' AND DATE '2000-01-05' GROUP BY ALL"))
def _(spark, sf):
    rows = filters.in_window(visits(spark, sf, "date", "categorie", "volume"), "1999-12-20", "2000-01-05")
    return preagg(rows, ["date", "categorie"])


@register("F02_where_dims", with_visits(
    f"SELECT date, CAST(sum(volume) AS BIGINT) AS volume FROM visits WHERE zone = '{ZONE}' AND categorie = '{R.touriste}' AND {NATIONAL} GROUP BY date"
))
def _(spark, sf):
    fact = visits(spark, sf, "date", "zone", "categorie", "provenance", "volume")
    return preagg(filters.where_dims(fact, ZONE, R.touriste, [R.nonlocal_]), ["date"])


@register("F03_where_ids", with_visits(
    "SELECT date, CAST(sum(volume) AS BIGINT) AS volume FROM visits WHERE departement IN ('NATION_3', 'NATION_7') GROUP BY date"
))
def _(spark, sf):
    fact = visits(spark, sf, "date", "id_departement", "volume")
    chosen = F.col("departement").isin("NATION_3", "NATION_7")
    return preagg(filters.where_member(fact, departements(spark, sf), "id_departement", chosen), ["date"])


@register("F04_where_provenance", with_visits(" UNION ALL ".join(
    f"SELECT '{n}' AS regle, count(*) AS lignes, {big('sum(volume)')} AS volume FROM visits WHERE {c}"
    for n, c in (("national", NATIONAL), ("foreign", FOREIGN), ("visitors", VISITORS), ("not_local", OUTSIDE))
)))
def _(spark, sf):
    fact = visits(spark, sf, "provenance", "volume")
    rules = ("national", "foreign", "visitors", "not_local")
    told = F.array_compact(F.array(*[F.when(filters.provenance_rule(r, R), F.lit(r)) for r in rules]))
    return fact.select("volume", F.explode(told).alias("regle")).groupBy("regle").agg(
        F.count(F.lit(1)).alias("lignes"), F.sum("volume").alias("volume")
    )


@register("F05_drop_sentinels", with_raw(
    """SELECT id, "Geolife" AS segment FROM raw WHERE upper(trim("Geolife")) NOT IN ('CUMUL', 'NR', 'NON RENSEIGNE', '')""",
    "id", "Geolife",
))
def _(spark, sf):
    return filters.drop_sentinels(raw_rows(spark, sf, "id", "Geolife").withColumnRenamed("Geolife", "segment"), "segment")


@register("F06_positive", with_raw(
    'SELECT id, volume FROM (SELECT id, coalesce(TRY_CAST("Quantite" AS BIGINT), 0) AS volume FROM raw) WHERE volume > 0', "id", "Volume"
))
def _(spark, sf):
    raw = raw_rows(spark, sf, "id", "Volume")
    return filters.positive(raw.select("id", F.coalesce(F.col("Volume").try_cast("bigint"), F.lit(0).cast("bigint")).alias("volume")))


@register("F07_known_commune", with_visits(
    "SELECT id_commune, count(*) AS lignes FROM visits WHERE id_commune > 0 GROUP BY id_commune"
))
def _(spark, sf):
    return filters.known_commune(visits(spark, sf, "id_commune")).groupBy("id_commune").agg(F.count(F.lit(1)).alias("lignes"))


@register("F08_like", """SELECT p_partkey, p_name, CASE WHEN contains(lower(p_name), 'ring') THEN 'contient' END AS c,
  CASE WHEN starts_with(lower(p_name), 'red') THEN 'debut' END AS d, CASE WHEN suffix(lower(p_name), 'widget') THEN 'fin' END AS f FROM part
  WHERE contains(lower(p_name), 'ring') OR starts_with(lower(p_name), 'red') OR suffix(lower(p_name), 'widget')""")
def _(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    modes = {"c": ("Ring", "contains", "contient"), "d": ("RED", "prefix", "debut"), "f": ("widget", "suffix", "fin")}
    out = None
    for name, (term, mode, label) in modes.items():
        hits = filters.like(part, "p_name", term, mode).select(
            "p_partkey", "p_name", *[F.lit(label if m == name else None).cast("string").alias(m) for m in modes]
        )
        out = hits if out is None else out.unionByName(hits)
    return out.groupBy("p_partkey", "p_name").agg(*[F.max(m).alias(m) for m in modes])


@register("F09_eq_ci_ai", with_raw(
    """SELECT id, "ZoneObservation" AS zone FROM raw WHERE strip_accents(upper(trim("ZoneObservation"))) = 'CHATAIGNERAIE'""",
    "id", "ZoneObservation",
))
def _(spark, sf):
    raw = raw_rows(spark, sf, "id", "ZoneObservation").withColumnRenamed("ZoneObservation", "zone")
    return raw.where(equals_ci_ai(F.trim("zone"), F.lit("Châtaigneraie")))


@register("F09_collation_groups", """SELECT cle, count(*) AS lignes, min(mot) AS exemple FROM (
  SELECT strip_accents(upper(replace(m, 'ß', 'ss'))) AS cle, m AS mot FROM (SELECT unnest(string_split(text, ' ')) AS m FROM documents) WHERE m <> '')
  GROUP BY cle""")
def _(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("mot")).where(F.col("mot") != "")
    # each distinct word has its key made once, however often it comes
    counted = words.groupBy("mot").agg(F.count(F.lit(1)).alias("lignes"))
    return counted.groupBy(collation_key(F.col("mot")).alias("cle")).agg(F.sum("lignes").alias("lignes"), F.min("mot").alias("exemple"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


DISPLAY_VALUES = ", ".join(f"({quoted(b)}, {quoted(d)})" for b, d in fv.ZONE_TO_DISPLAY.items())
HIDDEN_VALUES = ", ".join(f"({quoted(z)})" for z in fv.ZONES_HIDDEN)


@register("F10_visible_zones", with_raw(f"""SELECT DISTINCT coalesce(d.a, z.zone) AS zone
  FROM (SELECT upper(trim("ZoneObservation")) AS zone FROM raw) z LEFT JOIN (VALUES {DISPLAY_VALUES}) d(b, a) ON d.b = z.zone
  WHERE z.zone IS NULL OR z.zone NOT IN (SELECT h FROM (VALUES {HIDDEN_VALUES}) x(h))""", "ZoneObservation"))
def _(spark, sf):
    zones = raw_rows(spark, sf, "ZoneObservation").select(F.col("ZoneObservation").alias("zone")).distinct()
    return visible_zones(zones, hidden_frame(spark), display_frame(spark))


@register("F11_data_mode", with_visits(" UNION ALL ".join(
    f"SELECT '{m}' AS mode, count(*) AS lignes, {big('sum(volume)')} AS volume FROM visits WHERE {c}"
    for m, c in (("main", "NOT is_provisional"), ("provisional", "is_provisional"), ("all", "TRUE"))
)))
def _(spark, sf):
    fact = visits(spark, sf, "is_provisional", "volume")
    out = None
    for mode in ("main", "provisional", "all"):
        row = filters.data_mode(fact, mode).agg(F.count(F.lit(1)).alias("lignes"), F.sum("volume").alias("volume"))
        row = row.select(F.lit(mode).alias("mode"), "lignes", "volume")
        out = row if out is None else out.unionByName(row)
    return out


@register("F12_days_in_window", with_visits("""SELECT date, CAST(sum(volume) AS BIGINT) AS volume FROM visits
  WHERE strftime(date, '%m-%d') IN ('05-01', '07-14', '08-15') AND date BETWEEN DATE '1998-07-01' AND DATE '2000-07-31' GROUP BY date"""))
def _(spark, sf):
    fact = visits(spark, sf, "date", "volume")
    years = fact.select(F.year("date").alias("y")).distinct()
    days = years.select(F.explode(F.array(*[F.make_date("y", F.lit(m), F.lit(d)) for m, d in ((5, 1), (7, 14), (8, 15))])).alias("date"))
    kept = filters.days_in_window(days, "1998-07-01", "2000-07-31")
    return preagg(fact, ["date"]).join(kept, "date")
