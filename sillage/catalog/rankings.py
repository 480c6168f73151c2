"""R: rankings and distributions against the previous year."""

from __future__ import annotations

from pyspark.sql import functions as F

from sillage.catalog.base import (
    EXCURSIONISTS, FOREIGN, NATIONAL, OUTSIDE, SUMMER, TOURISTS, R, big, change, hit, part, register, rnd,
    with_visits,
)
from sillage.catalog.figures import day_visits, nights
from sillage.plans import rankings
from sillage.sources import binding
from sillage.sources.binding import visits

# the segment names of the benchmark tables, dealt to two groups; one belongs to none
GROUP_OF = {"AUTOMOBILE": "CSP +", "BUILDING": "CSP +", "FURNITURE": "Populaire", "HOUSEHOLD": "Populaire"}


def sums_sql(member: str, who: str, extra: str = "") -> str:
    return f"""SELECT {member}{extra}, {big(f'sum(CASE WHEN {hit(0)} THEN volume END)')} AS n0,
        {big(f'sum(CASE WHEN {hit(1)} THEN volume END)')} AS n1
        FROM visits WHERE {who} AND (({hit(0)}) OR ({hit(1)})) GROUP BY {member}{extra}"""


def comparison_sql(member: str, k: int, who: str, sums: str | None = None) -> str:
    return with_visits(f""", sums AS ({sums or sums_sql(member, who)}),
      totals AS (SELECT {big('coalesce(sum(n0), 0)')} AS t0, {big('coalesce(sum(n1), 0)')} AS t1 FROM sums),
      top AS (SELECT row_number() OVER (ORDER BY n0 DESC, {member}) AS r, {member}, n0, coalesce(n1, 0) AS n1
              FROM sums WHERE n0 IS NOT NULL ORDER BY n0 DESC, {member} LIMIT {k}),
      rest AS (SELECT {big('coalesce(sum(n0), 0)')} AS s0, {big('coalesce(sum(n1), 0)')} AS s1 FROM top),
      listed AS (
        SELECT CAST(i AS VARCHAR) AS rang, coalesce({member}, 'Données N/A') AS {member}, coalesce(n0, 0) AS n0,
          coalesce(n1, 0) AS n1, {member} IS NOT NULL AS reel
        FROM range(1, {k + 1}) g(i) LEFT JOIN top ON r = i
        UNION ALL SELECT 'Autre', 'Autre', greatest(t0 - s0, 0), greatest(t1 - s1, 0), TRUE FROM rest, totals)
      SELECT rang, {member}, n0, n1, CASE WHEN reel THEN {change('n0', 'n1', 'B')} END AS delta_pct,
        {part('n0', 't0')} AS part_pct, {part('n1', 't1')} AS part_pct_n1 FROM listed, totals""")


@register("R01_comparison_table", comparison_sql("departement", 30, f"{TOURISTS} AND {NATIONAL}"))
def _(spark, sf):
    return rankings.comparison_table(nights(spark, sf, "national", "departement"), SUMMER, "departement", 30)


@register("R02_rank_departments", comparison_sql("departement", 15, f"{TOURISTS} AND {NATIONAL}"))
def _(spark, sf):
    return rankings.rank_members(nights(spark, sf, "national", "departement"), SUMMER, "departement", 15)


@register("R02_rank_departments_day", comparison_sql("departement", 15, f"{EXCURSIONISTS} AND {NATIONAL}"))
def _(spark, sf):
    return rankings.rank_members(day_visits(spark, sf, "national", "departement"), SUMMER, "departement", 15)


@register("R03_rank_regions", comparison_sql("region", 5, f"{TOURISTS} AND {NATIONAL}"))
def _(spark, sf):
    fact = nights(spark, sf, "national", "departement")
    return rankings.rank_regions(fact, SUMMER, 5, binding.departements(spark, sf))


@register("R03_rank_regions_day", comparison_sql("region", 3, f"{EXCURSIONISTS} AND {NATIONAL}"))
def _(spark, sf):
    return rankings.rank_regions(day_visits(spark, sf, "national", "region"), SUMMER, 3)


@register("R04_rank_countries", comparison_sql("pays", 5, f"{TOURISTS} AND {FOREIGN}"))
def _(spark, sf):
    return rankings.rank_members(nights(spark, sf, "foreign", "pays"), SUMMER, "pays", 5)


_GROUP_SQL = "CASE " + " ".join(f"WHEN segment = '{s}' THEN '{g}'" for s, g in GROUP_OF.items()) + " END"


def _group():
    pairs = [F.lit(t) for pair in GROUP_OF.items() for t in pair]
    return F.create_map(*pairs)[F.col("segment")]


def _csp_sql(who: str) -> str:
    inner = sums_sql("csp", f"{who} AND csp IS NOT NULL").replace("FROM visits", f"FROM (SELECT *, {_GROUP_SQL} AS csp FROM visits)")
    return comparison_sql("csp", 3, who, inner)


@register("R05_rank_csp", _csp_sql(f"{TOURISTS} AND {NATIONAL}"))
def _(spark, sf):
    return rankings.rank_csp(nights(spark, sf, "national", "segment"), SUMMER, 3, _group())


@register("R06_rank_age", comparison_sql("tranche_age", 3, f"{TOURISTS} AND {NATIONAL}"))
def _(spark, sf):
    return rankings.rank_members(nights(spark, sf, "national", "tranche_age"), SUMMER, "tranche_age", 3)


@register("R04_rank_countries_day", comparison_sql("pays", 5, f"{EXCURSIONISTS} AND {FOREIGN}"))
def _(spark, sf):
    return rankings.rank_members(day_visits(spark, sf, "foreign", "pays"), SUMMER, "pays", 5)


@register("R05_rank_csp_day", _csp_sql(f"{EXCURSIONISTS} AND {NATIONAL}"))
def _(spark, sf):
    return rankings.rank_csp(day_visits(spark, sf, "national", "segment"), SUMMER, 3, _group())


@register("R06_rank_age_day", comparison_sql("tranche_age", 3, f"{EXCURSIONISTS} AND {NATIONAL}"))
def _(spark, sf):
    return rankings.rank_members(day_visits(spark, sf, "national", "tranche_age"), SUMMER, "tranche_age", 3)


def origins_sql(member: str, who: str, k: int, *, extra: str = "", share_of="all", digits=1, policy="A", keep="current") -> str:
    alive = "n0 > 0" if keep == "current" else "(n0 > 0 OR n1 > 0)"
    whole = "sums" if share_of == "all" else "top"
    return with_visits(f""", sums AS (SELECT {member}{extra}, coalesce(n0, 0) AS n0, coalesce(n1, 0) AS n1
          FROM ({sums_sql(member, who, extra)})),
      top AS (SELECT row_number() OVER (ORDER BY n0 DESC, {member}) AS r, * FROM sums WHERE {alive}
              ORDER BY n0 DESC, {member} LIMIT {k}),
      total AS (SELECT {big('sum(n0)')} AS t0 FROM {whole})
      SELECT CAST(r AS INT) AS rang, {member}{extra}, n0, n1, {change('n0', 'n1', policy)} AS delta_pct,
        {part('n0', 't0', digits)} AS part_pct FROM top, total""")


@register("R07_origins_departments", origins_sql(
    "departement", f"{TOURISTS} AND {NATIONAL}", 15, extra=", region", digits=2, policy="C", keep="either"
))
def _(spark, sf):
    fact = nights(spark, sf, "national", "departement", "region")
    return rankings.origins(fact, SUMMER, ["departement", "region"], 15, digits=2, policy="C", keep="either")


@register("R08_origins_departments_day", origins_sql(
    "departement", f"{EXCURSIONISTS} AND {NATIONAL}", 10, extra=", region", share_of="returned"
))
def _(spark, sf):
    fact = day_visits(spark, sf, "national", "departement", "region")
    return rankings.origins(fact, SUMMER, ["departement", "region"], 10, share_of="returned")


@register("R09_origins_regions", origins_sql("region", f"{TOURISTS} AND {NATIONAL}", 5, share_of="returned", policy="E"))
def _(spark, sf):
    return rankings.origins(nights(spark, sf, "national", "region"), SUMMER, ["region"], 5, share_of="returned", policy="E")


@register("R09_origins_regions_day", origins_sql("region", f"{EXCURSIONISTS} AND {NATIONAL}", 4, share_of="returned"))
def _(spark, sf):
    return rankings.origins(day_visits(spark, sf, "national", "region"), SUMMER, ["region"], 4, share_of="returned")


@register("R10_origins_countries", origins_sql("pays", f"{TOURISTS} AND {FOREIGN}", 5, policy="D"))
def _(spark, sf):
    fact = nights(spark, sf, "foreign", "pays")
    return rankings.origins(fact, SUMMER, ["pays"], 5, policy="D", with_sentinels=True)


@register("R10_origins_countries_day", origins_sql("pays", f"{EXCURSIONISTS} AND {FOREIGN}", 5, share_of="returned"))
def _(spark, sf):
    return rankings.origins(day_visits(spark, sf, "foreign", "pays"), SUMMER, ["pays"], 5, share_of="returned")


@register("R11_destinations", origins_sql(
    "commune", f"categorie = '{R.excursionniste}' AND id_commune > 0", 10, share_of="returned", policy="E"
))
def _(spark, sf):
    fact = visits(spark, sf, "date", "categorie", "commune", "id_commune", "volume").where(F.col("categorie") == R.excursionniste)
    return rankings.destinations(fact, SUMMER, 10)


@register("R12_top_destinations", with_visits("""SELECT zone, departement, volume, CAST(rang AS INT) AS rang FROM (
    SELECT zone, departement, volume, row_number() OVER (PARTITION BY zone ORDER BY volume DESC, departement) AS rang
    FROM (SELECT zone, departement, CAST(sum(volume) AS BIGINT) AS volume FROM visits GROUP BY zone, departement)) WHERE rang <= 10"""))
def _(spark, sf):
    return rankings.top_destinations(visits(spark, sf, "zone", "departement", "volume"), ["zone"], "departement", 10)


@register("R12_top_regions", with_visits("""SELECT zone, region, volume, CAST(rang AS INT) AS rang FROM (
    SELECT zone, region, volume, row_number() OVER (PARTITION BY zone ORDER BY volume DESC, region) AS rang
    FROM (SELECT zone, region, CAST(sum(volume) AS BIGINT) AS volume FROM visits GROUP BY zone, region)) WHERE rang <= 10"""))
def _(spark, sf):
    return rankings.top_destinations(visits(spark, sf, "zone", "region", "volume"), ["zone"], "region", 10)


@register("R14_rank_age_day", origins_sql("tranche_age", f"{EXCURSIONISTS} AND {NATIONAL}", 4, share_of="returned", policy="E"))
def _(spark, sf):
    return rankings.origins(day_visits(spark, sf, "national", "tranche_age"), SUMMER, ["tranche_age"], 4, share_of="returned", policy="E")


@register("R13_rank_age_simple", origins_sql("tranche_age", f"{EXCURSIONISTS} AND {NATIONAL}", 3, policy="E"))
def _(spark, sf):
    return rankings.origins(day_visits(spark, sf, "national", "tranche_age"), SUMMER, ["tranche_age"], 3, policy="E")


@register("R14_rank_csp_day", origins_sql("segment", f"{EXCURSIONISTS} AND {NATIONAL}", 4, share_of="returned", policy="E"))
def _(spark, sf):
    return rankings.origins(day_visits(spark, sf, "national", "segment"), SUMMER, ["segment"], 4, share_of="returned", policy="E")


DISTRIBUTION_SQL = f"""SELECT provenance, nb_nuits, n0 AS volume, coalesce(n1, 0) AS volume_n1,
  {part('n0', 't', empty='NULL')} AS part_pct, {change('n0', 'coalesce(n1, 0)', 'A')} AS delta_pct
  FROM (SELECT *, CAST(sum(n0) OVER (PARTITION BY provenance) AS BIGINT) AS t
        FROM ({sums_sql('provenance', f'{TOURISTS} AND {OUTSIDE}', ', nb_nuits')}) WHERE n0 IS NOT NULL)"""


@register("R15_stay_distribution", with_visits(DISTRIBUTION_SQL))
def _(spark, sf):
    return rankings.stay_distribution(nights(spark, sf, "not_local", "nb_nuits"), SUMMER, ["provenance"])


@register("R15_stay_distribution_all", with_visits(f"""SELECT nb_nuits, n0 AS volume, coalesce(n1, 0) AS volume_n1,
  {part('n0', 't', empty='NULL')} AS part_pct, {change('n0', 'coalesce(n1, 0)', 'A')} AS delta_pct
  FROM (SELECT *, CAST(sum(n0) OVER () AS BIGINT) AS t
        FROM ({sums_sql('nb_nuits', f'{TOURISTS} AND {OUTSIDE}')}) WHERE n0 IS NOT NULL)"""))
def _(spark, sf):
    return rankings.stay_distribution(nights(spark, sf, "not_local", "nb_nuits"), SUMMER)


def _side(name: str, code: str) -> str:
    return (
        f"sum(CASE WHEN provenance = '{code}' THEN part_pct END) AS p_{name}, "
        f"{big(f'''sum(CASE WHEN provenance = '{code}' THEN volume ELSE 0 END)''')} AS v_{name}, "
        f"{big(f'''sum(CASE WHEN provenance = '{code}' THEN volume_n1 ELSE 0 END)''')} AS w_{name}"
    )


@register("R16_stay_combined", with_visits(f""", dist AS ({DISTRIBUTION_SQL}),
  merged AS (SELECT nb_nuits, {_side('fr', R.nonlocal_)}, {_side('intl', R.etranger)} FROM dist GROUP BY nb_nuits),
  ranked AS (SELECT *, row_number() OVER (ORDER BY {rnd('coalesce(p_fr, 0) + coalesce(p_intl, 0)', 1)} DESC, nb_nuits) AS r FROM merged),
  lines AS (SELECT CASE WHEN r > 5 THEN 'Autres' ELSE CAST(nb_nuits AS VARCHAR) END AS duree, least(r, 6) AS r, p_fr, p_intl, v_fr, v_intl, w_fr, w_intl FROM ranked),
  sums AS (SELECT duree, CAST(min(r) AS INT) AS rang, {rnd('sum(coalesce(p_fr, 0))', 1)} AS part_fr, {rnd('sum(coalesce(p_intl, 0))', 1)} AS part_intl,
    {big('sum(v_fr)')} AS volume_fr, {big('sum(v_intl)')} AS volume_intl, {big('sum(w_fr)')} AS w_fr, {big('sum(w_intl)')} AS w_intl FROM lines GROUP BY duree)
  SELECT duree, rang, part_fr, part_intl, volume_fr, volume_intl,
    {change('volume_fr', 'w_fr', 'A')} AS delta_fr, {change('volume_intl', 'w_intl', 'A')} AS delta_intl FROM sums"""))
def _(spark, sf):
    both = rankings.stay_distribution(nights(spark, sf, "not_local", "nb_nuits"), SUMMER, ["provenance"])
    return rankings.stay_combined(both, "provenance", R.nonlocal_, R.etranger, 5)


def _origins_body(sql: str, member: str) -> str:
    return f"SELECT {member} AS origine, n0 AS valeur FROM ({sql})"


@register("R17_origins_all", _origins_body(
    origins_sql("region", f"{TOURISTS} AND {NATIONAL}", 5, share_of="returned", policy="E"), "region"
) + " UNION ALL " + _origins_body(origins_sql("pays", f"{TOURISTS} AND {FOREIGN}", 5, policy="D"), "pays"))
def _(spark, sf):
    regions = rankings.origins(nights(spark, sf, "national", "region"), SUMMER, ["region"], 5, share_of="returned", policy="E")
    countries = rankings.origins(nights(spark, sf, "foreign", "pays"), SUMMER, ["pays"], 5, policy="D")
    return rankings.origins_all(regions, countries)


@register("R18_top_communes", with_visits("""SELECT id_commune, CAST(sum(volume) AS BIGINT) AS volume,
  CAST(row_number() OVER (ORDER BY sum(volume) DESC, id_commune) AS INT) AS rang FROM visits GROUP BY id_commune
  ORDER BY volume DESC, id_commune LIMIT 15"""))
def _(spark, sf):
    return rankings.top_members(visits(spark, sf, "id_commune", "volume"), "id_commune", 15)


@register("R19_load_profile", with_visits("""SELECT departement, count(*) AS lignes, CAST(sum(volume) AS BIGINT) AS volume
  FROM visits GROUP BY departement"""))
def _(spark, sf):
    return rankings.load_profile(visits(spark, sf, "departement", "volume"), "departement")


@register("R20_daily_average", with_visits("SELECT " + ", ".join(
    f"{big(rnd(f'coalesce(sum(CASE WHEN {hit(w.offset)} THEN volume END), 0) / {w.days}', 0))} AS n{w.offset}" for w in SUMMER
) + f" FROM visits WHERE {TOURISTS}"))
def _(spark, sf):
    return rankings.daily_average(nights(spark, sf, None), SUMMER)


