"""P: named periods, seasons and window arithmetic, over a period table that grows with the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from sillage import fixed_values as fv
from sillage.catalog.base import register, rnd, with_periods, with_visits
from sillage.catalog.filters import quoted
from sillage.catalog.joins import BEST_SEASON_SQL, CONFLICTS_SQL, SEASONS_SQL, seasons
from sillage.functions import dates
from sillage.plans import calendar
from sillage.plans.windows import Windows
from sillage.sources import binding
from sillage.sources.binding import OFFICIAL_SQL, SEASON_STARTS_SQL, official_periods, order_periods, season_starts, table, visits

# requests, one per order: the period's code or name as users would type it, or something unknown
_CODE, _NAME = binding.PERIOD_COLUMNS["code_periode"], binding.PERIOD_COLUMNS["nom_periode"]
ASKED = {
    "id": "o_orderkey",
    "annee": "CAST(extract(year FROM o_orderdate) AS INT) - CASE WHEN o_orderkey % 6 = 5 THEN 1 ELSE 0 END",
    "periode": f"""CASE o_orderkey % 6 WHEN 0 THEN {_CODE} WHEN 1 THEN upper({_CODE}) WHEN 2 THEN replace({_NAME}, '-', ' ')
      WHEN 3 THEN {_NAME} WHEN 4 THEN 'Année complète' ELSE replace({_CODE}, '_', '-') END""",
}
ASKED_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in ASKED.items()) + " FROM orders"


def asked(spark, sf):
    return table(spark, sf, "orders").select(*[F.expr(e).alias(n) for n, e in ASKED.items()])


def _key_sql(text: str) -> list[str]:
    return [text, f"lower({text})", f"lower(replace(replace({text}, '_', ' '), '-', ' '))"]


def _tier_sql() -> str:
    levels = ("1 exact", "2 casse", "3 separateur")
    parts = []
    for i, level in enumerate(levels):
        wanted = _key_sql("q.periode")[i]
        for c in ("code_periode", "nom_periode"):
            parts.append(
                f"""SELECT q.annee, q.periode, '{level}' AS niveau, p.date_debut, p.date_fin, p.id_periode FROM q JOIN periods p
                ON p.annee = q.annee AND {_key_sql('p.' + c)[i]} = {wanted}"""
            )
    return " UNION ALL ".join(parts)


@register("P01_resolve_period", with_periods(f""", asked AS ({ASKED_SQL}),
  q AS (SELECT DISTINCT annee, periode FROM asked WHERE lower(periode) NOT IN ('annee_complete', 'année complète')),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY annee, periode ORDER BY niveau, date_debut, id_periode) AS r FROM ({_tier_sql()})) WHERE r = 1)
  SELECT id, a.annee, a.periode, coalesce(date_debut, make_date(a.annee, 1, 1)) AS start, coalesce(date_fin, make_date(a.annee, 12, 31)) AS "end",
    coalesce(niveau, 'annee') AS niveau FROM asked a LEFT JOIN best USING (annee, periode)"""))
def _(spark, sf):
    return calendar.resolve_period(asked(spark, sf), order_periods(spark, sf))


# words that are part of the official codes and names; also the year and an unknown word
WORDS = ("paques", "HIVER", "weekend", "Ascension", "vacances", "année", " ete ", "ski", "Weekend Paques", "noe", "k", "ca", "_")
_WORD_CASE = "CASE o_orderkey % 13 " + " ".join(f"WHEN {i} THEN {quoted(w)}" for i, w in enumerate(WORDS)) + " END"
WORDS_SQL = f"SELECT o_orderkey AS id, CAST(extract(year FROM o_orderdate) AS INT) AS annee, {_WORD_CASE} AS periode FROM orders"


def words(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("annee"), F.expr(_WORD_CASE).alias("periode")
    )


@register("P02_resolve_alias", f"""WITH asked AS ({WORDS_SQL}), off AS ({OFFICIAL_SQL}),
  q AS (SELECT DISTINCT annee, periode, lower(trim(periode)) AS w FROM asked WHERE lower(trim(periode)) NOT IN ('annee_complete', 'année complète', 'annee', 'année')),
  best AS (SELECT * FROM (SELECT q.annee, q.periode, date_debut, date_fin, row_number() OVER (PARTITION BY q.annee, q.periode ORDER BY
      CASE WHEN lower(code_periode) = w THEN 1 WHEN lower(nom_periode) = w THEN 2 WHEN contains(lower(code_periode), w) THEN 3 ELSE 4 END, date_debut, id_periode) AS r
    FROM q JOIN off ON off.annee = q.annee AND (contains(lower(code_periode), w) OR contains(lower(nom_periode), w))) WHERE r = 1)
  SELECT id, a.annee, a.periode, coalesce(date_debut, make_date(a.annee, 1, 1)) AS start, coalesce(date_fin, make_date(a.annee, 12, 31)) AS "end",
    CASE WHEN date_debut IS NULL THEN 'annee' ELSE '4 partie' END AS niveau FROM asked a LEFT JOIN best USING (annee, periode)""")
def _(spark, sf):
    return calendar.resolve_alias(words(spark, sf), official_periods(spark, sf))


def linked_official(spark, sf):
    return calendar.link_seasons(official_periods(spark, sf), seasons(spark, sf))


LINKED_OFFICIAL_SQL = f"""SELECT periods.*, id_saison FROM periods LEFT JOIN ({BEST_SEASON_SQL}) b USING (id_periode)"""
_PREFIX = "CASE WHEN starts_with(code_periode, 'vacances_') THEN 1 WHEN starts_with(code_periode, 'weekend_') THEN 2 WHEN starts_with(code_periode, 'pont_') THEN 3 ELSE 4 END"
SEASON_BEST = f"""SELECT * FROM (SELECT s.saison, s.annee AS s_annee, l.code_periode, l.date_debut, l.date_fin,
    row_number() OVER (PARTITION BY s.saison, s.annee ORDER BY {_PREFIX}, l.date_debut, l.id_periode) AS r
  FROM linked l JOIN ({SEASONS_SQL}) s ON s.id = l.id_saison) WHERE r = 1"""


@register("P03_season_period", f"""WITH periods AS ({OFFICIAL_SQL}), linked AS ({LINKED_OFFICIAL_SQL}),
  asked AS (SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INT) AS annee, list_extract(['hiver', 'printemps', 'ete', 'automne'], CAST(o_orderkey % 4 AS INT) + 1) AS saison FROM orders)
  SELECT id, annee, a.saison, code_periode, date_debut, date_fin FROM asked a LEFT JOIN ({SEASON_BEST}) b
    ON b.saison = a.saison AND b.s_annee = CASE WHEN a.saison = 'hiver' THEN annee - 1 ELSE annee END""")
def _(spark, sf):
    names = F.array(*[F.lit(s) for s in ("hiver", "printemps", "ete", "automne")])
    requests = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("annee"),
        F.element_at(names, (F.col("o_orderkey") % 4).cast("int") + 1).alias("saison"),
    )
    return calendar.season_period(requests, linked_official(spark, sf), seasons(spark, sf))


_SPOKEN = " ".join(f"WHEN w = {quoted(a)} THEN {quoted(b)}" for a, b in fv.SEASON_WORDS.items())
_RELATED = " ".join(
    f"WHEN contains(w, {quoted(word)}) THEN [{', '.join(quoted(m) for m in more)}]" for word, more in fv.TERM_EXPANSIONS
)
_SPLIT = "unnest(list_concat(regexp_split_to_array(lower(code_periode), '[_\\-\\s''\"]+'), regexp_split_to_array(lower(nom_periode), '[_\\-\\s''\"]+')))"
_STOP = ", ".join(quoted(w) for w in fv.STOP_WORDS)


@register("P04_recognise", f"""WITH periods AS ({OFFICIAL_SQL}), linked AS ({LINKED_OFFICIAL_SQL}), asked AS ({WORDS_SQL}),
  named AS (SELECT l.*, s.saison FROM linked l LEFT JOIN ({SEASONS_SQL}) s ON s.id = l.id_saison),
  q AS (SELECT DISTINCT annee, periode, lower(trim(periode)) AS w FROM asked),
  seasonal AS (SELECT q.annee, periode, 0 AS rang, '' AS mot, code_periode, date_debut, date_fin FROM
    (SELECT *, CASE {_SPOKEN} END AS saison FROM q) q JOIN ({SEASON_BEST}) b ON b.saison = q.saison AND b.s_annee = CASE WHEN q.saison = 'hiver' THEN q.annee - 1 ELSE q.annee END),
  learned AS (SELECT DISTINCT w, mot FROM (SELECT q.w, {_SPLIT} AS mot FROM (SELECT DISTINCT w FROM q) q JOIN named
      ON contains(lower(code_periode), q.w) OR contains(lower(nom_periode), q.w) OR contains(coalesce(saison, ''), q.w)) WHERE length(mot) > 2 AND mot NOT IN ({_STOP})),
  terms AS (SELECT annee, periode, 1 AS rang, w AS mot FROM q UNION ALL SELECT annee, periode, 2, mot FROM q JOIN learned USING (w)
    UNION ALL SELECT annee, periode, 3, unnest(CASE {_RELATED} END) FROM q),
  matched AS (SELECT t.annee, t.periode, t.rang, t.mot, code_periode, date_debut, date_fin, row_number() OVER (PARTITION BY t.annee, t.periode, t.rang, t.mot ORDER BY
      CASE WHEN lower(code_periode) = mot THEN 1 WHEN lower(nom_periode) = mot THEN 2 WHEN saison = mot THEN 3 WHEN contains(lower(code_periode), mot) THEN 4 ELSE 5 END,
      {_PREFIX}, date_debut, id_periode) AS r
    FROM terms t JOIN named n ON n.annee = t.annee AND (contains(lower(code_periode), mot) OR contains(lower(nom_periode), mot) OR contains(coalesce(saison, ''), mot))),
  chosen AS (SELECT *, row_number() OVER (PARTITION BY annee, periode ORDER BY rang, mot) AS c FROM
    (SELECT * FROM seasonal UNION ALL SELECT annee, periode, rang, mot, code_periode, date_debut, date_fin FROM matched WHERE r = 1))
  SELECT id, a.annee, a.periode, code_periode, date_debut, date_fin, rang FROM asked a LEFT JOIN (SELECT * FROM chosen WHERE c = 1) b USING (annee, periode)""")
def _(spark, sf):
    return calendar.recognise(words(spark, sf), linked_official(spark, sf), seasons(spark, sf))


_SEASON_OF_ROW = "list_extract(['hiver', 'printemps', 'ete', 'automne', 'autre'], CAST(o_orderkey % 5 AS INT) + 1)"


def dated_rows(spark, sf):
    names = F.array(*[F.lit(s) for s in ("hiver", "printemps", "ete", "automne", "autre")])
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("annee"),
        F.element_at(names, (F.col("o_orderkey") % 5).cast("int") + 1).alias("saison"),
    )


def _window_query(key: str, sql_start: str, sql_end: str, function) -> None:
    sql = f"""SELECT id, annee, saison, {sql_start} AS start, {sql_end} AS "end" FROM
      (SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INT) AS annee, {_SEASON_OF_ROW} AS saison FROM orders)"""

    @register(key, sql)
    def _(spark, sf):
        start, end = function(F.col("saison"), F.col("annee"))
        return dated_rows(spark, sf).select("*", start.alias("start"), end.alias("end"))


def _case(arms: dict[str, str], other: str) -> str:
    return "CASE saison " + " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in arms.items()) + f" ELSE {other} END"


_JAN, _DEC = "make_date(annee, 1, 1)", "make_date(annee, 12, 31)"
_window_query(
    "P05_synthetic_window",
    _case({"hiver": "make_date(annee - 1, 12, 1)", "printemps": "make_date(annee, 3, 1)", "ete": "make_date(annee, 6, 1)", "automne": "make_date(annee, 9, 1)"}, _JAN),
    _case({"hiver": "make_date(annee, 3, 1) - 1", "printemps": "make_date(annee, 5, 31)", "ete": "make_date(annee, 8, 31)", "automne": "make_date(annee, 11, 30)"}, _DEC),
    dates.synthetic_window,
)
_window_query(
    "P06_astro_window",
    _case({"hiver": "make_date(annee, 12, 21)", "printemps": "make_date(annee, 3, 21)", "ete": "make_date(annee, 6, 21)", "automne": "make_date(annee, 9, 23)"}, _JAN),
    _case({"hiver": "make_date(annee + 1, 3, 20)", "printemps": "make_date(annee, 6, 20)", "ete": "make_date(annee, 9, 22)", "automne": "make_date(annee, 12, 20)"}, _DEC),
    dates.astro_window,
)
_window_query(
    "P07_fallback_window",
    _case({"hiver": "make_date(annee, 2, 8)", "printemps": "make_date(annee, 4, 5)"}, _JAN),
    _case({"hiver": "make_date(annee, 3, 8)", "printemps": "make_date(annee, 6, 8)"}, _DEC),
    dates.fallback_window,
)


@register("P08_shift_years", with_periods("""SELECT id_periode, CAST(date_debut - INTERVAL 1 YEAR AS DATE) AS debut_n1, CAST(date_fin - INTERVAL 1 YEAR AS DATE) AS fin_n1,
  CAST(date_debut - INTERVAL 4 YEAR AS DATE) AS debut_n4 FROM periods"""))
def _(spark, sf):
    return order_periods(spark, sf).select(
        "id_periode", dates.shift_years(F.col("date_debut"), -1).alias("debut_n1"),
        dates.shift_years(F.col("date_fin"), -1).alias("fin_n1"), dates.shift_years(F.col("date_debut"), -4).alias("debut_n4"),
    )


@register("P09_override", with_periods("""SELECT id_periode, CASE WHEN f >= d THEN d ELSE date_debut END AS start, CASE WHEN f >= d THEN f ELSE date_fin END AS "end" FROM (
  SELECT *, date_debut + 3 AS d, CASE WHEN id_periode % 5 = 0 THEN NULL ELSE date_fin - 5 END AS f FROM periods)"""))
def _(spark, sf):
    user_end = F.when(F.col("id_periode") % 5 != 0, F.date_sub("date_fin", 5))
    start, end = dates.override(F.col("date_debut"), F.col("date_fin"), F.date_add("date_debut", 3), user_end)
    return order_periods(spark, sf).select("id_periode", start.alias("start"), end.alias("end"))


def _saturday_sql(n: int) -> str:
    day = f"date_debut + CAST((13 - isodow(date_debut)) % 7 + {7 * (n - 1)} AS INT)"
    return f"CASE WHEN {day} <= date_fin THEN {day} END AS samedi_{n}"


@register("P10_nth_saturday", with_periods(f"SELECT id_periode, {', '.join(_saturday_sql(n) for n in (1, 2, 3))} FROM periods"))
def _(spark, sf):
    return order_periods(spark, sf).select("id_periode", *[
        dates.nth_saturday(F.col("date_debut"), F.col("date_fin"), n).alias(f"samedi_{n}") for n in (1, 2, 3)
    ])


@register("P11_season_bounds", f"""SELECT *, CAST(date_fin - date_debut + 1 AS INT) AS duree_jours FROM (
  SELECT annee, saison, date_debut, coalesce(lead(date_debut) OVER (ORDER BY date_debut) - 1, make_date(annee, 12, 31)) AS date_fin FROM ({SEASON_STARTS_SQL}))""")
def _(spark, sf):
    return calendar.season_bounds(season_starts(spark, sf))


def linked(spark, sf):
    return calendar.link_seasons(order_periods(spark, sf), seasons(spark, sf))


@register("P12_link_seasons", with_periods(f"SELECT periods.*, id_saison, jours FROM periods LEFT JOIN ({BEST_SEASON_SQL}) USING (id_periode)"))
def _(spark, sf):
    return linked(spark, sf)


# links as they were before: none for every third period, one season too early for every fifth
@register("P13_link_stats", with_periods(f""", new AS (SELECT periods.id_periode, id_saison FROM periods LEFT JOIN ({BEST_SEASON_SQL}) USING (id_periode))
  SELECT CASE WHEN n IS NULL THEN 'sans_saison' WHEN o IS NULL THEN 'nouveau' WHEN o <> n THEN 'modifie' ELSE 'inchange' END AS etat, count(*) AS periodes FROM (
    SELECT id_saison AS n, CASE WHEN id_periode % 3 = 0 THEN NULL WHEN id_periode % 5 = 0 THEN id_saison - 1 ELSE id_saison END AS o FROM new) GROUP BY ALL"""))
def _(spark, sf):
    new = linked(spark, sf)
    before = F.when(F.col("id_periode") % 3 == 0, None).when(F.col("id_periode") % 5 == 0, F.col("id_saison") - 1).otherwise(F.col("id_saison"))
    return calendar.link_stats(new.select("id_periode", before.alias("id_saison")), new)


@register("P14_season_calendar", f"""WITH periods AS ({binding.order_periods_sql('base')}), l AS (SELECT id_saison, base FROM periods JOIN ({BEST_SEASON_SQL}) USING (id_periode)),
  n AS (SELECT id_saison, count(*) AS nb, string_agg(DISTINCT base, ', ' ORDER BY base) AS noms FROM l GROUP BY id_saison)
  SELECT id, annee, saison, date_debut, date_fin, strftime(date_debut, '%d/%m/%Y') AS debut_fr, strftime(date_fin, '%d/%m/%Y') AS fin_fr,
    CAST(date_fin - date_debut + 1 AS INT) AS duree_jours, coalesce(nb, 0) AS nb_periodes, noms AS periodes,
    DATE '2000-07-14' BETWEEN date_debut AND date_fin AS en_cours FROM ({SEASONS_SQL}) LEFT JOIN n ON id_saison = id""")
def _(spark, sf):
    named = calendar.link_seasons(order_periods(spark, sf, "base"), seasons(spark, sf))
    return calendar.season_calendar(seasons(spark, sf), named, "2000-07-14", "base")


@register("P15_periods_by_code", with_periods("""SELECT code_periode, nom_periode, count(*) AS nb_annees, min(annee) AS premiere_annee, max(annee) AS derniere_annee,
  string_agg(DISTINCT CAST(annee AS VARCHAR), ',' ORDER BY CAST(annee AS VARCHAR) DESC) AS annees, min(date_debut) AS plus_ancienne, max(date_fin) AS plus_recente
  FROM periods GROUP BY code_periode, nom_periode"""))
def _(spark, sf):
    return calendar.periods_by_code(order_periods(spark, sf))


@register("P16_period_conflicts", with_periods(f"SELECT * FROM ({CONFLICTS_SQL}) WHERE nb_conflits > 0"))
def _(spark, sf):
    return calendar.period_conflicts(order_periods(spark, sf))


# one fault per kind of row
_FAULTS = {
    "code_periode": "CASE WHEN id_periode % 11 = 0 THEN ' ' ELSE code_periode END",
    "nom_periode": "CASE WHEN id_periode % 13 = 0 THEN NULL ELSE nom_periode END",
    "annee": "CASE WHEN id_periode % 17 = 0 THEN 0 WHEN id_periode % 19 = 0 THEN annee + 3 ELSE annee END",
    "date_debut": "date_debut",
    "date_fin": "CASE WHEN id_periode % 23 = 0 THEN NULL ELSE date_fin END",
}
_FAULTY = "SELECT id_periode, " + ", ".join(f"{e} AS {n}" for n, e in _FAULTS.items()) + " FROM periods"


@register("P17_validate_periods", with_periods(f"""SELECT *, CASE WHEN trim(coalesce(code_periode, '')) = '' THEN 'code requis' WHEN trim(coalesce(nom_periode, '')) = '' THEN 'nom requis'
  WHEN coalesce(annee, 0) = 0 THEN 'annee invalide' WHEN date_debut IS NULL OR date_fin IS NULL THEN 'dates requises' WHEN date_debut >= date_fin THEN 'debut apres fin'
  WHEN year(date_debut) <> annee AND year(date_fin) <> annee THEN 'annee differente' ELSE 'OK' END AS motif FROM ({_FAULTY})"""))
def _(spark, sf):
    faulty = order_periods(spark, sf).select("id_periode", *[F.expr(e).alias(n) for n, e in _FAULTS.items()])
    return calendar.validate_periods(faulty)


@register("P18_copy_periods", with_periods("""SELECT code_periode, nom_periode, CAST(2001 AS INT) AS annee, CAST(date_debut + INTERVAL 5 YEAR AS DATE) AS date_debut,
  CAST(date_fin + INTERVAL 5 YEAR AS DATE) AS date_fin FROM periods WHERE annee = 1996 AND code_periode NOT IN (SELECT code_periode FROM periods WHERE annee = 2001)"""))
def _(spark, sf):
    return calendar.copy_periods(order_periods(spark, sf), 1996, 2001)


@register("P19_period_stats", with_periods("""SELECT 'total' AS groupe, '' AS valeur, count(*) AS periodes FROM periods
  UNION ALL SELECT 'annee', CAST(annee AS VARCHAR), count(*) FROM periods GROUP BY annee UNION ALL SELECT 'code', code_periode, count(*) FROM periods GROUP BY code_periode"""))
def _(spark, sf):
    return calendar.period_stats(order_periods(spark, sf))


@register("P20_season_coverage", with_periods(f""", l AS (SELECT periods.annee, id_saison FROM periods LEFT JOIN ({BEST_SEASON_SQL}) USING (id_periode)),
  s AS (SELECT annee, count(DISTINCT saison) AS saisons FROM ({SEASONS_SQL}) WHERE annee < 2001 OR saison <> 'hiver' GROUP BY annee),
  p AS (SELECT annee, count(*) AS periodes, count(id_saison) AS liees FROM l GROUP BY annee)
  SELECT annee, coalesce(saisons, 0) AS saisons, coalesce(saisons, 0) = 4 AS complete, coalesce(periodes, 0) AS periodes, coalesce(liees, 0) AS liees,
    {rnd('liees * 100.0::DOUBLE / periodes', 1)} AS taux_liaison FROM s FULL JOIN p USING (annee)"""))
def _(spark, sf):
    known = seasons(spark, sf).where((F.col("annee") < 2001) | (F.col("saison") != "hiver"))
    return calendar.season_coverage(known, linked(spark, sf))


_SEASON_CASE = "CASE base " + " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in fv.PERIOD_SEASONS.items()) + " END"


@register("P21_assign_season", with_periods(f"SELECT id_periode, base, {_SEASON_CASE} AS saison FROM periods", "base"))
def _(spark, sf):
    return calendar.assign_season(order_periods(spark, sf, "base").select("id_periode", "base"), "base")


@register("P21_unassigned", with_periods(f"SELECT base, count(*) AS periodes FROM periods WHERE {_SEASON_CASE} IS NULL GROUP BY base", "base"))
def _(spark, sf):
    return calendar.unassigned(order_periods(spark, sf, "base"), "base")


@register("P22_current_season", with_periods("""SELECT id_periode, CASE WHEN month(date_debut) BETWEEN 3 AND 5 THEN 'printemps' WHEN month(date_debut) BETWEEN 6 AND 8 THEN 'ete'
  WHEN month(date_debut) BETWEEN 9 AND 11 THEN 'automne' ELSE 'hiver' END AS saison, CAST(greatest(date_fin - DATE '2000-07-14', 0) AS INT) AS jours_restants FROM periods"""))
def _(spark, sf):
    return order_periods(spark, sf).select(
        "id_periode", dates.season_of_month(F.col("date_debut")).alias("saison"),
        dates.days_left(F.col("date_fin"), F.lit("2000-07-14").cast("date")).alias("jours_restants"),
    )


@register("P23_period_list", with_periods("""SELECT 1 AS ordre, code_periode AS value, nom_periode AS label,
  nom_periode || ' (' || strftime(date_debut, '%d/%m') || ' - ' || strftime(date_fin, '%d/%m') || ')' AS description, annee, date_debut, date_fin FROM periods
  UNION ALL SELECT 0, 'annee_complete', 'Année complète', 'Année complète (01/01 - 31/12)', NULL, NULL, NULL"""))
def _(spark, sf):
    return calendar.period_list(order_periods(spark, sf))


@register("P23_year_list", with_visits("SELECT DISTINCT CAST(year(date) AS INT) AS annee FROM visits"))
def _(spark, sf):
    from sillage.operators.aggregates import years

    return years(visits(spark, sf, "date"))


# windows that come out of a table rather than from the caller
@register("P01_windows_of_request", with_visits(f"""SELECT code_periode, CAST(sum(CASE WHEN date BETWEEN date_debut AND date_fin THEN volume END) AS BIGINT) AS n0
  FROM visits, (SELECT * FROM ({OFFICIAL_SQL}) WHERE code_periode = 'vacances_ete' AND annee = 2000) GROUP BY ALL"""))
def _(spark, sf):
    from sillage.plans.kpi import kpi_total

    asked_for = official_periods(spark, sf).where((F.col("code_periode") == "vacances_ete") & (F.col("annee") == 2000))
    windows = Windows.resolved(asked_for.select(F.lit(0).alias("offset"), F.col("date_debut").alias("start"), F.col("date_fin").alias("end")))
    return kpi_total(visits(spark, sf, "date", "volume"), windows).select(F.lit("vacances_ete").alias("code_periode"), "n0")


