"""Named periods and seasons: finding, linking, checking and listing them.

Requests and periods meet on keys. Each kind of match (exact, any case, any
separator, part of a text) becomes its own key, the periods keep one best candidate
per key before the join, and a request takes its best kind. So a text that a third
of the requests share is resolved once, and no join pairs unequal keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sillage import fixed_values as fv
from sillage.functions import dates
from sillage.functions.text import separator_key, word_list
from sillage.operators.joins import max_overlap, overlap_counts
from sillage.operators.topk import first_by_priority

_WINDOW = ["date_debut", "date_fin"]


def _best(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The window (and code) of the first period of each key."""
    row = F.struct("date_debut", "date_fin", "code_periode", "id_periode")
    rank = F.struct(*order, F.col("date_debut"), F.col("id_periode"))
    return df.groupBy(*key).agg(F.min_by(row, rank).alias("p"))


def _distinct_requests(requests: DataFrame) -> DataFrame:
    return requests.select("annee", "periode").distinct()


def _answer(requests: DataFrame, found: DataFrame) -> DataFrame:
    """Every request with its window: what was found, else the whole year."""
    jan, dec = dates.full_year(F.col("annee"))
    return requests.join(found, ["annee", "periode"], "left").select(
        *requests.columns,
        F.coalesce(F.col("p.date_debut"), jan).alias("start"),
        F.coalesce(F.col("p.date_fin"), dec).alias("end"),
        F.coalesce("niveau", F.lit("annee")).alias("niveau"),
    )


def resolve_period(requests: DataFrame, periods: DataFrame) -> DataFrame:
    """Window of each (annee, periode): exact code or name, then any case, then any
    separator, else the whole year.

    Texts that agree exactly or but for case agree under the separator key too, so
    one join on that key finds the candidates of all three kinds. Both sides are
    distinct before it: what still shares a key are spellings of one label.
    """
    text = F.col("periode")
    whole_year = F.lower(text).isin(fv.FULL_YEAR_CODE, fv.FULL_YEAR_LABEL.lower())
    asked = _distinct_requests(requests).where(~whole_year).withColumn("cle", separator_key(text))
    labels = periods.select("*", F.explode(F.array("code_periode", "nom_periode")).alias("libelle"))
    known = _best(labels, ["annee", "libelle"], []).withColumn("cle", separator_key(F.col("libelle")))
    level = (
        F.when(F.col("libelle") == text, "1 exact")
        .when(F.lower("libelle") == F.lower(text), "2 casse").otherwise("3 separateur")
    )
    found = asked.join(known, ["annee", "cle"]).withColumn("niveau", level)
    rank = F.struct("niveau", "p.date_debut", "p.id_periode")
    best = found.groupBy("annee", "periode").agg(F.min_by("p", rank).alias("p"), F.min("niveau").alias("niveau"))
    return _answer(requests, best)


def _prefix_rank(code: Column) -> Column:
    out = None
    for prefix, rank in fv.PERIOD_PREFIX_ORDER:
        out = F.when(code.startswith(prefix), rank) if out is None else out.when(code.startswith(prefix), rank)
    return out.otherwise(len(fv.PERIOD_PREFIX_ORDER) + 1)


def _part_index(periods: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows (annee, terme, period) for every asked-for text that is part of a code, a
    name or a season of a period; a blank text is part of none.

    Distinct labels are cut into parts of the lengths that somebody asks for (as many as
    the longest label has letters at most) and met by equality; periods follow by label.
    """
    terms = asked.where("terme <> ''").select("terme").distinct()
    columns = ["code_periode", "nom_periode"] + (["saison"] if "saison" in periods.columns else [])
    labelled = periods.select("*", F.explode(F.array_distinct(F.array(*[F.lower(F.col(c)) for c in columns]))).alias("libelle"))
    labels = labelled.where(F.col("libelle").isNotNull()).select("libelle").distinct()
    longest = labels.agg(F.max(F.length("libelle"))).first()[0] or 0
    lengths = sorted(r[0] for r in terms.select(F.length("terme").alias("n")).where(F.col("n") <= longest).distinct().collect())
    label = F.col("libelle")
    wanted = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(label))
    parts = F.transform(wanted, lambda n: F.transform(F.sequence(F.lit(1), F.length(label) - n + 1), lambda i: F.substr(label, i, n)))
    met = labels.select("libelle", F.explode(F.array_distinct(F.flatten(parts))).alias("terme")).join(terms, "terme", "left_semi")
    return labelled.join(met, "libelle").drop("libelle").distinct()


def resolve_alias(requests: DataFrame, periods: DataFrame) -> DataFrame:
    """As ``resolve_period``, for the words of the interface: ``annee`` means the whole
    year, and a word may be part of a code or a name."""
    asked = _distinct_requests(requests).withColumn("terme", F.lower(F.trim("periode")))
    words = asked.where(~F.col("terme").isin(*fv.FULL_YEAR_WORDS))
    code, name = F.lower(F.col("code_periode")), F.lower(F.col("nom_periode"))
    term = F.col("terme")
    rank = F.when(code == term, 1).when(name == term, 2).when(code.contains(term), 3).otherwise(4)
    best = _best(_part_index(periods, words).withColumn("_rang", rank), ["annee", "terme"], [F.col("_rang")])
    found = words.join(best, ["annee", "terme"]).select(
        "annee", "periode", "p", F.lit("4 partie").alias("niveau")
    )
    return _answer(requests, found)


def season_period(requests: DataFrame, periods: DataFrame, seasons: DataFrame) -> DataFrame:
    """Best linked period of a season for each (annee, saison); the winter of a year is
    stored under the year before."""
    linked = periods.join(seasons.select(F.col("id").alias("id_saison"), "saison", F.col("annee").alias("_an")), "id_saison")
    best = _best(linked, ["saison", "_an"], [_prefix_rank(F.col("code_periode"))])
    asked = requests.withColumn("_an", F.when(F.col("saison") == "hiver", F.col("annee") - 1).otherwise(F.col("annee")))
    return asked.join(best, ["saison", "_an"], "left").select(
        *requests.columns, "p.code_periode", "p.date_debut", "p.date_fin"
    )


def recognise(requests: DataFrame, periods: DataFrame, seasons: DataFrame) -> DataFrame:
    """Free text to a period: a season word, the text itself, words of the periods whose
    labels hold the text, then related words."""
    asked = _distinct_requests(requests).withColumn("texte", F.lower(F.trim("periode")))
    spoken = F.create_map(*[F.lit(t) for pair in fv.SEASON_WORDS.items() for t in pair])[F.col("texte")]
    by_season = season_period(
        asked.withColumn("saison", spoken).where(F.col("saison").isNotNull()), periods, seasons
    ).where(F.col("code_periode").isNotNull()).select(
        "annee", "periode", F.lit(0).alias("rang"), F.lit("").alias("mot"), "code_periode", *_WINDOW
    )

    labelled = periods.join(
        seasons.select(F.col("id").alias("id_saison"), "saison"), "id_saison", "left"
    )
    texts = asked.select(F.col("texte").alias("terme")).distinct()
    learned = (
        _part_index(periods, texts)
        .select("terme", F.explode(F.array_union(word_list(F.col("code_periode")), word_list(F.col("nom_periode")))).alias("mot"))
        .distinct()
    )
    related = None
    for word, more in fv.TERM_EXPANSIONS:
        hit, words = F.col("texte").contains(word), F.array(*[F.lit(m) for m in more])
        related = F.when(hit, words) if related is None else related.when(hit, words)
    terms = (
        asked.select("annee", "periode", F.lit(1).alias("rang"), F.col("texte").alias("mot"))
        .unionByName(asked.join(learned, asked.texte == learned.terme).select("annee", "periode", F.lit(2).alias("rang"), "mot"))
        .unionByName(asked.select("annee", "periode", F.lit(3).alias("rang"), F.explode(related).alias("mot")))
    )
    vocabulary = terms.select(F.col("mot").alias("terme"))
    code, name, term = F.lower("code_periode"), F.lower("nom_periode"), F.col("terme")
    match = (
        F.when(code == term, 1).when(name == term, 2).when(F.lower("saison") == term, 3)
        .when(code.contains(term), 4).otherwise(5)
    )
    candidates = _part_index(labelled, vocabulary).withColumn("_m", match)
    best = _best(candidates, ["annee", "terme"], [F.col("_m"), _prefix_rank(F.col("code_periode"))])
    by_term = terms.join(best, (terms.mot == best.terme) & (terms.annee == best.annee)).select(
        terms.annee, "periode", "rang", "mot", "p.code_periode", "p.date_debut", "p.date_fin"
    )
    chosen = first_by_priority(
        by_season.unionByName(by_term), ["annee", "periode"], [F.col("rang"), F.col("mot")]
    )
    return requests.join(chosen, ["annee", "periode"], "left").select(
        *requests.columns, "code_periode", "date_debut", "date_fin", "rang"
    )


def season_bounds(starts: DataFrame) -> DataFrame:
    """A season ends the day before the next one starts; the last one with the year."""
    upcoming = F.lead("date_debut").over(W.orderBy("date_debut"))
    end = F.coalesce(F.date_sub(upcoming, 1), F.make_date("annee", F.lit(12), F.lit(31)))
    return starts.withColumn("date_fin", end).withColumn(
        "duree_jours", dates.days_inclusive(F.col("date_debut"), F.col("date_fin"))
    )


def number_seasons(seasons: DataFrame) -> DataFrame:
    return seasons.withColumn("id", F.row_number().over(W.orderBy("date_debut")))


def link_seasons(periods: DataFrame, seasons: DataFrame) -> DataFrame:
    """Each period with the season that shares most of its days, null if none does."""
    named = seasons.select(
        F.col("id").alias("id_saison"), F.col("date_debut").alias("s_debut"), F.col("date_fin").alias("s_fin")
    )
    best = max_overlap(
        periods, named, "id_periode", "id_saison", ("date_debut", "date_fin"), ("s_debut", "s_fin")
    )
    return periods.drop("id_saison").join(best.select("id_periode", "id_saison", "jours"), "id_periode", "left")


def link_stats(old: DataFrame, new: DataFrame) -> DataFrame:
    """Links that are new, changed, unchanged or missing."""
    o, n = F.col("ancien"), F.col("nouveau")
    state = (
        F.when(n.isNull(), "sans_saison").when(o.isNull(), "nouveau").when(o != n, "modifie").otherwise("inchange")
    )
    return (
        new.select("id_periode", F.col("id_saison").alias("nouveau"))
        .join(old.select("id_periode", F.col("id_saison").alias("ancien")), "id_periode", "left")
        .groupBy(state.alias("etat")).agg(F.count(F.lit(1)).alias("periodes"))
    )


def season_calendar(seasons: DataFrame, linked: DataFrame, asof, label: str = "nom_periode") -> DataFrame:
    """Seasons with their bounds, number and distinct names of periods, and whether they are on."""
    today = F.lit(asof).cast("date")
    per_season = linked.where(F.col("id_saison").isNotNull()).groupBy("id_saison").agg(
        F.count(F.lit(1)).alias("nb_periodes"),
        F.array_join(F.sort_array(F.collect_set(label)), ", ").alias("periodes"),
    )
    return seasons.join(per_season, seasons.id == per_season.id_saison, "left").select(
        "id", "annee", "saison", "date_debut", "date_fin",
        dates.fmt_dmy(F.col("date_debut")).alias("debut_fr"), dates.fmt_dmy(F.col("date_fin")).alias("fin_fr"),
        "duree_jours", F.coalesce("nb_periodes", F.lit(0).cast("long")).alias("nb_periodes"), "periodes",
        F.lit(today).between(F.col("date_debut"), F.col("date_fin")).alias("en_cours"),
    )


def periods_by_code(periods: DataFrame) -> DataFrame:
    """Years in which each code occurs, latest first, with its outermost dates."""
    years = F.transform(F.sort_array(F.collect_set("annee"), asc=False), lambda y: y.cast("string"))
    return periods.groupBy("code_periode", "nom_periode").agg(
        F.count(F.lit(1)).alias("nb_annees"), F.min("annee").alias("premiere_annee"),
        F.max("annee").alias("derniere_annee"), F.array_join(years, ",").alias("annees"),
        F.min("date_debut").alias("plus_ancienne"), F.max("date_fin").alias("plus_recente"),
    )


def period_conflicts(periods: DataFrame) -> DataFrame:
    """Periods that overlap others of their year, with the number of those."""
    return overlap_counts(periods).where(F.col("nb_conflits") > 0)


def period_verdict() -> Column:
    """First rule a period breaks, ``OK`` if none."""
    def blank(c: str) -> Column:
        return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""

    return (
        F.when(blank("code_periode"), "code requis")
        .when(blank("nom_periode"), "nom requis")
        .when(F.col("annee").isNull() | (F.col("annee") == 0), "annee invalide")
        .when(F.col("date_debut").isNull() | F.col("date_fin").isNull(), "dates requises")
        .when(F.col("date_debut") >= F.col("date_fin"), "debut apres fin")
        .when(
            (F.year("date_debut") != F.col("annee")) & (F.year("date_fin") != F.col("annee")),
            "annee differente",
        )
        .otherwise("OK")
    )


def validate_periods(periods: DataFrame) -> DataFrame:
    return periods.withColumn("motif", period_verdict())


def copy_periods(periods: DataFrame, source_year: int, target_year: int) -> DataFrame:
    """Periods of one year moved to another, codes that the target year has left out."""
    shift = target_year - source_year
    there = periods.where(F.col("annee") == target_year).select("code_periode")
    return (
        periods.where(F.col("annee") == source_year).join(there, "code_periode", "left_anti")
        .select(
            "code_periode", "nom_periode", F.lit(target_year).alias("annee"),
            dates.shift_years(F.col("date_debut"), shift).alias("date_debut"),
            dates.shift_years(F.col("date_fin"), shift).alias("date_fin"),
        )
    )


def period_stats(periods: DataFrame) -> DataFrame:
    """Counts in all, per year and per code: (groupe, valeur, periodes)."""
    cells = F.array(
        F.struct(F.lit("total").alias("groupe"), F.lit("").alias("valeur")),
        F.struct(F.lit("annee").alias("groupe"), F.col("annee").cast("string").alias("valeur")),
        F.struct(F.lit("code").alias("groupe"), F.col("code_periode").alias("valeur")),
    )
    return periods.select(F.explode(cells).alias("c")).select("c.*").groupBy("groupe", "valeur").agg(
        F.count(F.lit(1)).alias("periodes")
    )


def season_coverage(seasons: DataFrame, linked: DataFrame) -> DataFrame:
    """Per year: seasons present, whether all four are, periods and their linked share."""
    s = seasons.groupBy("annee").agg(F.countDistinct("saison").alias("saisons"))
    p = linked.groupBy("annee").agg(
        F.count(F.lit(1)).alias("periodes"), F.count("id_saison").alias("liees")
    )
    return s.join(p, "annee", "full").select(
        "annee", F.coalesce("saisons", F.lit(0).cast("long")).alias("saisons"),
        (F.coalesce("saisons", F.lit(0).cast("long")) == 4).alias("complete"),
        F.coalesce("periodes", F.lit(0).cast("long")).alias("periodes"),
        F.coalesce("liees", F.lit(0).cast("long")).alias("liees"),
        F.round(F.col("liees") * F.lit(100.0) / F.col("periodes"), 1).alias("taux_liaison"),
    )


def assign_season(periods: DataFrame, code: str = "code_periode") -> DataFrame:
    """Season of a period by its code alone; null means the code is not assigned."""
    pairs = [F.lit(t) for pair in fv.PERIOD_SEASONS.items() for t in pair]
    return periods.withColumn("saison", F.create_map(*pairs)[F.col(code)])


def unassigned(periods: DataFrame, code: str = "code_periode") -> DataFrame:
    return (
        assign_season(periods, code).where(F.col("saison").isNull())
        .groupBy(code).agg(F.count(F.lit(1)).alias("periodes"))
    )


def period_list(periods: DataFrame) -> DataFrame:
    """Periods as offered for choice, the whole year first."""
    spark = periods.sparkSession
    listed = periods.select(
        F.lit(1).alias("ordre"), F.col("code_periode").alias("value"), F.col("nom_periode").alias("label"),
        dates.period_label(F.col("nom_periode"), F.col("date_debut"), F.col("date_fin")).alias("description"),
        "annee", "date_debut", "date_fin",
    )
    whole = spark.range(1).select(
        F.lit(0).alias("ordre"), F.lit(fv.FULL_YEAR_CODE).alias("value"), F.lit(fv.FULL_YEAR_LABEL).alias("label"),
        F.lit(f"{fv.FULL_YEAR_LABEL} (01/01 - 31/12)").alias("description"),
        F.lit(None).cast("int").alias("annee"), F.lit(None).cast("date").alias("date_debut"),
        F.lit(None).cast("date").alias("date_fin"),
    )
    return whole.unionByName(listed).orderBy("ordre", F.desc("annee"), "date_debut", "value")


def visible_zones(zones: DataFrame, hidden: DataFrame, display: DataFrame, col: str = "zone") -> DataFrame:
    """Zones offered for choice under their displayed names."""
    key = F.upper(F.trim(F.col(col)))
    shown = zones.withColumn(col, key).join(hidden, col, "left_anti").join(display, col, "left")
    return shown.select(F.coalesce("affichage", F.col(col)).alias("zone")).distinct().orderBy("zone")
