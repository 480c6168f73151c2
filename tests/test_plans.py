"""Reports on small frames, period resolution, and the shape of the physical plans."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from rows import rows
from pyspark.sql import functions as F

from sillage.catalog import QUERIES
from sillage.plans import calendar, compare, kpi, load, quality, rankings
from sillage.plans.windows import Windows
from sillage.session import stage

DAY = dt.date
W = Windows.yearly("2024-07-01", "2024-07-31")


@pytest.fixture(scope="module")
def fact(spark):
    data = [
        (DAY(2024, 7, 1), "a", 50), (DAY(2024, 7, 2), "a", 10), (DAY(2024, 7, 6), "b", 40), (DAY(2024, 7, 9), None, 5), (DAY(2024, 7, 9), "CUMUL", 100),
        (DAY(2023, 7, 1), "a", 30), (DAY(2023, 7, 31), "c", 20), (DAY(2022, 7, 1), "a", 999), (DAY(2024, 8, 1), "a", 999),
    ]
    return spark.createDataFrame(data, "date date, departement string, volume bigint")


def test_comparison_table_pads_and_sums_the_rest(fact):
    got = {r["rang"]: r for r in rankings.comparison_table(fact, W, "departement", 6).collect()}
    assert [got[str(i)]["departement"] for i in range(1, 7)] == ["CUMUL", "a", "b", "Inconnu", "Données N/A", "Données N/A"]
    assert (got["2"]["n0"], got["2"]["n1"], got["2"]["delta_pct"]) == (60, 30, 100.0)
    assert got["5"]["delta_pct"] is None and got["5"]["part_pct"] == 0.0
    assert (got["Autre"]["n0"], got["Autre"]["n1"], got["Autre"]["delta_pct"]) == (0, 20, -100.0)


def test_rankings_leave_the_sentinel_out(fact):
    got = rankings.origins(fact, W, ["departement"], 10, keep="either", policy="C")
    assert [(r["departement"], r["n0"], r["n1"], r["part_pct"]) for r in got.orderBy("rang").collect()] == [
        ("a", 60, 30, 60.0), ("b", 40, 0, 40.0), ("c", 0, 20, 0.0),
    ]
    with_it = rankings.origins(fact, W, ["departement"], 10, with_sentinels=True)
    assert [(r["departement"], r["part_pct"]) for r in with_it.orderBy("rang").collect()] == [("a", 29.3), ("b", 19.5)]


def test_figures(fact):
    assert tuple(kpi.kpi_total(fact, W).first()) == (205, 50)
    assert tuple(kpi.kpi_peak(fact, W).first()) == (105, DAY(2024, 7, 9), 30, DAY(2023, 7, 1))
    assert tuple(kpi.kpi_saturday(fact, W, 1).first()) == (40, 30, DAY(2024, 7, 6), DAY(2023, 7, 1))
    assert tuple(kpi.kpi_saturday(fact, Windows.yearly("2024-07-01", "2024-07-03"), 1).first()) == (None, 30, None, DAY(2023, 7, 1))
    assert tuple(kpi.kpi_topk_sum(fact, W, "departement", 1).first()) == (100, 30)


def test_block_d7_uses_real_dates(fact):
    got = {r["rang"]: r for r in kpi.block_d7(fact, W, [(7, 14), (5, 1)]).collect()}
    assert got["14/07"]["date"] == DAY(2024, 7, 14) and got["14/07"]["n0"] == 0
    assert got["01/05"]["n0"] is None and got["01/05"]["date"] is None
    assert (got["Total"]["n0"], got["Total"]["delta_pct"]) == (205, 310.0)


def test_indicator_table(fact):
    table = kpi.indicator_table([kpi.labelled(kpi.kpi_total(fact, W), W, 1, "x", "Nuitées")], W).first()
    assert (table["n0"], table["n1"], table["evolution_1"]) == (205.0, 50.0, 310.0)


def test_stay_combined(spark):
    dist = spark.createDataFrame(
        [("fr", 1, 10, 5, 50.0), ("fr", 2, 6, 6, 30.0), ("fr", 3, 4, 0, 20.0), ("et", 1, 1, 1, 10.0), ("et", 4, 9, 3, 90.0)],
        "p string, nb_nuits int, volume bigint, volume_n1 bigint, part_pct double",
    )
    got = {r["duree"]: r for r in rankings.stay_combined(dist, "p", "fr", "et", 2).collect()}
    assert set(got) == {"4", "1", "Autres"}
    assert (got["Autres"]["part_fr"], got["Autres"]["part_intl"], got["Autres"]["volume_fr"], got["Autres"]["delta_fr"]) == (50.0, 0.0, 10, 66.7)


def test_compare_sides(spark):
    data = [(DAY(2024, 1, 1), "z", "a", 10), (DAY(2023, 1, 1), "y", "a", 4), (DAY(2023, 1, 1), "y", "b", 6), (DAY(2024, 1, 1), "y", "b", 100)]
    fact = spark.createDataFrame(data, "date date, zone string, departement string, volume bigint")
    a, b = compare.Selection("z", "2024-01-01", "2024-01-31"), compare.Selection("y", "2023-01-01", "2023-01-31")
    assert rows(compare.compare_ab({"n": fact}, a, b)) == [("n", 10, 10, 0, 0.0)]
    assert rows(compare.compare_departments(fact, a, b, 5)) == [(1, "a", 10, 4, 6, 150.0, 10, 10), (2, "b", 0, 6, -6, -100.0, 10, 10)]


@pytest.fixture(scope="module")
def periods(spark):
    return spark.createDataFrame([
        (1, "vacances_ete", "Vacances d'été", 2024, DAY(2024, 7, 6), DAY(2024, 9, 1)),
        (2, "weekend_paques", "Week-end de Pâques", 2024, DAY(2024, 3, 30), DAY(2024, 4, 1)),
        (3, "vacances_hiver", "Vacances d'hiver", 2024, DAY(2024, 2, 10), DAY(2024, 3, 10)),
        (4, "vacances_hiver", "Vacances d'hiver", 2023, DAY(2023, 2, 4), DAY(2023, 3, 6)),
    ], "id_periode int, code_periode string, nom_periode string, annee int, date_debut date, date_fin date")


@pytest.fixture(scope="module")
def seasons(spark):
    starts = spark.createDataFrame([
        (y, s, DAY(y, m, d)) for y in (2022, 2023, 2024) for s, m, d in (("printemps", 3, 20), ("ete", 6, 21), ("automne", 9, 22), ("hiver", 12, 21))
    ], "annee int, saison string, date_debut date")
    return calendar.number_seasons(calendar.season_bounds(starts))


def test_season_bounds(seasons):
    got = {(r["annee"], r["saison"]): (r["date_fin"], r["duree_jours"]) for r in seasons.collect()}
    assert got[2022, "hiver"] == (DAY(2023, 3, 19), 89) and got[2024, "hiver"] == (DAY(2024, 12, 31), 11)


def test_resolution_tiers(spark, periods):
    asked = [("vacances_ete", "1 exact"), ("VACANCES_ETE", "2 casse"), ("vacances ete", "3 separateur"), ("Week_end_de Pâques", "3 separateur"),
             ("Année complète", "annee"), ("inconnu", "annee")]
    requests = spark.createDataFrame([(2024, t) for t, _ in asked], "annee int, periode string")
    got = {r["periode"]: r for r in calendar.resolve_period(requests, periods).collect()}
    assert {t: got[t]["niveau"] for t, _ in asked} == dict(asked)
    assert got["VACANCES_ETE"]["start"] == DAY(2024, 7, 6) and got["inconnu"]["end"] == DAY(2024, 12, 31)


def test_alias_and_recognition(spark, periods, seasons):
    linked = calendar.link_seasons(periods, seasons)
    requests = spark.createDataFrame([(2024, t) for t in ("hiver", "été", "paques", "annee", "ski", "weekend")], "annee int, periode string")
    alias = {r["periode"]: r["start"] for r in calendar.resolve_alias(requests, periods).collect()}
    assert alias["hiver"] == DAY(2024, 2, 10) and alias["annee"] == alias["ski"] == DAY(2024, 1, 1)
    known = {r["periode"]: r["code_periode"] for r in calendar.recognise(requests, linked, seasons).collect()}
    assert known == {"hiver": "vacances_hiver", "été": "vacances_ete", "paques": "weekend_paques", "annee": None, "ski": None, "weekend": "weekend_paques"}


def test_season_links(periods, seasons):
    linked = calendar.link_seasons(periods, seasons)
    names = {s["id"]: (s["annee"], s["saison"]) for s in seasons.collect()}
    assert {r["id_periode"]: names[r["id_saison"]] for r in linked.collect()} == {
        1: (2024, "ete"), 2: (2024, "printemps"), 3: (2023, "hiver"), 4: (2022, "hiver"),
    }


def test_period_rules(spark, periods):
    assert {r["motif"] for r in calendar.validate_periods(periods).collect()} == {"OK"}
    copied = calendar.copy_periods(periods, 2024, 2023)
    assert rows(copied.select("code_periode", "date_debut")) == [("vacances_ete", DAY(2023, 7, 6)), ("weekend_paques", DAY(2023, 3, 30))]


def test_load_fact_end_to_end(spark):
    from sillage.operators.zones import alias_frame

    raw = spark.createDataFrame([
        ("2024-01-01", "Haut Cantal", "non local", "touriste", "Lot", "5"), ("2024-01-01", "GENTIANE", "NONLOCAL", "Touriste", "LOT ", "7"),
        ("2024-01-01", "Lioran", "Étranger", "touriste", None, "3"), ("2024-02-31", "Lioran", "Local", "Touriste", "Lot", "3"),
        ("2024-01-02", "Lioran", "Local", "Touriste", "Lot", "x"),
    ], "Date string, ZoneObservation string, Provenance string, CategorieVisiteur string, NomDepartement string, Volume string")
    clean = load.conform_labels(raw, alias_frame(spark))
    got = load.load_fact(clean, ("zone", "provenance", "categorie", "departement"))
    assert [(r["date"], r["volume"]) for r in got.collect()] == [(DAY(2024, 1, 1), 12)]
    optional = load.load_fact(clean, ("zone", "provenance", "categorie"), optional=("departement",))
    assert sorted((r["id_departement"], r["volume"]) for r in optional.collect()) == [(0, 3), (1, 12)]


def test_load_mobility_files(spark, tmp_path):
    from sillage.operators.zones import alias_frame

    (tmp_path / "LieuActivite_Soir_2025B1_x.csv").write_text(
        "Date;JourDeLaSemaine;ZoneObservation;Provenance;CategorieVisiteur;EPCIZoneDiurneSoir;CodeInseeDiurneSoir;Bruit;Volume\n"
        "2024-01-01;lun;Lioran;local;touriste;HTC;15001;?;5\n2024-01-01;LUNDI;STATION;Local;Touriste;htc;15001;?;6\n2024-01-01;lun;Lioran;local;touriste;;;?;7\n"
    )
    got = load.load_files(spark, str(tmp_path), "LieuActivite_Soir", alias_frame(spark))
    assert sorted((r["jour_semaine"], r["id_epci"], r["id_commune"], r["volume"]) for r in got.collect()) == [("LUNDI", 0, 0, 7), ("LUNDI", 1, 1, 11)]


def test_families_have_their_grain():
    assert load.grain_of_family("SejourDuree_Pays") == (["zone", "provenance", "categorie", "pays", "duree"], [], [])
    assert load.grain_of_family("LieuNuitee_Veille_Departement")[1:] == (["epci", "commune"], ["jour_semaine"])


def test_migrate_all_keeps_each_grain(spark):
    columns = "date date, id_zone int, id_pays int, volume bigint"
    main = spark.createDataFrame([(DAY(2024, 1, 1), 1, 1, 5)], columns).withColumn("is_provisional", F.lit(False))
    staged = spark.createDataFrame([(DAY(2024, 1, 1), 1, 1, 9), (DAY(2024, 1, 1), 1, 2, 3)], columns).withColumn("lot", F.lit("x"))
    got = quality.migrate_all({"fact_nuitees_pays": staged}, {"fact_nuitees_pays": main})["fact_nuitees_pays"]
    assert rows(got.select("id_pays", "volume", "is_provisional")) == [(1, 5, True), (2, 3, True)]


def test_health_and_logs(spark):
    stats = spark.createDataFrame([(10, 0, 0.0), (10, 4, 100.0), (10, 9, 100.0), (10, 10, 40.0), (10, 10, 95.0), (10, 10, 70.0)], "attendus int, presents int, taux_succes double")
    assert [r["statut"] for r in quality.health_status(stats).collect()] == ["critical", "warning", "partial", "processing_error", "healthy", "operational"]
    lines = spark.createDataFrame([("❌ Pays X non trouvé",), ("⚠️ rien",), ("Pays X non trouvé",)], "value string")
    assert rows(quality.classify_log(lines)) == [("Autre", 1), ("Pays inconnu", 1)]


def _final_plan(df) -> str:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    kept, skip = [], None
    for line in plan.split("\n"):
        depth = len(line) - len(line.lstrip(" :+-|"))
        if skip is not None:
            if depth > skip or not line.strip():
                continue
            skip = None
        if "== Initial Plan ==" in line:
            skip = depth - 1
            continue
        kept.append(line)
    return "\n".join(kept)


@pytest.mark.parametrize("key", [
    "K01_kpi_nights", "K04_kpi_top_departments", "K10_kpi_peak", "K32_block_d7", "R07_origins_departments", "R11_destinations",
    "C11_trend_class", "C14_gainers_losers", "J08_in_period",
])
def test_a_report_scans_its_fact_once(spark, sf_dir, key):
    plan = _final_plan(QUERIES[key](spark, sf_dir))
    scans = [s for s in re.findall(r"FileScan parquet \[([^\]]*)\]", plan) if "l_shipdate" in s]
    assert len(scans) == 1
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_window_and_role_reach_the_scan(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    plan = QUERIES["K01_kpi_nights"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(line for line in plan.split("\n") if "l_shipdate" in line and "FileScan" in line)
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", scan).group(1)
    assert "EqualTo(l_returnflag,A)" in pushed and "GreaterThanOrEqual(l_shipdate" in pushed
    read = re.search(r"FileScan parquet \[([^\]]*)\]", scan).group(1)
    assert {c.split("#")[0] for c in read.split(",")} == {"l_orderkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate"}


@pytest.mark.parametrize("key", ["K06_kpi_period_nights", "K19_kpi_period_daytrips", "J08_in_period"])
def test_periods_bound_the_scan(spark, sf_dir, key):
    plan = QUERIES[key](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"DataFilters: \[[^\]]*l_shipdate[^\]]*\]", plan) and "GreaterThanOrEqual(l_shipdate" in plan


def test_block_a_scans_each_fact_once(spark, sf_dir, monkeypatch):
    plans = []

    def staged(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, name)

    monkeypatch.setattr(kpi, "stage", staged)
    plans.append(QUERIES["K31_block_a"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString())
    assert sum("l_shipdate" in s for plan in plans for s in re.findall(r"FileScan parquet \[([^\]]*)\]", plan)) == 2


def test_windows_by_offset(spark):
    rows_ = [(2, DAY(2022, 1, 1), DAY(2022, 1, 31)), (0, DAY(2024, 1, 1), DAY(2024, 1, 31))]
    found = Windows.resolved(spark.createDataFrame(rows_, "offset int, start date, end date"))
    assert [w.offset for w in found] == [0, 2] and found[2].start == DAY(2022, 1, 1)
    with pytest.raises(KeyError):
        found[1]
    many = spark.range(200).selectExpr("CAST(id AS INT) AS offset", "DATE'2024-01-01' AS start", "DATE'2024-01-02' AS end")
    assert len(Windows.resolved(many)) == 200


def test_short_texts_are_found(spark):
    periods = spark.createDataFrame([(1, "pont_1er_mai", "Pont du 8 mai", 2024, DAY(2024, 5, 1), DAY(2024, 5, 8))], "id_periode long, code_periode string, nom_periode string, annee int, date_debut date, date_fin date")
    asked = spark.createDataFrame([(2024, t) for t in ("1e", "8", "_", "x", " ", "pont_1er_mai", "du 8")], "annee int, periode string")
    got = {r["periode"]: r["niveau"] for r in calendar.resolve_alias(asked, periods).collect()}
    assert got == {"1e": "4 partie", "8": "4 partie", "_": "4 partie", "x": "annee", " ": "annee", "pont_1er_mai": "4 partie", "du 8": "4 partie"}


@pytest.mark.parametrize("key", ["J09_max_overlap", "J10_overlaps", "P01_resolve_period", "P04_recognise", "P12_link_seasons", "D10_load_history"])
def test_no_nested_loops_between_intervals_or_texts(spark, sf_dir, key):
    plan = _final_plan(QUERIES[key](spark, sf_dir))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_top_k_is_pruned_before_the_shuffle(spark, sf_dir):
    plan = QUERIES["R12_top_destinations"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_a_heavy_key_is_reduced_before_the_shuffle(spark):
    """A third of the rows share one grain: what leaves the map side is one row per partition."""
    from sillage.operators.conform import dedupe_grain

    n = 9_000
    df = spark.range(0, n, 1, 4).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("cle"), F.col("id"), (F.col("id") * 2).alias("v")
    )
    out = dedupe_grain(df, ["cle"], "id")
    assert out.count() == n - n // 3 + 1
    assert tuple(out.where("cle = -1").first()) == (-1, 0, 0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan
