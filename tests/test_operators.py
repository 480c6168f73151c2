"""Merge modes, joins, ids and ranks on small frames, against brute force."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F
from rows import rows

from sillage import schema
from sillage.catalog import QUERIES
from sillage.functions import text
from sillage.operators import aggregates as agg
from sillage.operators import conform, joins, merge, paging, topk
from sillage.session import shared_dir

DAY = dt.date
KEY = ["date", "zone"]
T = "date date, zone string, volume bigint"
D1, D2, D3 = DAY(2024, 1, 1), DAY(2024, 1, 2), DAY(2025, 1, 3)


@pytest.fixture()
def target(spark):
    return spark.createDataFrame([(D1, "a", 1), (D1, "b", 2), (D2, "a", 3), (D3, "a", 4)], T)


@pytest.fixture()
def batch(spark):
    # an equal key, a changed one, a new one and one that repeats inside the batch
    return spark.createDataFrame([(D1, "a", 1), (D1, "b", 9, ), (D1, "c", 5), (D2, "z", 6), (D2, "z", 7)], T)


def test_merge_overwrite(target, batch):
    assert rows(merge.merge_overwrite(target, batch, KEY)) == [(D1, "a", 1), (D1, "b", 9), (D1, "c", 5), (D2, "a", 3), (D2, "z", 7), (D3, "a", 4)]


def test_merge_overwrite_takes_the_latest_of_the_batch(spark, target):
    late = spark.createDataFrame([(D1, "a", 50, 2), (D1, "a", 60, 1)], T + ", ordre int")
    assert (D1, "a", 50) in rows(merge.merge_overwrite(target, late, KEY, order="ordre"))


def test_merge_keep(target, batch):
    assert rows(merge.merge_keep(target, batch, KEY)) == [(D1, "a", 1), (D1, "b", 2), (D1, "c", 5), (D2, "a", 3), (D2, "z", 6), (D3, "a", 4)]


def test_merge_add(target, batch):
    assert rows(merge.merge_add(target, batch, KEY)) == [(D1, "a", 2), (D1, "b", 11), (D1, "c", 5), (D2, "a", 3), (D2, "z", 13), (D3, "a", 4)]


def test_merge_flag_keeps_the_stored_volume(target, batch):
    got = merge.merge_flag(target.withColumn("is_provisional", F.lit(False)), batch, KEY)
    assert rows(got) == [
        (D1, "a", 1, True), (D1, "b", 2, True), (D1, "c", 5, True), (D2, "a", 3, False), (D2, "z", 6, True), (D3, "a", 4, False),
    ]


def test_merge_dim_never_loses_a_value(spark):
    stored = spark.createDataFrame([(1, "x", None), (2, "y", "q")], "id int, nom string, reg string")
    fresh = spark.createDataFrame([(1, None, "r"), (2, "w", None), (3, None, None)], "id int, nom string, reg string")
    assert rows(merge.merge_dim(stored, fresh, "id")) == [(1, "x", "r"), (2, "w", "q"), (3, None, None)]


def test_replace_dates(target, batch):
    assert rows(merge.replace_dates(target, batch)) == sorted([*map(tuple, batch.collect()), (D3, "a", 4)], key=repr)


@pytest.mark.parametrize("mode, expected", [
    ("overwrite", [(D1, "a", 1), (D1, "b", 9), (D1, "c", 5), (D2, "a", 3), (D2, "z", 7), (D3, "a", 4)]),
    ("add", [(D1, "a", 2), (D1, "b", 11), (D1, "c", 5), (D2, "a", 3), (D2, "z", 13), (D3, "a", 4)]),
])
def test_merge_on_disk_leaves_other_partitions_alone(spark, target, batch, mode, expected):
    path = shared_dir(spark, "fact")
    merge.write_fact(target, path)
    untouched = {p for p in spark.read.parquet(path).inputFiles() if "annee=2025" in p}
    merge.merge_partitions_into(path, batch.withColumn("annee", F.year("date")), [*KEY, "annee"], mode)
    spark.catalog.clearCache()
    assert rows(spark.read.parquet(path).select("date", "zone", "volume")) == expected
    assert untouched <= set(spark.read.parquet(path).inputFiles())


def test_rows_without_a_partition_value_are_merged(spark):
    path = shared_dir(spark, "fact")
    schema = "annee int, zone string, volume bigint"
    spark.createDataFrame([(None, "old", 2), (None, "both", 1), (2024, "a", 3)], schema).write.partitionBy("annee").parquet(path)
    merge.merge_partitions_into(path, spark.createDataFrame([(None, "new", 9), (None, "both", 5)], schema), ["annee", "zone"])
    spark.catalog.clearCache()
    assert rows(spark.read.parquet(path).select("annee", "zone", "volume")) == sorted([(None, "old", 2), (None, "both", 5), (None, "new", 9), (2024, "a", 3)], key=repr)


def test_purge_and_cutoff(target):
    assert rows(merge.purge_year(target, 2024)) == [(D3, "a", 4)]
    assert [tuple(r) for r in merge.purge_report(target, 2024).collect()] == [(1, 3)]
    assert tuple(merge.cutoff_report(target, "date", "2024-01-01").first()) == (4, 2, 2)
    assert merge.retain(target, "date", 1, "2025-01-03").count() == 1


def test_a_year_is_dropped_as_a_partition(spark, target):
    path = shared_dir(spark, "table")
    target.withColumn("annee", F.year("date")).write.partitionBy("annee").option("path", path).saveAsTable("purge_me")
    try:
        merge.drop_year(spark, "purge_me", 2024)
        merge.drop_year(spark, "purge_me", 1999)
        assert [r["annee"] for r in spark.table("purge_me").select("annee").distinct().collect()] == [2025]
    finally:
        spark.sql("DROP TABLE purge_me")


def test_ids_are_dense_stable_and_ordered_by_bucket(spark):
    labels = [f"L{i}" for i in range(500)]
    df = spark.createDataFrame([(x,) for x in labels * 3 if x], "zone string")
    dim = spark.createDataFrame([(7, "L3"), (2, "ailleurs")], "id_zone bigint, zone string")
    first = dict((r["zone"], r["id_zone"]) for r in conform.get_or_create(df, dim, "zone", "zone", "id_zone").collect())
    again = dict((r["zone"], r["id_zone"]) for r in conform.get_or_create(df.repartition(7), dim, "zone", "zone", "id_zone").collect())
    assert first == again and first["L3"] == 7 and first["ailleurs"] == 2
    assert sorted(first.values()) == [2, *range(7, 507)]


def test_ids_of_several_dimensions_do_not_mix(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None), ("a", "y")], "zone string, pays string")
    stored = spark.createDataFrame([("a", 5)], "membre string, id bigint")
    got = rows(conform.assign_ids(df, {"zone": stored, "pays": None}).select("dimension", "membre", "id"))
    assert [(d, m) for d, m, _ in got] == [("pays", "x"), ("pays", "y"), ("zone", "a"), ("zone", "b")]
    assert {m: i for d, m, i in got if d == "zone"} == {"a": 5, "b": 6}
    assert sorted(i for d, _, i in got if d == "pays") == [1, 2]


def test_labels_that_differ_in_accents_are_one_member(spark):
    df = spark.createDataFrame([("PUY-DE-DÔME",), ("PUY-DE-DOME",), ("Lot",), ("LOT",), (None,)], "d string")
    dim = spark.createDataFrame([(4, "Puy-de-Dôme")], "id_d bigint, d string")
    full = conform.get_or_create(df, dim, "d", "d", "id_d")
    assert rows(full) == [(4, "Puy-de-Dôme"), (5, "LOT")]
    assert sorted((r["d"] or "", r["id_d"]) for r in conform.attach_ids(df, full, "d", "d", "id_d", unknown=0).collect()) == [
        ("", 0), ("LOT", 5), ("Lot", 5), ("PUY-DE-DOME", 4), ("PUY-DE-DÔME", 4),
    ]


def test_reject_report(spark):
    df = spark.createDataFrame([(1, 1), (None, 1), (None, None), (1, 1), (None, 2)], "a int, b int")
    got = conform.reject_report(df, {"a": F.col("a").isNotNull(), "b": F.col("b").isNotNull()})
    assert rows(got) == [("a", 2, 66.7, 40.0), ("a, b", 1, 33.3, 40.0)]


def _periods(spark, n: int, seed: int):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = DAY(2023, 1, 1) + dt.timedelta(days=rng.randrange(700))
        out.append((i, start.year, start, start + dt.timedelta(days=rng.randrange(40))))
    return out, spark.createDataFrame(out, "id_periode int, annee int, date_debut date, date_fin date")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overlap_counts(spark, seed):
    plain, df = _periods(spark, 60, seed)
    expected = sorted(
        (i, y, sum(1 for j, z, c, d in plain if j != i and z == y and a <= d and c <= b)) for i, y, a, b in plain
    )
    assert sorted(tuple(r) for r in joins.overlap_counts(df).collect()) == expected
    busy = plain[0]
    hit = joins.conflicts_with(df, busy[1], busy[2], busy[3], exclude_id=busy[0]).count()
    assert hit == dict((e[0], e[2]) for e in expected)[busy[0]]


def test_max_overlap_ties_go_to_the_earlier(spark):
    a = spark.createDataFrame([(1, DAY(2024, 1, 30), DAY(2024, 2, 2)), (2, DAY(2024, 2, 1), DAY(2024, 2, 9)), (3, DAY(2030, 1, 1), DAY(2030, 1, 2))], "p int, d date, f date")
    b = spark.createDataFrame([(10, DAY(2024, 1, 1), DAY(2024, 1, 31)), (11, DAY(2024, 2, 1), DAY(2024, 3, 31))], "s int, sd date, sf date")
    assert rows(joins.max_overlap(a, b, "p", "s", ("d", "f"), ("sd", "sf"))) == [(1, 10, 2), (2, 11, 9)]


def test_in_period_counts_a_day_once_per_period(spark):
    fact = spark.createDataFrame([(D1, "x", 2), (D1, "x", 3), (D2, "x", 7)], "date date, k string, volume bigint")
    periods = spark.createDataFrame([("p", D1, D2), ("q", D2, D2), ("r", D2, D1)], "code string, date_debut date, date_fin date")
    assert rows(joins.in_period(fact, periods, ["code"], ["k"])) == [("p", "x", 12), ("q", "x", 7)]


def test_four_metrics_do_not_multiply(spark):
    from sillage.plans.windows import Windows

    dim = spark.createDataFrame([("a",), ("b",)], "departement string")
    nights = spark.createDataFrame([(D1, "a", 5), (D1, "a", 5), (DAY(2023, 1, 1), "a", 1)], "date date, departement string, volume bigint")
    days = spark.createDataFrame([(D1, "a", 2), (D1, "a", 2), (D1, "a", 2)], "date date, departement string, volume bigint")
    got = joins.four_metrics(dim, nights, days, Windows.yearly(D1, D1), "departement")
    assert rows(got) == [("a", 10, 1, 6, 0), ("b", 0, 0, 0, 0)]


def test_weighted_mean_counts_unknown_nights_in_the_denominator_only(spark):
    df = spark.createDataFrame([(2, 10), (4, 10), (None, 20)], "n int, v bigint")
    assert agg.weighted_mean(df, "n", "v").first()[0] == 1.5


def test_peak_day_ties_go_to_the_earlier(spark):
    df = spark.createDataFrame([(D2, 3), (D1, 1), (D1, 2), (D3, 2)], "date date, volume bigint")
    assert tuple(agg.peak_day(df).first()) == (D1, 3)


def test_ranks_pages_and_padding(spark):
    df = spark.createDataFrame([(k, v) for k, v in zip("abcdef", [5, 9, 9, 1, 7, 3])], "k string, v int")
    order = [F.desc("v"), F.col("k")]
    assert [r["k"] for r in topk.ranked_top_k(df, order, 3).orderBy("rang").collect()] == ["b", "c", "e"]
    assert [r["k"] for r in topk.page(df, order, 2, 2).collect()] == ["e", "a"]
    assert topk.sum_top_k(df, order, 2, "v", "s").first()[0] == 18
    padded = topk.pad_to_k(topk.ranked_top_k(df, order, 8), 8).orderBy("rang").collect()
    assert [r["k"] for r in padded] == ["b", "c", "e", "a", "f", "d", None, None]


def test_orders(spark):
    df = spark.createDataFrame([(1, "x", 5), (2, "b", 5), (3, "a", 7), (4, "b", 1)], "id int, k string, v int")
    assert [r["id"] for r in topk.order_custom(df, "k", ["b", "a"], "id").collect()] == [2, 4, 3, 1]
    assert [r["id"] for r in topk.order_multi(df, ["v", "k"], "id").collect()] == [3, 1, 2, 4]


def test_schemas(spark):
    assert len(schema.FACTS) == 2 * 6 + 3 + 12
    for name in schema.PRESETS["all"]:
        assert schema.empty_table(spark, name).columns == [f.name for f in schema.schema_for(name + "_temp")]
    assert schema.grain_of("fact_lieu_activite_soir_pays") == ["date", "id_zone", "id_provenance", "id_categorie", "id_pays", "jour_semaine", "id_epci", "id_commune"]


@pytest.mark.parametrize("order", [["a", "b"], ["-a", "b"], ["a", "-b"], ["-a", "-b"]])
def test_pages_are_those_of_the_whole_order(spark, order):
    rng = random.Random(2)
    data = [(rng.choice([None, 1, 2, 2, 2, 3]), b) for b in rng.sample(range(1000), 150)]
    df = spark.createDataFrame(data, "a int, b int").repartition(4)
    sorting = [F.col(c[1:]).desc() if c[0] == "-" else F.col(c) for c in order]
    every = [tuple(r) for r in df.orderBy(*sorting).collect()]
    laid = paging.paged(df, order, 6)
    assert laid.total == 150
    for offset, limit in ((0, 10), (37, 60), (140, 30), (149, 1), (150, 5), (400, 5), (0, 150)):
        assert [tuple(r) for r in laid.page(offset, limit).collect()] == every[offset : offset + limit]
    for at in range(0, 149, 13):
        last = dict(zip("ab", every[at]))
        assert [tuple(r) for r in laid.after([last[c.lstrip("-")] for c in order], 9).collect()] == every[at + 1 : at + 10]


def test_a_deep_page_reads_its_own_ranges(spark):
    laid = paging.paged(spark.range(10_000).select(F.col("id").alias("k")), ["k"], 20)
    deep = laid.page(9_000, 20)
    assert [r["k"] for r in deep.collect()] == list(range(9_000, 9_020))
    assert len(deep.inputFiles()) == 20  # before pruning
    scan = deep._jdf.queryExecution().executedPlan().toString()
    # one range gives an equality, two a list
    assert re.search(r"PartitionFilters: \[[^\]]*_range#\d+ (=|IN)", scan)
    limit = int(re.search(r"limit=(\d+)", scan)[1])
    assert limit < 1_500


def _stored(spark, path):
    return sorted(((r["annee"], r["zone"], r["volume"]) for r in spark.read.parquet(path).collect()), key=repr)


def test_a_batch_that_is_given_again_adds_nothing(spark, tmp_path):
    path, schema, key = str(tmp_path / "fact"), "annee int, zone string, volume bigint", ["annee", "zone"]
    one = spark.createDataFrame([(2023, "a", 5), (2024, "a", 7), (None, "a", 1), (2024, "a", 1)], schema)
    two = spark.createDataFrame([(2024, "a", 10), (2025, "b", 2), (None, "a", 3)], schema)
    for df, name in ((one, "1"), (one, "1"), (two, "2"), (one, "1"), (two, "2")):
        merge.add_batch_into(path, df, key, name)
    assert _stored(spark, path) == sorted([(2023, "a", 5), (2024, "a", 18), (2025, "b", 2), (None, "a", 4)], key=repr)


def test_a_batch_that_was_cut_short_is_finished(spark, tmp_path):
    path, schema, key = str(tmp_path / "fact"), "annee int, zone string, volume bigint", ["annee", "zone"]
    merge.add_batch_into(path, spark.createDataFrame([(2023, "a", 5), (2024, "a", 7)], schema), key, "1")
    batch = spark.createDataFrame([(2023, "a", 1), (2024, "a", 1)], schema)
    # the merge ended after its first partition
    merge.add_batch_into(path, batch.where("annee = 2023"), key, "2")
    merge.add_batch_into(path, batch, key, "2")
    assert _stored(spark, path) == [(2023, "a", 6), (2024, "a", 8)]


def test_a_table_without_a_ledger_takes_one(spark, tmp_path):
    path, key = str(tmp_path / "fact"), ["annee", "zone"]
    spark.createDataFrame([(2023, "a", 5), (2024, "a", 7)], "annee int, zone string, volume bigint").write.partitionBy("annee").parquet(path)
    merge.add_batch_into(path, spark.createDataFrame([(2023, "a", 1)], "annee int, zone string, volume bigint"), key, "1")
    assert _stored(spark, path) == [(2023, "a", 6), (2024, "a", 7)]


def test_a_failed_write_leaves_the_old_rows(spark, tmp_path):
    root = str(tmp_path / "t")
    merge.publish(spark.range(3), root, view="t_seen")
    broken = spark.range(100).select(F.when(F.col("id") < 99, F.col("id")).otherwise(F.raise_error(F.lit("stop"))).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        merge.publish(broken, root, view="t_seen")
    assert rows(merge.read_current(spark, root)) == rows(spark.table("t_seen")) == [(0,), (1,), (2,)]
    merge.publish(merge.read_current(spark, root).select(F.col("id") + 10).toDF("id"), root, view="t_seen")
    merge.publish(merge.read_current(spark, root).where("id > 10"), root, view="t_seen", keep=1)
    assert rows(merge.read_current(spark, root)) == rows(spark.table("t_seen")) == [(11,), (12,)]
    assert len(list((tmp_path / "t").glob("v=*"))) == 1


def test_labels_that_are_equal_have_one_key(spark):
    """Ids are dealt and labels compared by the same key, in any script."""
    same = [["\u0419\u043e\u0434", "\u0418\u0306\u043e\u0434", "\u0439\u041e\u0434"], ["\u0386\u03bd\u03c9", "\u0391\u0301\u03bd\u03c9", "\u03b1\u03bd\u03c9"], ["\uff21\uff42\uff43", "Abc", "\xe4b\xe7"],
        ["fin", "\ufb01n", "\uff46i\u0301n"], ["d\u017eep", "\u01c6ep", "\u01c5ep", "DZEP"], ["x2", "x\xb2"], ["\xc5", "\u212b", "A\u030a"], ["\uff8a\uff9f", "\u30cf"], ["\u0141\xf3d\u017a", "\u0141odz"], ["\uac00"], ["\u1100"]]
    df = spark.createDataFrame([(w, k) for k, words in enumerate(same) for w in words], "nom string, k int")
    members = conform.get_or_create(df, spark.createDataFrame([], "id bigint, nom string"), "nom", "nom", "id")
    found = conform.attach_ids(df, members, "nom", "nom", "id")
    assert found.select("k", "id").distinct().count() == members.count() == len(same)
    pairs = df.alias("a").crossJoin(df.alias("b")).where((F.col("a.k") == F.col("b.k")) != text.equals_ci_ai(F.col("a.nom"), F.col("b.nom")))
    assert rows(pairs) == []


def test_distinct_labels_are_numbered_apart_from_their_rows(spark):
    """Numbering reads distinct labels that are staged, not all rows twice."""
    labels = spark.createDataFrame([("Été",), ("ETE",), ("b",), (None,)] * 3, "zone string")
    members = conform.assign_ids(labels, {"zone": None})
    assert sorted((r["cle"], r["membre"]) for r in members.collect()) == [("B", "b"), ("ETE", "ETE")]
    assert "Generate" not in members._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_counted_before_their_keys_are_made(spark, tmp_path):
    spark.createDataFrame([(1, "Été ete x été"), (2, "ETE  x"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    groups = QUERIES["F09_collation_groups"](spark, str(tmp_path))
    assert rows(groups) == [("ETE", 4, "ETE"), ("X", 2, "x")]
    plan = groups._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2
