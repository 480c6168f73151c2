"""W, T and U: ranks, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sillage.catalog.base import big, register, with_periods, with_visits
from sillage.catalog.filters import quoted
from sillage.catalog.joins import SEASONS_SQL, seasons
from sillage.operators import merge, topk
from sillage.operators.aggregates import preagg
from sillage.session import stage
from sillage.sources.binding import order_periods, table, visits

_BY_COMMUNE = "SELECT id_commune, CAST(sum(volume) AS BIGINT) AS volume FROM visits GROUP BY id_commune"


def by_commune(spark, sf):
    return preagg(visits(spark, sf, "id_commune", "volume"), ["id_commune"])


def largest():
    return [F.desc("volume"), F.col("id_commune")]


@register("W01_row_number_topk", with_visits(f"""SELECT zone, id_commune, volume, CAST(rang AS INT) AS rang FROM (
  SELECT *, row_number() OVER (PARTITION BY zone ORDER BY volume DESC, id_commune) AS rang FROM (
    SELECT zone, id_commune, CAST(sum(volume) AS BIGINT) AS volume FROM visits GROUP BY ALL)) WHERE rang <= 10"""))
def _(spark, sf):
    sums = preagg(visits(spark, sf, "zone", "id_commune", "volume"), ["zone", "id_commune"])
    return topk.top_k_per(sums, ["zone"], largest(), 10)


@register("W02_rank", with_visits(f"SELECT *, CAST(row_number() OVER (ORDER BY volume DESC, id_commune) AS INT) AS rang FROM ({_BY_COMMUNE}) ORDER BY rang LIMIT 20"))
def _(spark, sf):
    return topk.ranked_top_k(by_commune(spark, sf), largest(), 20)


@register("W03_next_value", f"SELECT id, saison, date_debut, lead(date_debut) OVER (PARTITION BY saison ORDER BY date_debut) AS suivante FROM ({SEASONS_SQL})")
def _(spark, sf):
    rows = seasons(spark, sf).select("id", "saison", "date_debut")
    return topk.next_value(rows, ["saison"], [F.col("date_debut")], "date_debut", "suivante")


_YEARLY = "SELECT departement, CAST(year(date) AS INT) AS annee, CAST(sum(volume) AS BIGINT) AS volume FROM visits GROUP BY ALL"


@register("W04_prev_value", with_visits(f"SELECT *, lag(volume) OVER (PARTITION BY departement ORDER BY annee) AS precedent FROM ({_YEARLY})"))
def _(spark, sf):
    sums = visits(spark, sf, "date", "departement", "volume").groupBy("departement", F.year("date").alias("annee")).agg(F.sum("volume").alias("volume"))
    return topk.prev_value(sums, ["departement"], [F.col("annee")], "volume", "precedent")


@register("W05_total_over", with_visits(f"SELECT *, {big('(SELECT sum(volume) FROM visits)')} AS total FROM ({_BY_COMMUNE})"))
def _(spark, sf):
    from sillage.operators.joins import with_total

    return with_total(stage(by_commune(spark, sf), "sums"), "volume")


_PRIORITY = ("3-MEDIUM", "1-URGENT", "2-HIGH", "5-LOW")
_RANK = "CASE o_orderpriority " + " ".join(f"WHEN {quoted(p)} THEN {i}" for i, p in enumerate(_PRIORITY, 1)) + f" ELSE {len(_PRIORITY) + 1} END"


@register("W06_first_by_priority", f"""SELECT client, id, priorite FROM (SELECT o_custkey AS client, o_orderkey AS id, o_orderpriority AS priorite,
  row_number() OVER (PARTITION BY o_custkey ORDER BY {_RANK}, o_orderkey) AS r FROM orders) WHERE r = 1""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("client"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priorite")
    )
    return topk.first_by_priority(rows, ["client"], [topk.custom_order(F.col("priorite"), _PRIORITY), F.col("id")])


@register("W07_argmax", """SELECT o_custkey AS client, arg_max(o_orderkey, o_totalprice) AS id FROM orders GROUP BY o_custkey""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("client"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("montant")
    )
    return topk.argmax(rows, ["client"], "id", [F.col("montant")])


@register("T01_top_k", with_visits(f"{_BY_COMMUNE} ORDER BY volume DESC, id_commune LIMIT 10"))
def _(spark, sf):
    return topk.top_k(by_commune(spark, sf), largest(), 10)


@register("T02_order_custom", f"SELECT o_orderkey AS id, o_orderpriority AS priorite, CAST({_RANK} AS BIGINT) AS ordre FROM orders ORDER BY ordre, id")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priorite"))
    return topk.order_custom(rows, "priorite", _PRIORITY, "id")


@register("T03_order_multi", """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS jour, o_totalprice AS montant FROM orders
  ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("jour"), F.col("o_totalprice").alias("montant")
    )
    return topk.order_multi(rows, ["jour", "montant"], "id")


@register("T04_sum_top_k", with_visits(f"SELECT {big('coalesce(sum(volume), 0)')} AS somme FROM ({_BY_COMMUNE} ORDER BY volume DESC, id_commune LIMIT 15)"))
def _(spark, sf):
    return topk.sum_top_k(by_commune(spark, sf), largest(), 15, "volume", "somme")


@register("T05_page", "SELECT o_orderkey AS id, o_totalprice AS montant FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("montant"))
    return topk.page(rows, [F.desc("montant"), F.col("id")], 50, 25)


@register("T06_pad_to_k", with_visits("""SELECT CAST(i AS INT) AS rang, zone, volume FROM range(1, 13) g(i) LEFT JOIN (
  SELECT zone, CAST(sum(volume) AS BIGINT) AS volume, row_number() OVER (ORDER BY sum(volume) DESC, zone) AS r FROM visits GROUP BY zone) ON r = i"""))
def _(spark, sf):
    sums = preagg(visits(spark, sf, "zone", "volume"), ["zone"])
    return topk.pad_to_k(topk.ranked_top_k(sums, [F.desc("volume"), F.col("zone")], 12), 12)


@register("U01_union_by_name", """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS jour, CAST(NULL AS VARCHAR) AS nom FROM orders
  UNION ALL SELECT c_custkey, NULL, c_name FROM customer""")
def _(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("jour"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("nom"))
    return merge.union_all([a, b])


@register("U02_distinct_rows", "SELECT DISTINCT role, text FROM conversations")
def _(spark, sf):
    return merge.distinct_rows(table(spark, sf, "conversations").select("role", "text"))


@register("U03_difference", """SELECT CAST(l_shipdate AS DATE) AS date FROM lineitem EXCEPT SELECT CAST(o_orderdate AS DATE) FROM orders""")
def _(spark, sf):
    shipped = visits(spark, sf, "date")
    ordered = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    return merge.difference(shipped, ordered, "date")


@register("U04_common_columns", "SELECT id_periode, code_periode, date_debut FROM (" + with_periods("SELECT * FROM periods") + ")")
def _(spark, sf):
    a = order_periods(spark, sf).select("id_periode", "nom_periode", "code_periode", "date_debut")
    b = order_periods(spark, sf).select("date_debut", "code_periode", "annee", "id_periode")
    return a.select(*merge.common_columns(a, b))


@register("U05_key_union", """SELECT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderpriority = '5-LOW' UNION
  SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderpriority = '1-URGENT'""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date"), "o_orderpriority")
    return merge.key_union(rows.where(F.col("o_orderpriority") == "5-LOW"), rows.where(F.col("o_orderpriority") == "1-URGENT"), "date")

