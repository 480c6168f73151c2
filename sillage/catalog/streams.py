"""X: incremental ingest of the events, delivered in several lots."""

from __future__ import annotations

from pyspark.sql import functions as F

from sillage.catalog.base import ORACLES, big, register
from sillage.session import shared_dir
from sillage.sources.binding import table
from sillage.streaming import ingest

KEY = ["date", "zone", "id_commune"]
_VOLUME = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
DELIVERIES_SQL = f"""deliveries AS (SELECT livraison, CAST(ts AS DATE) AS date, event_type AS zone, user_id AS id_commune, {big(f'sum({_VOLUME})')} AS volume
  FROM (SELECT 1 AS livraison, * FROM events UNION ALL SELECT 2, * FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 3, * FROM events WHERE event_id % 5 = 0 AND ts < TIMESTAMP '2024-01-12') GROUP BY ALL)"""


def delivery(spark, sf, number: int):
    """What delivery 1, 2 or 3 says: all events, then corrections that see only part of them."""
    events = table(spark, sf, "events")
    part = {
        1: F.lit(True),
        2: F.col("event_id") % 2 == 0,
        3: (F.col("event_id") % 5 == 0) & (F.col("ts") < F.lit("2024-01-12").cast("timestamp_ntz")),
    }[number]
    volume = F.get_json_object("props", "$.k").try_cast("bigint")
    return (
        events.where(part)
        .groupBy(F.col("ts").cast("date").alias("date"), F.col("event_type").alias("zone"), F.col("user_id").alias("id_commune"))
        .agg(F.sum(volume).alias("volume")).withColumn("livraison", F.lit(number))
    )


def delivered(spark, sf, confirmed_from: int = 3):
    """Lots of all three deliveries, the later two arriving in a second run of the stream."""
    inbox, lots, checkpoint = (shared_dir(spark, n) for n in ("inbox", "lots", "checkpoint"))
    delivery(spark, sf, 1).write.mode("append").parquet(inbox)
    schema = spark.read.parquet(inbox).schema

    def run() -> None:
        stream = ingest.read_new_files(spark, inbox, schema, max_files=1)
        ingest.ingest(stream, lots, checkpoint, lambda df: df.withColumn("confirme", F.col("livraison") >= confirmed_from))

    run()
    for number in (2, 3):
        delivery(spark, sf, number).write.mode("append").parquet(inbox)
    run()
    return ingest.read_lots(spark, lots, schema.add("confirme", "boolean"))


@register("X01_read_new_files", f"WITH {DELIVERIES_SQL} SELECT livraison, count(*) AS lignes, {big('sum(volume)')} AS volume FROM deliveries GROUP BY livraison")
def _(spark, sf):
    return delivered(spark, sf).groupBy("livraison").agg(F.count(F.lit(1)).alias("lignes"), F.sum("volume").alias("volume"))


@register("X01_two_streams", f"WITH {DELIVERIES_SQL} SELECT livraison, count(*) AS lignes, {big('sum(volume)')} AS volume FROM deliveries WHERE livraison < 3 GROUP BY livraison")
def _(spark, sf):
    lots = shared_dir(spark, "lots")
    for number in (1, 2):
        inbox, checkpoint = shared_dir(spark, "inbox"), shared_dir(spark, "checkpoint")
        delivery(spark, sf, number).write.parquet(inbox)
        ingest.ingest(ingest.read_new_files(spark, inbox, spark.read.parquet(inbox).schema), lots, checkpoint)
    rows = spark.read.parquet(lots)
    return rows.groupBy("livraison").agg(F.count(F.lit(1)).alias("lignes"), F.sum("volume").alias("volume"))


@register("X02_upsert_batch", f"WITH {DELIVERIES_SQL} SELECT date, zone, id_commune, arg_max(volume, livraison) AS volume FROM deliveries GROUP BY ALL")
def _(spark, sf):
    return ingest.latest(delivered(spark, sf), KEY, "livraison")


@register("X03_replace_batch", f"""WITH {DELIVERIES_SQL} SELECT date, zone, id_commune, {big('sum(volume)')} AS volume FROM deliveries
  JOIN (SELECT date, max(livraison) AS livraison FROM deliveries GROUP BY date) USING (date, livraison) GROUP BY ALL""")
def _(spark, sf):
    return ingest.latest_dates(delivered(spark, sf), KEY, "livraison")


@register("X04_provisional_batch", f"""WITH {DELIVERIES_SQL} SELECT date, zone, id_commune, arg_max(volume, (livraison >= 2, volume)) AS volume, max(livraison) < 2 AS is_provisional
  FROM deliveries WHERE livraison < 3 GROUP BY ALL""")
def _(spark, sf):
    lots = delivered(spark, sf, confirmed_from=2).where(F.col("livraison") < 3)
    return ingest.provisional_state(lots, KEY, "confirme")


def merged(spark, sf, combine, conform, last: int = 3):
    """The fact that deliveries 1 to ``last`` leave on disk, the last one merged twice."""
    inbox, fact, checkpoint = (shared_dir(spark, n) for n in ("inbox", "fact", "checkpoint"))
    write = ingest.merge_into(fact, checkpoint, combine, conform)
    for number in range(1, last + 1):
        delivery(spark, sf, number).write.mode("append").parquet(inbox)
        ingest.ingest_fact(ingest.read_new_files(spark, inbox, spark.read.parquet(inbox).schema), checkpoint, write)
    write(delivery(spark, sf, last), last - 1)
    return spark.read.parquet(fact)


@register("X02_upsert_on_disk", ORACLES["X02_upsert_batch"])
def _(spark, sf):
    return merged(spark, sf, ingest.upsert(KEY, "livraison"), lambda df: df).select(*KEY, "volume")


@register("X03_replace_on_disk", ORACLES["X03_replace_batch"])
def _(spark, sf):
    fact = merged(spark, sf, ingest.replace_by_date(KEY, "livraison"), lambda df: df)
    return fact.groupBy(*KEY).agg(F.sum("volume").alias("volume"))


@register("X04_provisional_on_disk", ORACLES["X04_provisional_batch"])
def _(spark, sf):
    def conform(df):
        return df.select(*KEY, "volume", (F.col("livraison") >= 2).alias("confirme"))

    fact = merged(spark, sf, ingest.provisional(KEY, "confirme"), conform, last=2)
    return fact.select(*KEY, "volume", (~F.col("confirme")).alias("is_provisional"))
