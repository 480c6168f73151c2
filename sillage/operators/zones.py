"""Zone labels: displayed, stored and historical names.

The alias tables are frames, so a deployment can keep its own; those here hold the
fixed values.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sillage import fixed_values as fv


def _pairs(spark: SparkSession, pairs: Mapping[str, str], left: str, right: str) -> DataFrame:
    rows = [F.struct(F.lit(a).alias(left), F.lit(b).alias(right)) for a, b in pairs.items()]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def alias_frame(spark: SparkSession, pairs: Mapping[str, str] = fv.ZONE_TO_BASE) -> DataFrame:
    """(alias, base): displayed or delivered label and the stored zone."""
    return _pairs(spark, pairs, "alias", "base")


def display_frame(spark: SparkSession, pairs: Mapping[str, str] = fv.ZONE_TO_DISPLAY) -> DataFrame:
    """(zone, affichage): stored zone and the name it is shown under."""
    return _pairs(spark, pairs, "zone", "affichage")


def hidden_frame(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(z) for z in fv.ZONES_HIDDEN])).alias("zone"))


def zone_to_base(df: DataFrame, aliases: DataFrame, col: str, env: str | None = None) -> DataFrame:
    """Stored zone of a displayed label; a label without alias stands for itself."""
    if env is not None:
        aliases = aliases.where(F.col("env") == env).drop("env")
    keyed = df.withColumn("alias", F.upper(F.trim(F.col(col))))
    return keyed.join(aliases, "alias", "left").withColumn("base", F.coalesce("base", "alias")).drop("alias")


def zone_to_display(df: DataFrame, display: DataFrame, col: str) -> DataFrame:
    """Names the zones are shown under, each once."""
    zones = df.select(F.upper(F.trim(F.col(col))).alias("zone")).distinct()
    return zones.join(display, "zone", "left").select(F.coalesce("affichage", "zone").alias("affichage")).distinct()


def expand_zone(df: DataFrame, col: str) -> DataFrame:
    """One row per stored name of the displayed zone."""
    shown = F.upper(F.trim(F.col(col)))
    history = F.create_map(*[
        c for name, stored in fv.ZONE_HISTORY.items() for c in (F.lit(name), F.array(*[F.lit(s) for s in stored]))
    ])
    return df.withColumn("zone", F.explode(F.coalesce(history[shown], F.array(shown))))
