"""Reports about the data: loads, migration, coverage, mappings and logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillage import fixed_values as fv
from sillage.functions.text import normalize_label
from sillage.operators.merge import common_columns, merge_flag
from sillage.schema import grain_of


def _pct(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(part * F.lit(100.0) / F.nullif(whole, F.lit(0)), digits)


def migrate(staging: DataFrame, main: DataFrame, key: Sequence[str], flag: str = "is_provisional") -> DataFrame:
    """Staged rows merged into the main fact, columns of both sides only."""
    cols = [c for c in common_columns(main, staging) if c != flag]
    stored = main.select(*cols, F.coalesce(flag, F.lit(False)).alias(flag))
    return merge_flag(stored, staging.select(*cols), key)


def migrate_all(staging: Mapping[str, DataFrame], main: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Every staged fact merged into its main fact, each at its own grain."""
    return {
        name: migrate(staged, main[name], [c for c in grain_of(name) if c in staged.columns and c in main[name].columns])
        for name, staged in staging.items()
    }


def migration_rate(staging: Mapping[str, DataFrame], main: Mapping[str, DataFrame]) -> DataFrame:
    """Per table: staged rows, provisional rows, migration rate and provisional share."""
    rows = []
    for name in staging:
        staged = staging[name].agg(F.count(F.lit(1))).scalar()
        rows.append(main[name].agg(
            F.count(F.lit(1)).alias("total"), F.count_if("is_provisional").alias("provisoires")
        ).select(F.lit(name).alias("table"), staged.alias("stage"), "total", "provisoires"))
    return reduce(lambda a, b: a.unionByName(b), rows).select(
        "*", _pct(F.col("provisoires"), F.col("stage")).alias("taux_migration"),
        _pct(F.col("provisoires"), F.col("total")).alias("part_provisoire"),
    )


def drop_provisional(df: DataFrame, flag: str = "is_provisional") -> DataFrame:
    return df.where(~F.col(flag))


def removed_counts(df: DataFrame, flag: str = "is_provisional") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("avant"), F.count_if(flag).alias("retirees"), F.count_if(~F.col(flag)).alias("restantes"))


def load_stats(results: DataFrame, family: str = "famille", ok: str = "charge") -> DataFrame:
    """Files and rows per family with the success rate."""
    return results.groupBy(family).agg(
        F.count(F.lit(1)).alias("fichiers"), F.count_if(ok).alias("charges"), F.sum("lignes").alias("lignes"),
    ).withColumn("taux_succes", _pct(F.col("charges"), F.col("fichiers")))


def health_status(stats: DataFrame) -> DataFrame:
    """Status and severity out of expected, present and success rate."""
    missing, expected = F.col("attendus") - F.col("presents"), F.col("attendus")
    status = (
        F.when(F.col("presents") == 0, "critical")
        .when((missing > 0) & (missing > expected / 2), "warning")
        .when(missing > 0, "partial")
        .when(F.col("taux_succes") < 50, "processing_error")
        .when(F.col("taux_succes") >= 90, "healthy")
        .otherwise("operational")
    )
    severity = (
        F.when(status == "critical", "critical").when(status == "warning", "high")
        .when(status.isin("partial", "processing_error"), "medium").otherwise("low")
    )
    return stats.withColumn("statut", status).withColumn("gravite", severity).withColumn(
        "pret", F.col("statut").isin("healthy", "operational")
    )


def missing_files(expected: DataFrame, manifest: DataFrame, col: str = "fichier") -> DataFrame:
    return expected.select(col).join(manifest.select(col), col, "left_anti")


def log_class(line: Column) -> Column:
    """Class of a marked log line; null for lines without a mark."""
    marked = reduce(lambda a, b: a | b, [line.contains(m) for m in fv.LOG_MARKS])
    out = None
    for pattern, name in fv.LOG_PATTERNS:
        hit = line.rlike(f"(?i){pattern}")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.when(marked, out.otherwise("Autre"))


def classify_log(lines: DataFrame, col: str = "value") -> DataFrame:
    return (
        lines.select(log_class(F.col(col)).alias("type")).where(F.col("type").isNotNull())
        .groupBy("type").agg(F.count(F.lit(1)).alias("lignes"))
    )


def zone_labels(rows: DataFrame, zone: str = "ZoneObservation", file: str = "fichier") -> DataFrame:
    """Frequency of each zone label per file."""
    return rows.groupBy(F.trim(zone).alias("libelle"), file).agg(F.count(F.lit(1)).alias("occurrences"))


def zone_label_totals(per_file: DataFrame) -> DataFrame:
    """Each label with its frequency and the number of files that carry it."""
    return per_file.groupBy("libelle").agg(
        F.sum("occurrences").alias("occurrences"), F.count(F.lit(1)).alias("nb_fichiers")
    )


def mapping_coverage(labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """Labels and volume that the alias table maps, and the share that is lost."""
    mapped = labels.withColumn("alias", normalize_label(F.col("libelle"))).join(aliases, "alias", "left")
    found = F.col("base").isNotNull()
    return mapped.agg(
        F.count(F.lit(1)).alias("libelles"), F.count_if(found).alias("mappes"),
        F.coalesce(F.sum("volume"), F.lit(0)).cast("long").alias("volume"),
        F.coalesce(F.sum(F.when(found, F.col("volume"))), F.lit(0)).cast("long").alias("volume_mappe"),
    ).withColumn("perte_pct", _pct(F.col("volume") - F.col("volume_mappe"), F.col("volume"), 2))


def mapping_score(coverage: DataFrame, aliases: DataFrame, expected: DataFrame, files: DataFrame, files_needed: int = 3) -> DataFrame:
    """Checks passed out of four: enough files, all labels mapped, expected pairs kept, no volume lost."""
    pairs = expected.join(aliases, "alias", "left").agg(F.struct(
        F.count(F.lit(1)).alias("attendues"),
        F.count_if(F.coalesce(F.col("base") == F.col("base_attendue"), F.lit(False))).alias("justes"),
    )).scalar()
    found = files.agg(F.count(F.lit(1))).scalar()
    passed = [
        F.col("fichiers") >= files_needed, F.col("mappes") == F.col("libelles"),
        F.col("p.justes") == F.col("p.attendues"), F.col("volume_mappe") == F.col("volume"),
    ]
    score = reduce(lambda a, b: a + b, [c.cast("int") for c in passed])
    return coverage.withColumn("p", pairs).withColumn("fichiers", found).select(
        "fichiers", "libelles", "mappes", F.col("p.attendues").alias("attendues"),
        F.col("p.justes").alias("justes"), score.alias("score"),
    )


def coverage_by_year(fact: DataFrame) -> DataFrame:
    return fact.groupBy(F.year("date").alias("annee")).agg(
        F.count(F.lit(1)).alias("lignes"), F.countDistinct("date").alias("jours"), F.sum("volume").alias("volume")
    )


def slice_stats(fact: DataFrame) -> DataFrame:
    return fact.agg(
        F.count(F.lit(1)).alias("lignes"), F.sum("volume").alias("volume"),
        F.min("date").alias("premiere"), F.max("date").alias("derniere"),
    )


def availability(fact: DataFrame, col: str = "id_commune", by: Sequence[str] = ()) -> DataFrame:
    """What there is when a report comes back empty."""
    return fact.groupBy(*by).agg(
        F.count(F.lit(1)).alias("lignes"), F.countDistinct(col).alias("membres"),
        F.coalesce(F.sum("volume"), F.lit(0).cast("long")).alias("volume"),
    )


def check_headers(headers: DataFrame, allowed: Sequence[str], file: str = "fichier", header: str = "entete") -> DataFrame:
    """Files to drop with the reason: no Date column first, or not on the list."""
    dated = F.regexp_replace(F.col(header), "^﻿", "").rlike(r"^Date\b")
    listed = F.col(file).isin(*allowed)
    reason = F.concat_ws(
        " et ", F.when(~dated, F.lit("pas d'en-tête Date")), F.when(~listed, F.lit("non listé"))
    )
    return headers.select(file, reason.alias("motif")).where(F.col("motif") != "")


def inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table with its class, as told by the name."""
    rows = [df.agg(F.count(F.lit(1)).alias("lignes")).select(F.lit(n).alias("table"), "lignes") for n, df in tables.items()]
    name = F.col("table")
    kind = (
        F.when(name.endswith("_temp"), "staging").when(name.startswith("fact_"), "fait")
        .when(name.startswith("dim_"), "dimension").otherwise("autre")
    )
    return reduce(lambda a, b: a.unionByName(b), rows).withColumn("classe", kind)


def inventory_totals(listed: DataFrame) -> DataFrame:
    return listed.groupBy("classe").agg(F.count(F.lit(1)).alias("tables"), F.sum("lignes").alias("lignes"))
