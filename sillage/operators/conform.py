"""Members of dimensions: ids for new labels, rejects, duplicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sillage.functions.text import collation_key, normalize_label
from sillage.operators.merge import merge_dim
from sillage.session import stage

# new labels are numbered inside buckets of their hash, so no task sees all of them
_BUCKET_HEX = 3


def assign_ids(labels: DataFrame, dims: Mapping[str, DataFrame | None]) -> DataFrame:
    """Members of several dimensions at once: (dimension, membre, cle, id).

    ``dims`` maps a column of ``labels`` to its stored members (membre, id) or None.
    Labels that differ in case or accents only are one member, as ``cle`` says.
    Stored members keep their ids, new ones get the following. Their order is
    (hash bucket, key): always the same, and spread over at most 4096 buckets per
    dimension whatever the labels look like, so no task numbers them all.
    """
    melted = labels.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("dimension"), F.col(n).cast("string").alias("membre")) for n in dims
    ])).alias("m")).select("m.*").where(F.col("membre").isNotNull())
    # each distinct label has its key made once; numbering reads them twice
    melted = stage(melted.distinct(), "distinct")
    seen = melted.groupBy("dimension", collation_key(F.col("membre")).alias("cle")).agg(F.min("membre").alias("membre"))
    stored = None
    for name, dim in dims.items():
        if dim is not None:
            part = dim.select(
                F.lit(name).alias("dimension"), collation_key(F.col("membre")).alias("cle"), "membre",
                F.col("id").cast("long").alias("id"),
            )
            stored = part if stored is None else stored.unionByName(part)
    if stored is None:
        return _number(seen, None)
    new = seen.join(stored.select("dimension", "cle"), ["dimension", "cle"], "left_anti")
    return stored.unionByName(_number(new, stored))


def _number(new: DataFrame, stored: DataFrame | None) -> DataFrame:
    bucketed = new.withColumn("_bucket", F.substring(F.md5(F.col("cle").cast("binary")), 1, _BUCKET_HEX))
    sizes = bucketed.groupBy("dimension", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    if stored is not None:
        # the ids in use count as a bucket before all others
        used = stored.groupBy("dimension").agg(F.max("id").alias("_n"))
        sizes = sizes.unionByName(used.select("dimension", F.lit("").alias("_bucket"), "_n"))
    before = W.partitionBy("dimension").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("dimension", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("dimension", "_bucket").orderBy("cle"))
    # offsets: at most 16 ** _BUCKET_HEX rows per dimension
    return bucketed.join(F.broadcast(offsets), ["dimension", "_bucket"]).select(
        "dimension", "cle", "membre", (F.col("_before") + inside).cast("long").alias("id")
    )


def get_or_create(df: DataFrame, dim: DataFrame, col: str, label: str, id_col: str) -> DataFrame:
    """The dimension with a new id for every label of ``df`` it lacks."""
    stored = dim.select(F.col(label).alias("membre"), F.col(id_col).alias("id"))
    # numbering reads the labels twice
    labels = stage(df.select(F.col(col).alias(label)).distinct(), "labels")
    members = assign_ids(labels, {label: stored})
    return members.select(F.col("id").alias(id_col), F.col("membre").alias(label))


def attach_ids(df: DataFrame, dim: DataFrame, col: str, label: str, id_col: str, unknown: int | None = None) -> DataFrame:
    """Id of each row's label, whatever its case and accents; ``unknown`` (or null) where
    the dimension lacks it."""
    ids = dim.groupBy(collation_key(F.col(label)).alias("_cle")).agg(F.min(id_col).alias(id_col))
    out = df.withColumn("_cle", collation_key(F.col(col))).join(ids, "_cle", "left").drop("_cle")
    return out if unknown is None else out.withColumn(id_col, F.coalesce(F.col(id_col), F.lit(unknown)))


def conform_epci(df: DataFrame, dim: DataFrame, col: str = "epci") -> DataFrame:
    return attach_ids(df.withColumn(col, normalize_label(F.col(col))), dim, col, "nom_epci", "id_epci", unknown=0)


def conform_communes(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Communes by INSEE code: known ones get their missing attributes, new ones are added."""
    seen = df.where(F.col("code_insee").isNotNull()).groupBy("code_insee").agg(
        F.min("nom_commune").alias("nom_commune"), F.min("departement").alias("departement")
    )
    with_ids = get_or_create(df, dim, "code_insee", "code_insee", "id_commune")
    kept = dim.select("code_insee", "nom_commune", "departement")
    # the stored name stays; only gaps are filled, so the store is the newer side
    filled = merge_dim(seen, kept, "code_insee")
    return with_ids.join(filled, "code_insee")


def conform_stays(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Stay labels with their number of nights, in order of length."""
    with_ids = get_or_create(df, dim, "duree", "duree", "id_duree")
    nights = df.groupBy("duree").agg(F.min("nb_nuits").alias("nb_nuits"))
    stored = dim.select("duree", "nb_nuits")
    return with_ids.join(merge_dim(nights, stored, "duree"), "duree", "left")


def extend_calendar(fresh: DataFrame, cal: DataFrame) -> DataFrame:
    """Calendar with the dates it lacks; stored dates stay as they are."""
    return cal.unionByName(fresh.select(*cal.columns).join(cal.select("date"), "date", "left_anti").select(*cal.columns))


def enrich_departments(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Old and new region of each department; null never replaces a known region."""
    seen = df.where(F.col("departement").isNotNull()).groupBy("departement").agg(
        F.min(normalize_label(F.col("region"))).alias("region"),
        F.min(normalize_label(F.col("nouvelle_region"))).alias("nouvelle_region"),
    )
    return merge_dim(dim, seen, "departement")


def build_regions(df: DataFrame) -> DataFrame:
    """Distinct (old, new) region pairs."""
    return df.select("region", "nouvelle_region").na.drop().distinct()


def build_members(df: DataFrame, col: str) -> DataFrame:
    return df.select(normalize_label(F.col(col)).alias(col)).na.drop().distinct()


def prescan(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Members of every dimension in one pass: (dimension, member, rows)."""
    melted = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("dimension"), normalize_label(F.col(c).cast("string")).alias("membre")) for c in cols
    ])).alias("m")).select("m.*")
    return melted.where(F.col("membre").isNotNull()).groupBy("dimension", "membre").agg(
        F.count(F.lit(1)).alias("lignes")
    )


def require(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows that have all required ids."""
    return df.na.drop(subset=list(cols))


def reject_reasons(checks: Mapping[str, Column]) -> Column:
    """Names of the failed checks, in the given order."""
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))
    return F.array_join(failed, ", ")


def reject_report(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Rows and share of each combination of failed checks, next to the mapped rate."""
    by_reason = df.groupBy(reject_reasons(checks).alias("motif")).agg(F.count(F.lit(1)).alias("lignes"))
    # at most one row per combination of checks
    together = W.partitionBy()
    everything = F.sum("lignes").over(together)
    accepted = F.coalesce(F.sum(F.when(F.col("motif") == "", F.col("lignes"))).over(together), F.lit(0))
    return by_reason.withColumns({"_toutes": everything, "_acceptees": accepted}).where(F.col("motif") != "").select(
        "motif", "lignes",
        F.round(F.col("lignes") * F.lit(100.0) / (F.col("_toutes") - F.col("_acceptees")), 1).alias("part_rejets"),
        F.round(F.col("_acceptees") * F.lit(100.0) / F.col("_toutes"), 1).alias("taux_mappe"),
    )


def dedupe_grain(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Of rows with the same grain the one with the lowest id.

    ``min_by`` keeps one candidate per grain and partition, so duplicates of a grain
    never meet in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), id_col).alias("_row")).select(*keys, "_row.*")


def dedupe(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    return dedupe_grain(df, keys, id_col).select(*df.columns)
