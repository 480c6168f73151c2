"""From delivered rows to facts: labels, ids, sums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sillage import fixed_values as fv
from sillage.functions import text
from sillage.functions.dates import parse_iso
from sillage.operators.aggregates import preagg
from sillage.operators.conform import assign_ids, attach_ids, require
from sillage.operators.zones import zone_to_base
from sillage.session import stage
from sillage.sources.csvfiles import read_named

_CLEANERS = {
    "provenance": ("Provenance", text.clean_provenance),
    "categorie": ("CategorieVisiteur", text.clean_category),
    "pays": ("Pays", text.clean_country),
    "duree": ("DureeSejour", text.clean_stay),
}


def conform_labels(df: DataFrame, aliases: DataFrame, *keep: str) -> DataFrame:
    """Delivered columns as clean labels under the names of the star, as far as they are there."""
    cells: dict[str, Column] = {
        "date": parse_iso(F.col("Date")),
        "zone": text.normalize_label(F.col("ZoneObservation")),
        "volume": F.coalesce(F.col("Volume").try_cast("bigint"), F.lit(0).cast("bigint")),
    }
    for name, (source, clean) in _CLEANERS.items():
        if source in df.columns:
            cells[name] = clean(F.col(source))
    if set(fv.DEPARTMENT_COLUMNS) & set(df.columns):
        cells["departement"] = text.clean_department(text.first_present(df, fv.DEPARTMENT_COLUMNS))
    out = df.select(*keep, *[c.alias(n) for n, c in cells.items()])
    return zone_to_base(out, aliases, "zone").drop("zone").withColumnRenamed("base", "zone")


def conform_places(df: DataFrame, aliases: DataFrame, *keep: str) -> DataFrame:
    """As ``conform_labels``, with the weekday and the commune and EPCI of a mobility file."""
    df = df.withColumns({
        "commune": F.nullif(F.trim(text.first_present(df, fv.INSEE_COLUMNS)), F.lit("")),
        "epci": text.normalize_label(text.first_present(df, fv.EPCI_COLUMNS)),
        "jour_semaine": text.clean_weekday(F.col("JourDeLaSemaine")),
    })
    return conform_labels(df, aliases, "commune", "epci", "jour_semaine", *keep)


def load_fact(
    rows: DataFrame, required: Sequence[str], optional: Sequence[str] = (), extra: Sequence[str] = (),
    dims: Mapping[str, DataFrame] | None = None, counted_by: Observation | None = None,
) -> DataFrame:
    """Clean rows to a fact at its grain.

    The deliveries are read once: rows are summed per labels and those sums are
    written to the shared folder, where the dimensions and the fact read them. Rows
    that lack a required label are dropped, an unknown optional one gets id 0.
    ``dims`` maps a name to its stored members (membre, id), which new labels are added to.
    ``counted_by`` observes that one reading: its counts (``_counts``) are there when the function returns.
    """
    names = [*required, *optional]
    if counted_by is not None:
        rows = rows.observe(counted_by, *_counts(["date", *required]))
    keys = ["date", *extra, *names]
    # labels of rows without volume still enter the dimensions
    counted = F.when(F.col("volume") > 0, F.col("volume"))
    labels = stage(rows.groupBy(*keys).agg(F.sum(counted).alias("volume")), "labels")
    members = stage(assign_ids(labels, {n: (dims or {}).get(n) for n in names}), "members")
    sums = require(labels, ["date", "volume", *required])
    for name in names:
        dim = members.where(F.col("dimension") == name).select(F.col("membre").alias(name), F.col("id").alias(f"id_{name}"))
        sums = attach_ids(sums, dim, name, name, f"id_{name}", unknown=0 if name in optional else None)
    return preagg(sums, ["date", *extra, *[f"id_{n}" for n in names]])


def _counts(required: Sequence[str]) -> list[Column]:
    """What a load tells about its rows: read, kept, without volume, and rejected for each label that is missing."""
    missing = {c: F.col(c).isNull() for c in required}
    lacking = reduce(lambda a, b: a | b, missing.values())
    filled = F.coalesce(F.col("volume") > 0, F.lit(False))
    return [
        F.count(F.lit(1)).alias("lues"), F.count_if(~lacking & filled).alias("gardees"), F.count_if(~lacking & ~filled).alias("sans_volume"),
        F.count_if(lacking).alias("rejetees"), *(F.count_if(hit).alias(f"sans_{c}") for c, hit in missing.items()),
        F.coalesce(F.sum(F.when(~lacking & filled, F.col("volume"))), F.lit(0)).alias("volume"),
    ]


USEFUL = (*fv.DELIVERY_COLUMNS, *fv.GEO_COLUMNS, *fv.DEPARTMENT_COLUMNS, *fv.EPCI_COLUMNS, *fv.INSEE_COLUMNS)


def grain_of_family(family: str) -> tuple[list[str], list[str], list[str]]:
    """Required labels, optional labels and further columns of a file family."""
    required = ["zone", "provenance", "categorie"]
    if family.endswith("_Departement"):
        required.append("departement")
    if family.endswith("_Pays"):
        required.append("pays")
    if family.startswith("SejourDuree"):
        required.append("duree")
    if family in fv.MOBILITY_FAMILIES:
        return required, ["epci", "commune"], ["jour_semaine"]
    return required, [], []


def load_files(
    spark: SparkSession, path: str | Sequence[str], family: str, aliases: DataFrame,
    dims: Mapping[str, DataFrame] | None = None, sep: str = ";", counted_by: Observation | None = None,
) -> DataFrame:
    """Delivered files of one family to their fact: read, each by its own header and charset, clean, number, sum.

    ``counted_by`` as in ``load_fact``.
    """
    raw = read_named(spark, path, sep)
    raw = raw.select(*[c for c in USEFUL if c in raw.columns])
    required, optional, extra = grain_of_family(family)
    clean = conform_places(raw, aliases) if optional else conform_labels(raw, aliases)
    return load_fact(clean, required, optional, extra, dims, counted_by)


def load_families(spark: SparkSession, paths: Mapping[str, str | Sequence[str]], aliases: DataFrame, sep: str = ";") -> tuple[dict[str, DataFrame], DataFrame]:
    """The facts of several families, and a row per family with what its load read, kept and rejected.

    The counts are observed while the rows are summed; no row is read for them.
    """
    facts, told = {}, []
    for family, path in paths.items():
        counts = Observation(f"load {family}")
        facts[family] = load_files(spark, path, family, aliases, sep=sep, counted_by=counts)
        got = counts.get
        told.append((family, *(int(got[c]) for c in ("lues", "gardees", "sans_volume", "rejetees", "volume")), {c[5:]: int(v) for c, v in got.items() if c.startswith("sans_") and c != "sans_volume"}))
    schema = "famille string, lues bigint, gardees bigint, sans_volume bigint, rejetees bigint, volume bigint, manquants map<string,bigint>"
    stats = spark.createDataFrame(told, schema)
    rate = F.round(F.col("gardees") * F.lit(100.0) / F.nullif("lues", F.lit(0)), 1)
    return facts, stats.withColumn("taux_succes", rate)
