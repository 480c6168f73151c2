"""Schemas of the star: dimensions and the fact families by their extra grain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_I, _L, _S, _D, _B = T.IntegerType(), T.LongType(), T.StringType(), T.DateType(), T.BooleanType()
_BASE = [("date", _D), ("id_zone", _I), ("id_provenance", _I), ("id_categorie", _I)]
_GEO = {"departement": ("id_departement", _I), "departements": ("id_departement", _I), "pays": ("id_pays", _I),
        "regions": ("id_region", _I), "age": ("id_age", _I), "geolife": ("id_geolife", _I)}

DIMENSIONS = {
    "dim_zones_observation": [("id_zone", _I), ("nom_zone", _S)],
    "dim_provenances": [("id_provenance", _I), ("nom_provenance", _S)],
    "dim_categories_visiteur": [("id_categorie", _I), ("nom_categorie", _S)],
    "dim_pays": [("id_pays", _I), ("nom_pays", _S)],
    "dim_departements": [("id_departement", _I), ("nom_departement", _S), ("nom_region", _S), ("nom_nouvelle_region", _S)],
    "dim_regions": [("id_region", _I), ("nom_region", _S), ("nom_nouvelle_region", _S)],
    "dim_communes": [("id_commune", _I), ("code_insee", _S), ("nom_commune", _S), ("id_departement", _I)],
    "dim_epci": [("id_epci", _I), ("nom_epci", _S)],
    "dim_durees_sejour": [("id_duree", _I), ("libelle", _S), ("nb_nuits", _I), ("ordre", _I)],
    "dim_tranches_age": [("id_age", _I), ("tranche_age", _S)],
    "dim_segments_geolife": [("id_geolife", _I), ("nom_segment", _S)],
    "dim_dates": [("date", _D), ("vacances_a", _B), ("vacances_b", _B), ("vacances_c", _B), ("ferie", _B),
                  ("jour_semaine", _S), ("mois", _I), ("annee", _I), ("trimestre", _I), ("semaine", _I)],
    "dim_periodes": [("id_periode", _I), ("code_periode", _S), ("nom_periode", _S), ("annee", _I),
                     ("date_debut", _D), ("date_fin", _D), ("id_saison", _I)],
    "dim_saisons": [("id", _I), ("annee", _I), ("saison", _S), ("date_debut", _D), ("date_fin", _D), ("duree_jours", _I)],
}


def _fact(*extra: tuple) -> list[tuple]:
    return [*_BASE, *extra, ("volume", _L), ("is_provisional", _B)]


def _facts() -> dict[str, list[tuple]]:
    out = {}
    for kind in ("nuitees", "diurnes"):
        out[f"fact_{kind}"] = _fact()
        for suffix in ("departements", "pays", "regions", "age", "geolife"):
            out[f"fact_{kind}_{suffix}"] = _fact(_GEO[suffix])
    stay = ("id_duree", _I)
    out["fact_sejours_duree"] = _fact(stay)
    for suffix in ("departements", "pays"):
        out[f"fact_sejours_duree_{suffix}"] = _fact(_GEO[suffix], stay)
    place = [("jour_semaine", _S), ("id_epci", _I), ("id_commune", _I)]
    for what in ("activite", "nuitee"):
        for when in ("soir", "veille"):
            out[f"fact_lieu_{what}_{when}"] = _fact(*place)
            for suffix in ("departement", "pays"):
                out[f"fact_lieu_{what}_{when}_{suffix}"] = _fact(_GEO[suffix], *place)
    return out


FACTS = _facts()
PRESETS = {
    "dims": tuple(DIMENSIONS),
    "facts": tuple(t for t in FACTS if t.startswith(("fact_nuitees", "fact_diurnes"))),
    "sejours": tuple(t for t in FACTS if t.startswith("fact_sejours")),
    "lieu": tuple(t for t in FACTS if t.startswith("fact_lieu")),
}
PRESETS["all"] = tuple(DIMENSIONS) + tuple(FACTS)


def schema_for(table: str) -> T.StructType:
    """Schema of a table; staging (``_temp``) and test twins share that of the main table."""
    name = table.removesuffix("_test").removesuffix("_temp")
    columns = DIMENSIONS.get(name) or FACTS[name]
    return T.StructType([T.StructField(c, t) for c, t in columns])


def grain_of(table: str) -> list[str]:
    return [f.name for f in schema_for(table) if f.name not in ("volume", "is_provisional")]


def empty_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema_for(table))


def fit(df: DataFrame, table: str) -> DataFrame:
    """Frame with exactly the columns and types of a table; missing columns are null."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema_for(table)
    ])
