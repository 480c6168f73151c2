"""Fact rows that arrive as JSON texts with more than one spelling of their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sillage.functions.dates import parse_iso, weekday_fr
from sillage.functions.text import normalize_label

# fixed values: target column -> accepted keys, in order of preference
SPELLINGS = {
    "date": ("date", "Date"),
    "zone": ("nom_zone", "ZoneObservation"),
    "provenance": ("nom_provenance", "Provenance"),
    "categorie": ("nom_categorie", "CategorieVisiteur"),
    "departement": ("nom_departement", "NomDepartement"),
    "pays": ("nom_pays", "Pays"),
    "duree": ("libelle_duree", "DureeSejour"),
    "nb_nuits": ("nb_nuits", "DureeSejourNum"),
    "epci": ("nom_epci", "EPCI", "NomEPCI"),
    "code_insee": (
        "code_insee", "CodeInsee", "CodeINSEE", "CodeInseeNuiteeSoir", "CodeInseeDiurneSoir",
        "CodeInseeNuiteeVeille", "CodeInseeDiurneVeille",
    ),
    "jour_semaine": ("jour_semaine", "JourDeLaSemaine"),
    "volume": ("volume", "Volume"),
}
_LABELS = ("zone", "provenance", "categorie", "departement", "pays", "duree", "epci")


def rows_from_json(df: DataFrame, col: str = "value", *keep: str) -> DataFrame:
    """One typed row per JSON text; what cannot be read is null.

    A text is parsed once for all its keys. ``json_tuple`` tells keys apart by case,
    which a struct schema would not.
    """
    keys = list(dict.fromkeys(k for spellings in SPELLINGS.values() for k in spellings))
    names = {key: f"_k{i}" for i, key in enumerate(keys)}
    parsed = df.select(*keep, F.json_tuple(col, *keys).alias(*names.values()))
    raw = parsed.select(*keep, *[
        F.coalesce(*[F.col(names[k]) for k in spellings]).alias(target) for target, spellings in SPELLINGS.items()
    ])
    day = parse_iso(F.col("date"))
    cells = {
        "date": day,
        **{c: normalize_label(F.col(c)) for c in _LABELS},
        "code_insee": F.nullif(F.trim("code_insee"), F.lit("")),
        "nb_nuits": F.col("nb_nuits").try_cast("int"),
        "jour_semaine": F.coalesce(normalize_label(F.col("jour_semaine")), weekday_fr(day)),
        "volume": F.coalesce(F.col("volume").try_cast("bigint"), F.lit(0).cast("bigint")),
    }
    return raw.select(*keep, *[c.alias(name) for name, c in cells.items()])


def usable(rows: DataFrame) -> DataFrame:
    """Rows with a date, the three base labels and a positive volume."""
    return rows.na.drop(subset=["date", "zone", "provenance", "categorie"]).where(F.col("volume") > 0)


def payload_rows(df: DataFrame, col: str = "value") -> DataFrame:
    """Rows inside ``{"table": ..., "rows": [...]}`` payloads, one JSON text each."""
    shape = T.StructType([T.StructField("table", T.StringType()), T.StructField("rows", T.ArrayType(T.StringType()))])
    return df.select(F.from_json(col, shape).alias("p")).select("p.table", F.explode("p.rows").alias("value"))
