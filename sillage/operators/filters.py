"""Row predicates of the reports."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillage import fixed_values as fv


def in_window(df: DataFrame, start: date | str, end: date | str, col: str = "date") -> DataFrame:
    return df.where(F.col(col).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def where_dims(
    df: DataFrame, zone: str | None = None, categorie: str | None = None,
    provenances: Iterable[str] | None = None,
) -> DataFrame:
    """Rows of a fact that carries its dimension names."""
    if zone is not None:
        df = df.where(F.col("zone") == zone)
    if categorie is not None:
        df = df.where(F.col("categorie") == categorie)
    if provenances is not None:
        df = df.where(F.col("provenance").isin(*provenances))
    return df


def where_member(fact: DataFrame, dim: DataFrame, id_col: str, predicate: Column) -> DataFrame:
    """Rows of a fact keyed by ids, chosen by the names in its dimension."""
    return fact.join(dim.where(predicate).select(id_col), id_col, "left_semi")


def provenance_rule(rule: str, roles: "Roles | None" = None) -> Column:
    """``national``, ``foreign``, ``visitors`` (both) or ``not_local``."""
    r = roles or Roles()
    c = F.col("provenance")
    return {
        "national": c == r.nonlocal_,
        "foreign": c == r.etranger,
        "visitors": c.isin(r.nonlocal_, r.etranger),
        "not_local": c != r.local,
    }[rule]


class Roles:
    """Which stored member plays which part; the defaults are the delivered names."""

    def __init__(
        self, local: str = fv.LOCAL, nonlocal_: str = fv.NONLOCAL, etranger: str = fv.ETRANGER,
        touriste: str = fv.TOURISTE, excursionniste: str = fv.EXCURSIONNISTE,
    ):
        self.local, self.nonlocal_, self.etranger = local, nonlocal_, etranger
        self.touriste, self.excursionniste = touriste, excursionniste


def not_sentinel(c: Column, sentinels: Iterable[str] = fv.SENTINELS) -> Column:
    return F.coalesce(~F.upper(F.trim(c)).isin(*sentinels), F.lit(False))


def drop_sentinels(df: DataFrame, col: str, sentinels: Iterable[str] = fv.SENTINELS) -> DataFrame:
    """Without pre-summed, unnamed and missing members."""
    return df.where(F.col(col).isNotNull() & ~F.upper(F.trim(F.col(col))).isin(*sentinels))


def positive(df: DataFrame, col: str = "volume") -> DataFrame:
    return df.where(F.col(col) > 0)


def known_commune(df: DataFrame, col: str = "id_commune") -> DataFrame:
    return df.where(F.col(col) > 0)


def like(df: DataFrame, col: str, term: str, mode: str = "contains") -> DataFrame:
    c = F.lower(F.col(col))
    wanted = F.lit(term.lower())
    test = {"contains": F.contains, "prefix": F.startswith, "suffix": F.endswith}[mode]
    return df.where(test(c, wanted))


def data_mode(df: DataFrame, mode: str = "all", flag: str = "is_provisional") -> DataFrame:
    """``main`` rows, ``provisional`` rows or ``all``."""
    if mode == "main":
        return df.where(~F.col(flag))
    if mode == "provisional":
        return df.where(F.col(flag))
    return df


def days_in_window(days: DataFrame, start: date | str, end: date | str, col: str = "date") -> DataFrame:
    """Fixed days that the chosen window holds; join the rest of the report to these."""
    return in_window(days, start, end, col)


def having(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition)
