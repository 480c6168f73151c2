"""Registry and the pieces the SQL texts share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sillage.plans.windows import Windows
from sillage.sources import binding

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# the question most reports are asked: summer 2000 against earlier summers, one zone
ZONE = "EUROPE"
SUMMER = Windows.yearly("2000-06-21", "2000-09-22", back=4)
R = binding.ROLES


def register(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"two queries named {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add


def with_visits(body: str) -> str:
    return f"WITH visits AS ({binding.VISITS_SQL}) {body}"


def with_raw(body: str, *cols: str) -> str:
    return f"WITH raw AS ({binding.raw_sql(*cols)}) {body}"


def with_periods(body: str, *extra: str) -> str:
    return f"WITH periods AS ({binding.order_periods_sql(*extra)}) {body}"


def rnd(expr: str, digits: int) -> str:
    """Rounding half up on the decimal text of a double, as Spark does it."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def hit(offset: int, windows: Windows = SUMMER) -> str:
    w = windows[offset]
    return f"date BETWEEN DATE '{w.start}' AND DATE '{w.end}'"


def yearly(windows: Windows = SUMMER, condition: str = "TRUE") -> str:
    """n0, n1, ... as the reports define them, over ``visits``."""
    return ", ".join(
        f"{big(f'coalesce(sum(CASE WHEN {hit(w.offset, windows)} AND {condition} THEN volume END), 0)')} AS n{w.offset}"
        for w in windows
    )


def change(cur: str, prev: str, policy: str) -> str:
    pct = rnd(f"(({cur}) - ({prev})) * 100.0::DOUBLE / nullif({prev}, 0)", 1)
    zero = {
        "A": "NULL",
        "B": f"CASE WHEN {cur} = 0 THEN 0.0::DOUBLE END",
        "C": f"CASE WHEN {cur} > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END",
        "D": "0.0::DOUBLE",
        "E": f"CASE WHEN {cur} > 0 THEN 100.0::DOUBLE END",
    }[policy]
    if policy == "B":
        return f"CASE WHEN {prev} = 0 THEN {zero} ELSE {pct} END"
    return f"CASE WHEN {prev} > 0 THEN {pct} ELSE {zero} END"


def part(value: str, whole: str, digits: int = 1, empty: str = "0.0::DOUBLE") -> str:
    return f"CASE WHEN {whole} > 0 THEN {rnd(f'({value}) * 100.0::DOUBLE / nullif({whole}, 0)', digits)} ELSE {empty} END"


TOURISTS = f"zone = '{ZONE}' AND categorie = '{R.touriste}'"
EXCURSIONISTS = f"zone = '{ZONE}' AND categorie = '{R.excursionniste}'"
NATIONAL = f"provenance = '{R.nonlocal_}'"
FOREIGN = f"provenance = '{R.etranger}'"
VISITORS = f"provenance IN ('{R.nonlocal_}', '{R.etranger}')"
OUTSIDE = f"provenance <> '{R.local}'"
