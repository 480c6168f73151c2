"""Calendar columns and window arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sillage import fixed_values as fv

ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}$"


def parse_iso(c: Column) -> Column:
    """Date of an exact ``yyyy-MM-dd`` text, null for anything else."""
    return F.when(c.rlike(ISO_SHAPE), F.try_to_date(c, "yyyy-MM-dd"))


def valid_iso_date(c: Column) -> Column:
    return parse_iso(c).isNotNull()


def parse_dmy(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_date(c, "dd/MM/yyyy"))


def fmt_dmy(d: Column) -> Column:
    return F.date_format(d, "dd/MM/yyyy")


def period_label(name: Column, start: Column, end: Column) -> Column:
    return F.concat(
        name, F.lit(" ("), F.date_format(start, "dd/MM"), F.lit(" - "),
        F.date_format(end, "dd/MM"), F.lit(")"),
    )


def weekday_fr(d: Column) -> Column:
    # get, not element_at: the latter takes a null index for the last element
    return F.get(F.array(*[F.lit(w) for w in fv.WEEKDAYS_FR]), F.weekday(d))


def calendar_parts(d: Column) -> dict[str, Column]:
    return {
        "mois": F.month(d),
        "annee": F.year(d),
        "trimestre": F.quarter(d),
        "semaine": F.weekofyear(d),
    }


def calendar_extra(d: Column) -> dict[str, Column]:
    return {
        "jour": F.dayofmonth(d),
        "semestre": F.when(F.month(d) <= 6, 1).otherwise(2),
        "est_weekend": F.weekday(d) >= 5,
        "nom_mois": F.get(F.array(*[F.lit(m) for m in fv.MONTHS_FR]), F.month(d) - 1),
    }


def shift_years(d: Column, years: int | Column) -> Column:
    """Same day ``years`` later; 29 February becomes 28 February."""
    return F.add_months(d, (F.lit(years) if isinstance(years, int) else years) * 12)


def nth_saturday(start: Column, end: Column, n: int) -> Column:
    """n-th Saturday inside the window, null when the window is too short."""
    day = F.date_add(F.next_day(F.date_sub(start, 1), "SAT"), 7 * (n - 1))
    return F.when(day <= end, day)


def days_inclusive(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1


def full_year(year: Column) -> tuple[Column, Column]:
    return F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year, F.lit(12), F.lit(31))


def _pick(key: Column, choices: dict[str, Column], otherwise: Column) -> Column:
    out = None
    for value, column in choices.items():
        out = F.when(key == value, column) if out is None else out.when(key == value, column)
    return out.otherwise(otherwise)


def synthetic_window(season: Column, year: Column) -> tuple[Column, Column]:
    """Whole months of a season; other texts give the whole year."""
    starts, ends = {}, {}
    for name, (first, last) in fv.SEASON_MONTHS.items():
        start_year = year - 1 if first > last else year
        starts[name] = F.make_date(start_year, F.lit(first), F.lit(1))
        ends[name] = F.last_day(F.make_date(year, F.lit(last), F.lit(1)))
    jan, dec = full_year(year)
    return _pick(season, starts, jan), _pick(season, ends, dec)


def _from_month_day(year: Column, month_day: str) -> Column:
    month, day = month_day.split("-")
    return F.make_date(year, F.lit(int(month)), F.lit(int(day)))


def _window_table(
    key: Column, year: Column, table: dict[str, tuple[str, str]]
) -> tuple[Column, Column]:
    starts = {k: _from_month_day(year, a) for k, (a, _) in table.items()}
    ends = {k: _from_month_day(year + 1 if b < a else year, b) for k, (a, b) in table.items()}
    jan, dec = full_year(year)
    return _pick(key, starts, jan), _pick(key, ends, dec)


def astro_window(season: Column, year: Column) -> tuple[Column, Column]:
    return _window_table(F.lower(F.trim(season)), year, fv.ASTRO_WINDOWS)


def fallback_window(name: Column, year: Column) -> tuple[Column, Column]:
    return _window_table(F.lower(F.trim(name)), year, fv.FALLBACK_WINDOWS)


def override(start: Column, end: Column, user_start: Column, user_end: Column) -> tuple[Column, Column]:
    """The user's window where it is complete and in order, else the resolved one."""
    usable = F.coalesce(user_end >= user_start, F.lit(False))
    return F.when(usable, user_start).otherwise(start), F.when(usable, user_end).otherwise(end)


def season_of_month(d: Column) -> Column:
    month = F.month(d)
    out = F.lit("hiver")
    for name, (first, last) in fv.SEASON_MONTHS.items():
        if first < last:
            out = F.when(month.between(first, last), name).otherwise(out)
    return out


def days_left(end: Column, asof: Column) -> Column:
    """Days from ``asof`` to the end of a window, never negative."""
    return F.greatest(F.datediff(end, asof), F.lit(0))
