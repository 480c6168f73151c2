"""The reference window of a report and the same window in earlier years.

A report always compares a handful of windows that its caller names, so they are
plain dates and become literal predicates: the scan sees them (row groups outside
every window are skipped) and one pass over the fact answers all the years.
"""

from __future__ import annotations

import calendar
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same_day(d: date, year: int) -> date:
    return d.replace(year=year, day=min(d.day, calendar.monthrange(year, d.month)[1]))


@dataclass(frozen=True)
class Window:
    offset: int
    start: date
    end: date

    def hit(self, c: Column) -> Column:
        return c.between(F.lit(self.start), F.lit(self.end))

    def nth_saturday(self, n: int) -> date | None:
        to_saturday = (5 - self.start.weekday()) % 7
        day = self.start + timedelta(days=to_saturday + 7 * (n - 1))
        return day if day <= self.end else None

    def fixed_day(self, month: int, day: int) -> date | None:
        """That day of the year if the window holds it."""
        for year in range(self.start.year, self.end.year + 1):
            found = date(year, month, day)
            if self.start <= found <= self.end:
                return found
        return None

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1


class Windows:
    """Windows by offset: 0 is the reference year, 1 the year before, and so on."""

    def __init__(self, windows: list[Window]):
        self._windows = list(windows)
        self._by_offset = {w.offset: w for w in self._windows}

    @classmethod
    def yearly(cls, start: str | date, end: str | date, back: int = 1) -> Windows:
        a = date.fromisoformat(start) if isinstance(start, str) else start
        b = date.fromisoformat(end) if isinstance(end, str) else end
        if b < a:
            raise ValueError(f"window ends before it starts: {a} .. {b}")
        return cls([
            Window(k, _same_day(a, a.year - k), _same_day(b, b.year - k)) for k in range(back + 1)
        ])

    @classmethod
    def resolved(cls, df: DataFrame) -> Windows:
        """Windows out of a resolved request (offset, start, end), one per offset: as many as the report has columns."""
        return cls(sorted((Window(*r) for r in df.select("offset", "start", "end").collect()), key=lambda w: w.offset))

    def __iter__(self) -> Iterator[Window]:
        return iter(self._windows)

    def __len__(self) -> int:
        return len(self._windows)

    def __getitem__(self, offset: int) -> Window:
        return self._by_offset[offset]

    def first(self, n: int) -> Windows:
        return Windows(self._windows[:n])

    def any_hit(self, c: Column) -> Column:
        return reduce(lambda x, y: x | y, [w.hit(c) for w in self._windows])
