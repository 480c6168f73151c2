"""Change, share and significance columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sillage import fixed_values as fv


def _change(cur: Column, prev: Column) -> Column:
    # multiplied first, so that one division rounds: 23 of 80 is 28.75, not 28.749999
    return F.round((cur - prev) * F.lit(100.0) / F.nullif(prev, F.lit(0)), 1)


def pct_change(cur: Column, prev: Column, policy: str = "B") -> Column:
    """Percent change; the policy says what a previous value of zero means.

    A: null. B: 0 when both are zero, else null; a missing value gives null.
    C: 100 when there is something now, else 0. D: 0. E: 100 when there is
    something now, else null.
    """
    none = F.lit(None).cast("double")
    at_zero = {
        "A": none,
        "B": F.when(cur == 0, F.lit(0.0)),
        "C": F.when(cur > 0, F.lit(100.0)).otherwise(F.lit(0.0)),
        "D": F.lit(0.0),
        "E": F.when(cur > 0, F.lit(100.0)),
    }[policy]
    if policy == "B":
        return F.when(prev == 0, at_zero).otherwise(_change(cur, prev))
    return F.when(prev > 0, _change(cur, prev)).otherwise(at_zero)


def share(part: Column, whole: Column, digits: int = 1, empty: float | None = 0.0) -> Column:
    """Percentage of ``whole``; ``empty`` where the whole is zero or missing."""
    nothing = F.lit(empty).cast("double")
    return F.when(whole > 0, F.round(part * F.lit(100.0) / F.nullif(whole, F.lit(0)), digits)).otherwise(nothing)


def trend_class(cur: Column, prev: Column) -> Column:
    """New, gone, or the band of the percent change; null when both are zero."""
    change = _change(cur, prev)
    out = F.when((prev == 0) & (cur > 0), "nouveau").when((cur == 0) & (prev > 0), "disparu")
    for floor, name in fv.TREND_STEPS:
        out = out.when(change >= floor, name)
    return out.when(prev > 0, "fort_declin")


def size_bucket(volume: Column) -> Column:
    """Size class of a destination; null when nobody came."""
    out = F.when(volume <= 0, F.lit(None).cast("string"))
    for ceiling, name in fv.SIZE_STEPS:
        out = out.when(volume < ceiling, name)
    return out.otherwise("tres_grandes")


def poisson_z(cur: Column, prev: Column) -> Column:
    usable = (cur >= 0) & (prev >= 0)
    return F.when(usable, (cur - prev) / F.sqrt(F.greatest(cur + prev, F.lit(1))))


def poisson_significance(cur: Column, prev: Column, alpha: float = 0.05) -> Column:
    """Struct of z, threshold, verdict and direction for two counts."""
    threshold = fv.POISSON_THRESHOLDS.get(alpha, fv.POISSON_THRESHOLDS[0.05])
    z = poisson_z(cur, prev)
    significant = F.coalesce(F.abs(z) >= threshold, F.lit(False))
    direction = (
        F.when(significant & (z > 0), "increase")
        .when(significant & (z < 0), "decrease")
        .otherwise("stable")
    )
    return F.struct(
        z.alias("z"),
        F.when(z.isNotNull(), F.lit(threshold)).alias("threshold"),
        significant.alias("is_significant"),
        direction.alias("direction"),
    )
