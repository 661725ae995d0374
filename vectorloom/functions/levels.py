"""Value -> level expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def level_of(value, lo, hi, n_levels: int) -> Column:
    """Level of ``value`` on ``n_levels`` equal steps between ``lo`` and ``hi``.

    Values at or above the top edge (and NaN) take the last level, values below
    the bottom edge level 0. The division only proposes a level; comparing with
    the edges ``lo + level * gap`` themselves settles it.
    """
    value = F.col(value) if isinstance(value, str) else value
    lo = F.lit(float(lo)) if isinstance(lo, (int, float)) else lo
    hi = F.lit(float(hi)) if isinstance(hi, (int, float)) else hi
    last = F.lit(n_levels - 1)
    gap = (hi - lo) / F.lit(float(n_levels))
    guess = F.least(F.floor(F.try_divide(value - lo, gap)).cast("int"), last)
    settled = (
        F.when(value < lo + guess * gap, guess - 1)
        .when(value >= lo + (guess + 1) * gap, guess + 1)
        .otherwise(guess)
    )
    inside = F.greatest(F.least(settled, last), F.lit(0))
    return F.when(value >= hi, last).when(value < lo, F.lit(0)).otherwise(inside)


def levels_of(features, lo, hi, n_levels: int) -> Column:
    """Levels of a whole feature array."""
    return F.transform(features, lambda v: level_of(v, lo, hi, n_levels))
