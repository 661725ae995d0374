"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hv_add(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def hv_sub(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def hv_flip(hv, positions) -> Column:
    """Change the sign at the given 0-based positions (array column)."""
    positions = F.col(positions) if isinstance(positions, str) else positions
    return F.transform(
        hv, lambda x, i: F.when(F.array_contains(positions, i), -x).otherwise(x)
    )


def hv_roll(hv, shift) -> Column:
    """Rotate right by ``shift``; element d comes from position (d - shift) mod D."""
    hv = F.col(hv) if isinstance(hv, str) else hv
    shift = F.lit(shift) if isinstance(shift, int) else shift
    size = F.size(hv)
    tail = F.pmod(shift.cast("int"), size).cast("int")
    return F.concat(
        F.slice(hv, size - tail + F.lit(1), tail),
        F.slice(hv, F.lit(1), size - tail),
    )


def hv_dot(a, b) -> Column:
    """Dot product in DOUBLE, exact while it stays below 2**53."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def hv_norm(a) -> Column:
    return F.sqrt(hv_dot(a, a))


def hv_cosine(a, b) -> Column:
    """Cosine similarity; NULL when either vector is zero."""
    return F.try_divide(hv_dot(a, b), hv_norm(a) * hv_norm(b))
