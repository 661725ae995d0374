"""Deterministic ordering keys and run identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed, *columns) -> Column:
    """Pseudo-random but repeatable sort key: md5 of ``seed:col:col...`` in hex."""
    seed = F.lit(str(seed)) if isinstance(seed, (int, str)) else seed.cast("string")
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.md5(F.concat_ws(":", seed, *[p.cast("string") for p in parts]))


def key_bucket(key: Column, digits: int) -> Column:
    """Leading hex digits of an ordering key; buckets sort like the keys."""
    return F.substring(key, 1, digits)


def run_id(features) -> Column:
    """md5 of the printed, sorted feature list."""
    joined = F.array_join(F.array_sort(features), "', '")
    return F.md5(F.concat(F.lit("['"), joined, F.lit("']")))
