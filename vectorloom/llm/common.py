"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.tables import BROADCAST_ROWS, written

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The same white space as characters, for trimming.
SPACE = "\t\n\x0b\x0c\r "


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text of a row, empty where it is null."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow join side, computed once: broadcast if it is measured to have at most
    ``limit`` rows, else left to a shuffle join. Without this the other side, with its texts,
    is shuffled before Spark finds out how small this one is."""
    df = written(df)
    return F.broadcast(df) if df.count() <= limit else df


def rows_as(docs: DataFrame, name: str = "row") -> Column:
    """All columns of a row packed into one, so that no name can clash with ours."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias(name)
