"""Line removal by frequency within a site.

A line is boilerplate of a host if it stands on more than ``ratio`` of the host's pages, at
least ``min_pages`` (two), and not just on copies of one page. Lines are compared without
surrounding white space; each page counts a line once. At most (mean number of different lines a page) / ratio lines of a
host can pass, whatever the host's size, so a host's list is small and travels as one array.
Counting combines on the map side, so a hot host or line is a few counters per task.

Defined results: null text stays null and counts as a page without lines; a null host is a
host of its own; lines without a word are kept; copies count as pages; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import SPACE, WORD, let, rows_as
from vectorloom.tables import written

#: Line keys that may be sent to every task; longer lists are joined by shuffle.
BROADCAST_KEYS = 200_000
RATIO = 0.1
MIN_PAGES = 2


def line_key(line: Column) -> Column:
    """64-bit hash of a trimmed line; a host's few listed lines make collisions negligible."""
    return F.xxhash64(F.trim(line, F.lit(SPACE)))


def with_words(lines: Column) -> Column:
    return F.filter(lines, lambda x: x.rlike(WORD))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO,
                min_pages: int = MIN_PAGES) -> DataFrame:
    """host, listed: the line keys to drop on each host that has any."""
    pages = docs.select(docs[host].alias("host"), docs["text"].alias("text"),
                        F.xxhash64(docs["text"]).alias("page"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    keys = F.array_distinct(F.transform(with_words(F.split("text", "\n")), line_key))
    counts = (pages.select("host", "page", F.explode(keys).alias("key"))
              .groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"),
                                          F.min("page").alias("one"), F.max("page").alias("other"))
              .where((F.col("n") >= min_pages) & (F.col("one") != F.col("other"))))
    total = totals.select(F.col("host").alias("t_host"), "pages")
    return (counts.join(total, F.col("host").eqNullSafe(F.col("t_host")))
            .where(F.col("n") > F.col("pages") * F.lit(ratio))
            .groupBy("host").agg(F.collect_list("key").alias("listed")))


def without_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO,
                        min_pages: int = MIN_PAGES) -> DataFrame:
    """row (all columns of ``docs``), n_lines (lines with a word), n_removed, kept_text."""
    listed = written(boilerplate(docs, host, ratio, min_pages).select(
        F.col("host").alias("l_host"), "listed"))
    if (listed.agg(F.sum(F.size("listed"))).first()[0] or 0) <= BROADCAST_KEYS:
        listed = F.broadcast(listed)
    rows = docs.select(rows_as(docs, "row"), docs[host].alias("host"), docs["text"].alias("text"))
    bad = F.col("listed")
    cut = let(F.split("text", "\n"), lambda all_lines: let(
        F.filter(all_lines, lambda x: ~(x.rlike(WORD) & F.array_contains(bad, line_key(x)))),
        lambda kept: F.struct(
            F.size(with_words(all_lines)).cast("long").alias("n_lines"),
            (F.size(all_lines) - F.size(kept)).cast("long").alias("n_removed"),
            F.array_join(kept, "\n").alias("kept_text"))))
    plain = F.struct(
        F.coalesce(F.size(with_words(F.split("text", "\n"))), F.lit(0))
        .cast("long").alias("n_lines"),
        F.lit(0).cast("long").alias("n_removed"), F.col("text").alias("kept_text"))
    joined = rows.join(listed, F.col("host").eqNullSafe(F.col("l_host")), "left")
    made = F.when(bad.isNotNull() & F.col("text").isNotNull(), cut).otherwise(plain)
    return joined.select("row", made.alias("x")).select("row", "x.*")


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with boilerplate lines cut out of text; n_chars follows where it exists."""
    done = without_boilerplate(docs, **options)
    own = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return done.select(*[
        own[c].alias(c) if c in own else F.col("row")[c].alias(c) for c in docs.columns])
