"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources by code point (null last) get the weights in turn and share ``share`` of all
words; no target exceeds ``most`` times its source, the excess is shared again by weight. That
fixpoint is found in one step: in order of limit / weight, the level of a source is what is
left for it and its successors divided by their weight, and the highest level is the answer.

Positions: each source has a weight schedule over training time 0..1, linear between knots.
Its integral, scaled to the source's target, is the number of words demanded until a time. A
copy of a document starts where its source has delivered so many words; inverting the integral
gives the time. Copies sorted by time are the training order, and at any time the words seen of
a source follow its schedule.

Within a source documents come in the order of a hash of doc_id. Running sums use two levels,
sums of hash ranges and sums within a range, so a hot source is many small groups. A source
gives whole copies; the last one may be cut so that its words meet the target exactly.

Defined results: null text has no words; documents without words are taken 0 times; null
sources are one source; rows alike in doc_id and text are interchangeable; null doc_ids are
ordered by text; an empty table gives an empty result. Everything stays in DataFrame
expressions, and reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.llm.common import WORD, rows_as, small_side, text_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Knots (time, relative weight), used in turn like the weights: fading, growing, steady.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)),
    ((0.0, 1.0), (1.0, 1.0)),
)
#: Documents in a hash range, about.
RANGE_ROWS = 2000
HASH_BITS = 60


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def hash_order(doc_id: Column, text_hash: Column) -> Column:
    """60 bits of md5; SQL can say the same."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), text_hash.cast("string")))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
            most: int = MOST) -> DataFrame:
    """source, rank, docs, source_size, target. ``sizes`` has source and size. The windows run
    over one row per source."""
    per = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ranked = per.withColumn("rank", F.row_number().over(ordered) - 1).withColumn(
        "weight", F.get(F.array(*[F.lit(float(w)) for w in weights]),
                        F.col("rank") % len(weights)))
    limit = F.col("source_size") * F.lit(float(most))
    before = Window.orderBy((limit / F.col("weight")).asc(), F.col("rank")).rowsBetween(
        Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(everything) * F.lit(share)
              - F.coalesce(F.sum(limit).over(before), F.lit(0.0)))
             / (F.sum("weight").over(everything)
                - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    levelled = ranked.withColumn("level", level).withColumn(
        "level", F.max("level").over(everything))
    return levelled.select("source", "rank", "docs", "source_size", F.least(
        limit, F.col("weight") * F.col("level")).alias("target"))


def segments(knots: Sequence[tuple[float, float]]) -> Column:
    """Pieces of a schedule: start, length, weight at start, slope, area before, all areas
    as shares of the whole integral."""
    pairs = list(zip(knots, knots[1:], strict=False))
    if not pairs or knots[0][0] != 0.0 or knots[-1][0] != 1.0 or min(w for _, w in knots) < 0:
        raise ValueError("a schedule runs from time 0 to 1 and has no negative weight")
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in pairs]
    whole = sum(areas)
    if whole <= 0:
        raise ValueError("a schedule needs a weight above 0")
    made, before = [], 0.0
    for (a, b), area in zip(pairs, areas, strict=True):
        if b[0] > a[0] and area > 0:
            made.append(F.struct(
                F.lit(a[0]).alias("t"), F.lit(a[1] / whole).alias("w"),
                F.lit((b[1] - a[1]) / (b[0] - a[0]) / whole).alias("slope"),
                F.lit(before / whole).alias("before")))
        before += area
    return F.array(*made)


def time_of(delivered: Column, schedule: Column) -> Column:
    """The time by which a share ``delivered`` of a source's words is due."""
    piece = F.element_at(F.filter(schedule, lambda s: s["before"] <= delivered), -1)
    rest = delivered - piece["before"]
    root = F.sqrt(F.greatest(piece["w"] * piece["w"] + piece["slope"] * rest * 2, F.lit(0.0)))
    step = F.when(rest <= 0, F.lit(0.0)).otherwise(rest * 2 / (piece["w"] + root))
    return F.least(piece["t"] + step, F.lit(1.0))


def mix(docs: DataFrame, keep: Column | None = None, weights: Sequence[int] = WEIGHTS,
        share: float = SHARE, most: int = MOST, schedules=SCHEDULES) -> DataFrame:
    """One row per document: row, size, source_size, target, taken, and pieces, an array of
    (copy, words, position) with the copies to train on. ``keep`` is what row shall hold;
    by default every column of ``docs``."""
    text = text_of(docs)
    digest = F.xxhash64(text)
    rows = docs.select(
        (rows_as(docs) if keep is None else keep).alias("row"), docs["doc_id"].alias("doc_id"),
        docs["source"].alias("source"), n_words(text).alias("size"), digest.alias("digest"),
        hash_order(docs["doc_id"], digest).alias("key"))
    goal = targets(rows, weights, share, most).withColumns({
        "bits": F.greatest(F.ceil(F.log2(F.col("docs") / RANGE_ROWS)), F.lit(0)).cast("int"),
        "words": F.round("target").cast("long")})
    goal = small_side(goal.select(*[F.col(c).alias(f"g_{c}") for c in goal.columns]))
    ranged = rows.join(goal, F.col("source").eqNullSafe(F.col("g_source"))).withColumn(
        "range", F.call_function("shiftright", F.col("key"), F.lit(HASH_BITS) - F.col("g_bits")))
    sums = ranged.groupBy("g_rank", "range").agg(F.sum("size").alias("range_size"))
    starts = sums.select(
        F.col("g_rank").alias("s_rank"), F.col("range").alias("s_range"),
        (F.sum("range_size").over(Window.partitionBy("g_rank").orderBy("range"))
         - F.col("range_size")).alias("range_start"))
    inside = Window.partitionBy("g_rank", "range").orderBy("key", "doc_id", "digest")
    before = (F.col("range_start") + F.sum("size").over(
        inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = ranged.join(starts, (F.col("g_rank") == F.col("s_rank"))
                         & (F.col("range") == F.col("s_range"))).withColumn("before", before)

    size, whole = F.col("size"), F.col("g_source_size")
    full = F.when(whole > 0, F.floor(F.col("g_words") / whole)).otherwise(F.lit(0)).cast("long")
    rest = F.col("g_words") - full * whole
    cut = F.greatest(F.least(rest - F.col("before"), size), F.lit(0).cast("long"))
    taken = F.when(whole > 0, full * size + cut).otherwise(F.lit(0)).cast("long")
    schedule = F.get(F.array(*[segments(s) for s in schedules]),
                     F.col("g_rank") % len(schedules))
    copies = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: F.struct(
        k.alias("copy"),
        F.when(k < full, size).when(k == full, cut).otherwise(F.lit(0)).cast("long")
        .alias("words"),
        time_of((k * whole + F.col("before")) / F.col("g_words"), schedule).alias("position")))
    pieces = F.filter(copies, lambda x: x["words"] > 0)
    return placed.select(
        "row", "size", F.col("g_source_size").alias("source_size"),
        F.col("g_target").alias("target"), taken.alias("taken"), pieces.alias("pieces"))


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """The training order: one row per copy, with the columns of ``docs``, range-sorted by
    position. A cut copy keeps its first words; n_chars follows where it exists."""
    each = mix(docs, **options).select("row", "size", F.explode("pieces").alias("piece"))
    text = F.col("row")["text"]
    first = F.array_join(F.slice(F.regexp_extract_all(
        text, F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1)),
        F.lit(1), F.col("piece.words").cast("int")), "")
    cut = F.when(F.col("piece.words") < F.col("size"), first).otherwise(text)
    own = {"text": F.col("cut_text"), "n_chars": F.length("cut_text").cast("long")}
    placed = each.select("row", "piece", cut.alias("cut_text"))
    ordered = placed.repartitionByRange(F.col("piece.position"), F.col("row")["doc_id"]) \
        .sortWithinPartitions(F.col("piece.position"), F.col("row")["doc_id"])
    return ordered.select(*[
        own[c].alias(c) if c in own else F.col("row")[c].alias(c) for c in docs.columns])
