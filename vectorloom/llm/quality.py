"""Quality rules with thresholds that adapt to each language and source.

A quantile sketch is a histogram over logarithmic buckets (64 per doubling, so a quantile is
off by less than 2 %). Sketches are plain counts: they merge by addition, in any order, and
are built with map-side combining, so a hot source costs no more than its buckets. Fences are
the quartiles of a (language, source) pair moved outwards by three interquartile ranges and a
slack. Quartiles of few documents are drawn towards those of the merged sketch of the language
(and these towards those of all), which count as ``weight`` documents: there is no size at
which a pair's thresholds jump. A document outside a fence is rejected.

Defined results: null text counts as empty (no words, rejected by the base rules); null
language or source is a group of its own; repeated rows are judged alike; an empty table
gives an empty result. Everything stays in DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.llm.common import WORD, let, rows_as, small_side, text_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """An integer measure, what is added to its fences, and whether low values fail too."""

    name: str
    slack: int
    both_sides: bool = False


#: Per mille of word characters, words or lines; word length in hundredths.
RULES = (
    Rule("symbol_share", 20),
    Rule("capital_share", 150),
    Rule("repeat_share", 300),
    Rule("dup_line_share", 400),
    Rule("word_length", 150, both_sides=True),
)
#: Documents that a wider sketch counts as.
WEIGHT = 100
SPREAD = 3


def _covered(positions: Column) -> Column:
    """Words covered by windows that start at these ascending positions."""
    steps = F.transform(positions, lambda p, i: F.least(
        F.lit(WINDOW), F.coalesce(F.get(positions, i + 1) - p, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0), lambda total, x: total + x)


def _repeated_words(words: Column) -> Column:
    """Words inside a 3-word window that the text holds twice or more."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.struct(
            F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]).alias("h"), i.alias("p")))
    repeated = let(F.sort_array(windows), lambda s: F.filter(s, lambda x, i: (
        F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))))
    covered = let(F.sort_array(F.transform(repeated, lambda x: x["p"])), _covered)
    return F.when(F.size(words) > WINDOW, covered).otherwise(F.lit(0))


def measures(text: Column) -> Column:
    """All counts of one text as a struct of longs."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    of_words = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeated_words(w).cast("long").alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return let(F.struct(of_words.alias("w"), of_lines.alias("x")), lambda m: F.struct(
        m["w"]["n_words"].alias("n_words"), m["w"]["word_chars"].alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        m["x"]["n_dup_lines"].alias("n_dup_lines"),
        m["w"]["n_repeat_words"].alias("n_repeat_words"),
        m["x"]["n_lines"].alias("n_lines"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_capitals")))


def base_failed(m: Column) -> Column:
    """The fixed part of the verdict."""
    return (m["n_words"] < MIN_WORDS) | (
        m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT)


def _share(part: Column, whole: Column, scale: int = 1000) -> Column:
    return F.floor(part * scale / F.greatest(whole, F.lit(1))).cast("long")


def values(m: Column) -> dict[str, Column]:
    """The integer measure of every rule."""
    return {
        "symbol_share": _share(m["n_symbols"], m["word_chars"]),
        "capital_share": _share(m["n_capitals"], m["word_chars"]),
        "repeat_share": _share(m["n_repeat_words"], m["n_words"]),
        "dup_line_share": _share(m["n_dup_lines"], m["n_lines"]),
        "word_length": _share(m["word_chars"], m["n_words"], 100),
    }


def bucket(value: Column) -> Column:
    """Lowest value of the sketch bucket that holds ``value``: seven leading bits stay."""
    drop = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, rule, bucket, n: one mergeable sketch per language, source and rule.
    ``measured`` has lang, source and the struct m. Rows the base rules reject are no model
    of good text and are left out."""
    def listed(m: Column) -> Column:
        each = F.array(*[F.struct(F.lit(r.name).alias("rule"),
                                  bucket(values(m)[r.name]).alias("bucket")) for r in RULES])
        return F.when(base_failed(m), F.slice(each, 1, 0)).otherwise(each)

    # One expression rather than a filter, which would be pushed down to measure texts again.
    return (measured.select("lang", "source", F.explode(let(F.col("m"), listed)).alias("x"))
            .groupBy("lang", "source", "x.rule", "x.bucket").agg(F.count(F.lit(1)).alias("n")))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    """Sketches added up to coarser keys."""
    return sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """keys, rule, total, q1, q3."""
    by = Window.partitionBy(*keys, "rule")
    ranked = sketch.select(
        *keys, "rule", "bucket", F.sum("n").over(by).alias("total"),
        F.sum("n").over(by.orderBy("bucket")).alias("upto"))
    low = F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bucket")))
    high = F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bucket")))
    return ranked.groupBy(*keys, "rule").agg(
        F.max("total").alias("total"), low.alias("q1"), high.alias("q3"))


def _drawn(own: str, prior: str, weight: int) -> list[Column]:
    """total, q1 and q3 of ``own`` drawn towards those of ``prior``, which count as ``weight``
    documents; whole numbers, rounded down."""
    return [F.col(f"{own}_total").alias("total"), *[
        F.expr(f"({own}_total * {own}_{q} + {weight} * {prior}_{q}) div ({own}_total + {weight})")
        .alias(q) for q in ("q1", "q3")]]


def thresholds(sketch: DataFrame, weight: int = WEIGHT) -> DataFrame:
    """lang, source, t: the fences of each pair. A language's quartiles are drawn towards those
    of all documents, a pair's towards its language's, so that fences move evenly from the
    language's to the pair's own as its documents grow in number."""
    def named(df: DataFrame, name: str, *keys: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{name}_{c}")
                           for c in (*keys, "rule", "total", "q1", "q3")])

    everything = named(quartiles(merged(sketch)), "a")
    of_lang = named(quartiles(merged(sketch, "lang"), "lang"), "l", "lang")
    lang = of_lang.join(everything, F.col("l_rule") == F.col("a_rule")).select(
        F.col("l_lang").alias("lang"), F.col("l_rule").alias("rule"), *_drawn("l", "a", weight))
    pair = named(quartiles(sketch, "lang", "source"), "o", "lang", "source").join(
        named(lang, "p", "lang"), F.col("o_lang").eqNullSafe(F.col("p_lang"))
        & (F.col("o_rule") == F.col("p_rule"))).select(
        F.col("o_lang").alias("lang"), F.col("o_source").alias("source"),
        F.col("o_rule").alias("rule"), *_drawn("o", "p", weight))
    made = []
    for r in RULES:
        own = F.col("rule") == r.name
        width = (F.col("q3") - F.col("q1")) * SPREAD + r.slack
        made.append(F.max(F.when(own, F.col("q1") - width)).alias(f"low_{r.name}"))
        made.append(F.max(F.when(own, F.col("q3") + width)).alias(f"high_{r.name}"))
    fences = pair.groupBy("lang", "source").agg(*made)
    names = [c for c in fences.columns if c not in ("lang", "source")]
    return fences.select("lang", "source", F.struct(*names).alias("t"))


def within(m: Column, t: Column) -> Column:
    """Every measure lies inside its fences; true where a pair has no fences."""
    ok = F.lit(True)
    for r in RULES:
        value = values(m)[r.name]
        good = value <= t[f"high_{r.name}"]
        if r.both_sides:
            good = good & (value >= t[f"low_{r.name}"])
        ok = ok & F.coalesce(good, F.lit(True))
    return ok


def judged(measured: DataFrame, weight: int = WEIGHT) -> DataFrame:
    """``measured`` (lang, source, m, ...) with base_failed and kept."""
    t = small_side(thresholds(sketches(measured), weight).select(
        F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), "t"))
    failed = let(F.col("m"), base_failed)
    kept = let(F.struct("m", "t"), lambda x: ~base_failed(x["m"]) & within(x["m"], x["t"]))
    return (measured.join(t, F.col("lang").eqNullSafe(F.col("t_lang"))
                          & F.col("source").eqNullSafe(F.col("t_source")), "left")
            .select(*measured.columns, failed.alias("base_failed"), kept.alias("kept")))


def measured(docs: DataFrame, *carry: Column) -> DataFrame:
    """lang, source, the struct m, and the columns to carry along."""
    return docs.select(docs["lang"], docs["source"], measures(text_of(docs)).alias("m"), *carry)


def quality_filter(docs: DataFrame, weight: int = WEIGHT) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns they had. The texts are measured
    twice, once for the sketches and once for the verdict, rather than kept on disk."""
    kept = judged(measured(docs, rows_as(docs, "row")), weight).where("kept")
    return kept.select("row.*")
