"""Spelling variants: words one edit apart, found by a frontier of states walking a trie.

Words are counted with a table per task that is emptied into the shuffle when it is full. The
trie of all words is a table of edges (way, depth, node, ch): a node is spelled by its prefix.
The frontier is a table of states (word, position, node, edits). A state without edits follows
the word itself; at each position it branches over the edges of its node into states with one
edit (another character, an additional one, one left out). A state with one edit has to follow
the rest of the word. All states of one depth are joined with the edges of that depth, level by
level; a state that ends with its word at the node of a word has found a neighbour.

Two things keep the frontier small, and neither loses a neighbour. An edit lies in one half of
the word, so the words are also entered backwards (``way`` 1), and each way branches only in the
second half, where nodes have few edges. And an edge carries a mask with a bit for the rest of
every word below it, which a state that wants to pass must find set.

Words of more than ``MAX_LEVELS`` code points would need as many levels. They meet at hashes of
the word with one character left out instead (their count is the word's length, their text is
not copied), and are compared exactly.

A word's form is its neighbour of largest count (ties: least in code-point order) if that is at
least ``ratio`` times its own. Counts grow along forms, so chains are short and end; the last
form is found by doubling steps.

Skew: counts are added up before the shuffle; a node has at most as many edges as there are
letters, and a word at most as many neighbours as it has edits, so no group grows with the
data. States and edges meet in a shuffle by node at every size; the edges, the smaller side by
far, are what a task keeps in memory, and a node that many words pass is split by adaptive
execution. Levels are written to the shared folder, so a lost executor costs one level.

Defined results: null and empty texts have no words; a null doc_id is written ``null`` in the
hash that drops letters; repeated rows count each; very long texts are read in steps, very long
words as said above; an empty table gives an empty result. Only doc_id and text are read, so
other columns cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import text_of
from vectorloom.tables import checkpoint_dir, prepare, written

#: Fixed values of the contract.
RUN = r"[A-Za-zÀ-ÿ]+"
DROP_EVERY = 31
MIN_LENGTH = 7
MIN_COUNT = 2
FORM_RATIO = 10
#: Longest words that walk the trie.
MAX_LEVELS = 48
#: Bits of an edge's mask.
MASK_BITS = 256
#: Words counted in a task before they are passed on, and characters read in a step.
TABLE_WORDS = 200_000
STEP_CHARS = 1 << 20

_RUN = re.compile(RUN)
_BREAK = re.compile(r"[^A-Za-zÀ-ÿ]")


def _steps(text: str) -> Iterator[str]:
    """The text in pieces that end between runs."""
    at = 0
    while at < len(text):
        end = _BREAK.search(text, at + STEP_CHARS) if len(text) - at > STEP_CHARS else None
        stop = end.start() if end else len(text)
        yield text[at:stop]
        at = stop


def _count_text(doc_id, text: str, counts: Counter, min_length: int) -> None:
    own = "null" if doc_id is None else str(doc_id)
    for piece in _steps(text):
        runs = Counter(_RUN.findall(piece.encode().lower().decode()))
        for run, n in runs.items():
            if len(run) < min_length:
                continue
            h = crc32(f"{own}:{run}".encode())
            if h % DROP_EVERY == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
                if len(run) < min_length:
                    continue
            counts[run] += n


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: words with letters dropped by the rule above, of enough length and count."""
    prepare(docs.sparkSession)
    rows = docs.select(docs["doc_id"].alias("doc_id"), text_of(docs).alias("text"))

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"),
                                    strict=True):
                _count_text(doc_id, text.as_py(), counts, min_length)
                if len(counts) > TABLE_WORDS:
                    yield batch_of(counts)
                    counts.clear()
        yield batch_of(counts)

    return (rows.mapInArrow(run, "word STRING, n BIGINT").groupBy("word")
            .agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))


# ---- the trie and its frontier -----------------------------------------------------------


def _place(word: Column, left: Column) -> Column:
    """The mask bit of the last ``left`` characters of ``word``."""
    rest = F.call_function("right", word, F.greatest(left, F.lit(0)))
    return F.pmod(F.xxhash64(left, rest), F.lit(MASK_BITS)).cast("int")


def _masked(place: Column) -> Column:
    """Whether an edge's mask has the bit at ``place``."""
    word = F.lit(0).cast("long")
    for k in range(MASK_BITS // 64):
        word = F.when(F.call_function("shiftright", place, F.lit(6)) == k,
                      F.col(f"mask{k}")).otherwise(word)
    return F.call_function("shiftright", word, place.bitwiseAND(F.lit(63))).bitwiseAND(
        F.lit(1).cast("long")) == 1


def both_ways(words: DataFrame) -> DataFrame:
    """way, w, len, start: words forwards and backwards, and where branching begins."""
    size = F.length("word")
    ahead = words.select(F.lit(0).alias("way"), F.col("word").alias("w"), size.alias("len"),
                         F.floor(size / 2).cast("int").alias("start"))
    back = words.select(F.lit(1).alias("way"), F.reverse("word").alias("w"), size.alias("len"),
                        F.ceil(size / 2).cast("int").alias("start"))
    return ahead.union(back)


def trie_edges(walks: DataFrame, first: int) -> DataFrame:
    """way, depth, node, ch, mask: the edges from depth ``first`` on."""
    each = walks.where(F.col("len") > first).select(
        "way", "w", "len", F.explode(F.sequence(F.lit(first), F.col("len") - 1)).alias("depth"))
    edges = each.select(
        "way", "depth", F.left("w", F.col("depth")).alias("node"),
        F.substring("w", F.col("depth") + 1, F.lit(1)).alias("ch"),
        _place(F.col("w"), F.col("len") - F.col("depth") - 1).alias("place"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place") % 64)
    own = F.call_function("shiftright", F.col("place"), F.lit(6))
    return edges.groupBy("way", "depth", "node", "ch").agg(*[
        F.bit_or(F.when(own == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"mask{k}")
        for k in range(MASK_BITS // 64)])


STATE = ("way", "w", "len", "pos", "node")


def _level(walks: DataFrame, frontier: DataFrame | None, edges: DataFrame,
           depth: int) -> DataFrame:
    """STATE and done: the states of the next depth. ``frontier``: states with one edit at nodes
    of ``depth``."""
    w, size, pos = F.col("w"), F.col("len"), F.col("pos")
    here = F.substring("w", depth + 1, 1)
    plain = walks.where((F.col("start") <= depth) & (size >= depth)).select(
        "way", "w", "len", F.lit(depth).alias("pos"), F.left("w", F.lit(depth)).alias("node"))
    # One character left out: of equal neighbours only the last.
    walking = plain.where((size > depth + 1) & (here != F.substring("w", depth + 2, 1))).select(
        "way", "w", "len", (pos + 1).alias("pos"), "node")
    if frontier is not None:
        walking = walking.union(frontier)
    # Bits to pass with the word's next character, or with one that is added before it.
    states = plain.withColumn("edits", F.lit(0)).union(walking.withColumn("edits", F.lit(1))).select(
        *STATE, "edits", F.substring("w", pos + 1, F.lit(1)).alias("next"),
        _place(w, size - pos - 1).alias("pass"), _place(w, size - pos).alias("add"))
    edge = edges.drop("depth").withColumnsRenamed({"way": "e_way", "node": "e_node"})
    met = states.join(edge, (F.col("way") == F.col("e_way")) & (F.col("node") == F.col("e_node"))
                      & ((F.col("edits") == 0) == (F.col("next") != F.col("ch"))))
    passed = F.when((pos < size) & _masked(F.col("pass")), pos + 1)
    added = F.when((F.col("edits") == 0) & _masked(F.col("add")), pos)
    return met.select(
        "way", "w", "len", F.explode(F.array_compact(F.array(passed, added))).alias("pos"),
        F.concat("node", "ch").alias("node")).withColumn("done", F.col("pos") == size)


def _trie_pairs(words: DataFrame, longest: int) -> DataFrame:
    """word, near: candidates whose spelling is one edit away; ``near`` need not be a word."""
    spark = words.sparkSession
    folder = f"{checkpoint_dir(spark)}/trie-{uuid4().hex}"
    walks = written(both_ways(words))
    first = walks.agg(F.min("start")).first()[0]
    trie_edges(walks, first).sortWithinPartitions("depth").write.parquet(f"{folder}/edges")
    edges = spark.read.parquet(f"{folder}/edges")
    # The last character left out ends a word at once.
    found = walks.where(F.col("len") > F.col("start")).select(
        "way", "w", F.expr("left(w, len - 1)").alias("node"))
    frontier = None
    for depth in range(first, longest + 1):
        own = edges.where(F.col("depth") == depth).hint("shuffle_hash")
        path = f"{folder}/level-{depth}"
        _level(walks, frontier, own, depth).write.parquet(path)
        states = spark.read.parquet(path)
        found = found.union(states.where("done").select("way", "w", "node"))
        frontier = states.where("NOT done").select(*STATE)

    def forwards(c: str) -> Column:
        return F.when(F.col("way") == 1, F.reverse(c)).otherwise(F.col(c))

    return found.select(forwards("w").alias("word"), forwards("node").alias("near"))


# ---- long words --------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def _left_out(word: str) -> np.ndarray:
    """Hashes of the word itself and of the word without each of its characters."""
    code = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64)
    with np.errstate(over="ignore"):
        value = (code + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
        value ^= value >> np.uint64(29)
        powers = np.cumprod(np.full(len(code), _BASE, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * powers)])
        rest = (sums[-1] - sums[1:]) * np.uint64(_INVERSE)
        return np.unique(np.append(sums[:-1] + rest, sums[-1]))


def _long_pairs(words: DataFrame) -> DataFrame:
    """word, near among long words, compared exactly."""
    named = written(words.select("word", F.sha2("word", 256).alias("id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, own in zip(batch.column("word"), batch.column("id"), strict=True):
                keys = _left_out(word.as_py())
                for lo in range(0, len(keys), STEP_CHARS):
                    some = keys[lo:lo + STEP_CHARS].view("<i8")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some), pa.array([own.as_py()] * len(some), pa.string())],
                        names=["key", "id"])

    keys = written(named.mapInArrow(run, "key BIGINT, id STRING"))
    other = keys.select(F.col("key").alias("o_key"), F.col("id").alias("o_id"))
    met = keys.join(other, (F.col("key") == F.col("o_key")) & (F.col("id") != F.col("o_id")))
    pairs = met.select("id", "o_id").distinct()
    a = named.select(F.col("id").alias("a_id"), "word")
    b = named.select(F.col("id").alias("b_id"), F.col("word").alias("near"))
    texts = (pairs.join(a, F.col("id") == F.col("a_id"))
             .join(b, F.col("o_id") == F.col("b_id")))
    return texts.where(F.levenshtein("word", "near", 1) == 1).select("word", "near")


# ---- neighbours, forms and roots -----------------------------------------------------------


def neighbours(words: DataFrame, max_levels: int = MAX_LEVELS) -> DataFrame:
    """word, near, near_n: all pairs of ``words`` (word, n; each once) one edit apart, both
    ways round."""
    prepare(words.sparkSession)
    size = F.length("word")
    shape = words.agg(F.max(F.when(size <= max_levels, size)).alias("short"),
                      F.max(size).alias("longest")).first()
    pairs = words.select("word", F.col("word").alias("near")).where(F.lit(False))
    if shape.short:
        pairs = _trie_pairs(words.where(size <= max_levels), shape.short)
    if shape.longest is not None and shape.longest > max_levels:
        pairs = pairs.union(_long_pairs(words.where(size >= max_levels)))
    known = words.select(F.col("word").alias("k_word"), F.col("n").alias("near_n"))
    met = pairs.join(known, F.col("near") == F.col("k_word")).repartition("word")
    return met.groupBy("word", "near").agg(F.max("near_n").alias("near_n"))


def _last_forms(forms: DataFrame) -> DataFrame:
    """word, root for words with a form: steps double until every chain has ended."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("n_word"), F.col("root").alias("n_root"))
        step = written(now.join(on, F.col("root") == F.col("n_word"), "left").select(
            "word", F.coalesce("n_root", "root").alias("root"),
            F.col("n_root").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, ratio: int = FORM_RATIO, min_length: int = MIN_LENGTH,
             min_count: int = MIN_COUNT, max_levels: int = MAX_LEVELS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = written(word_counts(docs, min_length, min_count))
    best = neighbours(words, max_levels).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("least"), "near")).alias("top"))
    joined = words.join(best.withColumnRenamed("word", "b_word"),
                        F.col("word") == F.col("b_word"), "left")
    strong = -F.col("top.least") >= F.col("n") * ratio
    formed = written(joined.select(
        "word", F.when(strong, F.col("top.near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, -F.col("top.least")).cast("long").alias("form_n")))
    last = _last_forms(formed.where(F.col("form").isNotNull()))
    return formed.join(last.withColumnRenamed("word", "l_word"),
                       F.col("word") == F.col("l_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
