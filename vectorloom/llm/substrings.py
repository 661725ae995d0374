"""Repeated passages found with prefix-partitioned suffix trees.

A window is ``WINDOW`` consecutive words; a word is removed if a window that covers it has the
same words as a window that starts anywhere else. Windows are suffixes cut at depth WINDOW.

Partitioning by prefix: of the PREFIX-word sequences in a window the one with the least hash
(the first of equals) is its prefix, so equal windows share prefix and offset. Neighbouring
windows mostly share theirs too: such a run is a fragment, and a text is a few fragments per
hundred words. Prefixes that occur once hold no repeat and end there. If all fragments of a
prefix are equal, all their windows repeat; these are only counted. Only where fragments of a
prefix differ, at the edges of repeats, a suffix tree is built from their words.

Trees grow breadth-first from (prefix, offset), an edge being a block of words; a branch with
one leaf ends. What reaches depth WINDOW is a deep internal node: its leaves repeat, and runs
of such windows are the maximal repeats. Equal fragments are one leaf with a weight. The group
of a prefix with over ``HOT`` different fragments would not fit into a task: its suffixes get
longer prefixes, ``EDGE`` words at a time, until every group is small enough for a tree, ends
because it has one leaf, or has all WINDOW words in common. Nothing is capped.

Words are compared by 64-bit hashes, so a window by 35 of them.

Defined results: null text has no words; texts shorter than a window keep all; rows alike in
doc_id and text are each other's repeats; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import text_of
from vectorloom.tables import prepare, written

WINDOW = 35
PREFIX = 10
#: Words of an edge of the tree.
EDGE = 9
HOT = 20_000
#: Suffixes whose trees are grown together in a task.
FOREST = 200_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def word_codes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), "<u8", len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def sequence_hash(codes: np.ndarray, starts: np.ndarray | slice, n: int) -> np.ndarray:
    """Hash of the n codes from each start; a slice covers all positions."""
    if isinstance(starts, slice):
        size = len(codes) - n + 1
        total = np.zeros(size, np.uint64)
        for j in range(n):
            total = total * _M1 + _mixed(codes[j:j + size])
    else:
        total = np.zeros(len(starts), np.uint64)
        for j in range(n):
            total = total * _M1 + _mixed(codes[starts + j])
    return _mixed(total)


def fragments(codes: np.ndarray, window: int = WINDOW, prefix: int = PREFIX):
    """Per run of windows with one prefix: hash of the prefix, first window, windows, place of
    the prefix after the first window."""
    n = len(codes) - window + 1
    if n < 1:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, empty
    hashes = sequence_hash(codes, slice(None), prefix)
    width = window - prefix + 1
    at = np.arange(n) + np.lib.stride_tricks.sliding_window_view(hashes, width).argmin(axis=1)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    count = np.diff(np.append(first, n))
    return hashes[at[first]], first, count, at[first] - first


def _digest(codes: np.ndarray, first: int, count: int, window: int) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(codes[first:first + count + window - 1].tobytes())


KEY = ["doc_id", "dhash"]


def _keyed(docs: DataFrame) -> DataFrame:
    text = text_of(docs)
    return docs.select(docs["doc_id"], F.xxhash64(text).alias("dhash"), text.alias("text"))


def _packed(keyed: DataFrame) -> DataFrame:
    """``keyed`` with text as compressed bytes: texts are shuffled twice, at half the size."""
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdCompressor

        pack = ZstdCompressor(level=1).compress
        for batch in batches:
            texts = [pack(x.as_py().encode()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("dhash"), pa.array(texts, pa.binary())],
                names=["doc_id", "dhash", "packed"])

    return keyed.mapInArrow(run, f"doc_id {kind}, dhash BIGINT, packed BINARY")


def _unpacked(column: pa.Array) -> Iterator[list[bytes]]:
    """The words of each compressed text."""
    from zstandard import ZstdDecompressor

    unpack = ZstdDecompressor().decompress
    for x in column:
        yield unpack(x.as_py()).split()


def _fragment_rows(keyed: DataFrame, window: int, prefix: int) -> DataFrame:
    """doc_id, dhash, mini, fh, lo, n: every fragment of every document."""
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base in range(0, batch.num_rows, 500):
                part = batch.slice(base, 500)
                minis, prints, los, ns, rows = [], [], [], [], []
                for i, text in enumerate(part.column("text")):
                    codes = word_codes(text.as_py().encode().split())
                    mini, first, count, _ = fragments(codes, window, prefix)
                    minis.append(mini)
                    prints += [_digest(codes, f, c, window)
                               for f, c in zip(first.tolist(), count.tolist(), strict=True)]
                    los.append(first)
                    ns.append(count)
                    rows.append(np.full(len(first), i))
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(take), part.column("dhash").take(take),
                    pa.array(np.concatenate(minis).view("<i8")),
                    pa.array(np.array(prints, "<u8").view("<i8")),
                    pa.array(np.concatenate(los).astype(np.int32)),
                    pa.array(np.concatenate(ns).astype(np.int32))],
                    names=["doc_id", "dhash", "mini", "fh", "lo", "n"])

    return keyed.mapInArrow(run, f"doc_id {kind}, dhash BIGINT, mini BIGINT, fh BIGINT, "
                                 "lo INT, n INT")


def _same_key(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on the document key, null-safe; right's key columns go."""
    right = right.withColumnsRenamed({k: f"{k}_of_right" for k in KEY})
    return left.join(right, F.col("doc_id").eqNullSafe(F.col("doc_id_of_right"))
                     & (F.col("dhash") == F.col("dhash_of_right")), how) \
        .drop("doc_id_of_right", "dhash_of_right")


def _contents(opened: DataFrame, window: int, prefix: int) -> DataFrame:
    """doc_id, dhash, mini, fh, lo, at, codes of the fragments listed in ``open``."""
    kind = opened.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base in range(0, batch.num_rows, 200):
                part = batch.slice(base, 200)
                out = {k: [] for k in ("row", "mini", "fh", "lo", "at", "codes")}
                for i, (words, wanted) in enumerate(zip(
                        _unpacked(part.column("packed")), part.column("open"), strict=True)):
                    codes = word_codes(words)
                    mini, first, count, at = fragments(codes, window, prefix)
                    wanted = np.array(wanted.as_py())
                    for j in np.searchsorted(first, np.unique(wanted)).tolist():
                        f, c = int(first[j]), int(count[j])
                        out["row"].append(i)
                        out["mini"].append(mini[j])
                        out["fh"].append(_digest(codes, f, c, window))
                        out["lo"].append(f)
                        out["at"].append(int(at[j]))
                        out["codes"].append(codes[f:f + c + window - 1].tobytes())
                take = pa.array(out["row"], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(take), part.column("dhash").take(take),
                    pa.array(np.array(out["mini"], "<u8").view("<i8")),
                    pa.array(np.array(out["fh"], "<u8").view("<i8")),
                    pa.array(out["lo"], pa.int32()), pa.array(out["at"], pa.int32()),
                    pa.array(out["codes"], pa.binary())],
                    names=["doc_id", "dhash", "mini", "fh", "lo", "at", "codes"])

    return opened.select("doc_id", "dhash", "packed", "open").mapInArrow(
        run, f"doc_id {kind}, dhash BIGINT, mini BIGINT, fh BIGINT, lo INT, at INT, codes BINARY")


def repeated_leaves(roots: np.ndarray, starts: np.ndarray, weights: np.ndarray,
                    codes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Grows the trees below ``roots`` (a node number per suffix) breadth-first over ``codes``
    from ``starts``; true for suffixes under a node of depth ``window`` with two leaves."""
    live = np.arange(len(starts))
    node = roots
    for depth in range(0, window, EDGE):
        edge = sequence_hash(codes, starts[live] + depth, min(EDGE, window - depth))
        order = np.lexsort((edge, node))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (np.diff(node[order]) != 0) | (edge[order][1:] != edge[order][:-1])
        child = np.empty(len(order), np.int64)
        child[order] = np.cumsum(fresh) - 1
        leaves = np.bincount(child, weights=weights[live])
        stay = leaves[child] > 1
        live, node = live[stay], child[stay]
        if not len(live):
            break
    repeated = np.zeros(len(starts), bool)
    repeated[live] = True
    return repeated


def _forest(root, at, weights, blobs, suffixes, window: int) -> np.ndarray:
    """Bit j of each fragment: its window j repeats. ``suffixes``: the windows to look at."""
    parts = [np.frombuffer(b, "<u8") for b in blobs]
    codes = np.concatenate(parts)
    lengths = np.array([len(p) for p in parts])
    counts = lengths - window + 1
    owner = np.repeat(np.arange(len(parts)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(np.cumsum(lengths) - lengths, counts) + inside
    wanted = np.flatnonzero(np.asarray(suffixes, np.int64)[owner] >> inside & 1)
    owner, inside, starts = owner[wanted], inside[wanted], starts[wanted]
    group = np.unique(root, return_inverse=True)[1]
    roots = group[owner] * window + (np.asarray(at)[owner] - inside)
    hit = repeated_leaves(roots, starts, np.asarray(weights, float)[owner], codes, window)
    masks = np.zeros(len(parts), np.int64)
    np.bitwise_or.at(masks, owner[hit], np.int64(1) << inside[hit])
    return masks


def _trees(leaves: DataFrame, window: int) -> DataFrame:
    """mini, fh, mask: trees of whole prefixes (``root``), kept together in a task."""
    names = ("root", "mini", "fh", "at", "weight", "codes", "suffixes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def grown(rows):
            root, mini, fh, at, weight, blobs, suffixes = zip(*rows, strict=True)
            masks = _forest(np.array(root), at, weight, blobs, suffixes, window)
            return pa.RecordBatch.from_arrays(
                [pa.array(mini, pa.int64()), pa.array(fh, pa.int64()), pa.array(masks)],
                names=["mini", "fh", "mask"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if size > FOREST and row[0] != held[-1][0]:
                    yield grown(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5]) // 8 - window + 1
        if held:
            yield grown(held)

    return (leaves.repartition("root").sortWithinPartitions("root").select(*names)
            .mapInArrow(run, "mini BIGINT, fh BIGINT, mask BIGINT"))


def _by_prefix(leaves: DataFrame, window: int, words: int) -> DataFrame:
    """``leaves`` once for each prefix of ``words`` words that its suffixes have (``root``)."""
    rest = ("mini", "fh", "at", "weight", "codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken, roots, suffixes = [], [], []
            for i in range(batch.num_rows):
                codes = np.frombuffer(batch.column("codes")[i].as_py(), "<u8")
                inside = np.arange(len(codes) - window + 1)
                inside = inside[batch.column("suffixes")[i].as_py() >> inside & 1 == 1]
                offset = (batch.column("at")[i].as_py() - inside).astype(np.uint64)
                mini = np.int64(batch.column("mini")[i].as_py()).astype(np.uint64)
                key = _mixed(sequence_hash(codes, inside, words) + _mixed(offset + mini))
                for root in np.unique(key):
                    taken.append(i)
                    roots.append(root.astype(np.int64))
                    suffixes.append(int((np.int64(1) << inside[key == root]).sum()))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(pa.array(taken, pa.int64())) for c in rest],
                 pa.array(roots, pa.int64()), pa.array(suffixes, pa.int64())],
                names=[*rest, "root", "suffixes"])

    return leaves.select(*rest, "suffixes").mapInArrow(
        run, "mini BIGINT, fh BIGINT, at INT, weight BIGINT, codes BINARY, root BIGINT, "
             "suffixes BIGINT")


def _lengthened(leaves: DataFrame, window: int, hot: int) -> DataFrame:
    """mini, fh, mask of prefixes with too many fragments: longer prefixes, step by step."""
    found = None
    for words in [*range(EDGE, window, EDGE), window]:
        leaves = written(_by_prefix(leaves, window, words))
        each = F.bit_count("suffixes")
        sizes = leaves.groupBy(F.col("root").alias("r_root")).agg(
            F.count(F.lit(1)).alias("k"), F.sum(F.col("weight") * each).alias("total"))
        sized = written(leaves.join(sizes.where("total > 1"), F.col("root") == F.col("r_root")))
        whole = words == window
        # All of a group's suffixes are equal once their prefix is the whole window.
        done = (sized.select("mini", "fh", F.col("suffixes").alias("mask")) if whole
                else _trees(sized.where(F.col("k") <= hot), window))
        found = done if found is None else found.union(done)
        leaves = sized.where(F.col("k") > hot)
        if whole or leaves.isEmpty():
            return found.groupBy("mini", "fh").agg(F.bit_or("mask").alias("mask"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX,
                   hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (words joined by spaces), spans (first word and
    number of words of each maximal run that was removed) of every row."""
    if window - prefix + 1 > 63:
        raise ValueError("a fragment's windows must fit into 63 bits: window - prefix <= 62")
    prepare(docs.sparkSession)
    keyed = _keyed(docs)
    kind = keyed.schema["doc_id"].dataType.simpleString()
    rows = _fragment_rows(keyed, window, prefix)
    shared = (rows.groupBy("mini").agg(
        F.count(F.lit(1)).alias("times"), F.min("fh").alias("low"), F.max("fh").alias("high"))
        .where(F.col("times") > 1)
        .select(F.col("mini").alias("s_mini"), (F.col("low") == F.col("high")).alias("same")))
    hits = rows.join(shared, F.col("mini") == F.col("s_mini"))
    listed = written(hits.groupBy(*KEY).agg(
        F.collect_set(F.when(F.col("same"), F.struct("lo", "n"))).alias("whole"),
        F.collect_set(F.when(~F.col("same"), F.col("lo"))).alias("open")))
    packed = _packed(keyed)
    opened = _same_key(packed, listed.where(F.size("open") > 0).select(*KEY, "open"), "inner")
    contents = written(_contents(opened, window, prefix))
    leaves = contents.groupBy("mini", "fh").agg(
        F.count(F.lit(1)).alias("weight"), F.first("at").alias("at"),
        F.first("codes").alias("codes"))
    sizes = leaves.groupBy("mini").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > hot)
    sizes = written(sizes.select(F.col("mini").alias("h_mini")))
    is_hot = F.col("mini") == F.col("h_mini")
    leaves = leaves.withColumns({"root": F.col("mini"), "suffixes": F.lit(-1).cast("bigint")})
    masks = _trees(leaves.join(sizes, is_hot, "left_anti"), window)
    large = leaves.join(sizes, is_hot, "left_semi")
    if not sizes.isEmpty():
        masks = masks.union(_lengthened(large, window, hot))
    masks = masks.where(F.col("mask") != 0).withColumnsRenamed({"mini": "m_mini", "fh": "m_fh"})
    marks = (contents.drop("codes").join(masks, (F.col("mini") == F.col("m_mini"))
                                         & (F.col("fh") == F.col("m_fh")))
             .groupBy(*KEY).agg(F.collect_set(F.struct("lo", "mask")).alias("marks")))
    done = _same_key(_same_key(packed, listed.select(*KEY, "whole"), "left"), marks, "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base in range(0, batch.num_rows, 500):
                part = batch.slice(base, 500)
                out = {k: [] for k in ("n_words", "n_removed", "kept_text", "spans")}
                for words, whole, marked in zip(
                        _unpacked(part.column("packed")), part.column("whole"),
                        part.column("marks"), strict=True):
                    edge = np.zeros(len(words) + 1, np.int64)
                    for x in whole.as_py() or ():
                        edge[x["lo"]] += 1
                        edge[x["lo"] + x["n"] + window - 1] -= 1
                    for x in marked.as_py() or ():
                        for j in range(int(x["mask"]).bit_length()):
                            if x["mask"] >> j & 1:
                                edge[x["lo"] + j] += 1
                                edge[x["lo"] + j + window] -= 1
                    gone = np.cumsum(edge)[:-1] > 0
                    turns = np.flatnonzero(np.diff(gone, prepend=False, append=False))
                    out["n_words"].append(len(words))
                    out["n_removed"].append(int(gone.sum()))
                    kept = (words if not len(turns) else
                            [w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                    out["kept_text"].append(b" ".join(kept).decode())
                    out["spans"].append([{"first": int(a), "words": int(b - a)} for a, b in
                                         zip(turns[::2], turns[1::2], strict=True)])
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(out["n_words"], pa.int64()),
                    pa.array(out["n_removed"], pa.int64()),
                    pa.array(out["kept_text"], pa.string()),
                    pa.array(out["spans"], pa.list_(pa.struct(
                        [("first", pa.int64()), ("words", pa.int64())])))],
                    names=["doc_id", "n_words", "n_removed", "kept_text", "spans"])

    return done.select("doc_id", "packed", "whole", "marks").mapInArrow(
        cut, f"doc_id {kind}, n_words BIGINT, n_removed BIGINT, kept_text STRING, "
             "spans ARRAY<STRUCT<first: BIGINT, words: BIGINT>>")
