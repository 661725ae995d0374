"""Ranked lexical search of many items at once, by a dual-tree search.

A document is a vector of impacts over terms, an item a vector of term weights, and a score
their dot product. Both sides form hierarchies whose nodes hold the greatest value of each
coordinate below them: items in groups of 8 and 64, documents in leaves of 16, nodes of 128 and
batches of about 1024. The product of two nodes' maxima bounds every score below the pair. A
pair whose bound is under the weakest kth score of its items cannot change a result and is left
with all that is below it; equal bounds are followed, since ties go to the lesser doc_id.

Documents are read and cut into terms once per block of items; what is kept is the counts of
the block's terms. They are range-sorted by the rarest term they hold, so that a batch's
documents resemble each other. The maxima of all batches are a table of their own: first each
item's most promising batch is searched, which gives a kth score to prune with, then the
batches that no item can use are dropped whole, and the others are searched by tasks that keep
the ten best of each item and prune with what they have seen.

Sizes: items come in blocks of bounded cells (items x terms), which is what is broadcast; a
batch is bounded in documents and entries; a task returns at most ``top`` rows per item. The
number of documents bounds nothing. All values are integers below 2**53 where floating-point
products are used (a larger block is computed in 64-bit integers), so results are exact.

Defined results: null and empty texts have no terms and count nowhere; repeated rows count
each and may each be listed; a null doc_id is the last among ties; items without terms and
empty tables give no rows; very long texts are cut into terms like any other. Only doc_id and
text, item_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from vectorloom.llm.common import small_side, text_of
from vectorloom.tables import prepare, written

#: Fixed values of the contract.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TOP = 10
SCALE = 1_000_000_000
#: Cells (items x different terms) of a block, and its items at most.
BLOCK_CELLS = 1 << 22
BLOCK_ITEMS = 512
#: Documents and entries of a batch; documents of a leaf; children of an inner node.
BATCH_DOCS = 1024
BATCH_ENTRIES = 1 << 17
LEAF = 16
FAN = 8
EXACT = 1 << 53

#: Bytes of a term, A-Z lowered; all others separate. Bytes of other characters stay.
_BYTES = bytes(b if b >= 128 or chr(b).isdigit() or "a" <= chr(b) <= "z"
               else ord(chr(b).lower()) if "A" <= chr(b) <= "Z" else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_BYTES).split()


class Block:
    """Some items: their ids, and per item the columns and repeats of its terms."""

    def __init__(self):
        self.ids: list = []
        self.rows: list[Counter] = []
        self.column: dict[bytes, int] = {}

    def fits(self, counts: Counter) -> bool:
        width = len(self.column) + sum(t not in self.column for t in counts)
        return not self.ids or (len(self.ids) < BLOCK_ITEMS
                                and (len(self.ids) + 1) * width <= BLOCK_CELLS)

    def add(self, item_id, counts: Counter) -> None:
        self.ids.append(item_id)
        self.rows.append(Counter({
            self.column.setdefault(t, len(self.column)): n for t, n in counts.items()}))

    def rarity(self) -> np.ndarray:
        """Place of each column when those that few items hold come first."""
        held = np.zeros(len(self.column), np.int64)
        for row in self.rows:
            held[list(row)] += 1
        place = np.empty(len(held), np.int64)
        place[np.argsort(held, kind="stable")] = np.arange(len(held))
        return place


def blocks(items: DataFrame) -> Iterator[Block]:
    """Items in blocks; the driver holds one of them and one partition of the table."""
    block = Block()
    rows = items.select(items["item_id"].alias("item_id"), items["text"].alias("text"))
    for row in rows.toLocalIterator():
        counts = Counter(terms_of(row.text))
        if not counts:
            continue
        if not block.fits(counts):
            yield block
            block = Block()
        block.add(row.item_id, counts)
    if block.ids:
        yield block


class ItemTree:
    """The item hierarchy: weights of the items and of groups of 8, 64 and all of them."""

    def __init__(self, block: Block, weight: np.ndarray):
        whole = np.zeros((len(block.rows), len(weight)), np.int64)
        for i, row in enumerate(block.rows):
            at = np.fromiter(row, np.int64, len(row))
            whole[i, at] = weight[at] * np.fromiter(row.values(), np.int64, len(row))
        # Items that share a heavy term become neighbours.
        self.items = np.lexsort((np.arange(len(whole)), whole.argmax(axis=1)))
        whole = whole[self.items]
        exact = float(whole.max(axis=0).astype(np.float64).sum()) * 1e6 < EXACT
        levels = [whole.astype(np.float64) if exact else whole]
        for _ in range(2):
            levels.append(np.maximum.reduceat(
                levels[-1], np.arange(0, len(levels[-1]), FAN), axis=0))
        self.item, self.group, self.super = levels
        self.root = self.super.max(axis=0)

    def weakest(self, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The least kth score below items, groups and supergroups."""
        group = np.minimum.reduceat(kth, np.arange(0, len(kth), FAN))
        return kth, group, np.minimum.reduceat(group, np.arange(0, len(group), FAN))


# ---- documents ---------------------------------------------------------------------------


def _ints(values: np.ndarray) -> bytes:
    return values.astype("<i4").tobytes()


def postings(docs: DataFrame, block: Block) -> DataFrame:
    """place, doc_id, n, cluster, cols, tfs of every document with a term."""
    rows = docs.select(docs["doc_id"].alias("doc_id"), text_of(docs).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((block.column, block.rarity()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column, rarity = shared.value
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            keep, sizes, clusters, cols, tfs = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                found = terms_of(text.as_py())
                if not found:
                    continue
                counts = Counter(filter(column.__contains__, found))
                held = np.fromiter(map(column.__getitem__, counts), np.int64, len(counts))
                order = np.argsort(held)
                keep.append(i)
                sizes.append(len(found))
                clusters.append(int(rarity[held].min()) if len(held) else -1)
                cols.append(_ints(held[order]))
                tfs.append(_ints(np.fromiter(counts.values(), np.int64, len(counts))[order]))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(place, place + len(keep))),
                batch.column("doc_id").take(pa.array(keep, pa.int64())),
                pa.array(sizes, pa.int64()), pa.array(clusters, pa.int32()),
                pa.array(cols, pa.binary()), pa.array(tfs, pa.binary())],
                names=["place", "doc_id", "n", "cluster", "cols", "tfs"])
            place += len(keep)

    out = written(rows.mapInArrow(
        run, f"place BIGINT, doc_id {id_type}, n BIGINT, cluster INT, cols BINARY, tfs BINARY"))
    shared.destroy()
    return out


def holding(rows: DataFrame, width: int) -> np.ndarray:
    """Documents that hold each term of the block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(width, np.int64)
        for batch in batches:
            for cols in batch.column("cols"):
                n[np.frombuffer(cols.as_buffer(), "<i4")] += 1
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], names=["col", "n"])

    found = (rows.select("cols").mapInArrow(count, "col BIGINT, n BIGINT")
             .groupBy("col").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(width, np.int64)
    out[found.column("col").to_numpy()] = found.column("n").to_numpy()
    return out


def impacts(tfs: np.ndarray, size: int, n_docs: int, n_terms: int) -> np.ndarray:
    """What each term's weight is multiplied by, in a document of ``size`` terms."""
    m = 25 + 75 * size * n_docs // n_terms
    tfs = tfs.astype(np.int64)
    return SCALE * tfs // (1000 * tfs + 8 * m)


def in_batches(rows: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """batch, doc_id, cols, values: documents in batches, range-sorted by their rarest term."""
    key = ["cluster", "n", "place"]
    ordered = (rows.where("cluster >= 0").repartitionByRange(*key).sortWithinPartitions(*key)
               .select("doc_id", "n", "cols", "tfs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, docs, entries = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            numbers, values = [], []
            for n, tfs in zip(batch.column("n").to_pylist(), batch.column("tfs"), strict=True):
                tf = np.frombuffer(tfs.as_buffer(), "<i4")
                if docs == BATCH_DOCS or (docs and entries + len(tf) > BATCH_ENTRIES):
                    number, docs, entries = number + 1, 0, 0
                docs, entries = docs + 1, entries + len(tf)
                numbers.append(number)
                values.append(_ints(impacts(tf, n, n_docs, n_terms)))
            yield pa.RecordBatch.from_arrays([
                pa.array(numbers, pa.int64()), batch.column("doc_id"), batch.column("cols"),
                pa.array(values, pa.binary())], names=["batch", "doc_id", "cols", "values"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return written(ordered.mapInArrow(
        run, f"batch BIGINT, doc_id {id_type}, cols BINARY, values BINARY"))


def _batches_of(batches: Iterator[pa.RecordBatch]):
    """(batch, doc ids, ends, cols, values) of runs of rows with the same batch."""
    held, ids, cols, values = None, [], [], []

    def done():
        ends = np.cumsum([len(c) for c in cols])
        return held, ids, ends, np.concatenate(cols), np.concatenate(values).astype(np.int64)

    for batch in batches:
        own = batch.column("doc_id").to_pylist() if "doc_id" in batch.schema.names else \
            [None] * batch.num_rows
        for number, doc_id, c, v in zip(batch.column("batch").to_pylist(), own,
                                        batch.column("cols"), batch.column("values"),
                                        strict=True):
            if number != held:
                if ids:
                    yield done()
                held, ids, cols, values = number, [], [], []
            ids.append(doc_id)
            # Copied, so that a batch does not keep the buffers it came in.
            cols.append(np.frombuffer(c.as_py(), "<i4"))
            values.append(np.frombuffer(v.as_py(), "<i4"))
    if ids:
        yield done()


def batch_maxima(rows: DataFrame) -> DataFrame:
    """batch, cols, values: the coordinate maxima of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, _, cols, values in _batches_of(batches):
            used, at = np.unique(cols, return_inverse=True)
            top = np.zeros(len(used), np.int64)
            np.maximum.at(top, at, values)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([_ints(used)], pa.binary()),
                 pa.array([_ints(top)], pa.binary())], names=["batch", "cols", "values"])

    return written(rows.select("batch", "cols", "values").mapInArrow(
        run, "batch BIGINT, cols BINARY, values BINARY"))


# ---- pairs of nodes ------------------------------------------------------------------------


def _nodes(nodes: DataFrame, tree, visit, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from visit(tree.value, zip(
                batch.column("batch").to_pylist(),
                (np.frombuffer(c.as_py(), "<i4") for c in batch.column("cols")),
                (np.frombuffer(v.as_py(), "<i4") for v in batch.column("values")), strict=True))

    return nodes.mapInArrow(run, schema)


def best_batches(nodes: DataFrame, tree) -> list[int]:
    """The batch with the greatest bound for each item."""

    def visit(items: ItemTree, rows) -> Iterator[pa.RecordBatch]:
        best = np.full(len(items.item), -1, np.int64)
        where = np.zeros(len(best), np.int64)
        for number, cols, values in rows:
            bound = (items.item[:, cols] @ values.astype(items.item.dtype)).astype(np.int64)
            better = bound > best
            best[better], where[better] = bound[better], number
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(best), dtype=np.int32)), pa.array(best), pa.array(where)],
            names=["item", "bound", "batch"])

    found = _nodes(nodes, tree, visit, "item INT, bound BIGINT, batch BIGINT")
    return sorted({r.batch for r in found.groupBy("item").agg(
        F.max_by("batch", "bound").alias("batch")).collect()})


def useful_batches(nodes: DataFrame, tree, kth: np.ndarray) -> DataFrame:
    """batch: those that may hold a document that some item lists."""

    def visit(items: ItemTree, rows) -> Iterator[pa.RecordBatch]:
        item, group, whole = items.weakest(np.maximum(kth, 1))
        kept = []
        for number, cols, values in rows:
            top = values.astype(items.item.dtype)
            if items.root[cols] @ top < whole.min():
                continue
            live = np.flatnonzero(items.super[:, cols] @ top >= whole)
            live = (live[:, None] * FAN + np.arange(FAN)).ravel()
            live = live[live < len(group)]
            live = live[items.group[np.ix_(live, cols)] @ top >= group[live]]
            live = (live[:, None] * FAN + np.arange(FAN)).ravel()
            live = live[live < len(item)]
            if (items.item[np.ix_(live, cols)] @ top >= item[live]).any():
                kept.append(number)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64())], names=["batch"])

    return _nodes(nodes, tree, visit, "batch BIGINT").distinct()


class Best:
    """The best documents of each item that a task has seen."""

    def __init__(self, kth: np.ndarray, top: int):
        self.top, self.kth = top, np.maximum(kth, 1)
        self.found: list[list[tuple]] = [[] for _ in kth]

    def add(self, item: int, scores, ids) -> None:
        """Documents in order of score, then doc_id, null last."""
        own = self.found[item]
        own += [(-int(s), d is None, d) for s, d in zip(scores, ids, strict=True)]
        own.sort(key=lambda x: (x[0], x[1], x[2] if x[2] is not None else 0))
        del own[self.top:]
        if len(own) == self.top:
            self.kth[item] = max(self.kth[item], -own[-1][0])


def _pairs_above(left: np.ndarray, right: np.ndarray, least: np.ndarray,
                 parents: np.ndarray | None) -> np.ndarray:
    """Which (item node, document node) pairs may matter; only children of ``parents``, the
    pairs of the level above, are multiplied."""
    out = np.zeros((len(left), len(right)), bool)
    if parents is None:
        rows, columns = np.arange(len(left)), np.arange(len(right))
    else:
        allowed = parents[np.arange(len(left)) // FAN]
        rows = np.flatnonzero(allowed.any(axis=1))
        columns = np.flatnonzero(allowed.any(axis=0))
    if len(rows) and len(columns):
        bound = left[rows] @ right[columns].T
        out[np.ix_(rows, columns)] = bound >= least[rows][:, None]
    return out if parents is None else out & parents[np.arange(len(left)) // FAN]


def _search_batch(tree: ItemTree, best: Best, ids: list, ends: np.ndarray, cols: np.ndarray,
                  values: np.ndarray) -> None:
    used, at = np.unique(cols, return_inverse=True)
    kind = tree.item.dtype
    starts = np.concatenate([[0], ends[:-1]])
    doc = np.repeat(np.arange(len(ids)), ends - starts)
    n_leaves = (len(ids) - 1) // LEAF + 1
    leaf = np.zeros(n_leaves * len(used), kind)
    np.maximum.at(leaf, doc // LEAF * len(used) + at, values.astype(kind))
    leaf = leaf.reshape(n_leaves, len(used))
    node = np.maximum.reduceat(leaf, np.arange(0, n_leaves, FAN), axis=0)
    item, group, whole = tree.weakest(best.kth)
    if tree.root[used] @ node.max(axis=0) < whole.min():
        return
    high = _pairs_above(tree.super[:, used], node, whole, None)
    middle = _pairs_above(tree.group[:, used], leaf, group,
                          high[:, np.arange(n_leaves) // FAN])
    low = _pairs_above(tree.item[:, used], leaf, item, middle)
    for number in np.argsort(-low.sum(axis=0), kind="stable"):
        wanted = np.flatnonzero(low[:, number])
        if not len(wanted):
            break
        weights = tree.item[np.ix_(wanted, used)]
        # The kth scores have risen since: look once more.
        still = weights @ leaf[number] >= best.kth[wanted]
        wanted, weights = wanted[still], weights[still]
        if not len(wanted):
            continue
        first, last = number * LEAF, min((number + 1) * LEAF, len(ids))
        own = slice(starts[first], ends[last - 1])
        dense = np.zeros((last - first, len(used)), kind)
        dense[doc[own] - first, at[own]] = values[own]
        scores = weights @ dense.T
        for i, row in zip(wanted.tolist(), scores, strict=True):
            good = np.flatnonzero(row >= best.kth[i])
            if len(good):
                best.add(i, row[good], [ids[first + d] for d in good])


def search_rows(rows: DataFrame, tree, kth: np.ndarray, top: int) -> DataFrame:
    """item, doc_id, score: the best of each item that each task has found."""
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = Best(kth, top), None

        def peeked():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("doc_id").type
                yield batch

        for _, ids, ends, cols, values in _batches_of(peeked()):
            _search_batch(tree.value, best, ids, ends, cols, values)
        if kind is None:
            return
        out = [(i, d, -s) for i, own in enumerate(best.found) for s, _, d in own]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], kind),
             pa.array([x[2] for x in out], pa.int64())], names=["item", "doc_id", "score"])

    found = rows.mapInArrow(run, f"item INT, doc_id {id_type}, score BIGINT")
    place = F.row_number().over(Window.partitionBy("item").orderBy(
        F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", place).where(F.col("rank") <= top)


def _search_block(docs: DataFrame, block: Block, top: int) -> DataFrame | None:
    """item, doc_id, score, rank; item is the place in ``block.ids``."""
    spark = docs.sparkSession
    rows = postings(docs, block)
    n_docs, n_terms = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    held = holding(rows, len(block.column))
    weight = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in held],
                      np.int64)
    items = ItemTree(block, weight)
    tree = spark.sparkContext.broadcast(items)
    placed = in_batches(rows, n_docs, n_terms)
    nodes = batch_maxima(placed)
    kth = np.zeros(len(items.items), np.int64)
    first = best_batches(nodes, tree)  # at most one per item
    seen = search_rows(placed.where(F.col("batch").isin(first)), tree, kth, top)
    for r in seen.where(F.col("rank") == top).collect():  # one row per item
        kth[r.item] = r.score
    useful = small_side(useful_batches(nodes, tree, kth).withColumnRenamed("batch", "u_batch"))
    live = placed.join(useful, F.col("batch") == F.col("u_batch"), "left_semi")
    found = written(search_rows(live, tree, kth, top))
    tree.destroy()
    order = F.array(*[F.lit(int(i)) for i in items.items])
    return found.withColumn("item", F.get(order, F.col("item")))


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of every item."""
    spark = docs.sparkSession
    prepare(spark)
    item_type = items.schema["item_id"].dataType
    id_type = docs.schema["doc_id"].dataType
    out = spark.createDataFrame([], f"item_id {item_type.simpleString()}, rank INT, "
                                    f"doc_id {id_type.simpleString()}, score BIGINT")
    for block in blocks(items):
        found = _search_block(docs, block, top)
        if found is None:
            continue
        names = spark.createDataFrame(list(enumerate(block.ids)), StructType([
            StructField("i_item", IntegerType()), StructField("item_id", item_type)]))
        out = out.unionByName(found.join(F.broadcast(names), F.col("item") == F.col("i_item"))
                              .select("item_id", "rank", "doc_id", "score"))
    return out
