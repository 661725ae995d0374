"""Null distribution of the accuracy: label-permuted replicates, counted side by side.

The features of a row are the same in every replicate, so they are read once: a row carries its
labels and sides of all replicates as one packed array, its cells are quantised once per value
range, and each cell is added to one class slot per replicate. Spark adds up the counters by
replicate, tasks make a model of each, and the models are streamed past blocks of rows: a task
holds one block of rows and one model, whatever the number of replicates.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom import kernels
from vectorloom.item_memory import load_item_memory
from vectorloom.operators import permute
from vectorloom.operators.bundle import Request, cell_numbers
from vectorloom.operators.classify import Classifier
from vectorloom.operators.matrix import has_missing
from vectorloom.operators.splits import stratified_split
from vectorloom.settings import Settings
from vectorloom.tables import attach_small, bounded_rows, prepare, written

# Bytes of quantised cells and labels a task holds.
ROW_BYTES = 64 << 20
_MAX_CLASSES = 10_000


def permuted_sides(matrix: DataFrame, replicates: int, percentage: float, seed: int) -> DataFrame:
    """``replicate, row_id, row_pos, label, is_train``: permuted labels, each replicate split by
    its own. No features are carried."""
    drawn = permute.label_permutations(matrix, replicates, seed)
    name = F.concat_ws(":", F.col("replicate"), F.col("label"))
    split = stratified_split(drawn.withColumn("_label", F.col("label")).withColumn("label", name),
                             percentage, seed)
    return split.withColumn("label", F.col("_label")).drop("_label")


class _Packed:
    """``block, features, slots``: a row's class number and side (2 * class + is_train) in
    every replicate; also what each replicate's model needs to know."""

    def __init__(self, matrix: DataFrame, replicates: int, percentage: float, seed: int):
        shape = matrix.agg(
            F.count(F.lit(1)).alias("n"), F.min(F.size("features")).alias("narrow"),
            F.max(F.size("features")).alias("wide"), F.count_if(F.col("label").isNull()).alias("nameless"),
            F.count_if(has_missing(F.col("features"))).alias("missing")).first()
        if not shape.n:
            raise ValueError("no rows")
        if shape.narrow != shape.wide:
            raise ValueError("rows with different feature counts; run validate_matrix first")
        if shape.missing or shape.nameless:
            raise ValueError(f"{shape.missing} rows have missing (null or NaN) cells and "
                             f"{shape.nameless} no label; drop them first")
        self.width, self.replicates = shape.wide, replicates
        found = bounded_rows(matrix.select("label").distinct(), _MAX_CLASSES, "classes")
        self.labels = sorted(r.label for r in found)
        names = matrix.sparkSession.createDataFrame(
            list(enumerate(self.labels)), "class INT, c_label STRING")
        sides = written(attach_small(
            permuted_sides(matrix, replicates, percentage, seed), names,
            F.col("label") == F.col("c_label")).select(
            "replicate", "row_id", "row_pos", "class", "is_train"))
        slot = (2 * F.col("class") + F.col("is_train").cast("int")).cast("smallint")
        packed = sides.groupBy(F.col("row_id").alias("s_id")).agg(F.transform(
            F.array_sort(F.collect_list(F.struct("replicate", slot.alias("slot")))),
            lambda x: x["slot"]).alias("slots"))
        per_row = 2 * replicates + 4 * self.width
        blocks = max(1, -(-shape.n * per_row // ROW_BYTES))
        self.rows = written(matrix.select("row_id", "features").join(
            packed, F.col("row_id") == F.col("s_id")).select(
            F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int").alias("block"),
            "features", "slots"))
        self.blocks = blocks
        self.of_replicate = self._replicates(matrix, sides)

    def _replicates(self, matrix: DataFrame, sides: DataFrame) -> list:
        """Per replicate the value range and class order of the training rows: one row each."""
        ends = matrix.select(F.col("row_id").alias("e_id"), F.array_min("features").alias("lo"),
                             F.array_max("features").alias("hi"))
        train = sides.where("is_train").join(ends, F.col("row_id") == F.col("e_id"))
        classes = train.groupBy("replicate", "class").agg(
            F.min("row_pos").alias("first"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        order = F.transform(F.array_sort(F.collect_list(F.struct("first", "class"))),
                            lambda x: x["class"])
        found = classes.groupBy("replicate").agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), order.alias("order")).collect()
        tested = sides.where("NOT is_train").select("replicate").distinct().count()
        if len(found) < self.replicates or tested < self.replicates:
            raise ValueError("a replicate's split leaves no training or no test rows")
        return sorted(found, key=lambda r: r.replicate)


def _slots(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def count_replicates(packed: _Packed, memory) -> DataFrame:
    """``replicate, cell, n``: occurrences of (class, rotation, level) among training rows."""
    shared = memory.on(packed.rows.sparkSession.sparkContext)
    by_edges: dict[tuple, list[int]] = {}
    for i, r in enumerate(packed.of_replicate):
        by_edges.setdefault((r.lo, r.hi), []).append(i)
    classes, width = len(packed.labels), packed.width

    def tally(batches):
        held, slots, size = [], [], 0

        def emitted():
            x, own = np.concatenate(held), np.concatenate(slots)
            memory = shared.value
            per_class = memory.width(width) * memory.levels
            for edges, members in by_edges.items():
                levels = kernels.quantise(x, *edges, memory.levels)
                cells = cell_numbers(levels, memory)
                for b in members:
                    train = np.flatnonzero(own[:, b] & 1)
                    at = cells[train] + (own[train, b] >> 1).astype(np.int64)[:, None] * per_class
                    n = np.bincount(at.ravel(), minlength=classes * per_class)
                    used = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(used), b, np.int32)), pa.array(used),
                         pa.array(n[used])], names=["replicate", "cell", "n"])
            held.clear()
            slots.clear()

        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(kernels.feature_matrix(batch.column("features")))
            slots.append(_slots(batch.column("slots")))
            size += held[-1].nbytes + slots[-1].nbytes
            if size > ROW_BYTES:
                yield from emitted()
                size = 0
        if held:
            yield from emitted()

    return packed.rows.select("features", "slots").mapInArrow(
        tally, "replicate INT, cell BIGINT, n BIGINT").groupBy("replicate", "cell").agg(
        F.sum("n").alias("n"))


def replicate_models(packed: _Packed, counts: DataFrame, memory) -> DataFrame:
    """``replicate, payload``: a model of each replicate, made by tasks."""
    shared = memory.on(counts.sparkSession.sparkContext)
    known, classes, width = packed.of_replicate, len(packed.labels), packed.width

    def build(key, table):
        b, memory = key[0].as_py(), shared.value
        dense = np.zeros(classes * memory.width(width) * memory.levels, np.int64)
        dense[table.column("cell").to_numpy()] = table.column("n").to_numpy()
        order = np.array(known[b].order)
        mine = dense.reshape(classes, -1, memory.levels)[order]
        request = Request(known[b].lo, known[b].hi, tuple(range(width)))
        model = Classifier(b, request, order, None, counts=mine).ready(memory)
        return pa.table({"replicate": pa.array([b], pa.int32()),
                         "payload": pa.array([pickle.dumps(model.slim())], pa.binary())})

    return written(counts.groupBy("replicate").applyInArrow(
        build, "replicate INT, payload BINARY"))


def score_replicates(packed: _Packed, models: DataFrame, memory) -> DataFrame:
    """``replicate, n, right`` over each replicate's test rows: every block of rows meets the
    models one after another."""
    shared = memory.on(models.sparkSession.sparkContext)
    row_type, slot_type = (packed.rows.schema[c].dataType for c in ("features", "slots"))
    rows = packed.rows.select("block", F.lit(-1).alias("replicate"), F.lit(None).cast("binary")
                              .alias("payload"), "features", "slots")
    each = F.explode(F.sequence(F.lit(0), F.lit(packed.blocks - 1))).alias("block")
    copies = models.select(each, "replicate", "payload", F.lit(None).cast(row_type)
                           .alias("features"), F.lit(None).cast(slot_type).alias("slots"))
    stream = rows.union(copies).repartition("block").sortWithinPartitions("block", "replicate")

    def tally(batches):
        held, slots, block, x, own, cache = [], [], None, None, None, {}
        for batch in batches:
            blocks, number = (batch.column(c).to_numpy() for c in ("block", "replicate"))
            at = 0
            out = []
            while at < batch.num_rows:
                if blocks[at] != block:
                    held, slots, block, x, cache = [], [], blocks[at], None, {}
                if number[at] < 0:
                    other = np.flatnonzero((blocks[at:] != block) | (number[at:] >= 0))
                    some = batch.slice(at, int(other[0]) if len(other) else None)
                    held.append(kernels.feature_matrix(some.column("features")))
                    slots.append(_slots(some.column("slots")))
                    at += some.num_rows
                    continue
                if x is None:
                    if not held:  # a block that no row fell into
                        at += 1
                        continue
                    x, own = np.concatenate(held), np.concatenate(slots)
                    held, slots = [x], [own]
                one = pickle.loads(batch.column("payload")[at].as_py())
                edges = (one.request.lo, one.request.hi)
                if edges not in cache:
                    cache.clear()  # models come by number, their ranges vary little
                    cache[edges] = kernels.quantise(x, *edges, shared.value.levels)
                test = np.flatnonzero(~own[:, one.model] & 1)
                guess = one.guess(cache[edges][test], shared.value)
                out.append((one.model, len(test), int((guess == own[test, one.model] >> 1).sum())))
                at += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], pa.int64()) for i in range(3)],
                names=["replicate", "n", "right"])

    found = stream.mapInArrow(tally, "replicate BIGINT, n BIGINT, right BIGINT")
    return found.groupBy("replicate").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))


def permutation_accuracy(matrix: DataFrame, replicates: int, percentage: float,
                         settings: Settings) -> DataFrame:
    """``replicate, accuracy`` of label-permuted replicates of ``matrix``."""
    if settings.retrain:
        raise ValueError("replicates are scored without retraining; use holdout_replicates")
    spark = matrix.sparkSession
    prepare(spark)
    memory = load_item_memory(spark, settings.dimensionality, settings.levels, settings.seed)
    packed = _Packed(matrix, replicates, percentage, settings.seed)
    models = replicate_models(packed, count_replicates(packed, memory), memory)
    scored = score_replicates(packed, models, memory)
    return scored.select(F.col("replicate").cast("int").alias("replicate"),
                         F.round(100 * (F.col("right") / F.col("n")), 2).alias("accuracy"))
