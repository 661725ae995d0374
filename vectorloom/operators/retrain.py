"""Perceptron retraining: online (row by row) and batch (classes fixed per pass)."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom import kernels
from vectorloom.item_memory import ItemMemory
from vectorloom.operators.bundle import Partials, add_counts, cell_numbers, label_index
from vectorloom.operators.classify import Classifier, LevelCache, Shipped, in_shipments
from vectorloom.operators.encode import sum_vectors
from vectorloom.tables import Scratch, bounded_rows

# Rows one task may walk through in order; longer training sets go block by block.
BLOCK_ROWS = 4096
# Bytes of encoded rows a task may hold for that.
BLOCK_BYTES = 256 << 20
# A pass goes through this many blocks before they are made longer, and how many times longer.
BLOCKS = 64
LONGEST = 16


def block_rows(width: int, dim: int) -> int:
    return max(1, min(BLOCK_ROWS, BLOCK_BYTES // (4 * dim + 8 * width)))


class OnlinePass:
    """State of an online pass: class vectors change after every wrong guess."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors.astype(np.float64)
        self.inverse = kernels.inverse_norms(self.vectors)

    def walk(self, hv: np.ndarray, truth: np.ndarray) -> int:
        """Visit rows in order; returns the number of wrong guesses."""
        wrong = 0
        for row, true in zip(hv.astype(np.float64), truth):
            scores = (self.vectors @ row) * self.inverse
            guess = int(kernels.first_best(scores[None, :])[0])
            if guess != true:
                wrong += 1
                self.vectors[guess] -= row
                self.vectors[true] += row
                pair = [guess, true]
                self.inverse[pair] = kernels.inverse_norms(self.vectors[pair])
        return wrong

    def right(self, hv: np.ndarray, truth: np.ndarray) -> int:
        scores = (hv @ self.vectors.T) * self.inverse
        return int((kernels.first_best(scores) == truth).sum())


def retrain_small(rows: DataFrame, models: list[Classifier], labels: list[str],
                  memory: ItemMemory, passes: int, stop: bool) -> DataFrame:
    """Whole retraining loops of models with at most ``block_rows`` rows each, one
    bounded group per model: ``model, iteration, error, right, n, hv`` where ``hv``
    holds the class vectors of the iteration end to end."""
    context = rows.sparkSession.sparkContext
    plan = context.broadcast({m.model: (m.request, m.order, m.train, m.test) for m in models})
    shared, names = memory.on(context), pa.array(labels)
    n_levels = memory.levels

    def loop(key, table):
        request, order, train, test = plan.value[key[0].as_py()]
        table = table.sort_by("row_pos")
        part = table.column("part").to_numpy()
        x = kernels.feature_matrix(table.column("features"))
        hv = kernels.encode(request.levels(x, n_levels), shared.value.doubled)
        place = np.full(len(labels) + 1, -1)
        place[order] = np.arange(len(order))
        truth = place[label_index(table.column("label").combine_chunks(), names)]
        learns, tests = np.isin(part, train), np.isin(part, test)
        start = np.stack([
            hv[learns & (truth == c)].sum(axis=0, dtype=np.int64) for c in range(len(order))
        ])
        state = OnlinePass(start)
        n_train, n_test = int(learns.sum()), int(tests.sum())
        steps = [(0, None, state.right(hv[tests], truth[tests]), state.vectors.ravel().copy())]
        previous = None
        for iteration in range(1, passes + 1):
            error = state.walk(hv[learns], truth[learns]) / n_train
            steps.append((iteration, error, state.right(hv[tests], truth[tests]),
                          state.vectors.ravel().copy()))
            if stop and error == previous:
                break
            previous = error
        size = len(steps)
        return pa.table({
            "model": pa.array([key[0].as_py()] * size, pa.int32()),
            "iteration": pa.array([s[0] for s in steps], pa.int32()),
            "error": pa.array([s[1] for s in steps], pa.float64()),
            "right": pa.array([s[2] for s in steps], pa.int64()),
            "n": pa.array([n_test] * size, pa.int64()),
            "hv": kernels.list_column(np.stack([s[3] for s in steps]).astype(np.int64), pa.int64()),
        })

    members = _explode_models(rows, {m.model: (*m.train, *m.test) for m in models})
    return members.groupBy("model").applyInArrow(
        loop, "model INT, iteration INT, error DOUBLE, right BIGINT, n BIGINT, hv ARRAY<BIGINT>"
    )


def _explode_models(rows: DataFrame, parts_of: dict[int, tuple[int, ...]]) -> DataFrame:
    """One copy of a row per model that uses its part."""
    models_of = {}
    for model, parts in parts_of.items():
        for part in parts:
            models_of.setdefault(part, []).append(model)
    width = max(models_of, default=0) + 1
    text = ";".join(",".join(map(str, models_of.get(p, []))) for p in range(width))
    table = F.split(F.lit(text), ";")
    mine = F.filter(F.split(F.get(table, F.col("part")), ","), lambda m: m != "")
    return rows.select(
        F.explode(mine.cast("array<int>")).alias("model"), "part", "label", "row_pos", "features"
    )


def rows_per_block(n_rows: int, width: int, dim: int) -> int:
    """Rows of a block: ``block_rows`` up to BLOCKS blocks, then more, so that a pass needs few
    jobs; a block's cells stay within BLOCK_BYTES."""
    size = block_rows(width, dim)
    most = max(size, min(LONGEST * size, BLOCK_BYTES // (8 * max(1, width))))
    return min(most, max(size, -(-n_rows // BLOCKS)))


def numbered_blocks(rows: DataFrame, n_rows: int, size: int, scratch: Scratch) -> DataFrame:
    """Add ``block``: runs of about ``size`` rows in ``row_pos`` order. Each block is a folder
    of a written table, so a job reads the blocks it walks and no others. ``row_pos`` must be
    unique."""
    ranges = rows.repartitionByRange(max(1, -(-n_rows // size)), "row_pos")
    return scratch.written(ranges.withColumn("block", F.spark_partition_id()), "block")


def online_pass(blocks: DataFrame, one: Classifier, labels: list[str], memory: ItemMemory,
                parallel: int) -> tuple[np.ndarray, int, int]:
    """One exact online pass of one model over any number of rows.

    A block without a wrong guess leaves the classes as they were, so a window of
    blocks is walked at once from the same state; everything before the first
    block with an error stands, that block's new classes are taken over, and the
    walk resumes behind it. A window of one block is a job of one task. Only class
    vectors reach the driver. Returns the class vectors, the wrong guesses and the
    number of rows.
    """
    spark = blocks.sparkSession
    names, n_levels = pa.array(labels), memory.levels
    shared = memory.on(spark.sparkContext)
    place = np.full(len(labels) + 1, -1)
    place[one.order] = np.arange(len(one.order))
    request = one.request
    step = block_rows(len(request.positions), memory.dimensionality)

    def block_walk(state_now):
        def walk(key, table):
            table = table.sort_by("row_pos")
            x = kernels.feature_matrix(table.column("features"))
            truth = place[label_index(table.column("label").combine_chunks(), names)]
            state, errors = OnlinePass(state_now.value), 0
            for top in range(0, len(x), step):
                levels = request.levels(x[top:top + step], n_levels)
                hv = kernels.encode(levels, shared.value.doubled)
                errors += state.walk(hv, truth[top:top + step])
            after = state.vectors.astype(np.int64).reshape(1, -1)
            return pa.table({
                "block": pa.array([key[0].as_py()], pa.int32()),
                "errors": pa.array([errors], pa.int64()),
                "hv": kernels.list_column(after, pa.int64()),
            })

        return walk

    mine = blocks.filter(F.col("part").isin(list(one.train)))
    span = mine.agg(F.min("block").alias("a"), F.max("block").alias("b"),
                    F.count(F.lit(1)).alias("n")).first()
    mine = mine.filter("row_pos IS NOT NULL")
    vectors = memory.bundle(one.counts) if one.vectors is None else one.vectors
    wrong, at, window = 0, span.a, parallel
    while at is not None and at <= span.b:
        state_now = spark.sparkContext.broadcast(vectors)
        walked = mine.filter(F.col("block").between(at, at + window - 1))
        if window == 1:
            walked = walked.coalesce(1)
        results = (
            walked.groupBy("block")
            .applyInArrow(block_walk(state_now), "block INT, errors BIGINT, hv ARRAY<BIGINT>")
            .filter("errors > 0").orderBy("block").limit(1).collect()
        )
        state_now.destroy()
        if results:
            first = results[0]
            vectors = np.asarray(first.hv, dtype=np.int64).reshape(vectors.shape)
            wrong += first.errors
            window = max(1, min(window, 2 * (first.block - at) + 1))
            at = first.block + 1
        else:
            at += window
            window *= 2
    return vectors, wrong, span.n


def batch_pass(rows: DataFrame, models: list[Classifier], labels: list[str],
               memory: ItemMemory) -> dict[int, tuple[np.ndarray, np.ndarray | None, int, int]]:
    """One pass with fixed classes for all models at once: every wrong guess takes its
    row out of the guessed class and adds it to its own. model -> (class vectors,
    counts, wrong, rows).

    Models with counters gather signed counters instead of vectors.
    """
    out = {}
    for group in in_shipments(models):
        counted = [m for m in group if m.table is not None and m.counts is not None]
        direct = [m for m in group if m.table is None or m.counts is None]
        if counted:
            out.update(_batch_counted(rows, counted, labels, memory))
        if direct:
            out.update(_batch_direct(rows, direct, labels, memory))
    return out


def _train_rows(rows, models):
    parts = sorted({p for m in models for p in m.train})
    return rows.filter(F.col("part").isin(parts)).select("part", "label", "features")


def _mistakes(batch, shipped, memory, names, n_labels):
    """(index of the model, its rows, wrong levels, guessed place, true place)."""
    cache = LevelCache(kernels.feature_matrix(batch.column("features")), memory.levels)
    part = batch.column("part").to_numpy(zero_copy_only=False)
    label = label_index(batch.column("label"), names)
    for i, one in enumerate(shipped.ready(memory)):
        chosen = np.flatnonzero(np.isin(part, one.train))
        if not len(chosen):
            continue
        place = np.full(n_labels + 1, -1)
        place[one.order] = np.arange(len(one.order))
        levels = cache.of(one.request, chosen)
        guess = one.guess(levels, memory)
        bad = guess != label[chosen]
        yield i, len(chosen), levels[bad], place[guess[bad]], place[label[chosen][bad]]


def _batch_counted(rows, models, labels, memory):
    context = rows.sparkSession.sparkContext
    shared, shipped = memory.on(context), context.broadcast(Shipped(models))
    names, n_labels = pa.array(labels), len(labels)
    sizes = [2 + m.counts.size for m in models]
    per_class = [m.counts[0].size for m in models]
    starts = np.concatenate([[0], np.cumsum(sizes)])

    def tally(batches):
        change = np.zeros(starts[-1], dtype=np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for i, n, levels, guess, true in _mistakes(batch, shipped.value, shared.value,
                                                       names, n_labels):
                at = starts[i]
                change[at] += n
                change[at + 1] += len(levels)
                cell = cell_numbers(levels, shared.value)
                for sign, place in ((-1, guess), (1, true)):
                    add_counts(change[at + 2:starts[i + 1]],
                               cell + (place * per_class[i])[:, None], sign)
        found = np.flatnonzero(change)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found), pa.array(change[found])], names=["cell", "n"]
        )

    totals = (
        _train_rows(rows, models).mapInArrow(tally, "cell BIGINT, n BIGINT")
        .groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    )
    shipped.destroy()
    dense = np.zeros(starts[-1], dtype=np.int64)
    dense[totals.column("cell").to_numpy()] = totals.column("n").to_numpy()
    out = {}
    for m, at, size in zip(models, starts, sizes):
        counts = m.counts + dense[at + 2:at + size].reshape(m.counts.shape)
        out[m.model] = None, counts, int(dense[at + 1]), int(dense[at])
    return out


def _batch_direct(rows, models, labels, memory):
    context = rows.sparkSession.sparkContext
    shared, shipped = memory.on(context), context.broadcast(Shipped(models))
    names, n_labels, dim = pa.array(labels), len(labels), memory.dimensionality

    def changes(batches):
        sums = Partials(["model", "place"], shared.value)
        seen = np.zeros((len(shipped.value.classifiers), 2), dtype=np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for i, n, levels, guess, true in _mistakes(batch, shipped.value, shared.value,
                                                       names, n_labels):
                seen[i] += n, len(levels)
                for sign, places in ((-1, guess), (1, true)):
                    for place in set(places.tolist()):
                        sums.add((i, place), levels[places == place], sign)
                        if sums.full():
                            yield sums.emit()
        yield sums.emit()
        totals = np.zeros((len(seen), dim), dtype=np.int64)
        totals[:, :2] = seen
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(seen), dtype=np.int32)),
             pa.array(np.full(len(seen), -1, dtype=np.int32)),
             kernels.list_column(totals, pa.int64())], names=["model", "place", "hv"])

    partials = _train_rows(rows, models).mapInArrow(
        changes, "model INT, place INT, hv ARRAY<BIGINT>"
    )
    totals = bounded_rows(sum_vectors(partials, ["model", "place"], salted=True),
                          len(models) * (n_labels + 1), "class changes")
    shipped.destroy()
    vectors = [m.vectors.copy() for m in models]
    seen = {}
    for row in totals:
        if row.place < 0:
            seen[row.model] = row.hv[1], row.hv[0]
        else:
            vectors[row.model][row.place] += np.asarray(row.hv)
    return {m.model: (vectors[i], None, *seen.get(i, (0, 0))) for i, m in enumerate(models)}


def updated(one: Classifier, vectors: np.ndarray | None, counts) -> Classifier:
    return replace(one, vectors=vectors, counts=counts, table=None, inverse=None)
