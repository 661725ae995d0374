"""Class hypervectors, by counting or by summing encoded rows.

Engine rows are ``part INT, label STRING, row_pos, features``. A *part* is a set
of rows that every model treats alike (a fold, say); a model trains on a list of
parts. A *request* ``(lo, hi, positions)`` is one way to quantise the matrix;
models with the same edges share it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom import kernels
from vectorloom.functions.levels import level_of
from vectorloom.item_memory import ItemMemory
from vectorloom.operators.encode import sum_vectors
from vectorloom.tables import TableTooLarge, written

# Counters one counting job may hold (int64); larger requests are bundled directly.
COUNT_CELLS = 1 << 22
# Bytes of counters a task holds before it turns them into class vectors.
PARTIAL_BYTES = 512 << 20
# Bytes of class vectors that may come back to the driver.
MODEL_BYTES = 1 << 30


@dataclass(frozen=True)
class Request:
    lo: float
    hi: float
    positions: tuple[int, ...]

    def levels(self, x: np.ndarray, n_levels: int) -> np.ndarray:
        if len(self.positions) != x.shape[1]:
            x = x[:, list(self.positions)]
        return kernels.quantise(x, self.lo, self.hi, n_levels)


def label_index(column: pa.Array, labels: pa.Array) -> np.ndarray:
    return pc.index_in(column, labels).to_numpy(zero_copy_only=False)


def class_counts(matrix: DataFrame, lo: float, hi: float, n_levels: int,
                 by=("label",)) -> DataFrame:
    """``by..., pos, level, n``: how often each level occurs at each position, from
    built-in functions only; map-side combining makes hot classes harmless."""
    cells = matrix.select(*by, F.posexplode("features").alias("pos", "value"))
    return cells.groupBy(*by, "pos", level_of("value", lo, hi, n_levels).alias("level")).agg(
        F.count(F.lit(1)).alias("n")
    )


def cell_numbers(levels: np.ndarray, memory: ItemMemory) -> np.ndarray:
    """Counter of each cell: (rotation, level) flattened."""
    rotation = np.arange(levels.shape[1]) % memory.dimensionality
    return rotation * memory.levels + levels


def count_levels(rows: DataFrame, requests: list[Request], n_parts: int, labels: list[str],
                 memory: ItemMemory) -> list[np.ndarray]:
    """Occurrences (parts, classes, rotations, levels) for each request.

    Tasks count Arrow batches into a table whose size depends on the parameters
    only; Spark adds the tables up.
    """
    shapes = [(n_parts, len(labels), memory.width(len(r.positions)), memory.levels)
              for r in requests]
    sizes = [int(np.prod(s)) for s in shapes]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    names, shared = pa.array(labels), memory.on(rows.sparkSession.sparkContext)

    def tally(batches):
        counts = np.zeros(starts[-1], dtype=np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = kernels.feature_matrix(batch.column("features"))
            part = batch.column("part").to_numpy(zero_copy_only=False).astype(np.int64)
            group = part * len(names) + label_index(batch.column("label"), names)
            for request, start, shape, size in zip(requests, starts, shapes, sizes):
                cell = cell_numbers(request.levels(x, shape[3]), shared.value)
                cell = cell + (group * (shape[2] * shape[3]))[:, None]
                add_counts(counts[start:start + size], cell)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found), pa.array(counts[found])], names=["cell", "n"]
        )

    slim = rows.select("part", "label", "features")
    totals = (
        slim.mapInArrow(tally, "cell BIGINT, n BIGINT").groupBy("cell").agg(F.sum("n").alias("n"))
    ).toArrow()
    dense = np.zeros(starts[-1], dtype=np.int64)
    dense[totals.column("cell").to_numpy()] = totals.column("n").to_numpy()
    return [dense[a:a + n].reshape(s) for a, n, s in zip(starts, sizes, shapes)]


def add_counts(counts: np.ndarray, cell: np.ndarray, sign: int = 1) -> None:
    """Add ``sign`` to the counter of every cell."""
    if cell.size > len(counts) // 4:
        counts += sign * np.bincount(cell.ravel(), minlength=len(counts)).astype(counts.dtype)
    else:
        np.add.at(counts, cell.ravel(), counts.dtype.type(sign))


class Partials:
    """Counters of one task, turned into class vectors when they are emitted: the
    counters of a wide matrix never leave the task."""

    def __init__(self, key_names: list[str], memory: ItemMemory):
        self.key_names, self.memory, self.counts, self.held = key_names, memory, {}, 0

    def add(self, key: tuple, levels: np.ndarray, sign: int = 1) -> None:
        size = self.memory.width(levels.shape[1]) * self.memory.levels
        if key not in self.counts:
            self.counts[key] = np.zeros(size, dtype=np.int32)
            self.held += 4 * size
        add_counts(self.counts[key], cell_numbers(levels, self.memory), sign)

    def full(self) -> bool:
        return self.held > PARTIAL_BYTES

    def emit(self) -> pa.RecordBatch:
        keys = np.array(list(self.counts), dtype=np.int32).reshape(-1, len(self.key_names))
        vectors = [
            self.memory.bundle(c.reshape(1, -1, self.memory.levels).astype(np.int64))[0]
            for c in self.counts.values()
        ]
        arrays = [pa.array(keys[:, i]) for i in range(len(self.key_names))]
        matrix = np.array(vectors).reshape(len(vectors), self.memory.dimensionality)
        arrays.append(kernels.list_column(matrix, pa.int64()))
        self.counts, self.held = {}, 0
        return pa.RecordBatch.from_arrays(arrays, names=[*self.key_names, "hv"])


def sum_encoded(rows: DataFrame, requests: list[Request], labels: list[str],
                memory: ItemMemory) -> DataFrame:
    """``request, part, label_no, hv``: sums of encoded rows for matrices with too many
    counters to collect. Each task counts, bundles and passes on class vectors only."""
    shared = memory.on(rows.sparkSession.sparkContext)
    names, key_names = pa.array(labels), ["request", "part", "label_no"]

    def partial_sums(batches):
        sums = Partials(key_names, shared.value)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = kernels.feature_matrix(batch.column("features"))
            part = batch.column("part").to_numpy(zero_copy_only=False)
            label = label_index(batch.column("label"), names)
            for r, request in enumerate(requests):
                levels = request.levels(x, shared.value.levels)
                for p, c in set(zip(part.tolist(), label.tolist())):
                    sums.add((r, p, c), levels[(part == p) & (label == c)])
                    if sums.full():
                        yield sums.emit()
        yield sums.emit()

    partials = rows.select("part", "label", "features").mapInArrow(
        partial_sums, "request INT, part INT, label_no INT, hv ARRAY<BIGINT>"
    )
    return sum_vectors(partials, key_names, salted=True)


def fetch_vectors(sums: DataFrame, n_requests: int, n_parts: int, n_labels: int,
                  dim: int) -> np.ndarray:
    """(requests, parts, classes, D) on the driver; refused when not small."""
    kept = written(sums)
    if kept.count() > MODEL_BYTES // (8 * dim):
        raise TableTooLarge("class vectors exceed what the driver may hold")
    out = np.zeros((n_requests, n_parts, n_labels, dim), dtype=np.int64)
    found = kept.toArrow()
    keys = [found.column(k).to_numpy() for k in ("request", "part", "label_no")]
    if found.num_rows:
        flat = found.column("hv").combine_chunks().flatten().to_numpy()
        out[tuple(keys)] = flat.reshape(-1, dim)
    return out


def class_hypervectors(matrix: DataFrame, memory: ItemMemory, lo: float, hi: float) -> DataFrame:
    """``label, class_rank, hv ARRAY<BIGINT>``; rank by first training row."""
    counts = class_counts(matrix, lo, hi, memory.levels)
    vectors = bundle_counts(counts, memory)
    first = matrix.groupBy("label").agg(F.min("row_pos").alias("first"))
    ranked = first.select(
        "label", (F.row_number().over(Window.orderBy("first")) - 1).alias("class_rank")
    )
    return vectors.join(ranked, "label")


def bundle_counts(counts: DataFrame, memory: ItemMemory, block: int = 256) -> DataFrame:
    """``label, hv`` from ``label, pos, level, n``: each (class, block of positions)
    becomes one partial vector, at most block*L counter rows per group."""
    shared = memory.on(counts.sparkSession.sparkContext)

    def partial(key, table):
        bundler = shared.value
        dense = np.zeros((1, block, bundler.levels), dtype=np.int64)
        pos = table.column("pos").to_numpy()
        first = int(pos[0]) // block * block
        dense[0, pos - first, table.column("level").to_numpy()] = table.column("n").to_numpy()
        hv = np.roll(bundler.bundle(dense), first % bundler.dimensionality, axis=1)
        return pa.Table.from_arrays(
            [pa.array([key[0].as_py()]), kernels.list_column(hv, pa.int64())], names=["label", "hv"]
        )

    grouped = counts.groupBy("label", F.floor(F.col("pos") / block).alias("block"))
    partials = grouped.applyInArrow(partial, f"label {counts.schema['label'].dataType.simpleString()}"
                                             ", hv ARRAY<BIGINT>")
    return sum_vectors(partials, ["label"])
