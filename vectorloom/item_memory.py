"""Level hypervectors (item memory) and the algebra that follows from them.

Level 0 is all -1 with floor(D/2) signs changed; each later level changes
floor(D/2/L) more signs of its predecessor. Positions are drawn by the rank of
md5("seed:level:position"), so every session and engine draws the same ones.
"""

from __future__ import annotations

from functools import cached_property, lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectorloom.tables import prepare


def sign_changes(spark: SparkSession, dimensionality: int, levels: int, seed: int) -> DataFrame:
    """(level, d): positions whose sign changes on entering a level; levels are drawn
    in parallel."""
    prepare(spark)
    half, later = dimensionality // 2, int(dimensionality / 2 / levels)

    def draw(batches):
        for batch in batches:
            for level in batch.column("id").to_pylist():
                text = f"{seed}:{level}:"
                digests = b"".join(
                    md5(f"{text}{d}".encode()).digest() for d in range(dimensionality)
                )
                keys = np.frombuffer(digests, dtype=">u8").reshape(-1, 2)
                ranked = np.lexsort((np.arange(dimensionality), keys[:, 1], keys[:, 0]))
                drawn = np.sort(ranked[:half if level == 0 else later]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(drawn), level, dtype=np.int32)), pa.array(drawn)],
                    names=["level", "d"],
                )

    return spark.range(levels).mapInArrow(draw, "level INT, d INT")


def item_memory(spark: SparkSession, dimensionality: int, levels: int, seed: int) -> DataFrame:
    """``level INT, hv ARRAY<TINYINT>``."""
    memory = load_item_memory(spark, dimensionality, levels, seed)
    return memory.to_frame(spark)


def item_memory_cells(spark: SparkSession, dimensionality: int, levels: int,
                      seed: int) -> DataFrame:
    """Long form ``level INT, d INT, sign INT``, all inside Spark."""
    changes = sign_changes(spark, dimensionality, levels, seed).withColumn("change", F.lit(1))
    grid = spark.range(dimensionality * levels).select(
        F.expr(f"cast(id div {dimensionality} as int)").alias("level"),
        F.expr(f"cast(id % {dimensionality} as int)").alias("d"),
    )
    so_far = F.sum(F.coalesce("change", F.lit(0))).over(
        Window.partitionBy("d").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    )
    return grid.join(changes, ["level", "d"], "left").select(
        "level", "d", F.when(so_far % 2 == 1, 1).otherwise(-1).alias("sign")
    )


class ItemMemory:
    """Item memory as a base vector plus the signs each level changes.

    Its size depends on D and L only, never on the data. Consecutive levels
    differ in few places, so class vectors and score tables cost O(D) per
    (class, feature) instead of O(L*D).
    """

    def __init__(self, dimensionality: int, levels: int, changes: list[np.ndarray]):
        self.dimensionality = dimensionality
        self.levels = levels
        self._handles = {}
        base = np.full(dimensionality, -1, dtype=np.int8)
        base[changes[0]] = 1
        self.matrix = np.empty((levels, dimensionality), dtype=np.int8)
        self.matrix[0] = base
        self.positions = np.array(changes[1:], dtype=np.int64).reshape(levels - 1, -1)
        self.steps = np.empty_like(self.positions)  # new sign - old sign: +-2
        for level in range(1, levels):
            row = self.matrix[level - 1].copy()
            at = self.positions[level - 1]
            row[at] = -row[at]
            self.steps[level - 1] = 2 * row[at].astype(np.int64)
            self.matrix[level] = row

    @cached_property
    def doubled(self) -> np.ndarray:
        """Every level vector twice end to end, so that a rotation is a slice."""
        return np.hstack([self.matrix, self.matrix])

    def on(self, context):
        """Broadcast handle, one per application: L*D bytes, set by the parameters."""
        if context.applicationId not in self._handles:
            self._handles[context.applicationId] = context.broadcast(self)
        return self._handles[context.applicationId]

    def __getstate__(self):
        state = {k: v for k, v in self.__dict__.items() if k != "doubled"}
        return {**state, "_handles": {}}

    def width(self, n_features: int) -> int:
        """Distinct rotations: features f and f + D rotate alike and share counters."""
        return min(n_features, self.dimensionality)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(level, self.matrix[level].tolist()) for level in range(self.levels)]
        return spark.createDataFrame(rows, "level INT, hv ARRAY<TINYINT>")

    def bundle(self, counts: np.ndarray) -> np.ndarray:
        """Class vectors (classes, D) from counts (classes, features, levels).

        A class vector is a sum over rows and features of rotated level vectors,
        so it only depends on how often each (feature, level) pair occurs.
        """
        classes, width, _ = counts.shape
        dim = self.dimensionality
        if self._spectral(width, float(counts.sum(axis=(1, 2)).max(initial=0))):
            return np.stack([self._convolve(c) for c in counts])
        out = np.zeros((classes, dim), dtype=np.int64)
        base = self.matrix[0].astype(np.int64)
        block = max(1, (4 << 20) // (classes * dim))
        for left in range(0, width, block):
            part = counts[:, left:left + block, :]
            at_least = np.cumsum(part[:, :, ::-1], axis=2)[:, :, ::-1]
            spread = at_least[:, :, :1] * base
            for level in range(1, self.levels):
                spread[:, :, self.positions[level - 1]] += (
                    at_least[:, :, level, None] * self.steps[level - 1]
                )
            for f in range(spread.shape[1]):
                out += np.roll(spread[:, f, :], (left + f) % dim, axis=1)
        return out

    def score_table(self, class_vectors: np.ndarray, width: int) -> np.ndarray:
        """(features, levels, classes): dot product of each class vector with each
        rotated level vector. The dot product of an encoded row is the sum of its
        cells' entries, so rows need no encoding to be classified."""
        classes, dim = class_vectors.shape
        table = np.empty((width, self.levels, classes))
        if self._spectral(width, float(np.abs(class_vectors).max(initial=0)) * dim ** 0.5):
            for c in range(classes):
                self._correlate(class_vectors[c], table[:, :, c])
            return table
        base = self.matrix[0].astype(np.float64)
        steps = self.steps.astype(np.float64)
        for c in range(classes):
            twice = np.concatenate([class_vectors[c], class_vectors[c]]).astype(np.float64)
            windows = np.lib.stride_tricks.sliding_window_view(twice, dim)
            for f in range(width):
                seen = windows[f % dim]
                table[f, 0, c] = seen @ base
                table[f, 1:, c] = (seen[self.positions] * steps).sum(axis=1)
        np.cumsum(table, axis=1, out=table)
        return table

    def _spectral(self, width: int, length: float) -> bool:
        """Whether rotations are better summed as a circular convolution: many rotations,
        and values small enough for its rounding error to stay far below one half."""
        error = length * self.dimensionality ** 0.5 * 1e-14
        return width > 2 * self.levels and width <= self.dimensionality and error < 0.05

    def _spectra(self):
        """Spectra of the level vectors, a few levels at a time."""
        for top in range(0, self.levels, 64):
            at = slice(top, min(top + 64, self.levels))
            yield at, np.fft.rfft(self.matrix[at].astype(np.float64), axis=1)

    def _convolve(self, counts: np.ndarray) -> np.ndarray:
        dim = self.dimensionality
        total = np.zeros(dim // 2 + 1, dtype=np.complex128)
        for at, spectra in self._spectra():
            total += (np.fft.rfft(counts[:, at].T, n=dim, axis=1) * spectra).sum(axis=0)
        return np.rint(np.fft.irfft(total, n=dim)).astype(np.int64)

    def _correlate(self, vector: np.ndarray, out: np.ndarray) -> None:
        own = np.fft.rfft(vector.astype(np.float64))
        for at, spectra in self._spectra():
            dots = np.fft.irfft(own * spectra.conj(), n=self.dimensionality, axis=1)
            out[:, at] = np.rint(dots[:, :len(out)]).T


@lru_cache(maxsize=8)
def _changes(dimensionality: int, levels: int, seed: int) -> tuple:
    spark = SparkSession.active()
    found = sign_changes(spark, dimensionality, levels, seed).toPandas()
    grouped = {int(k): np.sort(v.to_numpy()) for k, v in found.groupby("level")["d"]}
    empty = np.empty(0, dtype=np.int64)
    return tuple(grouped.get(level, empty) for level in range(levels))


@lru_cache(maxsize=8)
def _memory(dimensionality: int, levels: int, seed: int) -> ItemMemory:
    return ItemMemory(dimensionality, levels, list(_changes(dimensionality, levels, seed)))


def load_item_memory(spark: SparkSession, dimensionality: int, levels: int,
                     seed: int) -> ItemMemory:
    """Item memory on the driver: at most D drawn positions are fetched (then cached)."""
    prepare(spark)
    return _memory(dimensionality, levels, seed)
