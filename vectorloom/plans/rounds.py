"""Rounds of feature elimination: all leave-one-out subsets of many searches in one scan.

Leaving out position j of a base rotates all later features back by one. An encoded row without
j and one without j + 1 differ in a single rotated level vector, and so do the class vectors, so
a task walks j over a block of rows with two accumulators, one for the rows and one for the
classes, and scores every subset on its way. What a task holds is a block of rows, the class
vectors and the counters of the training rows; nothing grows with the number of subsets.

Value ranges of the subsets come from a table of ranges per part and feature, searched by tasks:
only the two least and two greatest features of a training set matter, since leaving out one
feature changes a range only if that feature alone holds its end. Those few subsets have edges
of their own and are scored apart, in the same scan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom import kernels
from vectorloom.item_memory import ItemMemory, load_item_memory
from vectorloom.operators import bundle
from vectorloom.operators.bundle import Request, label_index
from vectorloom.operators.classify import LevelCache
from vectorloom.settings import Settings
from vectorloom.tables import written

# Bytes of encoded rows a task holds while it walks.
BLOCK_BYTES = 32 << 20
# Counters (int64) of the training sets that are broadcast together.
SHIPPED_CELLS = 1 << 23
# Counters of all edges kept between rounds.
KEPT_CELLS = 1 << 25


# ---- value ranges --------------------------------------------------------------------------


def task_ranges(batches):
    """Least and greatest value of each feature in a task's rows, one row per part."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        if batch.num_rows == 0:
            continue
        x = kernels.feature_matrix(batch.column("features"))
        part = batch.column("part").to_numpy()
        for p in np.unique(part):
            own = x[part == p]
            both = np.stack([own.min(axis=0), own.max(axis=0)])
            if p in held:
                both = np.stack([np.minimum(held[p][0], both[0]), np.maximum(held[p][1], both[1])])
            held[p] = both
    for p, (lo, hi) in held.items():
        yield pa.RecordBatch.from_arrays([
            pa.array([int(p)], pa.int32()), kernels.list_column(lo[None], pa.float64()),
            kernels.list_column(hi[None], pa.float64())], names=["part", "lo", "hi"])


def feature_ranges(rows: DataFrame) -> DataFrame:
    """``part, pos, lo, hi``, merged by Spark and kept as a table."""
    ranges = rows.select("part", "features").mapInArrow(
        task_ranges, "part INT, lo ARRAY<DOUBLE>, hi ARRAY<DOUBLE>")
    cells = ranges.select("part", F.posexplode(F.arrays_zip("lo", "hi")).alias("pos", "v"))
    return written(cells.groupBy("part", "pos").agg(
        F.min("v.lo").alias("lo"), F.max("v.hi").alias("hi")))


@dataclass(frozen=True)
class Extremes:
    """Value range of some features in some parts. ``lo_pos`` holds the least value, and
    without that feature it is ``next_lo``; the same for the greatest."""

    lo: float
    lo_pos: int
    next_lo: float
    hi: float
    hi_pos: int
    next_hi: float

    def without(self, pos: int) -> tuple[float, float]:
        return (self.next_lo if pos == self.lo_pos else self.lo,
                self.next_hi if pos == self.hi_pos else self.hi)

    def holders(self) -> set[int]:
        """Features whose absence changes the range."""
        return ({self.lo_pos} if self.next_lo != self.lo else set()) | (
            {self.hi_pos} if self.next_hi != self.hi else set())


def _two_least(value: np.ndarray, pos: np.ndarray) -> list[tuple[float, int]]:
    """The least value and the least one of another feature."""
    if not len(value):
        return []
    first = int(np.argmin(value))
    rest = np.flatnonzero(pos != pos[first])
    out = [(float(value[first]), int(pos[first]))]
    if len(rest):
        second = rest[int(np.argmin(value[rest]))]
        out.append((float(value[second]), int(pos[second])))
    return out


def extremes(ranges: DataFrame, wanted: list[tuple[tuple[int, ...], np.ndarray]],
             width: int) -> list[Extremes]:
    """For each (parts, positions) the range of the cells. Tasks return at most four values per
    entry of ``wanted``; those of ranges of one feature have no next one (infinite)."""
    context = ranges.sparkSession.sparkContext
    shared = context.broadcast([(np.array(parts), np.asarray(positions))
                                for parts, positions in wanted])

    def search(batches):
        found: dict[tuple, list] = {}
        for batch in batches:
            part, pos = batch.column("part").to_numpy(), batch.column("pos").to_numpy()
            lo, hi = batch.column("lo").to_numpy(), batch.column("hi").to_numpy()
            for i, (parts, positions) in enumerate(shared.value):
                inside = np.zeros(width, bool)
                inside[positions] = True
                own = np.flatnonzero(inside[pos] & np.isin(part, parts))
                for side, value in enumerate((lo, -hi)):
                    old = found.get((i, side), [])
                    some = _two_least(value[own], pos[own])
                    found[i, side] = _merge(old + some)
        flat = [(i, side, v, p) for (i, side), both in found.items() for v, p in both]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in flat], pa.int32()), pa.array([r[1] for r in flat], pa.int32()),
             pa.array([r[2] for r in flat], pa.float64()), pa.array([r[3] for r in flat], pa.int32())],
            names=["entry", "side", "value", "pos"])

    rows = ranges.mapInArrow(search, "entry INT, side INT, value DOUBLE, pos INT").collect()
    shared.destroy()
    held: dict[tuple, list] = {}
    for r in rows:
        held.setdefault((r.entry, r.side), []).append((r.value, r.pos))
    out = []
    for i in range(len(wanted)):
        ends = []
        for side, sign in ((0, 1.0), (1, -1.0)):
            both = _merge(held[i, side])
            after = both[1][0] if len(both) > 1 else np.inf
            ends += [sign * both[0][0], both[0][1], sign * after]
        out.append(Extremes(*ends))
    return out


def _merge(found: list[tuple[float, int]]) -> list[tuple[float, int]]:
    least: dict[int, float] = {}
    for value, pos in found:
        least[pos] = min(value, least.get(pos, value))
    return sorted((v, p) for p, v in least.items())[:2]


# ---- walks -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Walk:
    """Subsets of ``base`` to score: all that lack one position, or (``whole``) base itself.
    ``table`` numbers the counters of the training rows, ``memory`` the item memory."""

    memory: int
    table: int
    edges: tuple[float, float]
    base: np.ndarray
    whole: bool
    test: tuple[int, ...]
    order: np.ndarray

    @property
    def subsets(self) -> int:
        return 1 if self.whole else len(self.base)


def _hits(rows: np.ndarray, classes: np.ndarray, order: np.ndarray, label: np.ndarray) -> int:
    vectors = classes.astype(np.float64)
    scores = (rows @ vectors.T) * kernels.inverse_norms(vectors)
    return int((order[kernels.first_best(scores)] == label).sum())


def _walk(levels: np.ndarray, label: np.ndarray, counts: np.ndarray, one: Walk,
          memory: ItemMemory, right: np.ndarray) -> None:
    """Add the right guesses of a block of rows for every subset. ``counts``: (classes,
    positions of base, levels)."""
    if one.whole:
        rows = kernels.encode(levels, memory.doubled).astype(np.float64)
        right[0] += _hits(rows, _bundled(counts, memory), one.order, label)
        return
    rows = kernels.encode(levels[:, 1:], memory.doubled).astype(np.float64)
    classes = _bundled(counts[:, 1:], memory)
    dim, last = memory.dimensionality, len(one.base) - 1
    for j in range(last + 1):
        right[j] += _hits(rows, classes, one.order, label)
        if j < last:
            start = dim - j % dim
            turned = memory.doubled[:, start:start + dim]
            rows += turned[levels[:, j]]
            rows -= turned[levels[:, j + 1]]
            step = (counts[:, j] - counts[:, j + 1]).astype(np.float64)
            classes += np.rint(step @ turned.astype(np.float64)).astype(np.int64)


def _bundled(counts: np.ndarray, memory: ItemMemory) -> np.ndarray:
    """Class vectors; features that rotate alike share counters."""
    wide, dim = counts.shape[1], memory.dimensionality
    if wide > dim:
        folded = np.zeros((counts.shape[0], dim, counts.shape[2]), np.int64)
        for left in range(0, wide, dim):
            some = counts[:, left:left + dim]
            folded[:, :some.shape[1]] += some
        counts = folded
    return memory.bundle(counts)


def count_right(rows: DataFrame, walks: list[Walk], tables: list[np.ndarray],
                memories: list[ItemMemory], labels: list[str]) -> list[np.ndarray]:
    """Right guesses of every subset of every walk, from one scan of the rows."""
    context = rows.sparkSession.sparkContext
    handles = [m.on(context) for m in memories]
    shared = context.broadcast((walks, tables))
    names = pa.array(labels)
    wanted = sorted({p for w in walks for p in w.test})

    def tally(batches):
        own_walks, own_tables = shared.value
        right = [np.zeros(w.subsets, np.int64) for w in own_walks]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = kernels.feature_matrix(batch.column("features"))
            part = batch.column("part").to_numpy(zero_copy_only=False)
            label = label_index(batch.column("label"), names)
            caches: dict[int, LevelCache] = {}
            for i, one in enumerate(own_walks):
                memory = handles[one.memory].value
                chosen = np.flatnonzero(np.isin(part, one.test))
                block = max(1, BLOCK_BYTES // (8 * memory.dimensionality))
                cache = caches.setdefault(memory.levels, LevelCache(x, memory.levels))
                counts = own_tables[one.table][:, one.base]
                for top in range(0, len(chosen), block):
                    some = chosen[top:top + block]
                    levels = cache.of(Request(*one.edges, tuple(one.base)), some)
                    _walk(levels, label[some], counts, one, memory, right[i])
        sizes = [len(r) for r in right]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)),
             pa.array(np.concatenate([np.arange(s, dtype=np.int32) for s in sizes])),
             pa.array(np.concatenate(right))], names=["walk", "subset", "n"])

    tested = rows.filter(F.col("part").isin(wanted)).select("part", "label", "features")
    found = (tested.mapInArrow(tally, "walk INT, subset INT, n BIGINT")
             .groupBy("walk", "subset").agg(F.sum("n").alias("n"))).toArrow()
    shared.destroy()
    out = [np.zeros(w.subsets, np.int64) for w in walks]
    for i, j, n in zip(*(found.column(c).to_numpy() for c in ("walk", "subset", "n")),
                       strict=True):
        out[i][j] = n
    return out


# ---- rounds ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Round:
    """A base whose leave-one-out subsets (or which itself) is to be scored with a seed."""

    seed: int
    base: np.ndarray
    whole: bool


class Counters:
    """Occurrences (parts, classes, positions, levels) by edges, kept between rounds."""

    def __init__(self, rows: DataFrame, stats, levels: int):
        self.rows, self.stats, self.levels = rows, stats, levels
        self.kept: dict[tuple[float, float], np.ndarray] = {}

    def cells(self) -> int:
        return self.stats.n_parts * len(self.stats.labels) * self.stats.width * self.levels

    def of(self, edges: set[tuple[float, float]], memory: ItemMemory) -> dict:
        """The counters of all ``edges``; those not kept are counted together."""
        missing = sorted(edges - self.kept.keys())
        room = max(len(edges), KEPT_CELLS // self.cells())
        for old in [e for e in self.kept if e not in edges][:max(
                0, len(self.kept) + len(missing) - room)]:
            del self.kept[old]
        blocks = self._blocks(memory)
        size = self.cells() // len(blocks)
        step = max(1, bundle.COUNT_CELLS // max(size, 1))
        jobs = [(e, b) for e in missing for b in blocks]
        found: dict[tuple, list] = {}
        for top in range(0, len(jobs), step):
            group = jobs[top:top + step]
            tables = bundle.count_levels(
                self.rows, [Request(*e, b) for e, b in group], self.stats.n_parts,
                self.stats.labels, memory)
            for (e, _), table in zip(group, tables, strict=True):
                found.setdefault(e, []).append(table)
        for e, tables in found.items():
            self.kept[e] = np.concatenate(tables, axis=2)
        return {e: self.kept[e] for e in edges}

    def _blocks(self, memory: ItemMemory) -> list[tuple[int, ...]]:
        """Positions in blocks whose counters fit a job and stand for single features."""
        per = self.stats.n_parts * len(self.stats.labels) * self.levels
        size = min(memory.dimensionality, max(1, bundle.COUNT_CELLS // per))
        return [tuple(range(a, min(a + size, self.stats.width)))
                for a in range(0, self.stats.width, size)]


def score_rounds(prepared, rounds: list[Round], settings: Settings) -> list[np.ndarray]:
    """For each round the percentages right of its subsets, one row per model (fold). The rows
    are read once for all of them, and once more to count where edges are new."""
    stats, models = prepared.stats, prepared.models
    spark = prepared.rows.sparkSession
    seeds = sorted({r.seed for r in rounds})
    memories = [load_item_memory(spark, settings.dimensionality, settings.levels, s)
                for s in seeds]
    bases: dict[bytes, int] = {}
    wanted = []
    for r in rounds:
        key = r.base.tobytes()
        if key not in bases:
            bases[key] = len(wanted)
            wanted += [(train, r.base) for train, _ in models]
    ends = extremes(prepared.ranges, wanted, stats.width)

    planned = []  # (round, model, column or None for all, edges, base, whole)
    for i, r in enumerate(rounds):
        for g in range(len(models)):
            range_ = ends[bases[r.base.tobytes()] + g]
            planned.append((i, g, None, (range_.lo, range_.hi), r.base, r.whole))
            if not r.whole:
                planned += [
                    (i, g, int(np.searchsorted(r.base, pos)), range_.without(pos),
                     r.base[r.base != pos], True) for pos in sorted(range_.holders())]

    counters = prepared.counters(settings.levels)
    right: dict[int, np.ndarray] = {}
    for group in _shipments(planned, counters.cells() // stats.n_parts):
        counted = counters.of({planned[k][3] for k in group}, memories[0])
        tables, number, walks = [], {}, []
        for k in group:
            i, g, _, edges, base, whole = planned[k]
            train, test = models[g]
            order = stats.order_of(train)
            if (edges, g) not in number:
                number[edges, g] = len(tables)
                tables.append(counted[edges][list(train)].sum(axis=0)[order])
            walks.append(Walk(seeds.index(rounds[i].seed), number[edges, g], edges, base, whole,
                              test, order))
        for k, n in zip(group, count_right(prepared.rows, walks, tables, memories,
                                           stats.labels), strict=True):
            right[k] = n

    out = [np.zeros((len(models), 1 if r.whole else len(r.base))) for r in rounds]
    for k, (i, g, column, *_) in enumerate(planned):
        share = 100 * (right[k] / stats.n_rows(models[g][1]))
        if column is None:
            out[i][g] = share
        else:
            out[i][g, column] = share[0]
    return out


def _shipments(planned: list[tuple], cells: int):
    """Walks whose training counters may be broadcast together."""
    group: list[int] = []
    tables: set = set()
    for k, (_, g, _, edges, _, _) in enumerate(planned):
        if group and (edges, g) not in tables and (len(tables) + 1) * cells > SHIPPED_CELLS:
            yield group
            group, tables = [], set()
        group.append(k)
        tables.add((edges, g))
    if group:
        yield group
