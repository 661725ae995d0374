"""Backward feature elimination and the feature-importance search."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from hashlib import md5

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.functions.keys import run_id
from vectorloom.operators.importance import (
    last_run_per_seed,
    selection_frequency,
    top_features,
)
from vectorloom.plans.evaluate import (
    PartStats,
    Spec,
    evaluate_models,
    fold_rows,
    fold_specs,
    holdout_rows,
    round_half_up,
)
from vectorloom.plans.rounds import KEPT_CELLS, Counters, Round, feature_ranges, score_rounds
from vectorloom.settings import Settings, check_folds, check_percentage
from vectorloom.tables import prepare, spread


@dataclass(frozen=True)
class Elimination:
    """Stopping rules. ``strict_min`` also refuses groups that jump below ``group_min``."""

    group_min: int = 1
    accuracy_threshold: float = 60.0
    tolerance: float = 5.0
    strict_min: bool = False

    def __post_init__(self):
        if self.group_min < 1:
            raise ValueError("group_min must be at least 1")
        check_percentage("accuracy_threshold", self.accuracy_threshold)
        check_percentage("tolerance", self.tolerance)


@dataclass
class _Search:
    """One elimination under way (a chunk of features, a seed). Positions index the matrix.

    A run is a round and the position it leaves out (none in the first round); a position is in
    the base of every round up to the one in which it went. So a search holds as much as it has
    features, and the features of a run are put together by Spark when they are asked for."""

    chunk: int
    first: np.ndarray
    rules: Elimination
    seed: int
    base: np.ndarray = None
    number: int = -1
    whole: bool = True
    size: int = 0
    top: float = 0.0
    gone: dict[int, int] = field(default_factory=dict)
    runs: list[tuple] = field(default_factory=list)
    best: float = -np.inf
    best_size: int = 0
    selected: np.ndarray = None

    def start(self) -> Round:
        self.base = self.first
        return Round(self.seed, self.base, True)

    def next_round(self) -> Round | None:
        """Leave-one-out subsets of what every retained run kept; none ends the search."""
        if self.size - 1 < max(self.rules.group_min, 1) or self.top < self.rules.accuracy_threshold:
            return None
        dropped = [r[1] for r in self.runs if r[0] == self.number and r[1] is not None]
        self.base = np.setdiff1d(self.base, np.array(dropped, dtype=self.base.dtype))
        self.gone.update((p, self.number) for p in dropped)
        smaller = len(self.base) - 1
        if smaller < (self.rules.group_min if self.rules.strict_min else 1):
            return None
        self.whole = False
        return Round(self.seed, self.base, False)

    def take(self, accuracy: np.ndarray, iteration: np.ndarray) -> None:
        """The subsets' results, in the order of the positions they lack."""
        self.number += 1
        self.size = len(self.base) if self.whole else len(self.base) - 1
        self.top = float(accuracy.max())
        retained = np.flatnonzero(accuracy >= self.top - self.top * self.rules.tolerance / 100.0)
        dropped = [None] if self.whole else self.base[retained].tolist()
        self.runs += [(self.number, out, self.size, int(iteration[i]), float(accuracy[i]))
                      for out, i in zip(dropped, retained.tolist(), strict=True)]
        if self.top >= self.best:
            self.best, self.best_size = self.top, self.size
            # Two runs that each lack one position have all of them together.
            alone = dropped[0] if len(dropped) == 1 and not self.whole else None
            self.selected = self.base[self.base != alone] if alone is not None else self.base


@dataclass
class Selection:
    """Result tables of an elimination."""

    spark: SparkSession
    names: list[str]
    searches: list[_Search]

    @property
    def runs(self) -> DataFrame:
        """Retained runs of every round."""
        members = self.spark.createDataFrame(
            [(i, int(p), self.names[p], s.gone.get(int(p)))
             for i, s in enumerate(self.searches) for p in s.first],
            "m_search INT, pos INT, name STRING, gone INT")
        runs = self.spark.createDataFrame(
            [(i, s.chunk, *run) for i, s in enumerate(self.searches) for run in s.runs],
            "search INT, chunk INT, round INT, dropped INT, group_size INT, iteration INT, "
            "accuracy DOUBLE")
        inside = F.col("gone").isNull() | (F.col("gone") >= F.col("round"))
        kept = F.col("dropped").isNull() | (F.col("pos") != F.col("dropped"))
        listed = runs.join(members, (F.col("search") == F.col("m_search")) & inside).groupBy(
            "search", "chunk", "round", "dropped", "group_size", "iteration", "accuracy").agg(
            F.array_sort(F.collect_list(F.when(kept, F.col("name")))).alias("features"),
            F.array_sort(F.collect_list(F.when(~kept, F.col("name")))).alias("excluded"))
        return listed.select("chunk", run_id("features").alias("run_id"), "group_size",
                             "iteration", "accuracy", "features", "excluded")

    @property
    def selection(self) -> DataFrame:
        """``chunk, group_size, accuracy, feature``: the best group's features."""
        rows = [(s.chunk, s.best_size, s.best, self.names[p])
                for s in self.searches for p in sorted(s.selected, key=self.names.__getitem__)]
        return self.spark.createDataFrame(
            rows, "chunk INT, group_size INT, accuracy DOUBLE, feature STRING"
        )


class Prepared:
    """Rows split into parts once, with their statistics, for any number of searches.
    ``models``: training and test parts of each fold."""

    def __init__(self, rows: DataFrame, parts, folds: int | None):
        self.rows = rows.select("part", "label", "row_pos", "features").persist()
        self.parts, self.folds = parts, folds
        prepare(rows.sparkSession)
        self.stats = PartStats(self.rows)
        self.ranges = feature_ranges(self.rows)
        every = tuple(range(self.stats.width))
        self.models = [(s.train, s.test) for s in self.specs(every, "")]
        for train, test in self.models:
            if not train or not self.stats.n_rows(train):
                raise ValueError("the split leaves no training rows")
            if not test or not self.stats.n_rows(test):
                raise ValueError("the split leaves no test rows")
        self._counters: dict[int, Counters] = {}

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.rows.unpersist()

    def specs(self, positions: tuple[int, ...], prefix: str) -> list[Spec]:
        if self.folds:
            return fold_specs(self.parts, self.folds, positions, prefix)
        return [Spec(prefix + "holdout", (1,), (0,), positions)]

    def counters(self, levels: int) -> Counters:
        if levels not in self._counters:
            self._counters[levels] = Counters(self.rows, self.stats, levels)
        return self._counters[levels]


def score(prepared: Prepared, rounds: list[Round],
          settings: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """(accuracy, iteration) of every subset of every round, all in the same jobs. Without
    retraining the rows are walked once; with it each subset is a model of its own, as it is
    where the counters of a matrix are too many to keep."""
    if settings.retrain or prepared.counters(settings.levels).cells() > KEPT_CELLS:
        return _score_models(prepared, rounds, settings)
    out = []
    for shares in score_rounds(prepared, rounds, settings):
        tops = np.array([[round_half_up(float(v)) for v in fold] for fold in shares])
        mean = [round_half_up(sum(fold.tolist()) / len(fold)) for fold in tops.T]
        out.append((np.array(mean), np.zeros(len(mean), np.int64)))
    return out


def _score_models(prepared: Prepared, rounds: list[Round], settings: Settings):
    out: list = [None] * len(rounds)
    for seed in sorted({r.seed for r in rounds}):
        specs, owner = [], []
        for i, r in enumerate(rounds):
            if r.seed != seed:
                continue
            base = r.base.tolist()
            for j in [None] if r.whole else range(len(base)):
                own = prepared.specs(tuple(p for k, p in enumerate(base) if k != j), f"{i}:{j}:")
                specs += own
                owner += [(i, j or 0)] * len(own)
        result = evaluate_models(prepared.rows, specs, replace(settings, seed=seed), prepared.stats)
        scores = {}
        for key, found in zip(owner, result.best_scores(), strict=True):
            scores.setdefault(key, []).append(found)
        for i in sorted({i for i, _ in scores}):
            mine = [scores[key] for key in sorted(k for k in scores if k[0] == i)]
            out[i] = (np.array([round_half_up(sum(s[0] for s in m) / len(m)) for m in mine]),
                      np.array([sum(s[1] for s in m) // len(m) for m in mine]))
    return out


class _Frontier:
    """Searches of any number of seeds and chunks, a round of all of them at a time. A task is
    a generator that yields lists of searches and goes on when they have ended."""

    def __init__(self, prepared: Prepared, settings: Settings):
        self.prepared, self.settings = prepared, settings

    def run(self, tasks: list) -> None:
        waiting = [(t, next(t, None)) for t in tasks]
        pending = [(s, s.start()) for _, searches in waiting for s in searches or []]
        while pending:
            results = score(self.prepared, [r for _, r in pending], self.settings)
            for (search, _), found in zip(pending, results, strict=True):
                search.take(*found)
            pending = [(s, r) for s, _ in pending if (r := s.next_round()) is not None]
            alive = {id(s) for s, _ in pending}
            going = []
            for task, searches in waiting:
                if searches and not any(id(s) in alive for s in searches):
                    searches = next(task, None)
                    pending += [(s, s.start()) for s in searches or []]
                going.append((task, searches))
            waiting = going


def eliminate(prepared: Prepared, chunks: dict[int, list[int]], settings: Settings,
              rules: Elimination) -> list[_Search]:
    """Run the searches of all chunks side by side."""
    for positions in chunks.values():
        if rules.group_min > len(positions) and len(chunks) == 1:
            raise ValueError("group_min exceeds the number of features")
    searches = _searches(chunks, rules, settings.seed)
    _Frontier(prepared, settings).run([iter([searches])])
    return searches


def _searches(chunks: dict[int, list[int]], rules: Elimination, seed: int) -> list[_Search]:
    return [_Search(c, np.array(sorted(p)), rules, seed) for c, p in sorted(chunks.items())]


def leave_one_out_accuracy(matrix: DataFrame, settings: Settings, folds: int | None = None,
                           percentage: float | None = None,
                           names: list[str] | None = None) -> DataFrame:
    """``excluded, accuracy`` of every subset that lacks one feature."""
    names = _named(matrix, names)
    slim = matrix.select("row_id", "row_pos", "label", "features")
    with spread(slim, "row_id") as wide, \
            _prepare(wide, folds, percentage, settings.seed) as prepared:
        (accuracy, _), = score(
            prepared, [Round(settings.seed, np.arange(len(names)), False)], settings)
    return matrix.sparkSession.createDataFrame(
        list(zip(names, accuracy.tolist(), strict=True)), "excluded STRING, accuracy DOUBLE")


def _named(matrix: DataFrame, names: list[str] | None) -> list[str]:
    if names is not None:
        return names
    width = matrix.agg(F.max(F.size("features")).alias("n")).first().n
    return [str(i) for i in range(width)]


def _prepare(wide: DataFrame, folds: int | None, percentage: float | None,
             seed: int) -> Prepared:
    if (folds is None) == (percentage is None):
        raise ValueError("give either folds or percentage")
    if folds is not None:
        check_folds(folds)
        return Prepared(*fold_rows(wide, folds), folds)
    return Prepared(holdout_rows(wide, percentage, seed), None, None)


def backward_elimination(matrix: DataFrame, settings: Settings, rules: Elimination | None = None,
                         folds: int | None = None, percentage: float | None = None,
                         names: list[str] | None = None) -> Selection:
    """Drop features step by step while accuracy holds; see ``Elimination``."""
    names = _named(matrix, names)
    slim = matrix.select("row_id", "row_pos", "label", "features")
    with spread(slim, "row_id") as wide:
        with _prepare(wide, folds, percentage, settings.seed) as prepared:
            searches = eliminate(prepared, {0: list(range(len(names)))}, settings,
                                 rules or Elimination())
    return Selection(matrix.sparkSession, names, searches)


def select_in_chunks(matrix: DataFrame, settings: Settings, chunk_size: int,
                     rules: Elimination | None = None, folds: int | None = None,
                     percentage: float | None = None, names: list[str] | None = None) -> Selection:
    """Random decomposition into chunks of features, and one elimination per chunk, all
    chunks in the same jobs."""
    names = _named(matrix, names)
    position = {name: i for i, name in enumerate(names)}
    chunks = _chunks(names, chunk_size, settings.seed, position)
    slim = matrix.select("row_id", "row_pos", "label", "features")
    with spread(slim, "row_id") as wide, \
            _prepare(wide, folds, percentage, settings.seed) as prepared:
        searches = eliminate(prepared, chunks, settings, rules or Elimination())
    return Selection(matrix.sparkSession, names, searches)


@dataclass
class Importance:
    """``selections``: ``seed, run, chunk, feature`` of every run of every seed."""

    selections: DataFrame

    @property
    def frequency(self) -> DataFrame:
        return selection_frequency(last_run_per_seed(self.selections))

    def top(self, percentage: float | None = None) -> DataFrame:
        return top_features(self.frequency, percentage)


def feature_importance(matrix: DataFrame, settings: Settings, chunk_size: int, seeds,
                       rules: Elimination | None = None, folds: int | None = None,
                       percentage: float | None = None,
                       names: list[str] | None = None) -> Importance:
    """For each seed: cut the features into random chunks, eliminate in every chunk,
    repeat on the survivors until their number stays, then run once on all of them."""
    spark = matrix.sparkSession
    names = _named(matrix, names)
    position = {name: i for i, name in enumerate(names)}
    rules = rules or Elimination()
    slim = matrix.select("row_id", "row_pos", "label", "features")
    found: list[tuple] = []
    with spread(slim, "row_id") as wide, \
            _prepare(wide, folds, percentage, settings.seed) as prepared:
        _Frontier(prepared, settings).run([
            _seed_task(seed, names, position, chunk_size, rules, found) for seed in seeds])
    return Importance(spark.createDataFrame(
        sorted(found), "seed INT, run INT, chunk INT, feature STRING"))


def _seed_task(seed: int, names, position, chunk_size: int, rules: Elimination, found: list):
    """The searches of one seed, run after run."""
    survivors, before, run = list(names), 0, 0
    while True:
        searches = _searches(_chunks(survivors, chunk_size, seed, position), rules, seed)
        yield searches
        picked = [(s.chunk, names[p]) for s in searches for p in s.selected]
        found += [(seed, run, chunk, name) for chunk, name in picked]
        survivors = [name for _, name in picked]
        run += 1
        if len(picked) == before:
            break
        before = len(picked)
    if rules.group_min > len(survivors):
        raise ValueError("group_min exceeds the number of features")
    last = _searches({0: [position[n] for n in survivors]}, rules, seed)
    yield last
    found += [(seed, run, 0, names[p]) for p in last[0].selected]


def _chunks(survivors, chunk_size: int, seed: int, position) -> dict[int, list[int]]:
    """The decomposition of operators.permute.feature_chunks for a list of names."""
    if chunk_size < 1:
        raise ValueError("chunk_size must be at least 1")
    drawn = sorted(survivors, key=lambda n: (md5(f"{seed}:{n}".encode()).hexdigest(), n))
    return {i // chunk_size: [position[n] for n in drawn[i:i + chunk_size]]
            for i in range(0, len(drawn), chunk_size)}
