"""Train, retrain and score many models over one set of rows."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.item_memory import ItemMemory, load_item_memory
from vectorloom.operators import bundle, classify, retrain
from vectorloom.operators.bundle import Request
from vectorloom.operators.classify import Classifier
from vectorloom.operators.matrix import has_missing
from vectorloom.operators.splits import kfold_held_out, stratified_split
from vectorloom.plans.rounds import extremes, feature_ranges
from vectorloom.settings import Settings
from vectorloom.tables import Scratch, attach_small, bounded_rows, prepare, spread

HISTORY = "model_id STRING, iteration INT, error DOUBLE, accuracy DOUBLE"
_MAX_STATS = 1_000_000


@dataclass(frozen=True)
class Spec:
    """A model to evaluate: which parts train it, which test it, which features it sees."""

    model_id: str
    train: tuple[int, ...]
    test: tuple[int, ...]
    positions: tuple[int, ...]


class PartStats:
    """Per part the value range, and per part and class the first row and the count: one row
    per (part, class) on the driver, small beside the data."""

    def __init__(self, rows: DataFrame):
        shape = rows.groupBy("part", "label").agg(
            F.min("row_pos").alias("first"), F.count(F.lit(1)).alias("n"),
            F.min(F.array_min("features")).alias("lo"), F.max(F.array_max("features")).alias("hi"),
            F.min(F.size("features")).alias("narrow"), F.max(F.size("features")).alias("wide"),
            F.count_if(has_missing(F.col("features"))).alias("missing"),
        )
        found = bounded_rows(shape, _MAX_STATS, "classes per part")
        if not found:
            raise ValueError("no rows")
        if min(r.narrow for r in found) != max(r.wide for r in found):
            raise ValueError("rows with different feature counts; run validate_matrix first")
        if nameless := sum(r.n for r in found if r.label is None):
            raise ValueError(f"{nameless} rows have no label; drop them first")
        if missing := sum(r.missing for r in found):
            raise ValueError(f"{missing} rows have missing (null or NaN) cells; "
                             "fill them or drop the rows first")
        self.width = found[0].wide
        self.labels = sorted({r.label for r in found})
        self.n_parts = max(r.part for r in found) + 1
        number = {label: i for i, label in enumerate(self.labels)}
        self.first = {}
        self.count = np.zeros((self.n_parts, len(self.labels)), dtype=np.int64)
        ranges = np.full((2, self.n_parts), np.nan)
        for r in found:
            self.first[r.part, number[r.label]] = r.first
            self.count[r.part, number[r.label]] = r.n
            ranges[0, r.part] = np.fmin(ranges[0, r.part], r.lo)
            ranges[1, r.part] = np.fmax(ranges[1, r.part], r.hi)
        self.lo, self.hi = ranges

    def whole_range(self, parts) -> tuple[float, float]:
        """Least and greatest value of all features."""
        return float(np.nanmin(self.lo[list(parts)])), float(np.nanmax(self.hi[list(parts)]))

    def order_of(self, parts) -> np.ndarray:
        """Class numbers by first row in the given (training) parts."""
        seen = {}
        for part in parts:
            for c in range(len(self.labels)):
                if (part, c) in self.first:
                    position = self.first[part, c]
                    seen[c] = min(position, seen.get(c, position))
        return np.array(sorted(seen, key=seen.get))

    def n_rows(self, parts) -> int:
        return int(self.count[list(parts)].sum())


def numbered_parts(rows: DataFrame, *columns: str) -> tuple[DataFrame, list]:
    """Replace the given columns by a part number; also the value of each part."""
    keys = rows.select(*columns).distinct().orderBy(*columns)
    found = bounded_rows(keys, 100_000, "parts")
    table = rows.sparkSession.createDataFrame(
        [(*r, i) for i, r in enumerate(found)],
        ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns) + ", part INT",
    )
    return attach_small(rows, table, list(columns)).drop(*columns), found


def parts_by_column(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("part", F.col(column).cast("int"))


def evaluate_models(rows: DataFrame, specs: list[Spec], settings: Settings,
                    stats: PartStats | None = None) -> "Evaluation":
    """Histories of all models. ``rows``: ``part, label, row_pos, features``."""
    spark = rows.sparkSession
    prepare(spark)
    given, rows = rows, rows.select("part", "label", "row_pos", "features")
    stats = stats or PartStats(rows)
    memory = load_item_memory(spark, settings.dimensionality, settings.levels, settings.seed)
    edges = edges_of(rows, specs, stats)
    for spec in specs:
        if not stats.n_rows(spec.test):
            raise ValueError(f"model {spec.model_id}: no test rows")
    online = settings.retrain and settings.retrain_mode == "online"
    bound = retrain.block_rows(stats.width, settings.dimensionality)
    small = [online and stats.n_rows(s.train) + stats.n_rows(s.test) <= bound for s in specs]
    history, final = {}, {}
    short = [i for i, is_small in enumerate(small) if is_small]
    long = [i for i, is_small in enumerate(small) if not is_small]
    if short:
        _run_small(rows, short, specs, edges, settings, stats, memory, history, final)
    if long:
        models = train(rows, [(i, specs[i]) for i in long], edges, settings, stats, memory)
        _run_passes(rows, models, settings, stats, memory, history, final)
    return Evaluation(given, specs, stats, memory, settings, history, final)


def edges_of(rows: DataFrame, specs: list[Spec], stats: PartStats) -> list[tuple[float, float]]:
    """Value range of every model's training cells. Those of feature subsets are looked up by
    tasks in a table of ranges per part and feature."""
    for spec in specs:
        if not stats.n_rows(spec.train):
            raise ValueError(f"model {spec.model_id}: no training rows")
    subsets = {(s.train, s.positions) for s in specs if len(s.positions) != stats.width}
    found = {}
    if subsets:
        wanted = sorted(subsets)
        ends = extremes(feature_ranges(rows), [(t, np.array(p)) for t, p in wanted], stats.width)
        found = {key: (e.lo, e.hi) for key, e in zip(wanted, ends, strict=True)}
    return [found[s.train, s.positions] if (s.train, s.positions) in found
            else stats.whole_range(s.train) for s in specs]


def train(rows: DataFrame, numbered: list[tuple[int, Spec]], edges, settings: Settings,
          stats: PartStats, memory: ItemMemory) -> list[Classifier]:
    """Untouched class vectors of every model; ``edges`` by model number. Models with the same
    edges share one count of the data; matrices too wide to count are encoded and summed."""
    union = {}
    for i, spec in numbered:
        union.setdefault(edges[i], set()).update(spec.positions)
    shared = {e: Request(*e, tuple(sorted(p))) for e, p in union.items()}
    per_position = stats.n_parts * len(stats.labels) * settings.levels
    specs_of = {}
    for i, spec in numbered:
        specs_of.setdefault(shared[edges[i]], []).append((i, spec))
    countable = [r for r in shared.values()
                 if memory.width(len(r.positions)) * per_position <= bundle.COUNT_CELLS
                 and _shareable(r, specs_of[r], memory)]
    models = []
    for group in _batches(countable, per_position, memory):
        tables = bundle.count_levels(rows, group, stats.n_parts, stats.labels, memory)
        for request, counts in zip(group, tables):
            models += _from_counts(rows, request, counts, specs_of[request], stats, memory)
    for request in shared.values():
        if request not in countable:
            models += _from_rows(rows, specs_of[request], edges, stats, memory)
    return sorted(models, key=lambda m: m.model)


def _shareable(request: Request, numbered, memory: ItemMemory) -> bool:
    """Counters stand for single features (needed to drop some), or every model uses all."""
    return len(request.positions) <= memory.dimensionality or all(
        spec.positions == request.positions for _, spec in numbered
    )


def _batches(requests: list[Request], per_position: int, memory: ItemMemory):
    group, size = [], 0
    for request in requests:
        cells = memory.width(len(request.positions)) * per_position
        if group and size + cells > bundle.COUNT_CELLS:
            yield group
            group, size = [], 0
        group.append(request)
        size += cells
    if group:
        yield group


def _from_counts(rows, request, counts, numbered, stats, memory) -> list[Classifier]:
    column = {p: i for i, p in enumerate(request.positions)}
    models = []
    for i, spec in numbered:
        order = stats.order_of(spec.train)
        mine = counts[list(spec.train)].sum(axis=0)[order]
        if spec.positions != request.positions:
            mine = mine[:, [column[p] for p in spec.positions]]
        own = Request(request.lo, request.hi, spec.positions)
        models.append(Classifier(i, own, order, None, spec.train, spec.test, mine))
    return classify.make_ready(rows.sparkSession.sparkContext, models, memory)


def _from_rows(rows, numbered, edges, stats, memory) -> list[Classifier]:
    models = []
    by_request = {}
    for i, spec in numbered:
        by_request.setdefault(Request(*edges[i], spec.positions), []).append((i, spec))
    requests = list(by_request)
    per_request = stats.n_parts * len(stats.labels) * memory.dimensionality * 8
    step = max(1, bundle.MODEL_BYTES // per_request)
    for top in range(0, len(requests), step):
        group = requests[top:top + step]
        sums = bundle.sum_encoded(rows, group, stats.labels, memory)
        vectors = bundle.fetch_vectors(sums, len(group), stats.n_parts, len(stats.labels),
                                       memory.dimensionality)
        for request, of_request in zip(group, vectors):
            for i, spec in by_request[request]:
                order = stats.order_of(spec.train)
                mine = of_request[list(spec.train)].sum(axis=0)[order]
                models.append(Classifier(i, request, order, mine, spec.train, spec.test)
                              .ready(memory))
    return models


def _run_small(rows, short, specs, edges, settings, stats, memory, history, final):
    models = [
        Classifier(i, Request(*edges[i], specs[i].positions),
                   stats.order_of(specs[i].train), np.zeros((0, 0)), specs[i].train, specs[i].test)
        for i in short
    ]
    steps = retrain.retrain_small(rows, models, stats.labels, memory, settings.retrain,
                                  settings.stop)
    by_number = {m.model: m for m in models}
    best = {}
    for row in steps.toLocalIterator():
        percent = _percent(row.right, row.n)
        history.setdefault(row.model, []).append((row.iteration, row.error, percent))
        if row.model not in best or percent > best[row.model]:
            best[row.model] = percent
            one = by_number[row.model]
            vectors = np.asarray(row.hv, dtype=np.int64).reshape(len(one.order), -1)
            one.vectors = vectors
            final[row.model] = one


def _run_passes(rows, models, settings, stats, memory, history, final):
    labels = stats.labels
    scored = classify.count_correct(rows, models, labels, memory)
    for m in models:
        percent = _percent(scored[m.model][1], scored[m.model][0])
        history[m.model] = [(0, None, percent)]
        final[m.model] = m
    if not settings.retrain:
        return
    online = settings.retrain_mode == "online"
    scratch = Scratch(rows.sparkSession)
    if online:
        n_rows = stats.n_rows(range(stats.n_parts))
        size = retrain.rows_per_block(n_rows, stats.width, settings.dimensionality)
        rows = retrain.numbered_blocks(rows, n_rows, size, scratch)
    else:
        rows = rows.persist()
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    active = list(models)
    try:
        for iteration in range(1, settings.retrain + 1):
            errors, moved = {}, []
            if online:
                for m in active:
                    vectors, wrong, n = retrain.online_pass(rows, m, labels, memory, parallel)
                    errors[m.model] = wrong / n
                    moved.append(retrain.updated(m, vectors, None))
            else:
                results = retrain.batch_pass(rows, active, labels, memory)
                for m in active:
                    vectors, counts, wrong, n = results[m.model]
                    errors[m.model] = wrong / n
                    moved.append(retrain.updated(m, vectors, counts))
            classify.make_ready(rows.sparkSession.sparkContext, moved, memory)
            scored = classify.count_correct(rows, moved, labels, memory)
            active = []
            for m in moved:
                percent = _percent(scored[m.model][1], scored[m.model][0])
                steps = history[m.model]
                if percent > max(s[2] for s in steps):
                    final[m.model] = m
                repeated = settings.stop and steps[-1][1] == errors[m.model]
                steps.append((iteration, errors[m.model], percent))
                if not repeated:
                    active.append(m)
            if not active:
                break
    finally:
        rows.unpersist()
        scratch.close()


def _percent(right: int, n: int) -> float:
    return round_half_up(100 * (right / n))


def round_half_up(value: float) -> float:
    """Two decimals, rounded as SQL does."""
    return float(Decimal(repr(value)).quantize(Decimal("0.01"), ROUND_HALF_UP))


class Evaluation:
    """Histories and best class vectors of a list of models."""

    def __init__(self, rows, specs, stats, memory, settings, history, final):
        self.rows, self.specs, self.stats = rows, specs, stats
        self.spark = rows.sparkSession
        self.memory, self.settings = memory, settings
        self.steps, self.final = history, final

    @property
    def history(self) -> DataFrame:
        """``model_id, iteration, error, accuracy``."""
        rows = [(self.specs[i].model_id, *step)
                for i in sorted(self.steps) for step in sorted(self.steps[i])]
        return self.spark.createDataFrame(rows, HISTORY)

    @property
    def best(self) -> DataFrame:
        """``model_id, accuracy, iteration``."""
        return classify.best_iteration(self.history)

    def best_scores(self) -> list[tuple[float, int]]:
        out = []
        for i in range(len(self.specs)):
            top = max(s[2] for s in self.steps[i])
            out.append((top, min(s[0] for s in self.steps[i] if s[2] == top)))
        return out

    def predictions(self, similarity: bool = False) -> DataFrame:
        """Test rows with ``guess`` from the best iteration of the model testing them."""
        tested = sorted({p for s in self.specs for p in s.test})
        return classify.predict(self.rows.filter(F.col("part").isin(tested)), self.classifiers(),
                                self.stats.labels, self.memory, similarity)

    def classifiers(self) -> list[Classifier]:
        return [self.final[i].ready(self.memory) for i in sorted(self.final)]


def holdout_rows(matrix: DataFrame, percentage: float, seed: int) -> DataFrame:
    """Part 1 trains, part 0 tests."""
    split = stratified_split(matrix, percentage, seed)
    return split.withColumn("part", F.col("is_train").cast("int")).drop("is_train")


def holdout_specs(positions) -> list[Spec]:
    return [Spec("holdout", (1,), (0,), tuple(positions))]


def fold_rows(matrix: DataFrame, k: int) -> tuple[DataFrame, list]:
    """Rows with the same fold and the same held-out folds form one part."""
    return numbered_parts(kfold_held_out(matrix, k), "fold", "held")


def fold_specs(parts: list, k: int, positions, prefix: str = "fold ") -> list[Spec]:
    positions = tuple(positions)
    return [
        Spec(f"{prefix}{g}",
             tuple(i for i, p in enumerate(parts) if g not in p.held),
             tuple(i for i, p in enumerate(parts) if p.fold == g), positions)
        for g in range(k)
    ]


@contextmanager
def split_once(rows: DataFrame, cached: bool):
    """Rows whose split is computed once where their source is small enough to be cached;
    larger ones compare their keys with the cutoffs in every scan."""
    if not cached:
        yield rows
        return
    rows = rows.persist()
    try:
        yield rows
    finally:
        rows.unpersist()


def holdout(matrix: DataFrame, percentage: float, settings: Settings) -> Evaluation:
    """Stratified percentage split, one model on all features."""
    slim = matrix.select("row_id", "row_pos", "label", "features")
    with spread(slim, "row_id") as wide, split_once(
            holdout_rows(wide, percentage, settings.seed), wide is not slim) as rows:
        stats = PartStats(rows)
        if stats.n_parts < 2 or not stats.count[1].sum():
            raise ValueError("the split leaves no training rows")
        return evaluate_models(rows, holdout_specs(range(stats.width)), settings, stats)


def cross_validate(matrix: DataFrame, k: int, settings: Settings) -> Evaluation:
    """Systematic folds, all models in the same jobs."""
    slim = matrix.select("row_pos", "label", "features")
    with spread(slim, "row_pos") as wide:
        rows, parts = fold_rows(wide, k)
        stats = PartStats(rows)
        return evaluate_models(rows, fold_specs(parts, k, range(stats.width)), settings, stats)


def holdout_replicates(rows: DataFrame, replicates: int, percentage: float,
                       settings: Settings) -> DataFrame:
    """``replicate, accuracy`` of label-permuted replicates (column ``replicate``), all
    in the same jobs. Each replicate is split by its own labels."""
    name = F.concat_ws(":", F.col("replicate"), F.col("label"))
    drawn = stratified_split(rows.withColumn("_label", F.col("label")).withColumn("label", name),
                             percentage, settings.seed)
    part = 2 * F.col("replicate") + F.col("is_train").cast("int")
    parted = drawn.select(part.cast("int").alias("part"), F.col("_label").alias("label"),
                          "row_pos", "features")
    with spread(parted, "row_pos") as parted:
        stats = PartStats(parted)
        positions = tuple(range(stats.width))
        specs = [Spec(str(r), (2 * r + 1,), (2 * r,), positions) for r in range(replicates)]
        best = evaluate_models(parted, specs, settings, stats).best
    return best.select(F.col("model_id").cast("int").alias("replicate"), "accuracy")
