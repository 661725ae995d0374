"""Similarity to class vectors, prediction and accuracy."""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from vectorloom import kernels
from vectorloom.item_memory import ItemMemory
from vectorloom.operators.bundle import Request, label_index
from vectorloom.tables import attach_small, checkpoint_dir, cut_lineage

# A score table up to this size is shipped instead of encoding rows.
TABLE_BYTES = 16 << 20
# Score tables a Python worker may build for itself when they are too large to ship.
WORKER_TABLE_BYTES = 256 << 20
# Classifiers broadcast together.
SHIPPED_BYTES = 64 << 20
# Rows dealt to one copy of a model when there are too many models to broadcast.
DEALT_ROWS = 100_000
# Multiplications the driver may spend on building score tables itself.
DRIVER_WORK = 1 << 27


@dataclass
class Classifier:
    """One model as tasks need it. ``order`` lists the class numbers present in the
    training rows by first appearance: the earlier class wins ties."""

    model: int
    request: Request
    order: np.ndarray
    vectors: np.ndarray | None
    train: tuple[int, ...] = ()
    test: tuple[int, ...] = ()
    counts: np.ndarray | None = None
    table: np.ndarray | None = None
    inverse: np.ndarray = field(default=None)

    def ready(self, memory: ItemMemory) -> "Classifier":
        """Fill in what scoring needs from the counters or class vectors."""
        if self.vectors is None:
            self.vectors = memory.bundle(self.counts)
        self.inverse = kernels.inverse_norms(self.vectors.astype(np.float64))
        if self.table_bytes(memory) <= TABLE_BYTES:
            self.build_table(memory)
        return self

    def class_vectors(self, memory: ItemMemory) -> np.ndarray:
        """The class vectors, bundled from the counters again if tasks dropped them."""
        return memory.bundle(self.counts) if self.vectors is None else self.vectors

    def table_bytes(self, memory: ItemMemory) -> int:
        return memory.width(len(self.request.positions)) * memory.levels * len(self.order) * 8

    def build_table(self, memory: ItemMemory) -> None:
        self.table = memory.score_table(self.vectors, memory.width(len(self.request.positions)))

    def slim(self) -> "Classifier":
        """Without what scoring does not need."""
        vectors = None if self.table is not None else self.vectors
        return Classifier(self.model, self.request, self.order, vectors, self.train, self.test,
                          None, self.table, self.inverse)

    def work(self, memory: ItemMemory) -> int:
        return len(self.order) * len(self.request.positions) * memory.dimensionality

    def n_bytes(self) -> int:
        return next(a.nbytes for a in (self.table, self.counts, self.vectors) if a is not None)

    def dots(self, levels: np.ndarray, memory: ItemMemory) -> np.ndarray:
        """(rows, classes) dot products of encoded rows with class vectors."""
        if self.table is not None:
            rotations, _, classes = self.table.shape
            out = np.empty((len(levels), classes))
            step = max(1, (1 << 21) // (levels.shape[1] * classes))
            at = np.arange(levels.shape[1]) % rotations
            for top in range(0, len(levels), step):
                out[top:top + step] = self.table[at, levels[top:top + step]].sum(axis=1)
            return out
        classes = self.vectors.astype(np.float64).T
        out = np.empty((len(levels), classes.shape[1]))
        step = max(1, (16 << 20) // (8 * len(classes)))
        for top in range(0, len(levels), step):
            out[top:top + step] = kernels.encode(levels[top:top + step], memory.doubled) @ classes
        return out

    def guess(self, levels: np.ndarray, memory: ItemMemory) -> np.ndarray:
        """Class number per row. The row's own length scales all classes alike and
        is left out."""
        scores = self.dots(levels, memory) * self.inverse
        return self.order[kernels.first_best(scores)]


def in_shipments(classifiers: list[Classifier]):
    """Groups of classifiers small enough to broadcast together."""
    group, size = [], 0
    for one in classifiers:
        if group and size + one.n_bytes() > SHIPPED_BYTES:
            yield group
            group, size = [], 0
        group.append(one)
        size += one.n_bytes()
    if group:
        yield group


def make_ready(context, models: list[Classifier], memory: ItemMemory) -> list[Classifier]:
    """Score tables of all models: here when that is little work, else by Spark tasks.
    Models made by tasks keep their counters and drop their class vectors."""
    if sum(m.work(memory) for m in models) < DRIVER_WORK:
        return [m.ready(memory) for m in models]
    here = [m for m in models if m.counts is None]
    there = [m for m in models if m.counts is not None]
    shared = memory.on(context)
    for group in in_shipments(there):
        tasks = min(len(group), 4 * context.defaultParallelism)
        made = context.parallelize(group, tasks).map(
            lambda m: (m.model, *_scoring_parts(m, shared.value))
        )
        found = {model: parts for model, *parts in made.collect()}
        for m in group:
            m.table, m.inverse, m.vectors = found[m.model]
    for m in here:
        m.ready(memory)
    return models


def _scoring_parts(model: Classifier, memory: ItemMemory):
    model.ready(memory)
    return model.table, model.inverse, None if model.table is not None else model.vectors


class Shipped:
    """Classifiers to broadcast. Tables too large to send are built once per Python
    worker from the class vectors, when they fit together."""

    def __init__(self, classifiers: list[Classifier]):
        self.classifiers = [c.slim() for c in classifiers]

    def ready(self, memory: ItemMemory) -> list[Classifier]:
        missing = [c for c in self.classifiers if c.table is None]
        if missing and sum(c.table_bytes(memory) for c in missing) <= WORKER_TABLE_BYTES:
            for c in missing:
                c.build_table(memory)
        return self.classifiers


class LevelCache:
    """Levels of one batch for each request, computed once."""

    def __init__(self, x: np.ndarray, n_levels: int):
        self.x, self.n_levels, self.found = x, n_levels, {}

    def of(self, request: Request, chosen: np.ndarray) -> np.ndarray:
        edges = (request.lo, request.hi)
        if edges not in self.found:
            self.found[edges] = kernels.quantise(self.x, *edges, self.n_levels)
        levels = self.found[edges]
        if len(request.positions) == levels.shape[1]:
            return levels[chosen]
        return levels[np.ix_(chosen, request.positions)]


def count_correct(rows: DataFrame, classifiers: list[Classifier], labels: list[str],
                  memory: ItemMemory) -> dict[int, tuple[int, int]]:
    """model -> (rows scored, rows right) over each model's test parts."""
    out = {}
    for group in in_shipments(classifiers):
        for row in _count_correct(rows, group, labels, memory):
            out[row.model] = (row.n, row.right)
    return out


def _count_correct(rows, classifiers, labels, memory) -> list:
    context = rows.sparkSession.sparkContext
    shared, shipped = memory.on(context), context.broadcast(Shipped(classifiers))
    names, n_levels = pa.array(labels), memory.levels
    wanted = sorted({p for c in classifiers for p in c.test})

    def tally(batches):
        ready = shipped.value.ready(shared.value)
        seen = np.zeros((len(ready), 2), dtype=np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cache = LevelCache(kernels.feature_matrix(batch.column("features")), n_levels)
            part = batch.column("part").to_numpy(zero_copy_only=False)
            label = label_index(batch.column("label"), names)
            for i, one in enumerate(ready):
                chosen = np.flatnonzero(np.isin(part, one.test))
                if len(chosen):
                    guess = one.guess(cache.of(one.request, chosen), shared.value)
                    seen[i] += len(chosen), int((guess == label[chosen]).sum())
        ids = np.array([c.model for c in ready], dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(seen[:, 0]), pa.array(seen[:, 1])],
            names=["model", "n", "right"],
        )

    tested = rows.filter(F.col("part").isin(wanted)).select("part", "label", "features")
    found = (
        tested.mapInArrow(tally, "model INT, n BIGINT, right BIGINT")
        .groupBy("model").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))
    ).collect()
    shipped.destroy()
    return found


def predict(rows: DataFrame, classifiers: list[Classifier], labels: list[str],
            memory: ItemMemory, similarity: bool = False) -> DataFrame:
    """Add ``guess`` (and ``similarity``, the cosine to the guessed class) to rows with
    ``part`` and ``features``; each row is scored by the model testing its part. Rows with a
    null or NaN cell get no guess. Few models are broadcast; many meet their rows in a shuffle,
    so that the rows are read once for any number of models."""
    groups = list(in_shipments(classifiers))
    if len(groups) == 1:
        return _predict(rows, groups[0], labels, memory, similarity)
    return _predict_dealt(rows, groups, labels, memory, similarity)


def _scored(one: Classifier, levels: np.ndarray, memory: ItemMemory, similarity: bool):
    """Class number and cosine of each row."""
    scores = one.dots(levels, memory) * one.inverse
    best = kernels.first_best(scores)
    cosine = np.full(len(best), np.nan)
    if similarity:
        length = row_lengths(levels, memory.doubled)
        with np.errstate(all="ignore"):
            cosine = scores[np.arange(len(best)), best] / length
    return one.order[best], cosine


def _guesses(guess: np.ndarray, cosine: np.ndarray, labels: list[str]) -> pa.StructArray:
    names = pa.array(labels, pa.string()).take(pa.array(guess, mask=guess < 0))
    return pa.StructArray.from_arrays(
        [names, pa.array(cosine, mask=np.isnan(cosine))], names=["guess", "similarity"])


def _whole_rows(features: pa.Array) -> np.ndarray:
    """Which rows have cells and none of them null or NaN."""
    good = features.is_valid().to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(features).fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(features)), sizes)
    values = features.flatten().to_numpy(zero_copy_only=False)  # nulls come as NaN
    good = good & (sizes > 0)
    good[rows[np.isnan(values)]] = False
    return good


def _predict_dealt(rows, groups, labels, memory, similarity) -> DataFrame:
    """Rows are dealt to groups of one model and at most about ``DEALT_ROWS`` rows; a copy of the
    model comes first in each group. Tasks hold one model and a batch of rows."""
    spark = rows.sparkSession
    shared, n_levels = memory.on(spark.sparkContext), memory.levels
    folder = f"{checkpoint_dir(spark)}/models-{uuid4().hex}"
    model_of = {}
    for group in groups:
        spark.createDataFrame(
            [(c.model, bytearray(pickle.dumps(c.slim()))) for c in group],
            "model INT, payload BINARY").write.mode("append").parquet(folder)
        model_of.update((p, c.model) for c in group for p in c.test)
    names = spark.createDataFrame(list(model_of.items()), "m_part INT, m_model INT")
    sizes = attach_small(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")), names,
                         F.col("part") == F.col("m_part")).select(
        F.col("part").alias("m_part"), F.col("m_model").alias("model"),
        F.ceil(F.col("n") / DEALT_ROWS).cast("int").alias("salts"))
    sizes = cut_lineage(sizes)
    packed = F.struct(*[rows[f"`{c}`"] for c in rows.columns if c != "features"]).alias("row")
    kept = rows.select(packed, "part", "features")
    salt = F.pmod(F.xxhash64("row"), F.col("salts")).cast("int")
    dealt = attach_small(kept, sizes, F.col("part") == F.col("m_part")).select(
        "model", salt.alias("salt"), F.lit(1).alias("kind"), F.lit(None).cast("binary")
        .alias("payload"), "row", "features")
    copies = sizes.groupBy("model").agg(F.max("salts").alias("salts"))
    models = spark.read.parquet(folder).join(copies, "model").select(
        "model", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        F.lit(0).alias("kind"), "payload", F.lit(None).cast(dealt.schema["row"].dataType)
        .alias("row"), F.lit(None).cast(dealt.schema["features"].dataType).alias("features"))
    order = ["model", "salt", "kind"]
    ordered = models.union(dealt).repartition("model", "salt").sortWithinPartitions(*order)
    row_type = dealt.schema["row"]

    def score(batches):
        one = None
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            at = 0
            while at < len(kind):
                if kind[at] == 0:
                    one = pickle.loads(batch.column("payload")[at].as_py())
                    if one.table is None and one.table_bytes(shared.value) <= WORKER_TABLE_BYTES:
                        one.build_table(shared.value)
                    at += 1
                    continue
                model = np.flatnonzero(kind[at:] == 0)
                some = batch.slice(at, int(model[0]) if len(model) else None)
                at += some.num_rows
                features = some.column("features")
                good = np.flatnonzero(_whole_rows(features))
                guess, cosine = np.full(some.num_rows, -1), np.full(some.num_rows, np.nan)
                if len(good):
                    x = kernels.feature_matrix(features.take(pa.array(good)))
                    guess[good], cosine[good] = _scored(
                        one, one.request.levels(x, n_levels), shared.value, similarity)
                yield pa.RecordBatch.from_arrays(
                    [some.column("row"), _guesses(guess, cosine, labels)],
                    names=["row", "scored"])

    out = StructType([row_type, StructField("scored", StructType([
        StructField("guess", StringType()), StructField("similarity", DoubleType())]))])
    scored = ordered.mapInArrow(score, out)
    return scored.select("row.*", "scored.guess", *(["scored.similarity"] if similarity else []))


def _predict(rows, classifiers, labels, memory, similarity) -> DataFrame:
    context = rows.sparkSession.sparkContext
    shared, shipped = memory.on(context), context.broadcast(Shipped(classifiers))
    n_levels = memory.levels

    def score(part: pa.Array, features: pa.Array) -> pa.Array:
        part = part.to_numpy(zero_copy_only=False)
        guess, cosine = np.full(len(part), -1), np.full(len(part), np.nan)
        good = np.flatnonzero(_whole_rows(features))
        if len(good) < len(part):
            features, own = features.take(pa.array(good)), part[good]
        else:
            own = part
        cache = LevelCache(kernels.feature_matrix(features), n_levels)
        for one in shipped.value.ready(shared.value):
            chosen = np.flatnonzero(np.isin(own, one.test))
            if len(chosen):
                levels = cache.of(one.request, chosen)
                guess[good[chosen]], cosine[good[chosen]] = _scored(
                    one, levels, shared.value, similarity)
        return _guesses(guess, cosine, labels)

    scored = F.arrow_udf(score, "guess STRING, similarity DOUBLE")
    out = rows.withColumn("_scored", scored("part", "features"))
    out = out.withColumn("guess", F.col("_scored.guess"))
    if similarity:
        out = out.withColumn("similarity", F.col("_scored.similarity"))
    return out.drop("_scored", "features")


def row_lengths(levels: np.ndarray, doubled: np.ndarray) -> np.ndarray:
    out = np.empty(len(levels))
    step = max(1, (16 << 20) // (4 * doubled.shape[1]))
    for top in range(0, len(levels), step):
        hv = kernels.encode(levels[top:top + step], doubled).astype(np.float64)
        out[top:top + step] = np.sqrt(np.einsum("rd,rd->r", hv, hv))
    return out


def class_similarities(matrix: DataFrame, one: Classifier, labels: list[str],
                       memory: ItemMemory) -> DataFrame:
    """``..., label_guess, class_rank, similarity``: one row per row and class, read
    from a per-row array, so no join of rows with classes is needed."""
    context = matrix.sparkSession.sparkContext
    shared, shipped = memory.on(context), context.broadcast(Shipped([one]))
    n_levels = memory.levels

    @F.arrow_udf("array<double>")
    def cosines(features: pa.Array) -> pa.Array:
        model = shipped.value.ready(shared.value)[0]
        levels = model.request.levels(kernels.feature_matrix(features), n_levels)
        scores = model.dots(levels, shared.value) * model.inverse
        length = row_lengths(levels, shared.value.doubled)
        with np.errstate(all="ignore"):
            table = scores / np.where(length > 0, length, np.nan)[:, None]
        return kernels.list_column(table, pa.float64())

    names = F.array(*[F.lit(labels[c]) for c in one.order])
    scored = matrix.withColumn("_all", cosines("features")).drop("features")
    return scored.select(
        *[c for c in scored.columns if c != "_all"],
        F.posexplode_outer("_all").alias("class_rank", "similarity"),
    ).withColumn("class_label", F.get(names, F.col("class_rank"))).withColumn(
        "similarity", F.when(~F.isnan("similarity"), F.col("similarity"))
    )


def accuracy(predictions: DataFrame, by=()) -> DataFrame:
    """Percent of right guesses, two decimals."""
    right = F.avg((F.col("guess") == F.col("label")).cast("int"))
    return predictions.groupBy(*by).agg(F.round(100 * right, 2).alias("accuracy"))


def best_iteration(history: DataFrame, by=("model_id",)) -> DataFrame:
    """Best accuracy and the first iteration that reaches it."""
    return history.groupBy(*by).agg(
        F.max("accuracy").alias("accuracy"),
        F.max_by("iteration", F.struct("accuracy", -F.col("iteration"))).alias("iteration"),
    )


def fold_mean(best: DataFrame, by=("run_id",)) -> DataFrame:
    """Mean of the folds' best accuracies and floor of the mean iteration."""
    return best.groupBy(*by).agg(
        F.round(F.avg("accuracy"), 2).alias("accuracy"),
        F.floor(F.avg("iteration")).cast("int").alias("iteration"),
    )
