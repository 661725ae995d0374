"""A fitted classifier that scores DataFrames, batch or streaming."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.item_memory import ItemMemory, load_item_memory
from vectorloom.operators import classify
from vectorloom.operators.bundle import Request
from vectorloom.operators.classify import Classifier
from vectorloom.plans.evaluate import PartStats, Spec, evaluate_models, train
from vectorloom.settings import Settings
from vectorloom.tables import prepare


@dataclass
class HDModel:
    """Edges, class vectors and item-memory parameters; small whatever the data."""

    settings: Settings
    labels: list[str]
    classifier: Classifier
    memory: ItemMemory

    def transform(self, matrix: DataFrame, similarity: bool = False) -> DataFrame:
        """Add ``guess``; works on streaming DataFrames as well."""
        prepare(matrix.sparkSession)
        rows = matrix.withColumn("part", F.lit(0))
        return classify.predict(rows, [self.classifier], self.labels, self.memory,
                                similarity).drop("part")

    def similarities(self, matrix: DataFrame) -> DataFrame:
        return classify.class_similarities(matrix, self.classifier, self.labels, self.memory)

    def class_vectors(self, spark: SparkSession) -> DataFrame:
        """``label, class_rank, hv``."""
        vectors = self.classifier.class_vectors(self.memory)
        rows = [
            (self.labels[c], rank, vectors[rank].tolist())
            for rank, c in enumerate(self.classifier.order)
        ]
        return spark.createDataFrame(rows, "label STRING, class_rank INT, hv ARRAY<BIGINT>")

    def parameters(self, spark: SparkSession) -> DataFrame:
        s, r = self.settings, self.classifier.request
        return spark.createDataFrame(
            [(s.dimensionality, s.levels, s.seed, r.lo, r.hi, len(r.positions))],
            "dimensionality INT, levels INT, seed BIGINT, lo DOUBLE, hi DOUBLE, n_features INT",
        )

    @classmethod
    def restore(cls, parameters: DataFrame, class_vectors: DataFrame) -> "HDModel":
        """Rebuild a model from its two stored tables."""
        spark = parameters.sparkSession
        p = parameters.first()
        settings = Settings(p.dimensionality, p.levels, p.seed)
        memory = load_item_memory(spark, p.dimensionality, p.levels, p.seed)
        rows = class_vectors.orderBy("class_rank").collect()
        labels = [r.label for r in rows]
        one = Classifier(0, Request(p.lo, p.hi, tuple(range(p.n_features))),
                         np.arange(len(rows)), np.array([r.hv for r in rows], dtype=np.int64),
                         (0,), (0,))
        return cls(settings, labels, one.ready(memory), memory)


class HDClassifier:
    """``fit`` bundles one vector per class (and retrains); ``HDModel.transform`` scores."""

    def __init__(self, **parameters):
        self.settings = Settings(**parameters)

    def fit(self, matrix: DataFrame) -> HDModel:
        """Train on all rows; with retraining, keep the iteration that fits them best."""
        rows = matrix.withColumn("part", F.lit(0))
        stats = PartStats(rows)
        spec = Spec("fit", (0,), (0,), tuple(range(stats.width)))
        if not self.settings.retrain:
            s = self.settings
            memory = load_item_memory(rows.sparkSession, s.dimensionality, s.levels, s.seed)
            return HDModel(s, stats.labels, train(
                rows, [(0, spec)], [stats.whole_range((0,))], s, stats, memory)[0], memory)
        result = evaluate_models(rows, [spec], self.settings, stats)
        return HDModel(self.settings, stats.labels, result.classifiers()[0], result.memory)
