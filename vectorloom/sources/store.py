"""Artifacts kept between runs, addressed by everything that determines them."""

from __future__ import annotations

import json
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.item_memory import item_memory, load_item_memory
from vectorloom.operators.encode import encode_rows
from vectorloom.sources.sinks import path_exists, remove_path
from vectorloom.tables import cut_lineage

# Changes whenever stored artifacts would no longer be equal.
FORMAT = 2


def fingerprint(matrix: DataFrame) -> str:
    """Order-independent digest of a matrix, one aggregate row."""
    row_hash = F.xxhash64("row_id", "row_pos", "label", "features")
    digest = matrix.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(row_hash).alias("x"),
        F.sum(row_hash.cast("decimal(38,0)")).alias("s"),
    ).first()
    return f"{digest.n}:{digest.x}:{digest.s}"


class ArtifactStore:
    """Parquet artifacts below ``root`` (a folder all executors share)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, kind: str, **key) -> str:
        text = json.dumps({"format": FORMAT, **key}, sort_keys=True, default=str)
        return f"{self.root}/{kind}/key={sha256(text.encode()).hexdigest()[:32]}"

    def has(self, kind: str, **key) -> bool:
        return path_exists(self.spark, self.path(kind, **key) + "/_SUCCESS")

    def load_or_build(self, build, kind: str, **key) -> DataFrame:
        """Read the artifact if it was completed before, else build and keep it."""
        path = self.path(kind, **key)
        if not self.has(kind, **key):
            build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def note(self, run: str, kind: str, key: str, **split) -> None:
        """Enter an artifact in the manifest of a run."""
        told = json.dumps(split, sort_keys=True, default=str)
        self.spark.createDataFrame([(kind, key, told)], "kind STRING, key STRING, split STRING") \
            .write.mode("append").parquet(f"{self.root}/manifest/run={run}")

    def manifest(self) -> DataFrame:
        """``run, kind, key, split``: the artifacts of every run."""
        if not path_exists(self.spark, f"{self.root}/manifest"):
            return self.spark.createDataFrame(
                [], "kind STRING, key STRING, split STRING, run STRING")
        schema = "kind STRING, key STRING, split STRING, run STRING"
        return self.spark.read.schema(schema).parquet(f"{self.root}/manifest")

    def item_memory(self, dimensionality: int, levels: int, seed: int,
                    run: str | None = None) -> DataFrame:
        key = dict(dimensionality=dimensionality, levels=levels, seed=seed)
        found = self.load_or_build(
            lambda: item_memory(self.spark, dimensionality, levels, seed), "levels", **key)
        if run is not None:
            self.note(run, "levels", self.path("levels", **key))
        return found

    def encoded(self, matrix: DataFrame, dimensionality: int, levels: int, seed: int,
                lo: float, hi: float, run: str | None = None, **split) -> DataFrame:
        """Encoded rows as ARRAY<INT>; ``split`` names the fold, side and feature list they
        belong to, ``run`` whose manifest they are entered in."""
        def build():
            memory = load_item_memory(self.spark, dimensionality, levels, seed)
            return encode_rows(matrix, memory, lo, hi, "int")

        key = dict(data=fingerprint(matrix), dimensionality=dimensionality, levels=levels,
                   seed=seed, lo=lo, hi=hi, **split)
        found = self.load_or_build(build, "encoded", **key)
        if run is not None:
            self.note(run, "encoded", self.path("encoded", **key), **split)
        return found

    def discard(self, kind: str, **key) -> bool:
        """Remove one artifact."""
        return remove_path(self.spark, self.path(kind, **key))

    def clean_up(self, run: str | None = None, keep_levels: bool = True) -> None:
        """Remove the encoded sets of a run, and its item memory too unless kept. What another
        run's manifest holds as well stays. Without a run everything goes."""
        if run is None:
            remove_path(self.spark, f"{self.root}/encoded")
            remove_path(self.spark, f"{self.root}/manifest")
            if not keep_levels:
                remove_path(self.spark, f"{self.root}/levels")
            return
        held = cut_lineage(self.manifest())
        mine = held.where(F.col("run") == run).select("kind", "key").distinct()
        others = held.where(F.col("run") != run).select("key").distinct()
        for row in mine.join(others, "key", "left_anti").toLocalIterator():
            if row.kind == "encoded" or not keep_levels:
                remove_path(self.spark, row.key)
        remove_path(self.spark, f"{self.root}/manifest/run={run}")
        if keep_levels:  # the run still answers for the item memory it keeps
            for row in mine.where("kind = 'levels'").collect():
                self.note(run, row.kind, row.key)

    def save_model(self, model, name: str) -> None:
        model.parameters(self.spark).write.mode("overwrite").parquet(
            f"{self.root}/models/{name}/parameters")
        model.class_vectors(self.spark).write.mode("overwrite").parquet(
            f"{self.root}/models/{name}/class_vectors")

    def load_model(self, name: str):
        from vectorloom.plans.model import HDModel

        base = f"{self.root}/models/{name}"
        return HDModel.restore(self.spark.read.parquet(f"{base}/parameters"),
                               self.spark.read.parquet(f"{base}/class_vectors"))
