"""Relational steps of backward feature elimination, on a table of runs
``run_id, group_size, accuracy, features, excluded`` (any extra key columns in ``by``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.tables import attach_small


def retain_runs(runs: DataFrame, tolerance: float = 5.0, by=()) -> DataFrame:
    """Runs whose accuracy is within ``tolerance`` percent of their group's best.

    The best is a partial aggregate joined back, so one huge group does not
    have to pass through a single window task.
    """
    keys = [*by, "group_size"]
    best = runs.groupBy(*keys).agg(F.max("accuracy").alias("_best"))
    limit = F.col("_best") - F.col("_best") * F.lit(float(tolerance)) / 100.0
    return attach_small(runs, best, keys).filter(F.col("accuracy") >= limit).drop("_best")


def next_base(retained: DataFrame, by=()) -> DataFrame:
    """Features that no retained run excluded, and the size of the next subsets."""
    keys = [*by, "group_size"]
    totals = retained.groupBy(*keys).agg(F.count(F.lit(1)).alias("_runs"))
    shared = (
        retained.select(*keys, F.explode("features").alias("feature"))
        .groupBy(*keys, "feature").agg(F.count(F.lit(1)).alias("_seen"))
    )
    kept = attach_small(shared, totals, keys).filter("_seen = _runs")
    return kept.groupBy(*keys).agg(
        F.array_sort(F.collect_list("feature")).alias("base")
    ).withColumn("next_size", F.size("base") - 1)


def best_group(retained: DataFrame, by=()) -> DataFrame:
    """Group with the best accuracy (the smaller one on ties), and the union of the
    features of its retained runs: ``by..., group_size, accuracy, feature``."""
    by = list(by)
    groups = retained.groupBy(*by, "group_size").agg(F.max("accuracy").alias("accuracy"))
    order = Window.partitionBy(*by).orderBy(F.desc("accuracy"), "group_size")
    winner = groups.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1")
    features = retained.select(*by, "group_size", F.explode("features").alias("feature")).distinct()
    return attach_small(features, winner.drop("_rank"), [*by, "group_size"])
