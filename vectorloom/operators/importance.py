"""Feature-importance ranking over repeated selections ``seed, run, feature``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.settings import check_percentage
from vectorloom.tables import attach_small


def selected_count(selections: DataFrame, by=("seed", "run")) -> DataFrame:
    """Number of selected features over all chunks."""
    return selections.groupBy(*by).agg(F.count(F.lit(1)).alias("n_selected"))


def last_run_per_seed(selections: DataFrame) -> DataFrame:
    """Selections of each seed's last run."""
    last = selections.groupBy("seed").agg(F.max("run").alias("run"))
    return attach_small(selections, last, ["seed", "run"], "left_semi")


def selection_frequency(selections: DataFrame) -> DataFrame:
    """``feature, n_selected, n_seeds``: how many seeds selected each feature.

    Distinct (feature, seed) pairs are formed first, so a feature selected by
    most seeds still aggregates in small pieces. A seed that selected nothing has one row
    with a null feature.
    """
    pairs = selections.where("feature IS NOT NULL").select("feature", "seed").distinct()
    counts = pairs.groupBy("feature").agg(F.count(F.lit(1)).alias("n_selected"))
    seeds = selections.select("seed").distinct().agg(F.count(F.lit(1)).alias("n_seeds"))
    return attach_small(
        counts.withColumn("_one", F.lit(1)), seeds.withColumn("_one", F.lit(1)), "_one"
    ).drop("_one")


def top_features(frequency: DataFrame, percentage: float | None = None,
                 keep: int | None = None) -> DataFrame:
    """Most often selected features: a percentage of the features, a fixed number,
    or all of them; ties by name."""
    order = [F.desc("n_selected"), "feature"]
    share = F.col("n_selected") / F.col("n_seeds")
    ranked = frequency.withColumn("frequency", share)
    if percentage is not None:
        check_percentage("percentage", percentage)
        total = frequency.count()
        keep = -int(-(total * percentage) // 100)
    ranked = ranked.orderBy(*order)
    return ranked if keep is None else ranked.limit(keep)


def permutation_p_value(observed: float, null_accuracy: DataFrame) -> DataFrame:
    """Empirical p-value of an accuracy against label-permuted replicates."""
    hits = F.sum((F.col("accuracy") >= F.lit(float(observed))).cast("int"))
    n = F.count(F.lit(1))
    return null_accuracy.agg(
        n.alias("n_replicates"),
        F.lit(float(observed)).alias("observed"),
        F.max("accuracy").alias("null_max"),
        F.avg("accuracy").alias("null_mean"),
        ((hits + 1) / (n + 1)).alias("p_value"),
    )
