"""Random decomposition, label permutation and leave-one-out subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.functions.keys import key_bucket, order_key
from vectorloom.tables import attach_small, written

_BUCKET_DIGITS = 4


def hash_rank(df: DataFrame, key: str, tie: str, out: str, by=()) -> DataFrame:
    """Exact 1-based rank by a uniform hex key, without one global sort: rank inside
    key-prefix buckets and add the number of rows in the buckets before."""
    by = list(by)
    bucketed = df.withColumn("_bucket", key_bucket(F.col(key), _BUCKET_DIGITS))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        bucketed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(key, tie))
    return (
        bucketed.withColumn("_inside", inside)
        .join(offsets, [*by, "_bucket"])
        .withColumn(out, F.col("_inside") + F.col("_offset"))
        .drop("_bucket", "_inside", "_offset")
    )


def feature_chunks(feature_dim: DataFrame, chunk_size: int, seed: int = 0) -> DataFrame:
    """Shuffle the features and cut them into consecutive chunks of ``chunk_size``."""
    if chunk_size < 1:
        raise ValueError("chunk_size must be at least 1")
    keyed = feature_dim.withColumn("_key", order_key(seed, "name"))
    ranked = hash_rank(keyed, "_key", "name", "_rank")
    return ranked.withColumn(
        "chunk", F.floor((F.col("_rank") - 1) / F.lit(chunk_size)).cast("int")
    ).drop("_key", "_rank")


def ordered_rank(df: DataFrame, columns, out: str) -> DataFrame:
    """Exact 1-based rank by some columns, nulls first, without one global sort: rows are
    sorted within ranges whose boundaries Spark takes from a sample of the values, so ranges
    are of similar length however unevenly values lie, and every range adds the number of rows
    before it. Rows are written once, which fixes their places."""
    columns = list(columns)
    ranged = written(df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn(
        "_id", F.monotonically_increasing_id()))
    split = F.call_function("shiftright", F.col("_id"), F.lit(33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    starts = ranged.groupBy(split.alias("_range")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")).select(
        "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1)
        .alias("_shift"))
    return attach_small(ranged.withColumn("_range", split), starts, "_range").withColumn(
        out, F.col("_id") + F.col("_shift")).drop("_id", "_range", "_shift")


def label_permutations(matrix: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """``replicate, row_id, row_pos, label``: labels shuffled over the rows, once per
    replicate. Places are ranked by (``row_pos``, ``row_id``) and labels by a hash, and ranks
    are joined with ranks, so positions may be null or have gaps, offsets and repeats, and every
    row gets one label. Features are not copied; join them by ``row_id`` when a replicate is used."""
    slim = matrix.select("row_id", "row_pos", "label")
    each = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))
    keyed = slim.withColumn("replicate", each).withColumn(
        "_key", order_key(F.col("replicate"), F.lit(seed), "row_id"))
    drawn = hash_rank(keyed, "_key", "row_pos", "_rank", by=["replicate"]).select(
        "replicate", "_rank", "label")
    places = ordered_rank(slim.drop("label"), ["row_pos", "row_id"], "_rank")
    return places.withColumn("replicate", each).join(drawn, ["replicate", "_rank"]).drop("_rank")


def leave_one_out(sets: DataFrame, features: str = "features") -> DataFrame:
    """Every subset that lacks exactly one feature: adds ``excluded`` and shortens
    ``features``."""
    return sets.withColumn("excluded", F.explode(features)).withColumn(
        features, F.array_remove(F.col(features), F.col("excluded"))
    )
