"""Train/test splits: exact stratified percentage and systematic folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.functions.keys import order_key
from vectorloom.settings import check_folds, check_percentage
from vectorloom.tables import attach_small, cut_lineage

# Each histogram splits a class into 16**3 buckets by key prefix; the bucket holding the
# last drawn row is split again while it is longer than one task should sort.
_DIGITS = 3
_SORTED_ROWS = 1_000_000
# Bytes of distinct copied vectors that may be broadcast.
COPIES_BYTES = 64 << 20


def stratified_split(matrix: DataFrame, percentage: float, seed: int = 0,
                     row_id: str = "row_id") -> DataFrame:
    """Add ``is_train``: exactly floor(n * percentage / 100) rows of each class.

    Rows are drawn by the rank of md5(seed:row_id) in their class. Instead of
    sorting whole classes, a histogram of key prefixes finds the bucket holding
    the last drawn row, only that bucket is ranked, and every row is compared
    with the resulting cutoff key, so the rows themselves are never shuffled.
    """
    check_percentage("percentage", percentage)
    key = order_key(seed, row_id)
    # Rows that share an id are told apart by their position, where there is one.
    place = F.col("row_pos") if "row_pos" in matrix.columns else F.lit(0)
    slim = matrix.select("label", F.col(row_id).alias("_id"), key.alias("_key"),
                         place.alias("_place"))
    n = F.sum("n").over(Window.partitionBy("label"))
    quota = F.floor(n * F.lit(percentage) / 100.0)
    digits = _DIGITS
    holding, longest = _holding_bucket(slim, digits, quota)
    while longest > _SORTED_ROWS and digits < 30:
        digits += _DIGITS
        inside = attach_small(slim.withColumn("_bucket", _prefix(digits - _DIGITS)), holding,
                              ["label", "_bucket"])
        wanted = F.max("take").over(Window.partitionBy("label"))
        holding, longest = _holding_bucket(inside, digits, wanted, "take")
    inside = attach_small(slim.withColumn("_bucket", _prefix(digits)), holding,
                          ["label", "_bucket"])
    rank = F.row_number().over(Window.partitionBy("label").orderBy("_key", "_id", "_place"))
    cutoff = (
        inside.withColumn("_rank", rank)
        .filter(F.col("_rank") == F.col("take"))
        .select("label", F.col("_key").alias("_last_key"), F.col("_id").alias("_last_id"),
                F.col("_place").alias("_last_place"))
    )
    drawn = F.struct(key, F.col(row_id), place) <= F.struct(
        "_last_key", "_last_id", "_last_place")
    return (
        attach_small(matrix, cutoff, "label", "left")
        .withColumn("is_train", F.coalesce(drawn, F.lit(False)))
        .drop("_last_key", "_last_id", "_last_place")
    )


def _prefix(digits: int):
    return F.substring("_key", 1, digits)


def _holding_bucket(keyed: DataFrame, digits: int, quota, *carried: str):
    """``label, _bucket, n, take``: the bucket with the class's last drawn row, its length
    and how many of its rows are drawn; also the longest such bucket."""
    counts = keyed.groupBy("label", _prefix(digits).alias("_bucket"), *carried).agg(
        F.count(F.lit(1)).alias("n")
    )
    before = Window.partitionBy("label").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    below = F.coalesce(F.sum("n").over(before), F.lit(0))
    placed = counts.withColumn("_below", below).withColumn("_quota", quota)
    found = placed.filter("_below < _quota and _quota <= _below + n").select(
        "label", "_bucket", "n", (F.col("_quota") - F.col("_below")).alias("take")
    )
    found = cut_lineage(found)  # one row per class, however many there are
    return found, found.agg(F.max("n")).first()[0] or 0


def kfold_assign(matrix: DataFrame, k: int) -> DataFrame:
    """Add ``fold``: row position modulo k, no shuffling."""
    check_folds(k)
    return matrix.withColumn("fold", F.pmod(F.col("row_pos"), F.lit(k)).cast("int"))


def kfold_held_out(matrix: DataFrame, k: int) -> DataFrame:
    """Add ``fold`` and ``held``, the sorted folds whose training set lacks the row:
    its own fold and every fold that tests an exact copy of its feature vector.

    Only 64-bit hashes are shuffled to find vectors present in several folds;
    the full vectors of just those candidates are then compared, and the result
    joins the rows by position and hash, so no vector is a hot join key for the
    whole table.
    """
    rows = kfold_assign(matrix, k).withColumn("_hash", F.xxhash64("features"))
    spread = (
        rows.groupBy("_hash")
        .agg(F.min("fold").alias("a"), F.max("fold").alias("b"))
        .filter("a < b")
        .select("_hash")
    )
    if spread.isEmpty():
        return rows.drop("_hash").withColumn("held", F.array("fold"))
    candidates = attach_small(rows.select("row_pos", "_hash", "features", "fold"), spread,
                              "_hash", "left_semi")
    copies = (
        candidates.groupBy("_hash", "features")
        .agg(F.array_sort(F.collect_set("fold")).alias("_folds"))
        .filter(F.size("_folds") > 1)
    )
    width = rows.agg(F.max(F.size("features"))).first()[0]
    longest = max(1, COPIES_BYTES // (8 * width + 64))
    members = attach_small(candidates, copies, ["_hash", "features"], limit=longest)
    # Positions may repeat: with the vector's hash a row finds its own folds, and once.
    folds_of_row = members.select("row_pos", "_hash", "_folds").distinct()
    return (
        attach_small(rows, folds_of_row, ["row_pos", "_hash"], "left")
        .withColumn("held", F.coalesce("_folds", F.array("fold")))
        .drop("_folds", "_hash")
    )


def kfold_train_rows(held: DataFrame, k: int) -> DataFrame:
    """One row per (training set, row): ``fold`` becomes the fold being tested."""
    folds = F.sequence(F.lit(0), F.lit(k - 1))
    return held.withColumn("fold", F.explode(F.array_except(folds, F.col("held")))).drop("held")
