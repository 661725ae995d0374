import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom import tables
from vectorloom.operators import permute, splits


def split_of(df):
    return {r.row_id: r.is_train for r in df.collect()}


def window_form(matrix, percentage, seed):
    from pyspark.sql import Window

    from vectorloom.functions import order_key

    keyed = matrix.withColumn("k", order_key(seed, "row_id"))
    w = Window.partitionBy("label")
    rank = F.row_number().over(w.orderBy("k", "row_id"))
    quota = F.floor(F.count(F.lit(1)).over(w) * percentage / 100.0)
    return split_of(keyed.withColumn("is_train", rank <= quota))


def test_split_counts(make_matrix):
    rows = make_matrix([("a", [i]) for i in range(5)] + [("b", [i]) for i in range(7)])
    found = splits.stratified_split(rows, 80, 0).filter("is_train").groupBy("label").count()
    assert {r.label: r["count"] for r in found.collect()} == {"a": 4, "b": 5}


@pytest.mark.parametrize("longest", [1_000_000, 1])
@pytest.mark.parametrize("percentage", [0, 1, 50, 99, 100])
def test_split_equals_full_sort(make_matrix, monkeypatch, longest, percentage):
    """Also with the bucket holding the cutoff split again and again."""
    monkeypatch.setattr(splits, "_SORTED_ROWS", longest)
    monkeypatch.setattr(splits, "_DIGITS", 1)
    rows = make_matrix([("ab"[i % 3 == 0], [i]) for i in range(400)], 5)
    assert split_of(splits.stratified_split(rows, percentage, 3)) == window_form(rows, percentage, 3)


def test_split_is_invariant(make_matrix):
    data = [("ab"[i % 2], [i]) for i in range(60)]
    one, many = make_matrix(data, 1), make_matrix(data, 17)
    assert split_of(splits.stratified_split(one, 70, 1)) == split_of(
        splits.stratified_split(many.orderBy(F.rand(1)), 70, 1))


def test_fold_exclusion_fixture(make_matrix):
    rows = make_matrix([("a", (1, 2)), ("a", (3, 4)), ("b", (5, 6)), ("b", (1, 2))])
    held = splits.kfold_held_out(rows, 2)
    train = splits.kfold_train_rows(held, 2).filter("fold = 0").collect()
    assert [r.row_id for r in train] == [1]


def test_folds_partition_rows(make_matrix):
    rows = make_matrix([("a", (i,)) for i in range(11)])
    assert sorted(r.fold for r in splits.kfold_assign(rows, 3).collect()) == sorted(
        i % 3 for i in range(11))


def test_exclusion_with_a_third_of_all_rows_equal(make_matrix):
    vectors = [[0.0] if i % 3 == 0 else [float(i)] for i in range(90)]
    rows = make_matrix([("a", v) for v in vectors])
    got = {(r.fold, r.row_id) for r in
           splits.kfold_train_rows(splits.kfold_held_out(rows, 4), 4).collect()}
    want = set()
    for fold in range(4):
        tested = [vectors[i] for i in range(90) if i % 4 == fold]
        want |= {(fold, i) for i in range(90) if vectors[i] not in tested}
    assert got == want


def test_bad_parameters(make_matrix):
    rows = make_matrix([("a", [1])])
    with pytest.raises(ValueError):
        splits.stratified_split(rows, 101)
    with pytest.raises(ValueError):
        splits.kfold_assign(rows, 1)


def test_chunks_fixture(spark):
    dim = spark.createDataFrame([(i, f"f{i}") for i in range(7)], "pos INT, name STRING")
    found = permute.feature_chunks(dim, 3, 0).groupBy("chunk").count().orderBy("chunk").collect()
    assert [(r.chunk, r["count"]) for r in found] == [(0, 3), (1, 3), (2, 1)]
    a = permute.feature_chunks(dim, 3, 0).collect()
    assert sorted(a) == sorted(permute.feature_chunks(dim.repartition(5), 3, 0).collect())


def test_label_permutations_keep_class_sizes(make_matrix):
    rows = make_matrix([("abc"[i % 3], [i]) for i in range(31)])
    found = permute.label_permutations(rows, 4, 0)
    sizes = found.groupBy("replicate", "label").count().collect()
    assert all(r["count"] == {"a": 11, "b": 10, "c": 10}[r.label] for r in sizes)
    orders = {tuple(x.label for x in sorted(found.filter(F.col("replicate") == r).collect(),
                                            key=lambda v: v.row_id)) for r in range(4)}
    assert len(orders) == 4


def test_leave_one_out(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "features ARRAY<STRING>")
    found = {r.excluded: r.features for r in permute.leave_one_out(df).collect()}
    assert found == {"a": ["b", "c"], "b": ["a", "c"], "c": ["a", "b"]}


def test_hash_rank_is_a_permutation(spark):
    df = spark.range(500).withColumn("k", F.md5(F.col("id").cast("string")))
    ranks = permute.hash_rank(df, "k", "id", "r").orderBy("k").collect()
    assert [r.r for r in ranks] == list(np.arange(1, 501))


def test_spread_partitions_grow_with_the_rows(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(1000).withColumnRenamed("id", "row_id")
    for megabytes in (1, 100):
        monkeypatch.setattr(tables, "estimated_bytes", lambda _, n=megabytes: n << 20)
        with tables.spread(rows, "row_id") as wide:
            assert wide.count() == 1000
            assert wide.rdd.getNumPartitions() == max(cores, megabytes // 4)
