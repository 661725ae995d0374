"""Shared rounds, many models, replicates and positions against the plain ways."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from test_models import blobs, matrix
from vectorloom import HDClassifier, cross_validate, feature_importance
from vectorloom.operators import classify
from vectorloom.operators import matrix as mx
from vectorloom.operators import permute
from vectorloom.plans import evaluate as ev
from vectorloom.plans import replicates, rounds, selection
from vectorloom.plans.selection import Elimination
from vectorloom.settings import Settings


@pytest.mark.parametrize("dim,width,folds,block", [
    (64, 6, 3, None), (16, 40, 3, None), (32, 9, None, 1), (33, 5, 2, 700)])
def test_walk_equals_separate_models(make_matrix, monkeypatch, dim, width, folds, block):
    if block:
        monkeypatch.setattr(rounds, "BLOCK_BYTES", 8 * dim * block)
    x, y = blobs(60, width, 3, 5, spread=1.5)
    x[7, 2], x[11, 4] = 50.0, -40.0  # two features hold the ends of the range
    rows = matrix(make_matrix, x, y)
    settings = Settings(dim, 5, 3)
    base = np.array([p for p in range(width) if p != 3])
    wanted = [selection.Round(3, np.arange(width), False), selection.Round(3, base, False),
              selection.Round(3, base, True), selection.Round(4, base, False)]
    with selection._prepare(rows, folds, None if folds else 70, 3) as prepared:
        found = selection.score(prepared, wanted, settings)
        want = selection._score_models(prepared, wanted, settings)
    for (a, _), (b, _) in zip(found, want, strict=True):
        assert a.tolist() == b.tolist()


def test_walk_with_few_counters_at_a_time(make_matrix, monkeypatch):
    x, y = blobs(50, 7, 2, 8)
    rows = matrix(make_matrix, x, y)
    wanted = [selection.Round(0, np.arange(7), False)]
    with selection._prepare(rows, 3, None, 0) as prepared:
        whole = selection.score(prepared, wanted, Settings(32, 4))
        monkeypatch.setattr(rounds, "SHIPPED_CELLS", 1)
        monkeypatch.setattr(rounds.bundle, "COUNT_CELLS", 60)
        prepared._counters.clear()
        again = selection.score(prepared, wanted, Settings(32, 4))
    assert whole[0][0].tolist() == again[0][0].tolist()


def test_extremes(spark):
    rng = np.random.default_rng(1)
    lo, hi = rng.integers(0, 9, (4, 12)).astype(float), rng.integers(9, 20, (4, 12)).astype(float)
    table = spark.createDataFrame(
        [(p, f, float(lo[p, f]), float(hi[p, f])) for p in range(4) for f in range(12)],
        "part INT, pos INT, lo DOUBLE, hi DOUBLE").repartition(3)
    wanted = [((0, 2), np.array([1, 4, 7])), ((1,), np.arange(12)), ((0, 1, 2, 3), np.array([5, 6]))]
    for (parts, positions), e in zip(wanted, rounds.extremes(table, wanted, 12), strict=True):
        for out in positions:
            rest = [p for p in positions if p != out]
            own = np.ix_(parts, rest)
            assert e.without(out) == (lo[own].min(), hi[own].max())
        own = np.ix_(parts, positions)
        assert (e.lo, e.hi) == (lo[own].min(), hi[own].max())


def test_seeds_share_their_rounds(make_matrix, monkeypatch):
    x, y = blobs(40, 6, 2, 3)
    rows, calls = matrix(make_matrix, x, y), []
    real = selection.score
    monkeypatch.setattr(selection, "score", lambda *a: calls.append(len(a[1])) or real(*a))
    counts = []
    for seeds in ([1], [1, 2, 3]):
        calls.clear()
        feature_importance(rows, Settings(16, 3), 3, seeds, Elimination(accuracy_threshold=0), folds=2)
        counts.append((len(calls), max(calls)))
    assert counts[1][0] <= counts[0][0] + 4 and counts[1][1] > counts[0][1]


def test_driver_holds_no_subsets(make_matrix):
    """A search keeps a number per feature and run, whatever the number of subsets."""
    x, y = blobs(40, 12, 2, 4)
    rows = matrix(make_matrix, x, y)
    with selection._prepare(rows, 2, None, 0) as prepared:
        search, = selection.eliminate(prepared, {0: list(range(12))}, Settings(16, 3),
                                      Elimination(accuracy_threshold=0, tolerance=0.0))
    assert len(search.runs) <= 13 and len(search.gone) <= 12 and len(search.base) <= 12


def many_models(make_matrix):
    x, y = blobs(80, 6, 3, 9)
    return cross_validate(matrix(make_matrix, x, y), 5, Settings(64, 4))


def test_many_models_meet_their_rows(make_matrix, monkeypatch):
    found = many_models(make_matrix)
    columns = ["row_pos", "label", "guess", "similarity"]
    few = sorted(map(tuple, found.predictions(similarity=True).select(columns).collect()))
    monkeypatch.setattr(classify, "SHIPPED_BYTES", 1)
    monkeypatch.setattr(classify, "DEALT_ROWS", 7)
    many = sorted(map(tuple, found.predictions(similarity=True).select(columns).collect()))
    assert [m[:3] for m in many] == [f[:3] for f in few] and len(few) == 80
    assert np.allclose([m[3] for m in many], [f[3] for f in few])


def test_missing_cells_get_no_guess(spark, make_matrix):
    x, y = blobs(30, 4, 2, 6)
    model = HDClassifier(dimensionality=32, levels=4).fit(matrix(make_matrix, x, y))
    rows = spark.createDataFrame([(0, [1.0, 2.0, 3.0, 4.0]), (1, [1.0, None, 3.0, 4.0]),
                                  (2, [1.0, float("nan"), 3.0, 4.0]), (3, None)],
                                 "row_id BIGINT, features ARRAY<DOUBLE>")
    guess = {r.row_id: r.guess for r in model.transform(rows, similarity=True).collect()}
    assert guess[0] is not None and guess[1] is guess[2] is guess[3] is None


def test_rows_without_label_are_refused(make_matrix):
    x, y = blobs(20, 3, 2, 6)
    rows = matrix(make_matrix, x, y).withColumn(
        "label", F.when(F.col("row_id") > 2, F.col("label")))
    with pytest.raises(ValueError, match="3 rows have no label"):
        HDClassifier(dimensionality=16, levels=2).fit(rows)


@pytest.mark.parametrize("small", [False, True])
def test_replicates_equal_separate_evaluations(make_matrix, monkeypatch, small):
    if small:
        monkeypatch.setattr(replicates, "ROW_BYTES", 400)
    x, y = blobs(50, 5, 3, 2, spread=2.0)
    x[4, 1] = 30.0  # the range depends on the side this row falls on
    rows, settings = matrix(make_matrix, x, y), Settings(32, 4, 1)
    found = replicates.permutation_accuracy(rows, 7, 70, settings)
    shuffled = permute.label_permutations(rows, 7, 1).drop("row_pos").join(
        rows.drop("label"), "row_id")
    want = ev.holdout_replicates(shuffled, 7, 70, settings)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_replicates_refuse_bad_rows(make_matrix):
    x, y = blobs(20, 3, 2, 2)
    rows = matrix(make_matrix, x, y)
    with pytest.raises(ValueError):
        replicates.permutation_accuracy(rows.where("row_id < 0"), 2, 70, Settings(16, 2))
    bad = rows.withColumn("features", F.when(F.col("row_id") == 1, F.array(
        *[F.lit(None).cast("double")] * 3)).otherwise(F.col("features")))
    with pytest.raises(ValueError, match="1 rows have missing"):
        replicates.permutation_accuracy(bad, 2, 70, Settings(16, 2))


def test_ranks_with_null_and_far_positions(spark):
    """Null positions keep their rows, and one far position does not pile up the others."""
    rows = [(i, i if i % 7 else None, "ab"[i % 2]) for i in range(70)] + [(99, 10 ** 15, "a")]
    table = spark.createDataFrame(rows, "row_id BIGINT, row_pos BIGINT, label STRING")
    found = permute.label_permutations(table.repartition(5), 3, 0)
    counts = {r["replicate"]: (r.n, r.ids) for r in found.groupBy("replicate").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("ids")).collect()}
    assert counts == {i: (71, 71) for i in range(3)}
    labels = found.groupBy("replicate", "label").count().collect()
    assert {(r.label, r["count"]) for r in labels} == {("a", 36), ("b", 35)}
    ranked = permute.ordered_rank(table, ["row_pos", "row_id"], "rank").collect()
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert [r.row_id for r in sorted(ranked, key=lambda r: r["rank"])] == [r[0] for r in want]


def test_cells_keep_their_positions(spark):
    cells = spark.createDataFrame([
        ("s1", 0, 1.0), ("s1", 1, 2.0), ("s1", 2, 3.0), ("s2", 0, 4.0), ("s2", 2, 6.0), ("s3", 1, 7.0),
        ("s3", 1, 8.0)], "row_id STRING, pos INT, value DOUBLE").repartition(3)
    found = {r.row_id: r.features for r in mx.cells_to_matrix(cells).collect()}
    assert found == {"s1": [1, 2, 3], "s2": [4, None, 6], "s3": [None, 7, None]}
    filled = {r.row_id: r.features for r in mx.cells_to_matrix(cells, n_features=4, fill=0).collect()}
    assert filled == {"s1": [1, 2, 3, 0], "s2": [4, 0, 6, 0], "s3": [0, 7, 0, 0]}


def test_brute_force_is_the_core_one():
    assert hasattr(brute, "history")
