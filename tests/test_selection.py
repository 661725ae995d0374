from hashlib import md5

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from test_models import blobs, fold_data, matrix
from vectorloom import backward_elimination, feature_importance
from vectorloom.functions import run_id
from vectorloom.operators import elimination, importance
from vectorloom.operators.permute import leave_one_out
from vectorloom.plans.selection import Elimination
from vectorloom.settings import Settings


def brute_elimination(x, y, names, k, dim, levels, seed, rules, passes=0):
    """Rounds of the elimination, scored subset by subset."""
    base, size, kept, runs = list(range(len(names))), None, [], []
    best, chosen = -1.0, set()
    subsets = [tuple(base)]
    while subsets:
        results = []
        for subset in subsets:
            tops = []
            for g in range(k):
                train_x, train_y, test_x, test_y = fold_data(x, y, k, g)
                h = brute.history(train_x[:, subset], train_y, test_x[:, subset], test_y,
                                  dim, levels, seed, passes)
                tops.append(max(s[2] for s in h))
            results.append((subset, round(np.mean(tops) + 1e-9, 2)))
        top = max(r[1] for r in results)
        kept = [r for r in results if r[1] >= top - top * rules.tolerance / 100]
        size = len(subsets[0])
        runs += [(size, r[1], tuple(sorted(names[p] for p in r[0]))) for r in kept]
        if top >= best:
            best, chosen = top, {size: sorted({names[p] for r in kept for p in r[0]})}
        if size - 1 < rules.group_min or top < rules.accuracy_threshold:
            break
        base = sorted(set.intersection(*(set(r[0]) for r in kept)))
        subsets = [tuple(p for p in base if p != out) for out in base] if len(base) > 1 else []
    return sorted(runs), best, chosen


@pytest.mark.parametrize("tolerance,passes", [(0.0, 0), (3.0, 0), (1.0, 1)])
def test_elimination_equals_brute_force(make_matrix, tolerance, passes):
    x, y = blobs(40, 5, 2, 11, spread=1.5)
    x[:, 2] *= 3  # dropping this feature changes the edges
    x[5] = x[9]
    names = ["e", "b", "d", "a", "c"]
    rules = Elimination(accuracy_threshold=0, tolerance=tolerance)
    found = backward_elimination(matrix(make_matrix, x, y), Settings(32, 4, 1, retrain=passes), rules,
                                 folds=3, names=names)
    runs, best, chosen = brute_elimination(x, y, names, 3, 32, 4, 1, rules, passes)
    got = sorted((r.group_size, r.accuracy, tuple(r.features)) for r in found.runs.collect())
    assert got == runs
    rows = found.selection.collect()
    assert {r.group_size: [s.feature for s in rows] for r in rows} == chosen
    assert {r.accuracy for r in rows} == {best}


def test_stopping_rules(make_matrix):
    x, y = blobs(40, 4, 2, 12)
    rows = matrix(make_matrix, x, y)
    low = backward_elimination(rows, Settings(16, 2), Elimination(accuracy_threshold=100), folds=2)
    assert {r.group_size for r in low.runs.collect()} <= {4, 3}
    one = backward_elimination(rows, Settings(16, 2), Elimination(group_min=4), folds=2)
    assert {r.group_size for r in one.runs.collect()} == {4}
    with pytest.raises(ValueError):
        backward_elimination(rows, Settings(16, 2), Elimination(group_min=5), folds=2)
    with pytest.raises(ValueError):
        backward_elimination(rows, Settings(16, 2))


RUNS = "run_id STRING, group_size INT, accuracy DOUBLE, features ARRAY<STRING>"


def test_tolerance_and_next_base(spark):
    runs = spark.createDataFrame([
        ("x", 3, 80.0, ["b", "c", "d"]), ("y", 3, 77.0, ["a", "b", "d"]),
        ("z", 3, 75.0, ["a", "c", "d"])], RUNS)
    kept = elimination.retain_runs(runs, 5.0)
    assert sorted(r.run_id for r in kept.collect()) == ["x", "y"]
    base = elimination.next_base(kept).first()
    assert (base.base, base.next_size) == (["b", "d"], 1)


def test_group_tie_takes_the_smaller(spark):
    runs = spark.createDataFrame([("x", 4, 90.0, ["a"]), ("y", 3, 90.0, ["b"]),
                                  ("z", 3, 90.0, ["c"])], RUNS)
    found = elimination.best_group(runs).collect()
    assert sorted((r.group_size, r.feature) for r in found) == [(3, "b"), (3, "c")]


def test_run_id(spark):
    df = spark.createDataFrame([(["b", "a"],)], "f ARRAY<STRING>")
    assert df.select(run_id("f")).first()[0] == md5(b"['a', 'b']").hexdigest()


def test_leave_one_out_matches_base(spark):
    df = spark.createDataFrame([(list("abcd"),)], "features ARRAY<STRING>")
    assert leave_one_out(df).filter(F.size("features") == 3).count() == 4


def test_importance(make_matrix):
    x, y = blobs(60, 7, 2, 13)
    names = [f"f{i}" for i in range(7)]
    found = feature_importance(matrix(make_matrix, x, y), Settings(32, 4), 3, [1, 2],
                               Elimination(accuracy_threshold=0), folds=3, names=names)
    sizes = {(r.seed, r.run): r.n_selected
             for r in importance.selected_count(found.selections).collect()}
    for seed in (1, 2):
        counts = [sizes[seed, run] for run in range(len([s for s in sizes if s[0] == seed]))]
        assert counts[-2] == counts[-3] if len(counts) > 2 else True
        assert all(a >= b for a, b in zip(counts, counts[1:]))
    last = importance.last_run_per_seed(found.selections).collect()
    want = {}
    for r in last:
        want.setdefault(r.feature, set()).add(r.seed)
    top = found.top().collect()
    assert {r.feature: r.n_selected for r in top} == {k: len(v) for k, v in want.items()}
    assert all(r.n_seeds == 2 for r in top)
    order = [(-r.n_selected, r.feature) for r in top]
    assert order == sorted(order)
    assert found.top(1).count() == 1


def test_p_value(spark):
    null = spark.createDataFrame([(v,) for v in (10.0, 20.0, 30.0)], "accuracy DOUBLE")
    row = importance.permutation_p_value(20.0, null).first()
    assert (row.n_replicates, row.null_max, row.p_value) == (3, 30.0, 0.75)


def test_importance_equals_brute_force(spark, make_matrix):
    """Chunks, fixpoint and final run, with every chunk searched by brute force."""
    from vectorloom.operators.permute import feature_chunks

    x, y = blobs(36, 6, 2, 14, spread=1.2)
    names = [f"f{i}" for i in range(6)]
    rules = Elimination(accuracy_threshold=0, tolerance=2.0)
    found = feature_importance(matrix(make_matrix, x, y), Settings(32, 4), 4, [3], rules,
                               folds=3, names=names)

    def picked(columns):
        _, _, chosen = brute_elimination(x[:, columns], y, [names[p] for p in columns], 3, 32, 4, 3,
                                         rules)
        return next(iter(chosen.values()))

    want, survivors, before, run = [], list(range(6)), 0, 0
    while True:
        table = spark.createDataFrame([(p, names[p]) for p in survivors], "pos INT, name STRING")
        chunks = {}
        for r in feature_chunks(table, 4, 3).collect():
            chunks.setdefault(r.chunk, []).append(r.pos)
        now = [(run, c, f) for c, columns in chunks.items() for f in picked(sorted(columns))]
        want += now
        survivors = sorted(names.index(f) for _, _, f in now)
        run += 1
        if len(now) == before:
            break
        before = len(now)
    want += [(run, 0, f) for f in picked(survivors)]
    got = [(r.run, r.chunk, r.feature) for r in found.selections.collect()]
    assert sorted(got) == sorted(want)
