import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom import HDClassifier, cross_validate, holdout
from vectorloom.item_memory import load_item_memory
from vectorloom.operators import bundle, classify, retrain
from vectorloom.plans import evaluate as ev
from vectorloom.settings import Settings


def blobs(n, width, classes, seed, spread=0.8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(classes, width))
    y = rng.integers(0, classes, n)
    x = centres[y] + spread * rng.normal(size=(n, width))
    return x, [f"c{v}" for v in y]


def matrix(make_matrix, x, y, partitions=4):
    return make_matrix(list(zip(y, x)), partitions)


def fold_data(x, y, k, g):
    at = np.arange(len(x)) % k == g
    tested = {tuple(r) for r in x[at]}
    keep = np.array([tuple(r) not in tested for r in x])
    return x[keep], [l for l, t in zip(y, keep) if t], x[at], [l for l, t in zip(y, at) if t]


def histories(result):
    out = {}
    for r in result.history.collect():
        out.setdefault(r.model_id, []).append((r.iteration, r.error, r.accuracy))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("mode", ["online", "batch"])
@pytest.mark.parametrize("stop", [False, True])
def test_cross_validation_equals_brute_force(make_matrix, mode, stop):
    x, y = blobs(60, 6, 3, 1)
    x[7] = x[8] = x[20]  # copies in several folds
    settings = Settings(40, 5, 2, retrain=4, stop=stop, retrain_mode=mode)
    found = histories(cross_validate(matrix(make_matrix, x, y), 3, settings))
    for g in range(3):
        want = brute.history(*fold_data(x, y, 3, g), 40, 5, 2, 4, stop, mode == "batch")
        assert found[f"fold {g}"] == want


def test_invariant_under_partitioning(make_matrix):
    x, y = blobs(50, 5, 3, 2)
    settings = Settings(32, 4, 0, retrain=2)
    runs = [histories(cross_validate(matrix(make_matrix, x, y, p).orderBy(F.rand(p)), 4, settings))
            for p in (1, 17)]
    assert runs[0] == runs[1]


def test_block_walk_equals_one_task(make_matrix, monkeypatch):
    """Online retraining split into blocks of 7 rows, speculating over several blocks."""
    x, y = blobs(80, 6, 3, 3, spread=0.3)
    settings = Settings(40, 5, 2, retrain=3)
    rows = matrix(make_matrix, x, y)
    whole = histories(cross_validate(rows, 2, settings))
    monkeypatch.setattr(retrain, "block_rows", lambda *_: 7)
    assert histories(cross_validate(rows, 2, settings)) == whole
    for g in range(2):
        assert whole[f"fold {g}"] == brute.history(*fold_data(x, y, 2, g), 40, 5, 2, 3)


@pytest.mark.parametrize("mode", ["online", "batch"])
def test_direct_path_equals_counting(make_matrix, monkeypatch, mode):
    """Matrices too wide to count or to tabulate take another road to the same result."""
    x, y = blobs(60, 30, 3, 4)
    settings = Settings(20, 6, 1, retrain=2, retrain_mode=mode)
    rows = matrix(make_matrix, x, y)
    monkeypatch.setattr(retrain, "block_rows", lambda *_: 16)
    counted = histories(cross_validate(rows, 3, settings))
    monkeypatch.setattr(bundle, "COUNT_CELLS", 0)
    monkeypatch.setattr(classify, "TABLE_BYTES", 0)
    monkeypatch.setattr(bundle, "PARTIAL_BYTES", 1)
    assert histories(cross_validate(rows, 3, settings)) == counted


def test_tables_made_by_tasks(make_matrix, monkeypatch):
    x, y = blobs(60, 8, 3, 5)
    settings = Settings(32, 4, 0, retrain=2, retrain_mode="batch")
    rows = matrix(make_matrix, x, y)
    here = histories(cross_validate(rows, 3, settings))
    monkeypatch.setattr(classify, "DRIVER_WORK", 0)
    monkeypatch.setattr(classify, "SHIPPED_BYTES", 1)
    assert histories(cross_validate(rows, 3, settings)) == here


def test_holdout_equals_brute_force(make_matrix):
    x, y = blobs(70, 5, 2, 6)
    rows = matrix(make_matrix, x, y)
    settings = Settings(64, 8, 0, retrain=2)
    result = holdout(rows, 70, settings)
    split = {r.row_id: r.part for r in ev.holdout_rows(rows, 70, 0).collect()}
    train = np.array([split[i] == 1 for i in range(70)])
    label = np.array(y)
    want = brute.history(x[train], label[train], x[~train], label[~train], 64, 8, 0, 2)
    assert histories(result)["holdout"] == want
    scored = result.predictions(similarity=True)
    best = result.best.first()
    assert classify.accuracy(scored).first().accuracy == best.accuracy == max(w[2] for w in want)
    assert best.iteration == min(w[0] for w in want if w[2] == best.accuracy)


def test_tie_goes_to_first_class(make_matrix):
    """Both classes have the same rows, so all similarities are equal."""
    rows = make_matrix([("z", [0, 1]), ("a", [0, 1]), ("z", [1, 0]), ("a", [1, 0])])
    model = HDClassifier(dimensionality=32, levels=2).fit(rows)
    assert {r.guess for r in model.transform(rows).collect()} == {"z"}


def test_zero_vectors(spark):
    mem = load_item_memory(spark, 16, 2, 0)
    one = classify.Classifier(0, bundle.Request(0.0, 1.0, (0,)), np.array([1, 0]),
                              np.zeros((2, 16), dtype=np.int64)).ready(mem)
    assert one.guess(np.array([[0], [1]]), mem.doubled).tolist() == [1, 1]
    one.vectors[1] = mem.matrix[0]
    one.ready(mem)
    assert one.guess(np.array([[0]]), mem.doubled).tolist() == [0]


def test_retraining_without_errors_changes_nothing(spark):
    x = np.array([[0.0], [0.0], [1.0], [1.0]])
    mem = load_item_memory(spark, 64, 2, 0)
    hv = brute.encode(x, brute.edges(x, 2), mem.matrix.astype(int))
    start = np.stack([hv[:2].sum(0), hv[2:].sum(0)])
    state = retrain.OnlinePass(start)
    assert state.walk(hv, np.array([0, 0, 1, 1])) == 0
    assert (state.vectors == start).all()


def test_best_iteration_and_fold_mean(spark):
    history = spark.createDataFrame(
        [("m", 0, 90.0), ("m", 1, 95.0), ("m", 2, 95.0)], "model_id STRING, iteration INT, accuracy DOUBLE")
    best = classify.best_iteration(history).first()
    assert (best.accuracy, best.iteration) == (95.0, 1)
    folds = spark.createDataFrame([("r", 90.0, 1), ("r", 95.0, 2)],
                                  "run_id STRING, accuracy DOUBLE, iteration INT")
    mean = classify.fold_mean(folds).first()
    assert (mean.accuracy, mean.iteration) == (92.5, 1)


def test_clear_errors(make_matrix):
    rows = make_matrix([("a", [1]), ("b", [2])])
    with pytest.raises(ValueError, match="no training rows"):
        holdout(rows, 0, Settings(16, 2))
    with pytest.raises(ValueError, match="no test rows"):
        holdout(rows, 100, Settings(16, 2))
    with pytest.raises(ValueError, match="feature counts"):
        holdout(make_matrix([("a", [1]), ("a", [1, 2])]), 50, Settings(16, 2))
    for bad in ({"dimensionality": 9}, {"levels": 1}, {"retrain": -1}, {"retrain_mode": "x"}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_letters_have_signal(spark, sf_dir):
    from vectorloom.plans.catalogue import language_accuracy

    assert language_accuracy(spark, sf_dir).first().accuracy > 90


def test_one_python_evaluation_per_encode(spark, make_matrix):
    from vectorloom.operators import encode

    rows = make_matrix([("a", [0, 1])])
    hv = encode.encode_rows(rows, load_item_memory(spark, 16, 2, 0), 0.0, 1.0)
    plan = hv.select("row_id", F.posexplode_outer("hv"))._jdf.queryExecution().executedPlan()
    assert plan.toString().count("MapInArrow") == 1


def test_online_pass_opens_only_the_blocks_it_walks(spark, make_matrix, monkeypatch):
    """Every block has wrong guesses: a pass takes a job per block, and that job few tasks."""
    x, _ = blobs(300, 5, 2, 9)
    y = [str(i % 2) for i in range(300)]
    rows = matrix(make_matrix, x, y)
    settings = Settings(40, 5, 2, retrain=1)
    whole = holdout(rows, 50, settings).steps
    monkeypatch.setattr(retrain, "block_rows", lambda *_: 7)
    spark.sparkContext.setJobGroup("blocks", "an online pass by blocks")
    steps = holdout(rows, 50, settings).steps
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("blocks")]
    stages = {s for j in jobs for s in j.stageIds}
    found = [tracker.getStageInfo(s) for s in stages]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert steps == whole
    assert len(jobs) > 40
    assert sum(s.numTasks for s in found if s) < 8 * len(jobs)


def test_blocks_are_bounded():
    assert retrain.rows_per_block(10_000, 26, 64) == 4096
    assert 4096 < retrain.rows_per_block(1_000_000, 26, 64) <= 1_000_000 // 64 + 1
    assert retrain.rows_per_block(10**9, 26, 64) == 16 * 4096
    for width in (10**5, 10**6):
        rows = retrain.rows_per_block(10**9, width, 64)
        assert rows * 8 * width <= retrain.BLOCK_BYTES
