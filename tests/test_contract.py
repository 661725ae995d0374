"""Inputs that are not dense, unique or complete, and data wider than the driver's share."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom import HDClassifier, cross_validate, holdout
from vectorloom.operators.permute import label_permutations
from vectorloom.operators.splits import kfold_held_out, stratified_split
from vectorloom.settings import Settings
from vectorloom.sources.bio import sample_of
from vectorloom.sources.store import ArtifactStore

SMALL = Settings(64, 8)


@pytest.mark.parametrize("place", ["3 * row_pos + 100", "-row_pos", "row_pos div 4",
                                   "xxhash64(row_pos)", "0"])
def test_permutation_keeps_every_row(make_matrix, place):
    rows = make_matrix([("ab"[i % 3 == 0], [i, 1]) for i in range(30)])
    found = label_permutations(rows.withColumn("row_pos", F.expr(place)), 3).collect()
    assert len(found) == 90
    for k in range(3):
        own = [r for r in found if r.replicate == k]
        assert sorted(r.row_id for r in own) == list(range(30))
        assert sum(r.label == "b" for r in own) == 10


def test_permutation_of_nothing(make_matrix):
    assert label_permutations(make_matrix([("a", [1.0])]).limit(0), 2).count() == 0


@pytest.mark.parametrize("percentage,drawn", [(50, 15), (70, 21), (90, 27)])
def test_split_is_exact_with_repeated_ids(make_matrix, percentage, drawn):
    rows = make_matrix([("a", [i, 0]) for i in range(30)]).withColumn(
        "row_id", F.expr("row_id div 2"))
    assert stratified_split(rows, percentage).where("is_train").count() == drawn


def test_folds_do_not_multiply_rows(make_matrix):
    rows = make_matrix([("a", [i % 4, 1]) for i in range(20)]).withColumn(
        "row_pos", F.expr("row_pos div 2"))
    held = kfold_held_out(rows, 5)
    assert held.count() == 20 and held.where("size(held) > 1").count() > 0


@pytest.mark.parametrize("bad", ["CAST(NULL AS DOUBLE)", "CAST('NaN' AS DOUBLE)"])
def test_missing_cells_are_refused(make_matrix, bad):
    rows = make_matrix([("ab"[i % 2], [i, i + 1]) for i in range(20)]).withColumn(
        "features", F.expr(f"IF(row_id = 7, array(1.0D, {bad}), features)"))
    for train in (lambda: HDClassifier(dimensionality=64, levels=8).fit(rows),
                  lambda: holdout(rows, 80, SMALL), lambda: cross_validate(rows, 4, SMALL)):
        with pytest.raises(ValueError, match="1 rows have missing"):
            train()


def test_sample_names_may_have_dots(spark):
    names = ["s1.rep1-mbv.bed", "s1.rep2-mbv.bed", "s-1-mbv.bed.meta", "plain.bed"]
    df = spark.createDataFrame([(n,) for n in names], "n STRING")
    assert [r[0] for r in df.select(sample_of(F.col("n"))).collect()] == [
        "s1.rep1", "s1.rep2", "s-1", "plain"]


def test_wide_model_keeps_its_class_vectors(spark, make_matrix, tmp_path):
    """Tables of this width are made by tasks; the model can still be read and saved."""
    rng = np.random.default_rng(0)
    rows = make_matrix([("abc"[i % 3], rng.random(6000).tolist()) for i in range(9)])
    model = HDClassifier(dimensionality=10000, levels=2).fit(rows)
    vectors = {r.label: np.array(r.hv) for r in model.class_vectors(spark).collect()}
    assert sorted(vectors) == ["a", "b", "c"] and all(len(v) == 10000 for v in vectors.values())
    store = ArtifactStore(spark, str(tmp_path))
    store.save_model(model, "wide")
    again = store.load_model("wide")
    assert {(r.row_id, r.guess) for r in model.transform(rows).collect()} == {
        (r.row_id, r.guess) for r in again.transform(rows).collect()}
