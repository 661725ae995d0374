import brute
import numpy as np
import pytest
from hypothesis import given, settings as hyp
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectorloom import kernels
from vectorloom.functions import (
    hv_add, hv_cosine, hv_dot, hv_flip, hv_norm, hv_roll, hv_sub, level_of,
)
from vectorloom.item_memory import item_memory, item_memory_cells, load_item_memory
from vectorloom.operators import encode
from vectorloom.operators.bundle import class_hypervectors


def test_edges_fixture(make_matrix):
    row = encode.level_edges(make_matrix([("a", range(0, 9))]), 4).first()
    assert (row.lo, row.hi, row.gap, row.n_levels) == (0.0, 8.0, 2.0, 4)


@pytest.mark.parametrize("value,expected", [
    (0, 0), (1.9, 0), (2, 1), (7.9, 3), (8, 3), (-5, 0), (99, 3), (float("nan"), 3),
    (float("inf"), 3), (float("-inf"), 0),
])
def test_level_fixture(spark, value, expected):
    df = spark.createDataFrame([(float(value),)], "v DOUBLE")
    assert df.select(level_of("v", 0, 8, 4)).first()[0] == expected
    assert kernels.quantise(np.array([float(value)]), 0.0, 8.0, 4)[0] == expected


def test_constant_data(spark):
    df = spark.createDataFrame([(3.0,), (2.0,)], "v DOUBLE")
    assert [r[0] for r in df.select(level_of("v", 3, 3, 4)).collect()] == [3, 0]
    assert kernels.quantise(np.array([3.0, 2.0]), 3.0, 3.0, 4).tolist() == [3, 0]


def test_levels_on_exact_edges(spark):
    df = spark.range(1001).select((F.col("id") / 1000).alias("v"))
    rows = df.select("v", level_of("v", 0, 1, 10).alias("k")).collect()
    edge = brute.edges(np.array([0.0, 1.0]), 10)
    assert all(r.k == brute.level(r.v, edge) for r in rows)


@hyp(max_examples=200, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=2, max_size=40), st.integers(2, 50))
def test_quantise_matches_edge_count(values, levels):
    x = np.array(values)
    edge = brute.edges(x, levels)
    expected = [brute.level(v, edge) for v in x] if x.min() < x.max() else [levels - 1] * len(x)
    assert kernels.quantise(x, float(x.min()), float(x.max()), levels).tolist() == expected


def test_item_memory(spark):
    mem = load_item_memory(spark, 64, 8, 0)
    assert (mem.matrix == brute.memory(64, 8, 0)).all()
    assert (mem.matrix[0] == 1).sum() == 32
    assert all((mem.matrix[k] != mem.matrix[k - 1]).sum() == 4 for k in range(1, 8))
    rows = {r.level: r.hv for r in item_memory(spark, 64, 8, 0).collect()}
    assert all(rows[k] == mem.matrix[k].tolist() for k in range(8))
    cells = item_memory_cells(spark, 64, 8, 0).collect()
    assert len(cells) == 512 and all(mem.matrix[c.level, c.d] == c.sign for c in cells)


def test_more_levels_than_flips(spark):
    mem = load_item_memory(spark, 10, 20, 3)
    assert (mem.matrix == mem.matrix[0]).all()
    counts = np.arange(40).reshape(1, 2, 20)
    expected = counts[0, 0].sum() * mem.matrix[0] + counts[0, 1].sum() * np.roll(mem.matrix[0], 1)
    assert (mem.bundle(counts)[0] == expected).all()


def test_rotation_fixture(spark):
    df = spark.createDataFrame([([1, -1, -1, -1],)], "hv ARRAY<INT>")
    row = df.select(hv_roll("hv", 1).alias("a"), hv_roll("hv", 5).alias("b"),
                    hv_roll("hv", 0).alias("c")).first()
    assert row.a == row.b == [-1, 1, -1, -1] and row.c == [1, -1, -1, -1]


def test_vector_helpers(spark):
    df = spark.createDataFrame([([3, 4], [4, -3], [0, 0])], "a ARRAY<INT>, b ARRAY<INT>, z ARRAY<INT>")
    row = df.select(
        hv_add("a", "b").alias("add"), hv_sub("a", "b").alias("sub"), hv_dot("a", "b").alias("dot"),
        hv_norm("a").alias("norm"), hv_cosine("a", "a").alias("cos"), hv_cosine("a", "z").alias("zero"),
        hv_flip("a", F.array(F.lit(1))).alias("flip"),
    ).first()
    assert (row.add, row["sub"], row.dot, row.norm, row.cos) == ([7, 1], [-1, 7], 0.0, 5.0, 1.0)
    assert row.zero is None and row.flip == [3, -4]


@pytest.mark.parametrize("dim,width", [(16, 5), (16, 40), (64, 300)])
def test_encoders_agree(spark, make_matrix, dim, width):
    rng = np.random.default_rng(dim + width)
    x = rng.normal(size=(7, width))
    rows = make_matrix([("a", r) for r in x])
    lo, hi = encode.edge_values(rows, 6)
    mem = load_item_memory(spark, dim, 6, 1)
    expected = brute.encode(x, brute.edges(x, 6), mem.matrix.astype(int))
    assert (kernels.encode(kernels.quantise(x, lo, hi, 6), mem.doubled) == expected).all()
    variants = [encode.encode_rows(rows, mem, lo, hi),
                encode.encode_rows(rows, mem, lo, hi, form="smallint"),
                encode.unpack(encode.encode_rows(rows, mem, lo, hi, form="packed")),
                encode.encode_rows_blocked(rows, mem, lo, hi, block=11)]
    if width < 100:
        variants.append(encode.encode_rows_native(rows, mem, lo, hi))
    for found in variants:
        got = {r.row_id: r.hv for r in found.collect()}
        assert all(got[i] == expected[i].tolist() for i in range(len(x)))


@pytest.mark.parametrize("partitions", [1, 5, 17])
def test_class_vectors_any_partitioning(spark, make_matrix, partitions):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 300))
    y = [["b", "a", "c"][i] for i in rng.integers(0, 3, 40)]
    rows = make_matrix(list(zip(y, x)), partitions)
    mem = load_item_memory(spark, 32, 4, 0)
    lo, hi = encode.edge_values(rows, 4)
    expected = brute.train(x, y, brute.edges(x, 4), mem.matrix.astype(int))
    found = class_hypervectors(rows, mem, lo, hi).orderBy("class_rank").collect()
    assert [r.label for r in found] == list(expected)
    assert all(r.hv == expected[r.label].tolist() for r in found)


def test_score_table_equals_dot_products(spark):
    mem = load_item_memory(spark, 48, 5, 2)
    rng = np.random.default_rng(0)
    levels = rng.integers(0, 5, (20, 60))
    vectors = rng.integers(-99, 99, (3, 48))
    table = mem.score_table(vectors, 60)
    by_table = table[np.arange(60), levels].sum(axis=1)
    assert (by_table == kernels.encode(levels, mem.doubled) @ vectors.T).all()


@pytest.mark.parametrize("dim,width", [(64, 64), (51, 40), (64, 9)])
def test_convolution_equals_addition(spark, monkeypatch, dim, width):
    mem = load_item_memory(spark, dim, 4, 5)
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 10**6, (2, width, 4))
    vectors = rng.integers(-10**9, 10**9, (2, dim))
    fast = mem.bundle(counts), mem.score_table(vectors, width)
    assert mem._spectral(width, 1e9)
    monkeypatch.setattr(type(mem), "_spectral", lambda *_: False)
    assert (mem.bundle(counts) == fast[0]).all()
    assert (mem.score_table(vectors, width) == fast[1]).all()
