"""Level edges and row encoding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom import kernels
from vectorloom.functions.levels import levels_of
from vectorloom.functions.vectors import hv_add
from vectorloom.item_memory import ItemMemory
from vectorloom.operators.matrix import int_array
from vectorloom.tables import bounded_rows, prepare

# Bytes of encoded vectors per batch leaving a task.
_BATCH_BYTES = 4 << 20


def level_edges(matrix: DataFrame, n_levels: int, by=()) -> DataFrame:
    """``by..., lo, hi, gap, n_levels`` over all cells of the matrix."""
    return matrix.groupBy(*by).agg(
        F.min(F.array_min("features")).alias("lo"), F.max(F.array_max("features")).alias("hi")
    ).select(*by, "lo", "hi", ((F.col("hi") - F.col("lo")) / n_levels).alias("gap"),
             F.lit(n_levels).alias("n_levels"))


def edge_values(matrix: DataFrame, n_levels: int) -> tuple[float, float]:
    row = bounded_rows(level_edges(matrix, n_levels), 1, "edges")[0]
    if row.lo is None:
        raise ValueError("no training rows")
    return row.lo, row.hi


def encode_rows(matrix: DataFrame, memory: ItemMemory, lo: float, hi: float,
                form: str = "int") -> DataFrame:
    """Replace ``features`` by ``hv``. Vectors leave a task in batches of a few megabytes.

    ``form``: ``int`` (ARRAY<INT>), ``smallint`` (ARRAY<SMALLINT>) or ``packed`` (BINARY,
    little-endian 16-bit integers; Spark moves these as a block instead of element by
    element, see ``unpack``). Up to 32767 features fit 16 bits.
    """
    spark_type, kind = {
        "int": (T.ArrayType(T.IntegerType()), np.dtype("<i4")),
        "smallint": (T.ArrayType(T.ShortType()), np.dtype("<i2")),
        "packed": (T.BinaryType(), np.dtype("<i2")),
    }[form]
    shared = memory.on(matrix.sparkSession.sparkContext)
    step = max(1, _BATCH_BYTES // (kind.itemsize * memory.dimensionality))
    kept = [c for c in matrix.columns if c != "features"]
    schema = T.StructType([matrix.schema[c] for c in kept] + [T.StructField("hv", spark_type)])

    def encode_batches(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = kernels.feature_matrix(batch.column("features"))
            if kind.itemsize == 2 and x.shape[1] > 32767:
                raise ValueError("too many features for 16-bit vectors")
            levels = kernels.quantise(x, lo, hi, shared.value.levels)
            for top in range(0, len(x), step):
                vectors = kernels.encode(levels[top:top + step], shared.value.doubled, dtype=kind)
                columns = [batch.column(c).slice(top, step) for c in kept]
                if form == "packed":
                    columns.append(kernels.binary_column(vectors))
                else:
                    columns.append(kernels.list_column(vectors, pa.from_numpy_dtype(kind)))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "hv"])

    return matrix.mapInArrow(encode_batches, schema)


def unpack(encoded: DataFrame) -> DataFrame:
    """Packed ``hv`` back to ARRAY<INT>."""
    prepare(encoded.sparkSession)

    @F.arrow_udf("array<int>")
    def widen(column: pa.Array) -> pa.Array:
        vectors = np.frombuffer(b"".join(column.to_pylist()), dtype="<i2")
        return kernels.list_column(vectors.reshape(len(column), -1), pa.int32())

    return encoded.withColumn("hv", widen("hv"))


def encode_rows_native(matrix: DataFrame, memory: ItemMemory, lo: float, hi: float) -> DataFrame:
    """Same result from built-in array functions only; meant for small D."""
    dim = memory.dimensionality
    table = int_array(memory.matrix.ravel())
    zero = F.array_repeat(F.lit(0), dim)
    levels = levels_of(F.col("features"), lo, hi, memory.levels)
    placed = F.transform(levels, lambda k, f: F.struct(k.alias("k"), f.alias("f")))

    def add_rotated(total, p):
        level = F.slice(table, p["k"] * dim + 1, F.lit(dim))
        back = F.pmod(p["f"], F.lit(dim))
        rolled = F.concat(F.slice(level, F.lit(dim) - back + 1, back),
                          F.slice(level, F.lit(1), F.lit(dim) - back))
        return hv_add(total, rolled)

    hv = F.aggregate(placed, zero, add_rotated)
    return matrix.withColumn("hv", hv).drop("features")


def encode_rows_blocked(matrix: DataFrame, memory: ItemMemory, lo: float, hi: float,
                        block: int | None = None, key: str = "row_id") -> DataFrame:
    """``key, hv`` for very wide rows: blocks of features are encoded by different
    tasks with their position offset and the partial vectors added per row. By default a block
    has at least D features, so the partial vectors (32-bit) are no larger than the cells (64-bit)
    they stand for, and they leave a task a few megabytes at a time."""
    shared = memory.on(matrix.sparkSession.sparkContext)
    block = block or max(4096, memory.dimensionality)
    starts = F.sequence(F.lit(0), F.size("features") - 1, F.lit(block))
    blocks = matrix.select(key, "features", F.explode(starts).alias("first")).select(
        key, "first", F.slice("features", F.col("first") + 1, F.lit(block)).alias("cells")
    ).repartition(key, "first")

    def encode_blocks(batches):
        doubled = shared.value.doubled
        dim = doubled.shape[1] // 2
        step = max(1, _BATCH_BYTES // (4 * dim))
        for batch in batches:
            for top in range(0, batch.num_rows, step):
                part = batch.slice(top, step)
                out = np.empty((part.num_rows, dim), dtype=np.int32)
                cells = zip(part.column("first").to_numpy(), part.column("cells"))
                for i, (start, cell) in enumerate(cells):
                    x = np.asarray(cell.values, dtype=np.float64)[None, :]
                    levels = kernels.quantise(x, lo, hi, doubled.shape[0])
                    out[i] = kernels.encode(levels, doubled, int(start))[0]
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), kernels.list_column(out, pa.int32())], names=[key, "hv"])

    kind = matrix.schema[key].dataType.simpleString()
    return sum_vectors(blocks.mapInArrow(encode_blocks, f"{key} {kind}, hv ARRAY<INT>"), [key])


def sum_vectors(partials: DataFrame, keys: list[str], salted: bool = False) -> DataFrame:
    """Elementwise sum of ``hv`` (integers) per key, as ARRAY<BIGINT>.

    Rows arrive sorted by key and are added as they stream by, so a task holds
    one vector whatever the number of partials. ``salted`` adds a first round
    over 64 salts for keys with one partial per upstream task.
    """
    if salted:
        salt = F.pmod(F.spark_partition_id(), F.lit(64))
        first = partials.select(*keys, salt.alias("_salt"), "hv")
        partials = _sum_sorted(first, [*keys, "_salt"])
    return _sum_sorted(partials.select(*keys, "hv"), keys)


def _sum_sorted(partials: DataFrame, keys: list[str]) -> DataFrame:
    schema = partials.select(*keys, F.col("hv").cast("array<bigint>").alias("hv")).schema
    names = [*keys, "hv"]

    def add_up(batches):
        current, total, like = None, None, None
        for batch in batches:
            columns = [batch.column(k) for k in keys]
            like = batch.schema
            vectors = batch.column("hv")
            for i in range(batch.num_rows):
                key = tuple(c[i].as_py() for c in columns)
                vector = np.asarray(vectors[i].values)
                if key == current:
                    total = total + vector
                    continue
                if current is not None:
                    yield _one_row(current, total, like, names)
                current, total = key, vector.astype(np.int64)
        if current is not None:
            yield _one_row(current, total, like, names)

    placed = partials.repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(add_up, schema)


def _one_row(key, vector, like, names):
    arrays = [pa.array([k], type=like.field(i).type) for i, k in enumerate(key)]
    arrays.append(kernels.list_column(vector[None, :], pa.int64()))
    return pa.RecordBatch.from_arrays(arrays, names=names)
