"""NumPy helpers that run inside Spark tasks on one Arrow batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_TILE_CELLS = 1 << 18  # int8 cells held per tile, about one L2 cache
_INT8_RUN = 127        # additions of +-1 that fit an int8 accumulator


def feature_matrix(column) -> np.ndarray:
    """(rows, features) view of a list<double> Arrow column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if rows == 0:
        return np.zeros((0, 0))
    if flat.size % rows or len(set(np.diff(column.offsets.to_numpy()).tolist())) != 1:
        raise ValueError("rows with different feature counts; run validate_matrix first")
    return flat.reshape(rows, -1)


def list_column(matrix: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """list<kind> Arrow column from a (rows, n) matrix."""
    rows, width = matrix.shape
    flat = np.ascontiguousarray(matrix).reshape(-1)
    values = pa.array(flat.astype(kind.to_pandas_dtype(), copy=False), type=kind)
    offsets = pa.array(np.arange(rows + 1, dtype=np.int64) * width, type=pa.int32())
    return pa.ListArray.from_arrays(offsets, values)


def binary_column(matrix: np.ndarray) -> pa.Array:
    """binary Arrow column holding each row's bytes."""
    rows = len(matrix)
    data = np.ascontiguousarray(matrix)
    offsets = np.arange(rows + 1, dtype=np.int32) * (data.nbytes // max(rows, 1))
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.binary(), rows, buffers)


def quantise(values: np.ndarray, lo: float, hi: float, n_levels: int) -> np.ndarray:
    """Levels of an array of values (see functions.levels.level_of)."""
    last = n_levels - 1
    gap = (hi - lo) / n_levels
    if not gap > 0:
        return np.where(values < hi, 0, last).astype(np.int32)
    with np.errstate(all="ignore"):
        guess = np.clip(np.nan_to_num(np.floor((values - lo) / gap), nan=last), 0, last)
        above = values >= lo + (guess + 1) * gap
        below = values < lo + guess * gap
    return np.clip(guess + above - below, 0, last).astype(np.int32)


def encode(levels: np.ndarray, doubled: np.ndarray, first_position: int = 0,
           dtype=np.int32) -> np.ndarray:
    """Sum of rotated level vectors for each row.

    ``doubled`` holds every level vector twice end to end, so a rotation is a
    slice. Sums run in int8 for up to 127 features, then widen.
    """
    rows, width = levels.shape
    dim = doubled.shape[1] // 2
    out = np.zeros((rows, dim), dtype=dtype)
    tile = max(1, _TILE_CELLS // dim)
    for top in range(0, rows, tile):
        chunk = levels[top:top + tile]
        if len(chunk) < 4:  # few long rows: add slices in place instead of gathering them
            for i in range(len(chunk)):
                _encode_row(chunk[i], doubled, first_position, out[top + i])
            continue
        for left in range(0, width, _INT8_RUN):
            narrow = np.zeros((len(chunk), dim), dtype=np.int8)
            for f in range(left, min(left + _INT8_RUN, width)):
                start = dim - (first_position + f) % dim
                narrow += doubled[chunk[:, f], start:start + dim]
            out[top:top + tile] += narrow
    return out


def _encode_row(levels: np.ndarray, doubled: np.ndarray, first_position: int,
                out: np.ndarray) -> None:
    dim = doubled.shape[1] // 2
    flat = doubled.reshape(-1)
    turn = (first_position + np.arange(len(levels))) % dim
    starts = levels.astype(np.int64) * (2 * dim) + dim - turn
    for left in range(0, len(levels), _INT8_RUN):
        narrow = np.zeros(dim, dtype=np.int8)
        for start in starts[left:left + _INT8_RUN].tolist():
            narrow += flat[start:start + dim]
        out += narrow


def first_best(scores: np.ndarray) -> np.ndarray:
    """Column of the best score per row; ties and missing scores keep the first class."""
    return np.argmax(np.where(np.isnan(scores), -np.inf, scores), axis=1)


def inverse_norms(class_vectors: np.ndarray) -> np.ndarray:
    """1 / length of each class vector, NaN for a zero vector."""
    lengths = np.sqrt(np.einsum("cd,cd->c", class_vectors, class_vectors))
    return np.divide(1.0, lengths, out=np.full(len(lengths), np.nan), where=lengths > 0)
