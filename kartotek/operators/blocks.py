"""Vectors of an Arrow batch as matrices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CELLS = 1 << 22


def entries_of(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, position and value of every stored entry of a batch of unwrapped vectors, and their sizes."""
    values = vectors.field("values")
    row = pc.list_parent_indices(values).to_numpy().astype("int64")
    value = pc.list_flatten(values).to_numpy(zero_copy_only=False)
    stored = pc.list_value_length(values).to_numpy(zero_copy_only=False).astype("int64")
    sparse = vectors.field("type").to_numpy(zero_copy_only=False) == 0
    first = np.cumsum(stored) - stored
    position = np.arange(len(row)) - first[row]
    position[sparse[row]] = pc.list_flatten(vectors.field("indices").filter(pa.array(sparse))).to_numpy(zero_copy_only=False)
    size = np.where(sparse, vectors.field("size").fill_null(0).to_numpy(zero_copy_only=False), stored)
    return row, position, value, size


def packed(vectors: pa.StructArray) -> dict[str, bytes]:
    """The entries of a batch of unwrapped vectors as four texts of bytes; those of dense rows of one size need no positions."""
    row, position, value, size = entries_of(vectors)
    stored = np.bincount(row, minlength=len(size))
    dense = len(size) > 0 and (vectors.field("type").to_numpy(zero_copy_only=False) == 1).all() and (size == size[0]).all()
    return {
        "size": size.astype(np.int32).tobytes(), "stored": b"" if dense else stored.astype(np.int32).tobytes(),
        "position": b"" if dense else position.astype(np.int32).tobytes(), "value": value.tobytes(),
    }


PACKED = "size binary, stored binary, position binary, value binary"


def packed_matrices(
    size: bytes, stored: bytes, position: bytes, value: bytes, width: int, cells: int = CELLS
) -> Iterator[tuple[slice, np.ndarray | slice, np.ndarray]]:
    """:func:`matrices` of a batch that :func:`packed` has packed; dense rows are taken as they are."""
    sizes, values = np.frombuffer(size, np.int32), np.frombuffer(value)
    if (sizes != width).any():
        raise ValueError("vector sizes differ")
    if len(stored):
        row = np.repeat(np.arange(len(sizes)), np.frombuffer(stored, np.int32))
        yield from _entry_matrices(row, np.frombuffer(position, np.int32), values, len(sizes), width, cells)
        return
    whole, step = values.reshape(len(sizes), width), max(1, cells // max(width, 1))
    for start in range(0, len(sizes), step):
        block = whole[start : start + step]
        yield slice(start, start + len(block)), slice(None), block


def matrices(vectors: pa.StructArray, width: int, cells: int = CELLS) -> Iterator[tuple[slice, np.ndarray | slice, np.ndarray]]:
    """Some rows at a time: which they are, which positions they use, and their values there.

    Rows of up to ``cells`` in all are taken together, so wide sparse vectors are only as wide as what they store.
    """
    row, position, value, size = entries_of(vectors)
    if (size != width).any():
        raise ValueError("vector sizes differ")
    yield from _entry_matrices(row, position, value, len(vectors), width, cells)


def _entry_matrices(row, position, value, n: int, width: int, cells: int) -> Iterator[tuple[slice, np.ndarray | slice, np.ndarray]]:
    bounds = np.searchsorted(row, np.arange(n + 1))
    start = 0
    while start < n:
        step = max(1, cells // max(width, 1))
        if step < n - start:
            stored = max(1.0, (bounds[-1] - bounds[start]) / (n - start))
            step = max(step, int(np.sqrt(cells / stored)))
        stop = min(n, start + step)
        a, b = bounds[start], bounds[stop]
        if width * (stop - start) <= cells:
            columns, at, used = slice(None), position[a:b], width
        else:
            columns, at = np.unique(position[a:b], return_inverse=True)
            used = len(columns)
        block = np.zeros((stop - start, used))
        block[row[a:b] - start, at] = value[a:b]
        yield slice(start, stop), columns, block
        start = stop
