"""Bloom filters that many tasks build and one bounded broadcast carries.

A filter is an array of bytes; its number of bits is a power of two, grows with the rows and stops at a bound. Past
the bound more keys than needed pass, never fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BITS_PER_KEY = 16
MAX_BITS = 1 << 28
HASHES = 4
SEGMENT_BITS = 1 << 20

_PART = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
_SQL = "segment int, once binary, twice binary"


def filter_bits(keys: int, max_bits: int = MAX_BITS) -> int:
    """A power of two near 16 bits a key, at most ``max_bits``."""
    return min(max_bits, 1 << max(10, (max(keys, 1) * BITS_PER_KEY - 1).bit_length()))


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions of each 64-bit hash, one row per hash; ``bits`` is a power of two."""
    first = hashes.view(np.uint64)
    step = (first >> np.uint64(17)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    mixed = first[:, None] + np.arange(HASHES, dtype=np.uint64)[None, :] * step[:, None]
    mixed ^= mixed >> np.uint64(31)
    return (mixed & np.uint64(bits - 1)).astype(np.int64)


def _set(bits: int):
    """Per batch of keys, the bits that they set and the bits that they set twice, as positions within segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, counts = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_counts=True)
            if not len(values):
                continue
            where = _positions(values, bits)
            once, hits = np.unique(where, return_counts=True)
            twice = np.union1d(np.unique(where[counts > 1]), once[hits > 1])
            for segment in np.unique(once // SEGMENT_BITS).tolist():
                low, high = segment * SEGMENT_BITS, (segment + 1) * SEGMENT_BITS
                cuts = [
                    (p[np.searchsorted(p, low) : np.searchsorted(p, high)] - low).astype(np.uint32).tobytes()
                    for p in (once, twice)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([segment], pa.int32()), *(pa.array([c], pa.binary()) for c in cuts)], schema=_PART
                )

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment's bits that were set, and those set twice in one batch or by two."""
    state: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for segment, once, twice in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if segment not in state:
                state[segment] = np.zeros(SEGMENT_BITS, dtype=bool), np.zeros(SEGMENT_BITS, dtype=bool)
            seen, again = state[segment]
            at = np.frombuffer(once, dtype=np.uint32)
            again[at[seen[at]]] = True
            seen[at] = True
            again[np.frombuffer(twice, dtype=np.uint32)] = True
    for segment, both in state.items():
        packed = [pa.array([np.packbits(x, bitorder="little").tobytes()], pa.binary()) for x in both]
        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), *packed], schema=_PART)


def build(keys: DataFrame, bits: int, twice: bool = False) -> np.ndarray:
    """The filter of the one long column of ``keys``: bits set, or with ``twice`` bits set at least twice."""
    parts = keys.mapInArrow(_set(bits), _SQL)
    merged = parts.repartition("segment").mapInArrow(_merge, _SQL)
    found = np.zeros(max(bits, SEGMENT_BITS) // 8, dtype=np.uint8)
    column = "twice" if twice else "once"
    for row in merged.select("segment", column).collect():
        start = row["segment"] * SEGMENT_BITS // 8
        found[start : start + SEGMENT_BITS // 8] = np.frombuffer(row[column], dtype=np.uint8)
    return found[: max(bits // 8, 1)]


def contains(found: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have all their bits set in the filter."""
    where = _positions(hashes, len(found) * 8)
    return ((found[where >> 3] >> (where & 7).astype(np.uint8)) & 1).all(axis=1)
