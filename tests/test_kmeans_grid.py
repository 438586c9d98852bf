from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from kartotek.operators import blocks, kmeans_grid


def lloyd(points, centres, iterations):
    for _ in range(iterations):
        best = ((points[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([points[best == c].mean(axis=0) if (best == c).any() else centres[c] for c in range(len(centres))])
    return centres


def cost(points, centres):
    return ((points[:, None] - centres) ** 2).sum(axis=2).min(axis=1).sum() if len(points) else 0.0


@pytest.fixture(scope="module")
def points():
    generator = np.random.default_rng(8)
    return np.vstack([generator.normal(c, 1.0, (50, 5)) for c in (-4, 0, 5)])


@pytest.fixture(scope="module")
def frame(spark, points):
    return spark.createDataFrame([(i, Vectors.dense(p)) for i, p in enumerate(points)] + [(999, None)], ["key", "features"]).repartition(5)


def test_shared_scans_equal_fits_by_hand(frame, points):
    starts = {k: points[:k] for k in (2, 3, 5)}
    fits = kmeans_grid.fit_grid(frame, (2, 3, 5), fold=F.col("key") % 4, folds=4, max_iterations=6, starts=starts, tolerance=0.0)
    assert [(f.k, f.fold) for f in fits] == [(k, f) for k in (2, 3, 5) for f in range(4)]
    fold = np.arange(len(points)) % 4
    for f in fits:
        centres = lloyd(points[fold != f.fold], points[: f.k], 6)
        assert f.centres == pytest.approx(centres)
        assert f.cost == pytest.approx(cost(points[fold != f.fold], centres))
        assert f.held_out == pytest.approx(cost(points[fold == f.fold], centres))


def test_the_number_of_scans_is_that_of_iterations(frame, monkeypatch):
    scans = []
    plain = kmeans_grid._scan
    monkeypatch.setattr(kmeans_grid, "_scan", lambda v, fits, wanted: scans.append(len(fits)) or plain(v, fits, wanted))
    fits = kmeans_grid.fit_grid(frame, (2, 3, 4), fold=F.col("key") % 5, folds=5, max_iterations=4)
    assert len(scans) <= 5 and scans[-1] == 15 == len(fits)


def test_starts_do_not_depend_on_layout(frame):
    a, b = (kmeans_grid.fit_grid(f, (3,), max_iterations=3)[0] for f in (frame, frame.repartition(2, "key")))
    assert a.centres == pytest.approx(b.centres) and a.cost == pytest.approx(b.cost)


def test_wide_sparse_rows(spark, monkeypatch):
    width = 200_000
    generator = np.random.default_rng(3)
    data = [(i, Vectors.sparse(width, {int(p): 1.0 for p in generator.integers(0, width, 20)} | {i % 2: 30.0})) for i in range(60)]
    frame = spark.createDataFrame(data, ["key", "features"])
    dense = np.array([v.toArray() for _, v in data])
    fits = kmeans_grid.fit_grid(frame, (2,), max_iterations=3, starts={2: dense[:2]})
    assert fits[0].cost == pytest.approx(cost(dense, lloyd(dense, dense[:2], 3)))


def test_matrices_hold_every_entry():
    import pyarrow as pa

    kind = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
    rows = [{"type": 0, "size": 50, "indices": [i, 40], "values": [1.0, 2.0]} for i in range(9)]
    rows += [{"type": 1, "size": None, "indices": None, "values": [float(i) for i in range(50)]}, {"type": 0, "size": 50, "indices": [], "values": []}]
    vectors = pa.array(rows, kind)
    expected = np.zeros((11, 50))
    for i in range(9):
        expected[i, [i, 40]] = 1.0, 2.0
    expected[9] = np.arange(50)
    for cells in (1, 30, 120, 10_000):
        got = np.zeros((11, 50))
        for where, columns, block in blocks.matrices(vectors, 50, cells):
            got[where][:, columns] = block
        assert np.array_equal(got, expected)
    with pytest.raises(ValueError, match="sizes differ"):
        list(blocks.matrices(vectors, 51))


def test_few_rows_and_none(spark):
    one = spark.createDataFrame([(1, Vectors.dense([1.0])), (2, Vectors.dense([1.0]))], ["key", "features"])
    fits = kmeans_grid.fit_grid(one, (3,))
    assert len(fits[0].centres) == 1 and fits[0].cost == 0.0
    assert kmeans_grid.fit_grid(one.limit(0), (3,)) == []
    held = kmeans_grid.fit_grid(one, (1,), fold=F.lit(0), folds=2)
    assert [(f.fold, f.held_out) for f in held] == [(1, None)]


def test_packed_rows_are_those_of_the_batch():
    """Dense rows are kept as their values alone; sparse and mixed ones with their positions; no row is changed."""
    import pyarrow as pa

    kind = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
    dense = [{"type": 1, "size": None, "indices": None, "values": [float(i * k) for k in range(5)]} for i in range(7)]
    sparse = [{"type": 0, "size": 5, "indices": [i % 5], "values": [1.0 + i]} for i in range(3)] + [{"type": 0, "size": 5, "indices": [], "values": []}]
    for rows in (dense, sparse, dense + sparse):
        vectors = pa.array(rows, kind)
        held = blocks.packed(vectors)
        assert (held["position"] == b"") == (rows is dense)
        for cells in (1, 10, 1_000):
            one, other = np.zeros((len(rows), 5)), np.zeros((len(rows), 5))
            for where, columns, block in blocks.matrices(vectors, 5, cells):
                one[where][:, columns] = block
            for where, columns, block in blocks.packed_matrices(*held.values(), 5, cells):
                other[where][:, columns] = block
            assert np.array_equal(one, other)
        with pytest.raises(ValueError, match="sizes differ"):
            list(blocks.packed_matrices(*held.values(), 6))
