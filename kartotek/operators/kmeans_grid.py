"""K-means for many numbers of clusters and folds in shared scans of the rows.

The rows are packed first, a batch of them as one row of bytes, and kept. Every iteration reads them once. Each batch is
multiplied with the centres of all models that still move, and a task sends only the sums, counts and costs of its
rows per centre. So a search over folds and numbers of clusters takes as many scans as
its slowest fit has iterations, and one more for the costs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kartotek.operators.blocks import PACKED, packed, packed_matrices
from kartotek.operators.nested import quoted
from kartotek.sizing import SMALL_BYTES

TOLERANCE = 1e-4
COUNT, COST, HELD_COST, HELD_ROWS = -1, -2, -3, -4


@dataclass
class Fit:
    """One model: its number of clusters, the fold it was not fitted on (-1: none), centres and costs.

    ``cost`` is over the rows of the fit and ``held_out`` over those of the fold, both against the final centres;
    ``held_out`` is None when the fold has no rows.
    """

    k: int
    fold: int
    centres: np.ndarray
    cost: float = 0.0
    held_out: float | None = None
    iterations: int = 0


def starting_points(vectors: DataFrame, k: int, seed: int) -> dict[int, list[np.ndarray]]:
    """Per fold, up to ``k`` distinct vectors in an order given by a hash of their content; so the same for any layout."""
    digest = F.xxhash64(F.lit(seed), F.unwrap_udt("features"))
    within = Window.partitionBy("fold").orderBy("digest")
    drawn = (
        vectors.select("fold", digest.alias("digest")).distinct().withColumn("n", F.row_number().over(within))
        .filter(F.col("n") <= k).collect()
    )
    if not drawn:
        return {}
    wanted = sorted({r["digest"] for r in drawn})
    held = vectors.withColumn("digest", digest).filter(F.col("digest").isin(wanted)).groupBy("digest").agg(F.first("features").alias("v"))
    points = {r["digest"]: r["v"].toArray() for r in held.collect()}
    out: dict[int, list[tuple[int, np.ndarray]]] = {}
    for r in drawn:
        out.setdefault(r["fold"], []).append((r["digest"], points[r["digest"]]))
    return {fold: [p for _, p in sorted(found, key=lambda x: x[0])] for fold, found in out.items()}


def _first_centres(points: dict[int, list[np.ndarray]], k: int, fold: int) -> np.ndarray:
    """The first ``k`` of the points outside a fold, taken from the folds in turn."""
    lists = [points[f] for f in sorted(points) if f != fold]
    turns = [p for group in zip(*[l + [None] * (k - len(l)) for l in lists]) for p in group if p is not None] if lists else []
    chosen, seen = [], set()
    for p in turns:
        if len(chosen) < k and p.tobytes() not in seen:
            seen.add(p.tobytes())
            chosen.append(p)
    return np.array(chosen)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a batch as one row of bytes, which later scans take as they are."""
    for batch in batches:
        if batch.num_rows:
            folds = batch.column("fold").to_numpy(zero_copy_only=False).astype(np.int32)
            held = {"fold": folds.tobytes(), **packed(batch.column("features"))}
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in held.values()], names=list(held))


def _partial_sums(models: list[tuple[int, int, int]], centres: np.ndarray, sums_wanted: bool):
    """Per task: sums and counts of the rows nearest to each centre, and the costs of each model, as (cell, at, value)."""
    width = centres.shape[1]
    squares = (centres * centres).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(centres.shape if sums_wanted else (len(centres), 0))
        counts, costs = np.zeros(len(centres)), np.zeros((3, len(models)))
        seen = False
        every_row = (tuple(c[n].as_buffer() for c in batch.columns) for batch in batches for n in range(batch.num_rows))
        for fold_bytes, *parts in every_row:
            folds = np.frombuffer(fold_bytes, np.int32)
            for rows, columns, block in packed_matrices(*parts, width):
                seen = True
                own, fold = (block * block).sum(axis=1), folds[rows]
                away = own[:, None] - 2 * block @ centres[:, columns].T + squares
                nearest = np.zeros((len(block), len(centres)))
                every = np.arange(len(block))
                for m, (low, high, held) in enumerate(models):
                    best = away[:, low:high].argmin(axis=1)
                    cost, fitted = np.maximum(away[every, low + best], 0.0), fold != held
                    nearest[every[fitted], low + best[fitted]] = 1.0
                    costs[:, m] += cost[fitted].sum(), cost[~fitted].sum(), (~fitted).sum()
                counts += nearest.sum(axis=0)
                if sums_wanted:
                    sums[:, columns] += nearest.T @ block
        if not seen:
            return
        cell, at = np.nonzero(sums)
        parts = [(cell, at, sums[cell, at]), (np.arange(len(centres)), np.full(len(centres), COUNT), counts)]
        parts += [(np.arange(len(models)), np.full(len(models), what), costs[i]) for i, what in enumerate((COST, HELD_COST, HELD_ROWS))]
        columns = [np.concatenate([p[i] for p in parts]) for i in range(3)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0].astype(np.int32)), pa.array(columns[1].astype(np.int32)), pa.array(columns[2].astype(float))],
            names=["cell", "at", "value"],
        )

    return run


def _scan(packed_rows: DataFrame, fits: list[Fit], sums_wanted: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """One pass for the given models: sums per centre, counts per centre, and costs (fitted, held out, rows held out)."""
    out = []
    width = fits[0].centres.shape[1]
    per_scan = max(1, SMALL_BYTES // (8 * max(width, 1) * max(f.k for f in fits)))
    for start in range(0, len(fits), per_scan):
        some = fits[start : start + per_scan]
        ends = np.cumsum([len(f.centres) for f in some]).tolist()
        models = [(end - len(f.centres), end, f.fold) for f, end in zip(some, ends)]
        stacked = np.vstack([f.centres for f in some])
        rows = (
            packed_rows.mapInArrow(_partial_sums(models, stacked, sums_wanted), "cell int, at int, value double")
            .groupBy("cell", "at").agg(F.sum("value").alias("value")).toArrow()
        )
        cell, at, value = (rows.column(n).to_numpy() for n in ("cell", "at", "value"))
        sums, counts, costs = np.zeros(stacked.shape), np.zeros(len(stacked)), np.zeros((3, len(some)))
        inside = at >= 0
        sums[cell[inside], at[inside]] = value[inside]
        counts[cell[at == COUNT]] = value[at == COUNT]
        for i, what in enumerate((COST, HELD_COST, HELD_ROWS)):
            costs[i, cell[at == what]] = value[at == what]
        out += [(sums[low:high], counts[low:high], costs[:, m]) for m, (low, high, _) in enumerate(models)]
    return out


def fit_grid(
    frame: DataFrame,
    ks: tuple[int, ...],
    features: str = "features",
    fold: Column | None = None,
    folds: int = 0,
    max_iterations: int = 10,
    seed: int = 42,
    starts: dict[int, np.ndarray] | None = None,
    tolerance: float = TOLERANCE,
) -> list[Fit]:
    """A fit of each k, over all rows or, with ``folds``, without each fold (``fold`` numbers them from 0).

    Rows without a vector are left out. A model starts from distinct rows in the order of a hash, or from the ``starts``
    of its k; a centre without rows stays where it is, and a model stops when no centre moves by more than
    ``tolerance``. With fewer distinct rows than k there are as many centres as rows. No rows give no fits.
    """
    if not isinstance(frame.schema[features].dataType, VectorUDT):
        raise TypeError(f"{features} is not a vector column")
    number = F.coalesce(fold.cast("int"), F.lit(0)) if fold is not None else F.lit(0)
    vectors = frame.filter(F.col(quoted(features)).isNotNull()).select(number.alias("fold"), F.col(quoted(features)).alias("features")).persist()
    rows = None
    try:
        points = starting_points(vectors, max(ks), seed) if starts is None else {}
        fits = []
        for k in ks:
            for held in range(folds) if folds else (-1,):
                first = np.array(starts[k], dtype=float) if starts is not None else _first_centres(points, k, held)
                if len(first):
                    fits.append(Fit(k, held, first))
        rows = vectors.select("fold", F.unwrap_udt("features").alias("features")).mapInArrow(_packed, f"fold binary, {PACKED}").persist()
        moving = list(fits)
        for _ in range(max_iterations):
            if not moving:
                break
            still = []
            for fit, (sums, counts, _) in zip(moving, _scan(rows, moving, True)):
                means = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], fit.centres)
                moved = ((means - fit.centres) ** 2).sum(axis=1).max()
                fit.centres, fit.iterations = means, fit.iterations + 1
                if moved > tolerance * tolerance:
                    still.append(fit)
            moving = still
            vectors.unpersist()
        if fits:
            for fit, (_, _, (cost, held_cost, held_rows)) in zip(fits, _scan(rows, fits, False)):
                fit.cost, fit.held_out = float(cost), float(held_cost) if held_rows else None
        return fits
    finally:
        vectors.unpersist()
        if rows is not None:
            rows.unpersist()
