"""Logistic regressions of many penalties and folds, fitted together in shared scans.

Every round reads the rows once and gives each model that is not done its loss, gradient and matrix of second derivatives;
a proximal Newton step follows on the driver, on numbers that depend on the width alone. A model is done when zero
lies in its subgradient within a tolerance, and that gap is part of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartotek.functions.vector import vector_entries
from kartotek.operators.blocks import matrices
from kartotek.operators.nested import quoted

WIDEST = 512
TOLERANCE = 1e-9
SALTS = 16
FEW_BYTES = 8 << 20
_SUM = "key int, salt int, total binary"


@dataclass
class LogisticFit:
    """One model: its penalty, the fold it was not fitted on (-1: none), what it learned and how good that is.

    ``gap`` is the largest distance of a partial subgradient of the mean loss from zero; ``accuracy`` is that on the fold,
    None without rows in it.
    """

    penalty: float
    mixing: float
    fold: int
    coefficients: np.ndarray
    intercept: float = 0.0
    rows: int = 0
    scale: np.ndarray = field(default_factory=lambda: np.empty(0))
    gap: float = float("inf")
    rounds: int = 0
    accuracy: float | None = None


def _packed(key: int, salt: int, total: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([key], pa.int32()), pa.array([salt], pa.int32()), pa.array([total.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["key", "salt", "total"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for key, total in zip(batch.column("key").to_pylist(), batch.column("total").to_pylist()):
            values = np.frombuffer(total)
            totals[key] = totals[key] + values if key in totals else values
    for key, total in totals.items():
        yield _packed(key, 0, total)


def _sums(vectors: DataFrame, work, bytes_a_task: int) -> dict[int, np.ndarray]:
    """Arrays that tasks give per key, added up in two steps, so that one array a key reaches the driver; or there if few."""
    parts = vectors.mapInArrow(work, _SUM)
    if vectors.rdd.getNumPartitions() * bytes_a_task <= FEW_BYTES:
        totals: dict[int, np.ndarray] = {}
        for r in parts.collect():
            values = np.frombuffer(r["total"])
            totals[r["key"]] = totals[r["key"]] + values if r["key"] in totals else values
        return totals
    some = parts.repartition("key", "salt").mapInArrow(_added, _SUM)
    return {r["key"]: np.frombuffer(r["total"]) for r in some.repartition("key").mapInArrow(_added, _SUM).collect()}


def _blocks_of(batch: pa.RecordBatch, width: int):
    label, fold = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("label", "fold"))
    for rows, _, block in matrices(batch.column("features"), width, max(1 << 22, width)):
        yield block, label[rows], fold[rows]


def _moments(width: int, intercept: bool):
    """Per fold: rows, then sums and sums of squares of each position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, _, fold in _blocks_of(batch, width):
                for f in np.unique(fold).tolist():
                    mine = block[fold == f]
                    found = np.r_[len(mine), mine.sum(axis=0), (mine * mine).sum(axis=0)]
                    totals[f] = totals[f] + found if f in totals else found
        for f, total in totals.items():
            yield _packed(f, TaskContext.get().partitionId() % SALTS, total)

    return run


def _derivatives(models: list[tuple[int, np.ndarray, float]], width: int):
    """Per model: loss, gradient and second derivatives over its rows, and what it gets right on its fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        size = width + 1
        totals = [np.zeros(3 + size + size * size) for _ in models]
        seen = False
        weights = np.stack([w for _, w, _ in models], axis=1)
        bias = np.array([b for _, _, b in models])
        for batch in batches:
            for block, label, fold in _blocks_of(batch, width):
                seen = True
                margins = block @ weights + bias
                design = np.column_stack([block, np.ones(len(block))])
                for m, (held, _, _) in enumerate(models):
                    fitted = fold != held
                    z, y, x = margins[fitted, m], label[fitted], design[fitted]
                    p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
                    total = totals[m]
                    total[0] += (np.logaddexp(0.0, z) - y * z).sum()
                    away = ~fitted
                    total[1] += ((margins[away, m] > 0) == (label[away] > 0.5)).sum()
                    total[2] += away.sum()
                    total[3 : 3 + size] += (p - y) @ x
                    total[3 + size :] += ((x * (p * (1 - p))[:, None]).T @ x).ravel()
        if seen:
            for m, total in enumerate(totals):
                yield _packed(m, TaskContext.get().partitionId() % SALTS, total)

    return run


def _shrunk(value: float, by: float) -> float:
    return np.sign(value) * max(abs(value) - by, 0.0)


class _Problem:
    """The driver's side of one model: the penalty, where it stands, and its next step."""

    def __init__(self, fit: LogisticFit, scale: np.ndarray, rows: int, intercept: bool):
        self.fit, self.n, self.intercept = fit, max(rows, 1), intercept
        fit.rows, fit.scale = rows, scale
        width = len(scale)
        self.l1 = np.r_[fit.penalty * fit.mixing * scale, 0.0]
        self.l2 = np.r_[fit.penalty * (1 - fit.mixing) * scale * scale, 0.0]
        self.free = np.r_[scale > 0, intercept]
        self.at = np.r_[fit.coefficients, fit.intercept] if len(fit.coefficients) else np.zeros(width + 1)
        self.before: tuple[np.ndarray, float, np.ndarray, float] | None = None

    def objective(self, loss: float, at: np.ndarray) -> float:
        return loss / self.n + self.l1 @ np.abs(at) + 0.5 * self.l2 @ (at * at)

    def subgradient_gap(self, gradient: np.ndarray) -> float:
        smooth = gradient + self.l2 * self.at
        inside = np.maximum(np.abs(smooth) - self.l1, 0.0)
        gaps = np.where(self.at != 0, np.abs(smooth + self.l1 * np.sign(self.at)), inside)
        return float(gaps[self.free].max()) if self.free.any() else 0.0

    def take(self, total: np.ndarray, last: bool, tolerance: float) -> bool:
        """Use one scan's sums at the present point; True when the model is done."""
        size = len(self.at)
        loss, right, held = total[:3]
        gradient, second = total[3 : 3 + size] / self.n, total[3 + size :].reshape(size, size) / self.n
        value = self.objective(loss, self.at)
        self.fit.gap = self.subgradient_gap(gradient)
        self.fit.coefficients, self.fit.intercept = self.at[:-1].copy(), float(self.at[-1])
        self.fit.accuracy = float(right / held) if held else None
        if self.fit.gap <= tolerance or last:
            return True
        self.fit.rounds += 1
        if self.before is not None:
            start, was, direction, step = self.before
            if value > was + 1e-12 * abs(was) and step > 1e-6:
                self.before = start, was, direction, step / 2
                self.at = start + direction * step / 2
                return False
        direction = self._direction(gradient, second)
        self.before = self.at.copy(), value, direction, 1.0
        self.at = self.at + direction
        return False

    def _direction(self, gradient: np.ndarray, second: np.ndarray) -> np.ndarray:
        """To the minimum of the loss's parabola plus the penalty."""
        free = np.flatnonzero(self.free)
        model = second + np.diag(np.where(self.l2 > 0, self.l2, 0.0) + 1e-12)
        if not self.l1.any():
            step = np.zeros(len(self.at))
            step[free] = np.linalg.lstsq(model[np.ix_(free, free)], -(gradient + self.l2 * self.at)[free], rcond=None)[0]
            return step
        point, slope = self.at.copy(), gradient + self.l2 * self.at
        for _ in range(10_000):
            largest = 0.0
            for j in free:
                curve = model[j, j]
                if curve <= 0:
                    continue
                moved = _shrunk(point[j] - slope[j] / curve, self.l1[j] / curve) - point[j]
                if moved:
                    point[j] += moved
                    slope = slope + model[:, j] * moved
                    largest = max(largest, abs(moved) * np.sqrt(curve))
            if largest < 1e-12:
                break
        return point - self.at


def fit_paths(
    frame: DataFrame,
    penalties: tuple[float, ...],
    mixing: float = 0.0,
    label: str = "label",
    features: str = "features",
    fold: Column | None = None,
    folds: int = 0,
    intercept: bool = True,
    standardize: bool = False,
    tolerance: float = TOLERANCE,
    max_rounds: int = 100,
) -> list[LogisticFit]:
    """A fit of each penalty over all rows (fold -1) and, with ``folds``, without each of them.

    Minimised is the mean loss plus ``penalty * (mixing * |w| + (1 - mixing) / 2 * w²)``, the intercept left out; with
    ``standardize`` the penalty is on coefficients times the standard deviation of their position, and positions that do not
    vary get 0. Labels are 0 and 1; rows without label or vector are left out. At most ``WIDEST`` positions, as
    the second derivatives grow with their square; no rows give no fits.
    """
    if not isinstance(frame.schema[features].dataType, VectorUDT):
        raise TypeError(f"{features} is not a vector column")
    parts = F.unwrap_udt(F.col(quoted(features)))
    number = F.coalesce(fold.cast("int"), F.lit(0)) if fold is not None else F.lit(0)
    rows = frame.filter(F.col(quoted(features)).isNotNull() & F.col(quoted(label)).isNotNull()).select(
        parts.alias("features"), F.col(quoted(label)).cast("double").alias("label"), number.alias("fold")
    )
    first = rows.select(F.coalesce("features.size", F.size("features.values"))).first()
    if first is None:
        return []
    width = first[0]
    if width > WIDEST:
        raise ValueError(f"{width} positions; at most {WIDEST}")
    rows = rows.persist()
    try:
        moments = _sums(rows, _moments(width, intercept), 8 * (1 + 2 * width) * max(folds, 1))
        problems = []
        for held in (-1, *range(folds)):
            used = sum((m for f, m in moments.items() if f != held), np.zeros(1 + 2 * width))
            n, sums, squares = used[0], used[1 : 1 + width], used[1 + width :]
            spread = np.sqrt(np.maximum(squares - sums * sums / max(n, 1), 0.0) / max(n - 1, 1))
            scale = np.where(spread > 1e-12 * np.sqrt(squares / max(n, 1)), spread, 0.0) if standardize else np.ones(width)
            for penalty in penalties:
                problems.append(_Problem(LogisticFit(penalty, mixing, held, np.empty(0)), scale, int(n), intercept))
        moving = [p for p in problems if p.fit.rows]
        for round_ in range(max_rounds + 1):
            if not moving:
                break
            models = [(p.fit.fold, p.at[:-1], float(p.at[-1])) for p in moving]
            totals = _sums(rows, _derivatives(models, width), 8 * (width + 2) ** 2 * len(models))
            moving = [p for m, p in enumerate(moving) if not p.take(totals[m], round_ == max_rounds, tolerance)]
        return [p.fit for p in problems if p.fit.rows]
    finally:
        rows.unpersist()


def probability(frame: DataFrame, fit: LogisticFit, features: str = "features") -> Column:
    """The probability of label 1 as a column expression."""
    weights = F.lit(fit.coefficients.tolist())
    margin = F.aggregate(
        vector_entries(F.col(quoted(features))), F.lit(fit.intercept), lambda total, e: total + e["value"] * F.get(weights, e["index"])
    )
    return 1 / (1 + F.exp(-margin))


@dataclass
class LogisticSearch:
    """The fits of a search, the mean accuracy of each penalty over the folds, and the fit of the best one on all rows."""

    fits: list[LogisticFit]
    accuracy: dict[float, float]
    best: LogisticFit
    features: str
    prediction: str

    def transform(self, frame: DataFrame) -> DataFrame:
        """Rows with the predicted label as a double; null where there is no vector."""
        p = probability(frame, self.best, self.features)
        return frame.withColumn(self.prediction, (p > 0.5).cast("double"))


def logistic_search(
    frame: DataFrame,
    id_col: str,
    label: str = "label",
    features: str = "features",
    inverse_strengths: tuple[float, ...] = (0.1, 0.333, 0.666, 0.999),
    folds: int = 3,
    prediction: str = "predictionLogReg",
) -> LogisticSearch:
    """The penalty of best accuracy over folds by a hash of the id, the first of equals, all fitted in shared scans.

    Strengths are inverse and meant for a loss summed over rows: ``1 / (C * n)`` for the mean.
    """
    n = frame.filter(F.col(quoted(features)).isNotNull() & F.col(quoted(label)).isNotNull()).count()
    if not n:
        raise ValueError("no rows to fit on")
    penalties = tuple(1.0 / (c * n) for c in inverse_strengths)
    fold = F.pmod(F.xxhash64(F.col(quoted(id_col))), F.lit(folds))
    fits = fit_paths(frame, penalties, 0.0, label, features, fold, folds)
    accuracy = {}
    for penalty in penalties:
        told = [f.accuracy for f in fits if f.penalty == penalty and f.fold >= 0 and f.accuracy is not None]
        accuracy[penalty] = float(np.mean(told)) if told else 0.0
    best = max(penalties, key=lambda p: accuracy[p])
    return LogisticSearch(fits, accuracy, next(f for f in fits if f.fold == -1 and f.penalty == best), features, prediction)
