"""The binomial GLM for tables of any width, without a matrix of features by features.

Each Fisher scoring step solves its equations by conjugate gradients: a scan of the rows multiplies the weighted second
derivatives with one vector, and stored entries alone take part. Standard errors of chosen terms are the roots of the
diagonal of the inverse, found in the same way from unit vectors, several in a scan.

Where a row stores at most one position besides the most frequent ones, as a row of a wide code does, rows are dealt by that position of
their own. A task then finds the coefficients of its positions for given coefficients of the shared ones, and the
steps are taken over these alone; what a step sends to the driver does not grow with the table or its width.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartotek.operators.blocks import entries_of
from kartotek.operators.nested import quoted
from kartotek.sizing import SMALL_BYTES

TOLERANCE = 1e-8
MOST_STEPS = 50
SHARED = 64
DENSE_ROWS = 1 << 14


@dataclass
class WideFit:
    """Coefficients and intercept of a fit, its deviance, and the largest entry of the mean gradient at its end."""

    coefficients: np.ndarray
    intercept: float
    deviance: float
    gap: float
    steps: int
    rows: int


def _entries(batch: pa.RecordBatch, width: int):
    """Stored entries of a batch with a column of ones as the last position."""
    row, position, value, size = entries_of(batch.column("features"))
    if (size != width).any():
        raise ValueError("vector sizes differ")
    n = batch.num_rows
    every = np.arange(n)
    return np.r_[row, every], np.r_[position, np.full(n, width)], np.r_[value, np.ones(n)], n


def _vector_rows(totals: np.ndarray) -> Iterator[pa.RecordBatch]:
    which, at = np.nonzero(totals)
    for start in range(0, len(at), 1 << 16):
        part = slice(start, start + (1 << 16))
        yield pa.RecordBatch.from_arrays(
            [pa.array(which[part].astype(np.int32)), pa.array(at[part].astype(np.int32)), pa.array(totals[which[part], at[part]])],
            names=["which", "at", "value"],
        )


def _added(rows: DataFrame, work, shape: tuple[int, int]) -> np.ndarray:
    """What the tasks give, added up by position before it reaches the driver."""
    table = rows.mapInArrow(work, "which int, at int, value double").groupBy("which", "at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(shape)
    out[table["which"].to_numpy(), table["at"].to_numpy()] = table["value"].to_numpy()
    return out


def _gradient(beta: np.ndarray):
    """Gradient of the negative log likelihood, then the diagonal of its second derivatives, the deviance and the rows."""
    width = len(beta) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((3, width + 1))
        seen = False
        for batch in batches:
            seen = True
            row, position, value, n = _entries(batch, width)
            y = batch.column("label").to_numpy(zero_copy_only=False)
            z = np.bincount(row, weights=value * beta[position], minlength=n)
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
            totals[0] += np.bincount(position, weights=(p - y)[row] * value, minlength=width + 1)
            totals[1] += np.bincount(position, weights=(p * (1 - p))[row] * value * value, minlength=width + 1)
            totals[2, 0] += 2 * (np.logaddexp(0.0, z) - y * z).sum()
            totals[2, 1] += n
        if seen:
            yield from _vector_rows(totals)

    return run


def _products(beta: np.ndarray, vectors: np.ndarray):
    """Second derivatives at ``beta`` times each of the vectors."""
    width = len(beta) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(vectors.shape)
        seen = False
        for batch in batches:
            seen = True
            row, position, value, n = _entries(batch, width)
            z = np.bincount(row, weights=value * beta[position], minlength=n)
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
            weight = p * (1 - p)
            for i, v in enumerate(vectors):
                along = np.bincount(row, weights=value * v[position], minlength=n)
                totals[i] += np.bincount(position, weights=(weight * along)[row] * value, minlength=width + 1)
        if seen:
            yield from _vector_rows(totals)

    return run


def _solve(rows: DataFrame, beta: np.ndarray, diagonal: np.ndarray, right: np.ndarray, tolerance: float, most: int) -> np.ndarray:
    """Solutions of several equations in shared scans, by conjugate gradients scaled with the diagonal.

    Positions whose second derivative is zero (never stored, or settled) stay at 0.
    """
    scale = np.where(diagonal > 1e-300, 1.0 / np.where(diagonal > 1e-300, diagonal, 1.0), 0.0)
    out, rest = np.zeros(right.shape), right * (scale > 0)
    whole = np.linalg.norm(rest * np.sqrt(scale), axis=1)
    scaled = rest * scale
    toward, energy = scaled.copy(), (rest * scaled).sum(axis=1)
    for _ in range(most):
        open_ = np.flatnonzero(np.sqrt(np.maximum(energy, 0)) > tolerance * whole)
        if not len(open_):
            break
        product = _added(rows, _products(beta, toward[open_]), (len(open_), right.shape[1]))
        for i, o in enumerate(open_):
            curve = toward[o] @ product[i]
            if curve <= 0:
                energy[o] = 0.0
                continue
            step = energy[o] / curve
            out[o] += step * toward[o]
            rest[o] -= step * product[i]
            scaled[o] = rest[o] * scale
            fresh = rest[o] @ scaled[o]
            toward[o] = scaled[o] + fresh / energy[o] * toward[o]
            energy[o] = fresh
    return out


def _stored(batch: pa.RecordBatch, width: int):
    """Row, position and value of the entries of a batch that are not zero, its size checked."""
    row, position, value, size = entries_of(batch.column("features"))
    if (size != width).any():
        raise ValueError("vector sizes differ")
    use = value != 0
    return row[use], position[use], value[use]


def _position_counts(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = np.unique(_stored(batch, width)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(n.astype(np.int64))], names=["at", "n"])

    return run


def _dealt(shared: np.ndarray, width: int):
    """Each row with its own position (-1: none) and the value there, its shared ones by their number, and how many others it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, position, value = _stored(batch, width)
            number = np.minimum(np.searchsorted(shared, position), max(len(shared) - 1, 0))
            inside = shared[number] == position if len(shared) else np.zeros(len(position), dtype=bool)
            others = np.bincount(row[~inside], minlength=batch.num_rows)
            own, x = np.full(batch.num_rows, -1, dtype=np.int64), np.zeros(batch.num_rows)
            own[row[~inside]], x[row[~inside]] = position[~inside], value[~inside]
            offsets = pa.array(np.searchsorted(row[inside], np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(own), pa.array(others.astype(np.int64)), pa.array(x), batch.column("label"),
                    pa.ListArray.from_arrays(offsets, pa.array(number[inside].astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(value[inside])),
                ],
                names=["own", "others", "x", "label", "at", "value"],
            )

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches ordered by ``own``, cut so that no group of one position is parted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column("own").to_numpy()
        if own[-1] < 0:
            yield batch
            continue
        last = int(np.searchsorted(own, own[-1]))
        if last or (held and held[0].column("own")[0].as_py() != own[0]):
            cut = last or batch.num_rows
            same = int(np.searchsorted(own, held[0].column("own")[0].as_py(), "right")) if held else 0
            if held:
                yield pa.Table.from_batches([*held, batch.slice(0, same)]).combine_chunks().to_batches()[0]
            if last > same:
                yield batch.slice(same, cut - same)
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _own_coefficients(group: np.ndarray, groups: int, x: np.ndarray, y: np.ndarray, base: np.ndarray) -> np.ndarray:
    """For each group the coefficient of ``x`` at which its gradient vanishes, next to ``base``; steps are bounded."""
    out, moving = np.zeros(groups), np.arange(len(group))
    reach = np.zeros(groups)
    np.maximum.at(reach, group, np.abs(x))
    least = 1e-12 * (1 + np.bincount(group, minlength=groups)) * reach
    for step in range(4 * MOST_STEPS):
        g, v = group[moving], x[moving]
        p = 1.0 / (1.0 + np.exp(-np.clip(base[moving] + v * out[g], -700, 700)))
        slope = np.bincount(g, weights=(p - y[moving]) * v, minlength=groups)
        curve = np.bincount(g, weights=p * (1 - p) * v * v, minlength=groups)
        open_ = (np.abs(slope) > least) & (curve > 0)
        if not open_.any():
            break
        change = np.where(open_, -slope / np.where(open_, curve, 1.0), 0.0)
        if step < MOST_STEPS:
            change = np.clip(change, -2 / reach, 2 / reach)
        else:
            change = change / (1 + np.abs(change) * reach)
        out += change
        moving = moving[open_[g]]
    return out


def _shared_step(beta: np.ndarray, coefficients: bool):
    """At the shared ``beta`` with every own coefficient at its best: gradient, second derivatives, deviance, rows and widest own gradient.

    With ``coefficients``, the own coefficients instead.
    """
    k = len(beta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen, widest = np.zeros(k * k + k + 2), False, 0.0
        for batch in _whole_groups(batches):
            own, x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("own", "x", "label"))
            n, has = len(own), bool(own[0] >= 0)
            row = pc.list_parent_indices(batch.column("at")).to_numpy().astype(np.int64)
            at, value = (pc.list_flatten(batch.column(c)).to_numpy(zero_copy_only=False) for c in ("at", "value"))
            row, at, value = np.r_[row, np.arange(n)], np.r_[at.astype(np.int64), np.full(n, k - 1)], np.r_[value, np.ones(n)]
            base = np.bincount(row, weights=value * beta[at], minlength=n)
            positions, group = np.unique(own, return_inverse=True) if has else (own[:0], np.zeros(n, dtype=np.int64))
            found = _own_coefficients(group, len(positions), x, y, base) if has else np.zeros(1)
            if coefficients:
                if has:
                    yield pa.RecordBatch.from_arrays([pa.array(positions), pa.array(found)], names=["at", "value"])
                continue
            seen, z = True, base + x * found[group]
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
            weight = p * (1 - p)
            square, gradient = np.zeros((k, k)), np.bincount(at, weights=(p - y)[row] * value, minlength=k)
            order = np.argsort(row, kind="stable")
            bounds = np.searchsorted(row[order], np.arange(0, n + DENSE_ROWS, DENSE_ROWS))
            for i in range(len(bounds) - 1):
                some, start = order[bounds[i] : bounds[i + 1]], i * DENSE_ROWS
                block = np.zeros((min(DENSE_ROWS, n - start), k))
                block[row[some] - start, at[some]] = value[some]
                square += block.T @ (block * weight[start : start + len(block), None])
            if has:
                slope = np.bincount(group, weights=(p - y) * x)
                curve = np.bincount(group, weights=weight * x * x)
                inverse = np.where(curve > 1e-300, 1.0 / np.where(curve > 1e-300, curve, 1.0), 0.0)
                across = np.bincount(group[row] * k + at, weights=(weight * x)[row] * value, minlength=len(positions) * k).reshape(-1, k)
                square -= across.T @ (across * inverse[:, None])
                sums[k * k : k * k + k] -= across.T @ (slope * inverse)
                widest = max(widest, float(np.abs(slope).max()))
            sums[: k * k] += square.ravel()
            sums[k * k : k * k + k] += gradient
            sums[-2:] += 2 * (np.logaddexp(0.0, z) - y * z).sum(), n
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(sums) + 1)), pa.array(np.r_[sums, widest])], names=["at", "value"]
            )

    return run


def _fit_shared(rows: DataFrame, width: int, tolerance: float, max_steps: int) -> WideFit | None:
    """The fit over the shared positions, own ones found where their rows are; None when a row has several of its own."""
    counted = rows.mapInArrow(_position_counts(width), "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    shared = np.array(sorted(r["at"] for r in counted.orderBy(F.desc("n"), "at").limit(SHARED).collect()), dtype=np.int64)
    dealt = rows.mapInArrow(
        _dealt(shared, width), "own long, others long, x double, label double, at array<int>, value array<double>"
    )
    if dealt.agg(F.max("others")).first()[0] > 1:
        return None
    grouped = dealt.filter("own >= 0").repartition("own").sortWithinPartitions("own")
    kept = grouped.unionByName(dealt.filter("own < 0")).drop("others").persist()
    try:
        k = len(shared) + 1
        beta, direction, before = np.zeros(k), None, np.inf
        for step in range(max_steps + 1):
            told = (
                kept.mapInArrow(_shared_step(beta, False), "at long, value double")
                .groupBy("at").agg(F.sum("value").alias("total"), F.max("value").alias("most")).toArrow().sort_by("at")
            )
            total = told["total"].to_numpy()
            gradient, (deviance, n), widest = total[k * k : k * k + k], total[k * k + k : k * k + k + 2], told["most"][-1].as_py()
            if direction is not None and deviance > before + 1e-12 * abs(before) and np.abs(direction).max() > 1e-12:
                direction = direction / 2
                beta = beta - direction
                continue
            gap = max(float(np.abs(gradient).max()), widest) / n
            if gap <= tolerance or step == max_steps:
                break
            direction = -np.linalg.pinv(total[: k * k].reshape(k, k), rcond=1e-10, hermitian=True) @ gradient
            beta, before = beta + direction, deviance
        own = kept.mapInArrow(_shared_step(beta, True), "at long, value double").toArrow()
        coefficients = np.zeros(width)
        coefficients[shared] = beta[:-1]
        coefficients[own["at"].to_numpy()] = own["value"].to_numpy()
        return WideFit(coefficients, float(beta[-1]), float(deviance), float(gap), step, int(n))
    finally:
        kept.unpersist()


def _rows(frame: DataFrame, label: str, features: str) -> DataFrame:
    if not isinstance(frame.schema[features].dataType, VectorUDT):
        raise TypeError(f"{features} is not a vector column")
    return frame.filter(F.col(quoted(features)).isNotNull() & F.col(quoted(label)).isNotNull()).select(
        F.unwrap_udt(F.col(quoted(features))).alias("features"), F.col(quoted(label)).cast("double").alias("label")
    )


def fit_wide_binomial(
    frame: DataFrame, label: str = "label", features: str = "features", tolerance: float = TOLERANCE, max_steps: int = MOST_STEPS
) -> WideFit:
    """Binomial GLM with logit link and intercept over vectors of any width; rows without label or vector are left out.

    Steps are halved while the deviance rises, and end when every entry of the mean gradient is within ``tolerance``
    of zero. Positions that no row stores get 0. The coefficients are on the driver; rows that store several positions
    besides the ``SHARED`` most frequent need a few vectors of that length there, sent in every scan.
    """
    rows = _rows(frame, label, features).persist()
    try:
        first = rows.select(F.coalesce("features.size", F.size("features.values"))).first()
        if first is None:
            raise ValueError("no rows to fit on")
        width = first[0]
        fit = _fit_shared(rows, width, tolerance, max_steps)
        if fit is not None:
            return fit
        beta, direction, before = np.zeros(width + 1), None, np.inf
        for step in range(max_steps + 1):
            gradient, diagonal, told = _added(rows, _gradient(beta), (3, width + 1))
            deviance, n = told[0], max(told[1], 1.0) if width else told[0]
            if direction is not None and deviance > before + 1e-12 * abs(before) and np.abs(direction).max() > 1e-12:
                direction = direction / 2
                beta = beta - direction
                continue
            gap = np.abs(gradient).max() / n
            if gap <= tolerance or step == max_steps:
                break
            direction = _solve(rows, beta, diagonal, -gradient[None], min(1e-2, np.sqrt(gap)) * 1e-2, 4 * MOST_STEPS)[0]
            beta, before = beta + direction, deviance
        return WideFit(beta[:-1].copy(), float(beta[-1]), float(deviance), float(gap), step, int(n))
    finally:
        rows.unpersist()


def standard_errors(
    frame: DataFrame, fit: WideFit, terms: list[int], label: str = "label", features: str = "features", intercept: bool = True
) -> np.ndarray:
    """Standard errors of the coefficients at the given positions, and last that of the intercept."""
    rows = _rows(frame, label, features).persist()
    try:
        beta = np.r_[fit.coefficients, fit.intercept]
        wanted = [*terms, *([len(beta) - 1] if intercept else [])]
        _, diagonal, _ = _added(rows, _gradient(beta), (3, len(beta)))
        together = max(1, SMALL_BYTES // (8 * len(beta)))
        out = []
        for start in range(0, len(wanted), together):
            some = wanted[start : start + together]
            unit = np.zeros((len(some), len(beta)))
            unit[np.arange(len(some)), some] = 1.0
            inverse = _solve(rows, beta, diagonal, unit, 1e-10, 10 * MOST_STEPS)
            out += [float(np.sqrt(inverse[i, at])) for i, at in enumerate(some)]
        return np.array(out)
    finally:
        rows.unpersist()
