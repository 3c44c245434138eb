"""Survival SVM with the ranking objective, without forming pairs.

Objective: |w|^2 / 2 + alpha / 2 * sum over comparable pairs of max(0, 1 - (f_i - f_j))^2, f = w.x, where a pair is
comparable if j failed and i lived longer.  Value, gradient and Hessian products only need, for each row, the
number and the score sum of its partners inside the margin.  Those are order statistics: scores are counted on a
grid whose unit is a whole number of cells, by year of the duration, and running sums over years and cells give
every row its partners' sums by looking up one cell.  The tables have years x cells entries whatever the number
of rows; a step is one scan for the counts and one for the products with the features.  Kernel features are never
stored: a scan works out a row's kernel values, and their projection is applied to weights and sums.

The grid decides only which pairs are inside the margin; their losses use exact sums.  A pair within a cell of
the margin's edge has a loss below the square of the cell's width, which bounds the difference.

The problem is solved by Newton steps whose directions come from conjugate gradients, with halving of the step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..session import store
from .nystrom import Nystrom
from .table import FLAG, MAX_YEARS, YEAR, matrix, vector_sums

#: Cells of the score grid, at most; cells of one margin, at most (a power of two, halved until the grid fits).
CELLS, MARGIN = 1 << 14, 1 << 11
STEPS, PRODUCTS, TOLERANCE = 20, 30, 1e-5


@dataclass
class Pairs:
    """Rows with features (a column ``x`` of arrays, mapped by the kernel if there is one), duration and event flag."""

    df: DataFrame
    dim: int
    years: int
    tasks: int
    kernel: Nystrom | None = None

    def weights(self, w: np.ndarray) -> np.ndarray:
        """Weights of what ``values`` returns, from weights of the features."""
        return w if self.kernel is None else self.kernel.weights @ w

    def summed(self, add) -> np.ndarray:
        """Sum of feature vectors, from a sum of what ``values`` returns."""
        if self.kernel is None:
            return vector_sums(self.df, self.dim, add, self.tasks)
        return vector_sums(self.df, len(self.kernel.landmarks), add, self.tasks) @ self.kernel.weights


def values(x: np.ndarray, kernel: Nystrom | None) -> np.ndarray:
    """The features, or the kernel's values before their projection."""
    return x if kernel is None else kernel.values(x)


def pairs(train: DataFrame, features: str, kernel: Nystrom | None = None) -> Pairs:
    """Rows of ``train``; with a kernel, ``features`` are its inputs."""
    rows = train.where(F.col(S.DURATION).isNotNull() & F.col(S.EVENT).isNotNull() & (F.col(S.DURATION) >= 0))
    t = store(rows.select(F.col(S.DURATION).cast("int").alias(YEAR), F.col(S.EVENT).cast("int").alias(FLAG), vector_to_array(features).alias("x")), "rank-rows")
    last, dim = t.agg(F.max(YEAR), F.max(F.size("x"))).first()
    if (last or 0) >= MAX_YEARS:
        raise ValueError(f"durations reach {last} years, at most {MAX_YEARS - 1} are allowed")
    dim = dim if kernel is None else kernel.weights.shape[1]
    return Pairs(t, dim or 0, (last or 0) + 1, t.rdd.getNumPartitions(), kernel)


class Grid:
    """Score cells: ``margin`` of them make up one unit."""

    def __init__(self, low: float, high: float):
        self.margin = MARGIN
        while (high - low + 2) * self.margin > CELLS and self.margin > 1:
            self.margin //= 2
        self.low = low
        self.cells = int(np.floor((high - low) * self.margin)) + 1

    def of(self, f: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((f - self.low) * self.margin).astype(np.int64), 0, self.cells - 1)


def _longer(t: np.ndarray, margin: int) -> np.ndarray:
    """For an event at (year, cell): the sum over rows of later years whose cell is below the event's plus the margin, or equal."""
    later = np.zeros_like(t)
    later[:-1] = np.cumsum(t[:0:-1], axis=0)[::-1]
    upto = np.cumsum(later, axis=1)
    return upto[:, np.minimum(np.arange(t.shape[1]) + margin, t.shape[1] - 1)]


def _sooner(t: np.ndarray, margin: int) -> np.ndarray:
    """For a row at (year, cell): the sum over events of earlier years whose cell plus the margin reaches the row's."""
    earlier = np.zeros_like(t)
    earlier[1:] = np.cumsum(t, axis=0)[:-1]
    total = np.concatenate((np.zeros((len(t), 1)), np.cumsum(earlier, axis=1)), axis=1)
    return total[:, -1:] - total[:, np.maximum(np.arange(t.shape[1]) - margin, 0)]


class Objective:
    """Sums over the comparable pairs inside the margin at one w."""

    def __init__(self, data: Pairs, w: np.ndarray, alpha: float):
        self.data, self.w, self.alpha = data, w, alpha
        self.grid = Grid(*self._range())
        self.shape = (data.years, self.grid.cells)
        n, f, q, en, ef, eq = self._tables(3)
        m = self.grid.margin
        #: Partners of an event: longer-lived rows; of any row: sooner events.
        self.long_n, self.long_f, self.soon_n, self.soon_f = _longer(n, m), _longer(f, m), _sooner(en, m), _sooner(ef, m)
        # sum of (1 + f_j - f_i)^2 over pairs, from sums of 1, f and f^2 by cell of the event
        long_q = _longer(q, m)
        self.loss = float(((en + 2 * ef + eq) * self.long_n - 2 * (en + ef) * self.long_f + en * long_q).sum())
        self.value = float(w @ w) / 2 + alpha / 2 * self.loss

    def _range(self) -> tuple[float, float]:
        w, kernel = self.data.weights(self.w), self.data.kernel

        def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Least and greatest score of a task's rows."""
            lo, hi = np.inf, -np.inf
            for b in batches:
                if b.num_rows:
                    f = values(matrix(b.column(0), np.float64), kernel) @ w
                    lo, hi = min(lo, f.min()), max(hi, f.max())
            yield pa.record_batch([pa.array([lo], pa.float64()), pa.array([hi], pa.float64())], ["lo", "hi"])

        low, high = self.data.df.select("x").mapInArrow(ends, "lo double, hi double").agg(F.min("lo"), F.max("hi")).first()
        return (low, high) if low is not None and low <= high else (0.0, 0.0)

    def _tables(self, powers: int, v: np.ndarray | None = None) -> list[np.ndarray]:
        """By (year, cell): sums of 1, f, f^2 (or of x.v alone) over all rows, then over events."""
        cells = self.shape[0] * self.shape[1]
        own = Snapshot(self)
        v = None if v is None else self.data.weights(v)

        def add(b: pa.RecordBatch, total: np.ndarray) -> None:
            x, f, e, cell = own.each(b)
            out = total.reshape(-1, cells)
            for k, value in enumerate([x @ v] if v is not None else [np.ones(len(f)), f, f * f]):
                out[k] += np.bincount(cell, value, cells)
                out[k + len(out) // 2] += np.bincount(cell[e], value[e], cells)

        got = vector_sums(self.data.df, 2 * powers * cells, add, self.data.tasks)
        return list(got.reshape(2 * powers, *self.shape))

    def gradient(self) -> np.ndarray:
        """w - alpha * sum over pairs of (1 - f_i + f_j) (x_i - x_j)."""
        own = Snapshot(self)
        long_n, long_f, soon_n, soon_f = (t.ravel() for t in (self.long_n, self.long_f, self.soon_n, self.soon_f))

        def add(b: pa.RecordBatch, total: np.ndarray) -> None:
            x, f, e, cell = own.each(b)
            g = -((1 - f) * soon_n[cell] + soon_f[cell]) + np.where(e, (1 + f) * long_n[cell] - long_f[cell], 0)
            total += g @ x

        return self.w + self.alpha * self.data.summed(add)

    def product(self, v: np.ndarray) -> np.ndarray:
        """Hessian times v: v + alpha * sum over pairs of (x_i - x_j) (x_i - x_j).v"""
        u, eu = self._tables(1, v)
        own, m, inner = Snapshot(self), self.grid.margin, self.data.weights(v)
        long_n, soon_n, long_u, soon_u = (t.ravel() for t in (self.long_n, self.soon_n, _longer(u, m), _sooner(eu, m)))

        def add(b: pa.RecordBatch, total: np.ndarray) -> None:
            x, _, e, cell = own.each(b)
            z = x @ inner
            total += (soon_n[cell] * z - soon_u[cell] + np.where(e, long_n[cell] * z - long_u[cell], 0)) @ x

        return v + self.alpha * self.data.summed(add)


class Snapshot:
    """What a task needs of an objective: scores and cells of a batch."""

    def __init__(self, o: Objective):
        self.w, self.grid, self.kernel = o.data.weights(o.w), o.grid, o.data.kernel

    def each(self, b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Features, scores, event flags and table cells of a batch."""
        x = values(matrix(b.column("x"), np.float64), self.kernel)
        y, e = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (YEAR, FLAG))
        f = x @ self.w
        return x, f, e == 1, y * self.grid.cells + self.grid.of(f)


def direction(o: Objective, g: np.ndarray, products: int = PRODUCTS) -> np.ndarray:
    """Conjugate gradients for the Newton step, until the residual is a tenth of the gradient."""
    p, r = np.zeros_like(g), -g
    d, size = r.copy(), float(r @ r)
    for _ in range(products):
        h = o.product(d)
        a = size / float(d @ h)
        p, r = p + a * d, r - a * h
        new = float(r @ r)
        if new <= 0.01 * float(g @ g):
            break
        d, size = r + new / size * d, new
    return p


def fit(data: Pairs, alpha: float = 1.0, steps: int = STEPS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Weights at which the gradient is ``tolerance`` of the first one, or no step lowers the objective.

    ``alpha`` weighs the pairs' mean loss: their sum is divided by the number of comparable pairs, so that it
    means the same at every size.
    """
    zero = Objective(data, np.zeros(data.dim), 0.0)
    at = Objective(data, zero.w, alpha / zero.loss) if zero.loss else None  # every pair's loss is 1 at w = 0
    if at is None:
        return zero.w
    first = None
    for _ in range(steps):
        g = at.gradient()
        size = float(np.sqrt(g @ g))
        first = size if first is None else first
        if size <= tolerance * max(first, 1e-300):
            break
        p, length = direction(at, g), 1.0
        while length > 1e-4:
            to = Objective(data, at.w + length * p, at.alpha)
            if to.value <= at.value + 1e-4 * length * float(g @ p):
                break
            length /= 2
        else:
            break
        at = to
    return at.w


def risk(w: np.ndarray, features: str) -> Column:
    """Minus the ranking score: long-lived rows score high, risk is the other way round."""
    x = vector_to_array(features)
    return -F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
