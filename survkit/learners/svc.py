"""Linear SVMs on kernel features (mean hinge loss, squared penalty on standardised weights), many in the same scans.

A scan makes each row's kernel values once and adds up, for every model that is still being fitted, the loss and its
gradient over the rows of its training set; between scans each model takes its own step by limited-memory BFGS with a
backtracking line search.  Models differ in kernel, penalty and the fold they leave out, so a grid search with
cross-validation costs about the scans of its slowest fit, not their sum, and no features are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Generator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store
from .nystrom import Nystrom, distances
from .table import matrix, vector_sums

#: Steps of a fit; it ends if the objective falls by less than this share in ``PATIENCE`` steps; differences it remembers.
STEPS, TOLERANCE, PATIENCE, MEMORY = 50, 1e-6, 5, 10
#: Lengths that are tried for a step.
TRIALS = 12
#: Rows of a task, and those whose kernel values are worked on at once.
TASK_ROWS = 100_000
AT_ONCE = 256
#: Cells of the score grid on which an area under the curve is counted; equal cells count one half.
CELLS = 1 << 14


@dataclass
class Problem:
    """A model to fit: its kernel's name, its penalty and the fold whose rows it leaves out (none: all rows are its own)."""

    kernel: str
    reg: float
    fold: int = -1


def minimised(x: np.ndarray, steps: int = STEPS, tolerance: float = TOLERANCE) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Asks for (value, gradient) at the points it yields; returns the point at which it ends."""
    f, g = yield x
    past: list[tuple[np.ndarray, np.ndarray]] = []
    values = [f]
    for _ in range(steps):
        d, a = -g, []
        for s, y in reversed(past):
            a.append(s @ d / (s @ y))
            d = d - a[-1] * y
        if past:
            s, y = past[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), own in zip(past, reversed(a)):
            d = d + (own - y @ d / (s @ y)) * s
        slope = float(g @ d)
        if slope >= 0:
            break
        # weak Wolfe conditions by bisection: the loss has kinks
        t, low, high = 1.0 if past else 1 / max(float(np.sqrt(g @ g)), 1e-12), 0.0, np.inf
        for _ in range(TRIALS):
            step = t * d
            to, gt = yield x + step
            if to > f + 1e-4 * t * slope:
                high = t
            elif gt @ d < 0.9 * slope:
                low = t
            else:
                break
            t = 2 * low if high == np.inf else (low + high) / 2
        if to >= f:
            if not past:
                break
            past = []
            continue
        s, y = step, gt - g
        if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
            past = [*past, (s, y)][-MEMORY:]
        x, f, g = x + s, to, gt
        values.append(f)
        if len(values) > PATIENCE and values[-1 - PATIENCE] - f <= tolerance * max(abs(f), 1e-12):
            break
    return x


def rows_of(df: DataFrame, features: str, label: str, folds: int = 0, seed: int = 0) -> DataFrame:
    """The stored input of the fits: label, a random fold per row, kernel inputs."""
    fold = F.floor(F.rand(seed) * folds).cast("int") if folds else F.lit(-1)
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("label"), fold.alias("fold"), vector_to_array(features).alias("x"))
    # a few large files would leave each scan to as few tasks
    return store(rows.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))), "svc-rows")


def _scan(rows: DataFrame, size: int, add: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """Sums over all rows; ``add`` gets inputs, labels -1 and 1, folds and the vector it adds to."""

    def batch(b: pa.RecordBatch, total: np.ndarray) -> None:
        x, y, fold = matrix(b.column("x"), np.float64), *(b.column(c).to_numpy(zero_copy_only=False) for c in ("label", "fold"))
        for k in range(0, len(y), AT_ONCE):
            add(x[k : k + AT_ONCE], 2.0 * y[k : k + AT_ONCE] - 1, fold[k : k + AT_ONCE], total)

    return vector_sums(rows, size, batch, rows.rdd.getNumPartitions())


def _values(x: np.ndarray, kernels: dict[str, Nystrom]) -> dict[str, np.ndarray]:
    """Each kernel's values of the rows of x; kernels on the same landmarks share the distances."""
    out, known = {}, {}
    for name, k in kernels.items():
        if id(k.landmarks) not in known:
            known[id(k.landmarks)] = distances(x, k.landmarks)
        out[name] = np.exp(known[id(k.landmarks)] * -k.gamma)
    return out


def solve(rows: DataFrame, kernels: dict[str, Nystrom], problems: list[Problem], steps: int = STEPS, tolerance: float = TOLERANCE) -> list[tuple[np.ndarray, float]]:
    """Weights of the kernel features and intercept of each problem."""
    used = {name: kernels[name] for name in dict.fromkeys(p.kernel for p in problems)}
    folds = sorted({-1, *(p.fold for p in problems)})
    dims = {name: k.weights.shape[1] for name, k in used.items()}

    def moments(x: np.ndarray, y: np.ndarray, fold: np.ndarray, total: np.ndarray) -> None:
        at = 0
        for name, kernel in used.items():
            z = kernel.of(x)
            for own in folds:
                z_own = z if own == -1 else z[fold == own]
                total[at] += len(z_own)
                total[at + 1 : at + 1 + dims[name]] += z_own.sum(axis=0)
                total[at + 1 + dims[name] : at + 1 + 2 * dims[name]] += (z_own * z_own).sum(axis=0)
                at += 1 + 2 * dims[name]

    got = np.split(_scan(rows, sum((1 + 2 * d) * len(folds) for d in dims.values()), moments), np.cumsum([1 + 2 * d for d in dims.values() for _ in folds])[:-1])
    sums = dict(zip([(name, f) for name in used for f in folds], got))
    n, scale = [], []
    for p in problems:
        s = sums[p.kernel, -1] - (sums[p.kernel, p.fold] if p.fold != -1 else 0)
        if s[0] < 1:
            raise ValueError("no rows to fit")
        one, two = np.split(s[1:], 2)
        std = np.sqrt(np.maximum(two - one * one / s[0], 0) / max(s[0] - 1, 1))
        n.append(s[0])
        scale.append(np.divide(1, std, out=np.zeros(len(std)), where=std > 0))  # a constant feature has no weight

    fits = [minimised(np.zeros(dims[p.kernel] + 1), steps, tolerance) for p in problems]
    asked: list[np.ndarray | None] = [next(f) for f in fits]
    done: list[np.ndarray | None] = [None] * len(problems)
    while any(a is not None for a in asked):
        groups = {}
        for name, kernel in used.items():
            if own := [k for k, p in enumerate(problems) if p.kernel == name and asked[k] is not None]:
                inner = np.column_stack([kernel.weights @ (asked[k][:-1] * scale[k]) for k in own])
                groups[name] = own, inner, np.array([asked[k][-1] for k in own]), np.array([problems[k].fold for k in own])
        sizes = [len(own) * (len(inner) + 2) for own, inner, _, _ in groups.values()]

        def add(x: np.ndarray, y: np.ndarray, fold: np.ndarray, total: np.ndarray) -> None:
            values = _values(x, {name: used[name] for name in groups})
            for part, (name, (own, inner, shift, left_out)) in zip(np.split(total, np.cumsum(sizes)[:-1]), groups.items()):
                v, out = values[name], part.reshape(len(own), -1)
                gap = 1 - y[:, None] * (v @ inner + shift)
                on = (gap > 0) & ((left_out == -1) | (fold[:, None] != left_out))
                r = np.where(on, -y[:, None], 0.0)
                out[:, 0] += np.where(on, gap, 0.0).sum(axis=0)
                out[:, 1] += r.sum(axis=0)
                out[:, 2:] += r.T @ v

        got = np.split(_scan(rows, sum(sizes), add), np.cumsum(sizes)[:-1])
        for part, (name, (own, inner, _, _)) in zip(got, groups.items()):
            for k, (loss, shift, *by_value) in zip(own, part.reshape(len(own), -1)):
                w, reg = asked[k][:-1], problems[k].reg
                gradient = np.append(np.array(by_value) @ used[name].weights * scale[k] / n[k] + reg * w, shift / n[k])
                try:
                    asked[k] = fits[k].send((loss / n[k] + reg / 2 * float(w @ w), gradient))
                except StopIteration as end:
                    asked[k], done[k] = None, end.value
    return [(x[:-1] * s, float(x[-1])) for x, s in zip(done, scale)]


def areas(rows: DataFrame, kernels: dict[str, Nystrom], problems: list[Problem], models: list[tuple[np.ndarray, float]]) -> list[float]:
    """Area under the ROC curve of each model over the rows of the fold that it left out, counted on a fine score grid."""
    used = {name: kernels[name] for name in dict.fromkeys(p.kernel for p in problems)}
    by = {name: [k for k, p in enumerate(problems) if p.kernel == name] for name in used}
    inner = {name: np.column_stack([used[name].weights @ models[k][0] for k in own]) for name, own in by.items()}

    def scores(x: np.ndarray, fold: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        out, values = [], _values(x, used)
        for name, own in by.items():
            f = values[name] @ inner[name]
            out += [(k, f[:, j], fold == problems[k].fold) for j, k in enumerate(own)]
        return out

    def ends(batches):
        low, high = np.full(len(problems), np.inf), np.full(len(problems), -np.inf)
        for b in batches:
            x, fold = matrix(b.column("x"), np.float64), b.column("fold").to_numpy(zero_copy_only=False)
            for s in range(0, len(fold), AT_ONCE):
                for k, f, on in scores(x[s : s + AT_ONCE], fold[s : s + AT_ONCE]):
                    if on.any():
                        low[k], high[k] = min(low[k], f[on].min()), max(high[k], f[on].max())
        yield pa.record_batch([pa.array(np.arange(len(low))), pa.array(low), pa.array(high)], ["k", "low", "high"])

    got = {r["k"]: r for r in rows.mapInArrow(ends, "k long, low double, high double").groupBy("k").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    low = np.array([got[k]["low"] for k in range(len(problems))])
    wide = np.array([got[k]["high"] - got[k]["low"] for k in range(len(problems))])

    def count(x: np.ndarray, y: np.ndarray, fold: np.ndarray, total: np.ndarray) -> None:
        out = total.reshape(len(problems), 2, CELLS)
        for k, f, on in scores(x, fold):
            cell = ((f[on] - low[k]) * (CELLS / wide[k])).astype(np.int64).clip(0, CELLS - 1) if wide[k] > 0 else np.zeros(on.sum(), np.int64)
            np.add.at(out[k], ((y[on] > 0).astype(np.int64), cell), 1)

    found = []
    for neg, pos in _scan(rows, len(problems) * 2 * CELLS, count).reshape(len(problems), 2, CELLS):
        pairs = neg.sum() * pos.sum()
        found.append(float((pos * (np.cumsum(neg) - neg / 2)).sum() / pairs) if pairs else 0.0)
    return found


def cross_validated(rows: DataFrame, kernels: dict[str, Nystrom], grid: list[tuple[str, float]], folds: int, steps: int = STEPS) -> tuple[Problem, list[float]]:
    """The pair (kernel, penalty) of greatest mean area over the left-out folds, the first of equals; all mean areas."""
    problems = [Problem(name, reg, fold) for name, reg in grid for fold in range(folds)]
    area = np.array(areas(rows, kernels, problems, solve(rows, kernels, problems, steps))).reshape(len(grid), folds).mean(axis=1)
    return Problem(*grid[int(np.argmax(area))]), area.tolist()
