"""Hazard forest: trees that split person-years by Gini impurity, grown on counts of equal person-years.

Person-years of the same bins and label are one cell with their number, so a level of the trees costs as much as there
are different cells.  The bootstrap stays that of single person-years: each is in a tree's sample a Poisson(1) number
of times, and the sum over n of them is a Poisson(n) number, which is drawn for the cell.  A leaf keeps its share of
failures, a forest's hazard is the mean over its trees.  The trees grow by ``forest.grow``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import store
from . import forest
from .table import BINS, COUNT, DRAWS, FLAG, ROW, YEAR, Encoder, Table, matrix, sorted_alike

#: Levels of cuts and rows of a leaf.
LEVELS, MIN_LEAF = 5, 15
#: Cells whose weights one task draws, about.
TASK_CELLS = 50_000
#: Rows times trees that are scored at once.
AT_ONCE = 1 << 19


def gini(n_left: np.ndarray, d_left: np.ndarray, n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Decrease of the Gini impurity by cuts (rows) from rows and events, left of the cut and in all."""

    def impure(n: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Impurity times rows."""
        return np.divide(2 * d * (n - d), n, out=np.zeros(n.shape), where=n > 0)

    gain = (impure(n, d) - impure(n_left, d_left) - impure(n - n_left, d - d_left)).sum(axis=1) / max(n.sum(), 1)
    return np.where(gain > 1e-12, gain, 0.0)


def share(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.divide(d, n, out=np.zeros(len(n)), where=n > 0)


def weights(cell: int, rows: int, seed: int, trees: int) -> np.ndarray:
    """How often a cell's rows are in each tree's bootstrap sample, from the cell's own number and the seed alone."""
    return np.random.default_rng([seed, cell % (1 << 64)]).poisson(rows, trees)


def bootstrapped(rows: DataFrame, encoder: Encoder, label: str, seed: int, trees: int) -> Table:
    """Different rows with their number and, for each tree, how many are in its bootstrap sample."""
    flagged = rows.select(encoder.bins().alias(BINS), F.col(label).cast("int").alias(FLAG)).where(F.col(FLAG).isNotNull())
    counted = flagged.groupBy(BINS, FLAG).agg(F.count(F.lit(1)).alias(COUNT))
    counted = store(counted.select(F.xxhash64(BINS, FLAG).alias(ROW), F.lit(0).alias(YEAR), FLAG, BINS, COUNT), "hazard-cells")
    return drawn_cells(counted, trees, lambda cell, n: weights(cell, n, seed, trees))


def drawn_cells(counted: DataFrame, draws: int, draw: Callable[[int, int], np.ndarray]) -> Table:
    """A stored table of cells with ``draws`` numbers each, which ``draw`` makes from a cell's own number and its rows."""
    cells, total = counted.agg(F.count(F.lit(1)), F.sum(COUNT)).first()
    blocks = [range(k, min(k + DRAWS, draws)) for k in range(0, draws, DRAWS)]
    names = [YEAR, FLAG, BINS, COUNT, *[f"w{k}" for k in range(len(blocks))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            numbers = zip(b.column(ROW).to_pylist(), b.column(COUNT).to_pylist())
            w = np.array([draw(cell, n) for cell, n in numbers], "<u4")
            own = [pa.array([r.tobytes() for r in w[:, block.start : block.stop]], pa.binary()) for block in blocks]
            yield pa.record_batch([*(b.column(c) for c in names[:4]), *own], names)

    kinds = {f.name: f.dataType.simpleString() for f in counted.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in names[:4]), *(f"{c} binary" for c in names[4:])])
    tasks = max(counted.sparkSession.sparkContext.defaultParallelism, -(-cells // TASK_CELLS))
    t = store(counted.repartition(tasks, ROW).mapInArrow(run, schema), "learner-cells")
    return Table(t, total or 0, 1, t.rdd.getNumPartitions())


class Scorer:
    """All trees side by side: a node sends a row right if its feature's bin is above ``low`` and at most ``high``."""

    def __init__(self, model: forest.Forest, levels: int):
        columns, first = model.columns, np.cumsum([0] + [len(t.column) for t in model.trees])
        column, cut, left = (np.concatenate(a) for a in zip(*[t.arrays() for t in model.trees]))
        inner, most = column >= 0, np.iinfo(np.int16).max
        own = np.where(inner, column, 0)
        level = columns.level[own]
        self.feature = columns.feature[own].astype(np.int32)
        self.low = np.where(~inner, most, np.where(level >= 0, level - 1, cut)).astype(np.int16)
        self.high = np.where(inner & (level >= 0), level, most).astype(np.int16)
        self.left = np.where(inner, left + np.repeat(first[:-1], np.diff(first)), np.arange(first[-1])).astype(np.int32)
        self.leaf = np.array([0.0 if h is None else h[0] for t in model.trees for h in t.hazard])
        self.roots, self.levels = first[:-1].astype(np.int32), levels

    def of(self, x: np.ndarray) -> np.ndarray:
        """Mean over the trees of the leaves' shares, worked out once for equal rows."""
        kinds, where = np.unique(x.astype(np.int16), axis=0, return_inverse=True)
        out, size = np.empty(len(kinds)), max(1, AT_ONCE // len(self.roots))
        for k in range(0, len(kinds), size):
            part = kinds[k : k + size]
            row, at = np.arange(len(part))[:, None], np.tile(self.roots, (len(part), 1))
            for _ in range(self.levels):
                b = part[row, self.feature[at]]
                at = self.left[at] + ((b > self.low[at]) & (b <= self.high[at]))
            out[k : k + size] = self.leaf[at].mean(axis=1)
        return out[where.ravel()]


@dataclass
class HazardModel:
    """Scores rows like a fitted classifier: ``probability`` holds 1 - hazard and hazard."""

    trees: forest.Forest
    levels: int

    def transform(self, df: DataFrame) -> DataFrame:
        # trees x 2^levels numbers at most
        known = df.sparkSession.sparkContext.broadcast(Scorer(self.trees, self.levels))

        @F.arrow_udf("array<double>")
        def shares(bins: pa.Array) -> pa.Array:
            h = known.value.of(matrix(bins)) if len(bins) else np.zeros(0)
            flat = pa.array(np.column_stack((1 - h, h)).ravel())
            return pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(h) + 1, 2, dtype=np.int32)), flat)

        return df.withColumn("probability", array_to_vector(shares(self.trees.encoder.bins())))

    def alike(self, df: DataFrame, tie: Column) -> DataFrame:
        """The rows with those of equal bins next to each other."""
        return sorted_alike(df.withColumn(BINS, self.trees.encoder.bins()), [BINS], tie, df.count()).drop(BINS)


@dataclass
class HazardForest:
    """Settings of a forest; a node looks at the square root of the number of columns."""

    trees: int
    seed: int = 0
    levels: int = LEVELS
    min_leaf: int = MIN_LEAF
    label: str = "label"

    def fit(self, rows: DataFrame, numeric: list[str], categorical: list[str]) -> HazardModel:
        encoder = Encoder(list(numeric), list(categorical)).fit(rows, own_bins=True)
        cells = bootstrapped(rows, encoder, self.label, self.seed, self.trees)
        trees = forest.grow(cells, encoder, self.trees, self.levels, 0, self.min_leaf, self.seed, forest.COUNTS, gini, share, "w")
        return HazardModel(trees, self.levels)
