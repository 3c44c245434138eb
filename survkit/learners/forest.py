"""Survival forest: trees that split by the log-rank statistic, grown level by level on histograms.

A level of all trees is one aggregate of (tree, node, column, bin, duration) -> rows and events, in the bootstrap
sample of each tree.  At-risk and failure counts of both sides of every cut follow by running sums over bins and
years, from them the log-rank statistic; the best cut of each node is found where its counts are added up, a group
per tree, and only the cuts reach the driver.  A node without a cut that leaves enough rows on both sides becomes a
leaf with the Nelson-Aalen cumulative hazard of its rows.  Trees are taken in groups whose counts fit a task.

A column is a numeric feature's bins, or whether a category has one of its levels; each node looks at a seeded
sample of the square root of their number.  ``grow`` takes the rule of cuts and leaves: ``learners/hazard`` grows its
trees by it, too.  Bootstrap weights are Poisson counts drawn by a seeded hash of the row;
they are drawn once, and rows of the same bins, duration and flag are merged with the sums of their weights: a level
costs as much as there are different cells.  Scores are likewise worked out once for equal rows of a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .table import BINS, DRAWS, FLAG, YEAR, Encoder, Table, drawn, matrix, merged, run_starts, sorted_alike, uniform

#: Trees, rows that a node needs to be split, rows of a leaf.
TREES, MIN_SPLIT, MIN_LEAF = 500, 10, 15
#: Levels of cuts, at most: bounds the model at trees x 2^levels leaves.
LEVELS = 8
#: Counts that a task holds for a group of trees, at most.
COUNTS = 1 << 23

_POISSON = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])


@dataclass
class Tree:
    """Nodes in order of creation: column (-1: leaf), cut (left: bin at most the cut), left child (right: the next), hazard."""

    column: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    hazard: list[np.ndarray | None] = field(default_factory=lambda: [None])

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.column), np.array(self.cut), np.array(self.left)


class Columns:
    """The columns that cuts may use: (feature, level or -1) and their number of bins."""

    def __init__(self, encoder: Encoder):
        own = [[(f, v) for v in range(w)] if level else [(f, -1)] for f, (w, level) in enumerate(zip(encoder.widths, encoder.is_level))]
        pairs = [p for x in own for p in x]
        self.feature, self.level = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        self.width = np.array([2 if v >= 0 else encoder.widths[f] for f, v in pairs])
        self.sampled = max(1, int(np.sqrt(len(pairs))))

    def bins(self, x: np.ndarray, column: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Bin of each row, or of those named, in its own column."""
        b = x[np.arange(len(x)) if rows is None else rows, self.feature[column]]
        v = self.level[column]
        return np.where(v >= 0, b == v, b).astype(np.int64)

    def sample(self, seed: int, tree: int, node: int) -> np.ndarray:
        return np.random.default_rng([seed, tree, node]).choice(len(self.width), self.sampled, replace=False)

    def descend(self, x: np.ndarray, arrays: tuple[np.ndarray, ...], rows: np.ndarray | None = None) -> np.ndarray:
        """The node that each row, or each of those named, ends in."""
        column, cut, left = arrays
        rows = np.arange(len(x)) if rows is None else rows
        at = np.zeros(len(rows), np.int64)
        on = np.flatnonzero(column[at] >= 0)
        while len(on):
            node = at[on]
            at[on] = left[node] + (self.bins(x, column[node], rows[on]) > cut[node])
            on = on[column[at[on]] >= 0]
        return at


def weights(row: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is in a tree's bootstrap sample."""
    return np.searchsorted(_POISSON, uniform(row, seed, tree), side="right")


def bootstrapped(table: Table, seed: int, trees: int) -> Table:
    """Merged rows with, for each tree, their weight in its bootstrap sample and how many of them are in it."""

    def draw(row: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        w = weights(row, seed, tree)
        return w, (w > 0).astype(np.int64)

    return merged(table, range(trees), ["w", "c"], draw)


def logrank(n_left: np.ndarray, d_left: np.ndarray, n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Log-rank statistics of cuts (rows) from rows and events by duration, left of the cut and in all."""
    risk = np.cumsum(n[::-1])[::-1]
    share = np.divide(np.cumsum(n_left[:, ::-1], axis=1)[:, ::-1], risk, out=np.zeros(n_left.shape), where=risk > 0)
    spread = np.divide(d * (risk - d), risk - 1, out=np.zeros(len(n)), where=risk > 1)
    apart, var = (d_left - d * share).sum(axis=1), (share * (1 - share) * spread).sum(axis=1)
    return np.divide(apart**2, var, out=np.zeros(len(var)), where=var > 1e-12)


def nelson_aalen(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    risk = np.cumsum(n[::-1])[::-1]
    return np.cumsum(np.divide(d, risk, out=np.zeros(len(n)), where=risk > 0))


@dataclass
class Level:
    """The open nodes of one tree, their columns and where their counts lie."""

    arrays: tuple[np.ndarray, ...]
    nodes: np.ndarray
    columns: np.ndarray
    base: np.ndarray
    cells: int

    @classmethod
    def of(cls, tree: Tree, nodes: list[int], columns: Columns, seed: int, no: int, last: bool = False) -> Level:
        own = np.array([columns.sample(seed, no, k) for k in nodes])
        if last:  # leaves need the sums over all bins of a column, whichever it is
            own = own[:, :1]
        width = columns.width[own].ravel()
        base = (np.cumsum(width) - width).reshape(own.shape)
        return cls(tree.arrays(), np.array(nodes), own, base, int(width.sum()))


CELLS = "tree int, cell binary, n binary, d binary, rows binary"
CUTS = "tree int, node int, column int, cut int, hazard binary"


def _count(levels: dict[int, Level], columns: Columns, years: int, rows_of: str):
    """Rows and events of a task's part, by tree: the cells that are not zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {t: np.zeros((3, v.cells * years)) for t, v in levels.items()}
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(BINS))
            y, e = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (YEAR, FLAG))
            for t, v in levels.items():
                w = drawn(b, "w", t)
                on = np.flatnonzero(w)
                at = columns.descend(x, v.arrays, on)
                place = np.searchsorted(v.nodes, at)
                is_open = v.nodes[np.minimum(place, len(v.nodes) - 1)] == at
                on, place = on[is_open], place[is_open]
                own = v.columns[place]
                cell = (v.base[place] + columns.bins(x, own, on[:, None])) * years + y[on, None]
                for out, value in zip(sums[t], (w[on], w[on] * e[on], drawn(b, rows_of, t)[on])):
                    out += np.bincount(cell.ravel(), np.repeat(value, own.shape[1]), len(out))
        rows = []
        for t, (n, d, c) in sums.items():
            at = np.flatnonzero(n)
            rows.append((t, at.astype("<u4").tobytes(), *(z[at].astype("<i8").tobytes() for z in (n, d, c))))
        kinds = (pa.int32(), *[pa.binary()] * 4)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in CELLS.split(", ")])

    return run


def _split(levels: dict[int, Level], columns: Columns, years: int, last: bool, min_split: int, min_leaf: int, gain: Callable, kept: Callable):
    """Best cut, or the hazard of a leaf, for each open node of a tree."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        v = levels[t]
        total = np.zeros((3, v.cells * years))
        for cell, *parts in zip(pdf["cell"], pdf["n"], pdf["d"], pdf["rows"]):
            at = np.frombuffer(cell, "<u4")
            for out, x in zip(total, parts):
                out[at] += np.frombuffer(x, "<i8")
        n, d, rows = total.reshape(3, v.cells, years)
        out = []
        for node, own, base in zip(v.nodes.tolist(), v.columns, v.base):
            best, found = 0.0, None
            for c, at in zip(own.tolist(), base.tolist()):
                s = slice(at, at + columns.width[c])
                all_n, all_d, count = n[s].sum(axis=0), d[s].sum(axis=0), rows[s].sum(axis=1)
                if last or count.sum() < min_split or len(count) < 2:
                    continue
                left = np.cumsum(count)[:-1]
                stat = gain(np.cumsum(n[s], axis=0)[:-1], np.cumsum(d[s], axis=0)[:-1], all_n, all_d)
                stat[(left < min_leaf) | (count.sum() - left < min_leaf)] = 0
                k = int(np.argmax(stat))
                if stat[k] > best * (1 + 1e-9):
                    best, found = float(stat[k]), (c, k)
            s = slice(base[0], base[0] + columns.width[own[0]])
            out.append((t, node, *found, None) if found else (t, node, -1, 0, kept(n[s].sum(axis=0), d[s].sum(axis=0)).tobytes()))
        return pd.DataFrame(out, columns=[x.split()[0] for x in CUTS.split(", ")])

    return run


@dataclass
class Forest:
    encoder: Encoder
    columns: Columns
    trees: list[Tree]
    years: int

    def hazards(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, hazard): the mean over trees of the cumulative hazard at each year, an array."""
        columns, years = self.columns, self.years
        tables = []
        for t in self.trees:
            leaf = np.array([h if h is not None else np.zeros(years) for h in t.hazard])
            tables.append((t.arrays(), leaf))
        known = df.sparkSession.sparkContext.broadcast(tables)  # trees x 2^levels x years numbers at most
        plain = df.select(*keys, self.encoder.bins().alias(BINS))
        rows = sorted_alike(plain, [BINS], F.xxhash64(*keys), df.count())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = matrix(b.column(BINS))
                new = run_starts(x)
                x, size = x[new], np.diff(new, append=b.num_rows)
                total = np.zeros((len(x), years))
                for arrays, leaf in known.value if len(x) else []:
                    total += leaf[columns.descend(x, arrays)]
                total = np.repeat(total, size, axis=0)
                flat = pa.array((total / max(len(known.value), 1)).ravel())
                hazard = pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, years, dtype=np.int32)), flat)
                yield pa.record_batch([*(b.column(k) for k in keys), hazard], [*keys, "hazard"])

        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields if f.name in keys)
        return rows.mapInArrow(run, f"{types}, hazard array<double>")


def _part(cells: DataFrame, trees: dict[int, Level], rows_of: str) -> DataFrame:
    """The columns that counts of these trees need."""
    return cells.select(YEAR, FLAG, BINS, *[f"{n}{k}" for k in sorted({t // DRAWS for t in trees}) for n in sorted({"w", rows_of})])


def fit(table: Table, encoder: Encoder, trees: int = TREES, levels: int = LEVELS, min_split: int = MIN_SPLIT, min_leaf: int = MIN_LEAF, seed: int = 0, counts: int = COUNTS) -> Forest:
    """A forest of log-rank trees."""
    return grow(bootstrapped(table, seed, trees), encoder, trees, levels, min_split, min_leaf, seed, counts, logrank, nelson_aalen, "c")


def grow(cells: Table, encoder: Encoder, trees: int, levels: int, min_split: int, min_leaf: int, seed: int, counts: int, gain: Callable, kept: Callable, rows_of: str) -> Forest:
    """A forest on merged rows; a level of a group of trees is one job.

    ``gain`` rates cuts, ``kept`` is what a leaf keeps, both from weights and weights of events by year; ``rows_of`` is
    the draw that says how many rows of a merged row count towards ``min_split`` and ``min_leaf``.
    """
    columns, years = Columns(encoder), cells.years
    model = Forest(encoder, columns, [Tree() for _ in range(trees)], years)
    open_nodes = {t: [0] for t in range(trees)}
    for depth in range(levels + 1):
        plans = {t: Level.of(model.trees[t], nodes, columns, seed, t, depth == levels) for t, nodes in open_nodes.items() if nodes}
        todo, open_nodes = list(plans), {}
        while todo:
            group, size = {}, 0
            while todo and (not group or size + 3 * plans[todo[0]].cells * years <= counts):
                t = todo.pop(0)
                group[t] = plans[t]
                size += 3 * plans[t].cells * years
            # fewer scan tasks than cores: tasks for parts of the group read the table side by side
            shares = min(len(group), max(1, cells.df.sparkSession.sparkContext.defaultParallelism // max(cells.tasks, 1)))
            size = -(-len(group) // shares)  # neighbouring trees: a part reads only its own columns of weights
            parts = [dict(list(group.items())[k : k + size]) for k in range(0, len(group), size)]
            found = reduce(DataFrame.union, [_part(cells.df, p, rows_of).mapInArrow(_count(p, columns, years, rows_of), CELLS) for p in parts])
            cuts = found.groupBy("tree").applyInPandas(_split(group, columns, years, depth == levels, min_split, min_leaf, gain, kept), CUTS)
            for r in sorted(cuts.collect(), key=lambda r: (r["tree"], r["node"])):
                tree = model.trees[r["tree"]]
                if r["column"] < 0:
                    tree.hazard[r["node"]] = np.frombuffer(r["hazard"])
                    continue
                k = len(tree.column)
                tree.column[r["node"]], tree.cut[r["node"]], tree.left[r["node"]] = r["column"], r["cut"], k
                tree.column += [-1, -1]
                tree.cut += [0, 0]
                tree.left += [0, 0]
                tree.hazard += [None, None]
                open_nodes.setdefault(r["tree"], []).extend((k, k + 1))
    return model


def mortality(hazards: DataFrame, keys: list[str], out: str = "proba") -> DataFrame:
    """Ensemble mortality: the cumulative hazard summed over the years."""
    return hazards.select(*keys, F.aggregate("hazard", F.lit(0.0), lambda s, h: s + h).alias(out))


def curves(hazards: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, year, survival) = exp(-cumulative hazard)."""
    return hazards.select(*keys, F.posexplode("hazard").alias("year", "_h")).select(*keys, "year", F.exp(-F.col("_h")).alias("survival"))
