"""Boosted stumps on person-years for the logistic loss, fitted on counts of equal person-years.

Rounds are those of gradient boosted trees of depth one: the first stump fits the labels -1 and 1, each later one the
loss's negative gradient 4y / (1 + exp(2yF)) by squared error and is added with the step; the hazard is
1 / (1 + exp(-2F)).  A sum of stumps depends on one feature at a time: the model is a table of one number per
(feature, bin), whatever the number of rounds.

Episodes of the same bins, duration and flag are counted before their years are made, and equal person-years are one
cell.  A round's bag holds each person-year with the same chance, so of n equal ones a Binomial(n, share) number,
which is drawn for the cell.  A round needs two sums per (feature, bin): one scan of the cells.  Where a block of
rounds' cells and draws are few bytes they are read once and scanned by the driver; else by tasks, a job a round.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..operators.cumulative import _range_id
from ..session import store
from .coxboost import Stump, best_stump
from .hazard import drawn_cells
from .table import BINS, COUNT, DRAWS, FLAG, ROW, YEAR, Encoder, Table, drawn, matrix, vector_sums

#: Bytes of cells with one block of draws that the driver scans itself, at most.
LOCAL_BYTES = 64 << 20
#: Bins are short numbers.
MOST_LEVELS = 32_000
#: Numbers of a batch's curves that are worked out at once, about.
AT_ONCE = 1 << 20


@dataclass
class Stumps:
    """A sum of stumps: a number for each bin of each feature, the years since the start last."""

    numeric: list[str]
    categorical: list[str]
    edges: list[list[float]]
    levels: list[list[str]]
    year_edges: list[float]
    tables: list[list[float]]
    #: Whether numeric columns hold bins already.
    coded: bool = False

    @property
    def encoder(self) -> Encoder:
        return Encoder(self.numeric, self.categorical, self.edges, self.levels)

    @property
    def features(self) -> Column:
        """The features' columns as one, with a null number below all others."""
        cols = [F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))).alias(f"f{k}") for k, c in enumerate(self.numeric)]
        return F.struct(*cols, *[F.col(c).cast("string").alias(f"c{k}") for k, c in enumerate(self.categorical)])

    def rest(self, features: pa.StructArray) -> np.ndarray:
        """Rows' sums over all features but the years."""
        out = np.zeros(len(features))
        for k, e in enumerate(self.edges):
            v = features.field(k).to_numpy(zero_copy_only=False)
            out += np.asarray(self.tables[k])[v.astype(np.int64) if self.coded else np.searchsorted(e, v)]
        for k, v in enumerate(self.levels, len(self.edges)):
            at = pc.fill_null(pc.index_in(features.field(k).cast(pa.string()), value_set=pa.array(v, pa.string())), -1)
            out += np.asarray(self.tables[k])[at.to_numpy(zero_copy_only=False) + 1]
        return out

    def hazard(self, rest: np.ndarray, years: np.ndarray) -> np.ndarray:
        margin = rest + np.asarray(self.tables[-1])[np.searchsorted(self.year_edges, years)]
        return 1 / (1 + np.exp(-2 * margin))


class BoostedHazard(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Scores rows like a fitted classifier: ``probability`` holds 1 - hazard and hazard."""

    state = Param(Params._dummy(), "state", "the stumps and the name of the years' column as JSON", typeConverter=TypeConverters.toString)

    def __init__(self, stumps: Stumps | None = None, year: str = "k"):
        super().__init__()
        self._set(state=json.dumps({"year": year, **(asdict(stumps) if stumps else {})}))

    @property
    def known(self) -> tuple[Stumps, str]:
        own = json.loads(self.getOrDefault(self.state))
        year = own.pop("year")
        return Stumps(**own), year

    def _transform(self, df: DataFrame) -> DataFrame:
        own, year = self.known

        @F.arrow_udf("array<double>")
        def shares(x: pa.Array, k: pa.Array) -> pa.Array:
            h = own.hazard(own.rest(x), k.to_numpy(zero_copy_only=False))
            return pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(h) + 1, 2, dtype=np.int32)), pa.array(np.column_stack((1 - h, h)).ravel()))

        return df.withColumn("probability", array_to_vector(shares(own.features, F.coalesce(F.col(year).cast("double"), F.lit(float("-inf"))))))

    def gone(self, duration: str, horizon: int) -> Column:
        """1 - the product of 1 - hazard over the years duration + 1 .. duration + horizon; null without a duration."""
        own, _ = self.known

        @F.arrow_udf("double")
        def gone(x: pa.Array, d: pa.Array) -> pa.Array:
            rest, d = own.rest(x), d.to_numpy(zero_copy_only=False)
            left = np.ones(len(rest))
            for i in range(1, horizon + 1):
                left *= 1 - own.hazard(rest, d + i)
            return pa.array(1 - left)

        own_years = F.coalesce(F.col(duration).cast("double"), F.lit(0.0))
        return F.when(F.col(duration).isNotNull(), gone(own.features, own_years))

    def curve(self, duration: str, horizon: int) -> Column:
        """Hazard and survival at the years 0 .. duration + horizon; null without a duration."""
        own, _ = self.known

        @F.arrow_udf("array<struct<hazard double, survival double>>")
        def curve(x: pa.Array, d: pa.Array) -> pa.Array:
            rest, n = own.rest(x), np.maximum(d.to_numpy(zero_copy_only=False) + horizon + 1, 0)
            hazard, survival = (np.empty(int(n.sum())) for _ in range(2))
            at = np.concatenate(([0], np.cumsum(n)))
            size = max(1, AT_ONCE // max(int(n.max(initial=1)), 1))
            for s in range(0, len(rest), size):
                part = n[s : s + size]
                years = np.arange(part.max())
                h = own.hazard(rest[s : s + size, None], years[None, :])
                on, to = years < part[:, None], slice(at[s], at[s + len(part)])
                hazard[to], survival[to] = h[on], np.cumprod(1 - h, axis=1)[on]
            rows = pa.StructArray.from_arrays([pa.array(hazard), pa.array(survival)], ["hazard", "survival"])
            return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), rows)

        return F.when(F.col(duration).isNotNull(), curve(own.features, F.coalesce(F.col(duration).cast("long"), F.lit(0))))

    def coded(self, df: DataFrame) -> tuple[DataFrame, BoostedHazard]:
        """The rows with each feature's bin (a short number) in place of its value, and this model for such rows."""
        own, year = self.known
        names, widths = [*own.numeric, *own.categorical], own.encoder.widths
        bins = df.withColumn("_bins", own.encoder.bins())
        out = bins.select(*[F.get("_bins", names.index(c)).cast("short").alias(c) if c in names else F.col(c) for c in df.columns])
        # bin k has k of the edges 0, 1, .. below it
        return out, BoostedHazard(Stumps(names, [], [[float(k) for k in range(w - 1)] for w in widths], [], own.year_edges, own.tables, True), year)


@dataclass
class _Shape:
    widths: list[int]
    is_level: list[bool]


def cells(ep: DataFrame, encoder: Encoder, year_edges: list[float]) -> DataFrame:
    """Different person-years (bins with that of the year since the start, label) with their number."""
    some = ep.where(F.col(S.DURATION).isNotNull() & F.col(S.EVENT).isNotNull())
    alike = some.select(encoder.bins().alias("_b"), F.col(S.DURATION).alias("_d"), (F.col(S.EVENT) == 1).alias("_e")).groupBy("_b", "_d", "_e").agg(F.count(F.lit(1)).alias("_n"))
    years = alike.select("_b", "_d", "_e", "_n", F.explode(F.sequence(F.lit(0), F.col("_d"))).alias("_k"))
    bins = F.concat("_b", F.array(_range_id(F.col("_k").cast("double"), year_edges).cast("short")))
    label = (F.col("_e") & (F.col("_k") == F.col("_d"))).cast("int")
    counted = years.select(bins.alias(BINS), label.alias(FLAG), "_n").groupBy(BINS, FLAG).agg(F.sum("_n").alias(COUNT))
    return counted.select(F.xxhash64(BINS, FLAG).alias(ROW), F.lit(0).alias(YEAR), FLAG, BINS, COUNT)


def bag(cell: int, rows: int, seed: int, rounds: int, share: float) -> np.ndarray:
    """How many of a cell's rows are in each round's bag, from the cell's own number and the seed alone."""
    return np.random.default_rng([seed, cell % (1 << 64)]).binomial(rows, share, rounds)


def rounds(table: Table, shape: _Shape, number: int, step: float) -> list[np.ndarray]:
    """Each feature's table after so many rounds."""
    tables = [np.zeros(w) for w in shape.widths]
    size, held, block = sum(shape.widths), [], None
    offsets = np.concatenate(([0], np.cumsum(shape.widths)[:-1])).astype(int)
    local = table.df.count() * (4 * DRAWS + 2 * len(tables) + 16) <= LOCAL_BYTES
    for no in range(number):

        def add(b: pa.RecordBatch, total: np.ndarray) -> None:
            x, y = matrix(b.column(BINS)), 2.0 * b.column(FLAG).to_numpy(zero_copy_only=False) - 1
            n = drawn(b, "w", no)
            left = n if not no else n / (1 + np.exp(2 * y * sum(t[x[:, k]] for k, t in enumerate(tables))))
            g = y * left * (4 if no else 1)
            for k, (off, w) in enumerate(zip(offsets, shape.widths)):
                total[off : off + w] += np.bincount(x[:, k], n, w)
                total[size + off : size + off + w] += np.bincount(x[:, k], g, w)

        own = table.df.select(FLAG, BINS, f"w{no // DRAWS}")
        if local:
            if block != no // DRAWS:
                block, held = no // DRAWS, own.toArrow().combine_chunks().to_batches()
            total = np.zeros(2 * size)
            for b in held:
                add(b, total)
        else:
            total = vector_sums(own, 2 * size, add, table.tasks)
        n, g = total[:size], total[size:]
        rows = n[: shape.widths[0]].sum()
        if not rows:
            continue
        mean = float(g[: shape.widths[0]].sum() / rows)
        found = best_stump(shape, g, n) or Stump(0, 0, mean, mean)
        b = np.arange(shape.widths[found.feature])
        left = b == found.cut if shape.is_level[found.feature] else b <= found.cut
        tables[found.feature] = tables[found.feature] + np.where(left, found.left, found.right) * (step if no else 1)
    return tables


@dataclass
class HazardBoosting:
    """Settings of the boosted stumps."""

    rounds: int = 100
    step: float = 0.5
    subsample: float = 0.5
    seed: int = 0

    def fit(self, ep: DataFrame, years: DataFrame, year: str, numeric: list[str], categorical: list[str]) -> PipelineModel:
        """From episodes; bins are cut by quantiles of their person-years ``years``, whose column ``year`` counts from the start."""
        cut = Encoder([*numeric, year], list(categorical)).fit(years, max_levels=MOST_LEVELS + 1, own_bins=True)
        if any(len(v) > MOST_LEVELS for v in cut.levels):
            raise ValueError(f"a category has more than {MOST_LEVELS} values")
        encoder, year_edges = Encoder(list(numeric), list(categorical), cut.edges[:-1], cut.levels), cut.edges[-1]
        table = drawn_cells(store(cells(ep, encoder, year_edges), "hazard-cells"), self.rounds, lambda cell, n: bag(cell, n, self.seed, self.rounds, self.subsample))
        if not table.rows:
            raise ValueError("no rows to fit")
        shape = _Shape([*encoder.widths, len(year_edges) + 1], [*encoder.is_level, False])
        tables = rounds(table, shape, self.rounds, self.step)
        stumps = Stumps(encoder.numeric, encoder.categorical, encoder.edges, encoder.levels, year_edges, [t.tolist() for t in tables])
        return PipelineModel([BoostedHazard(stumps, year)])
