"""The learners' input: one compact row per episode, and sums over all of it.

A row holds a number of its own (for seeded samples), its duration in whole years, its event flag and, for each
feature, the bin it falls into.  Numeric features are cut at quantiles, categories are numbered by frequency; both
tables are bounded by parameters.  The table is written once to the shared folder and scanned in every pass.

``merged`` puts neighbouring rows of the same bins, duration and flag together, with the sums of their own seeded
draws: what a learner does with a row depends on nothing else, so sums over merged rows equal sums over rows, and a
pass costs as much as there are different cells, not rows.

``vector_sums`` is the only way a learner looks at the data: each task adds its rows to a vector whose length
depends on features, bins and years, never on rows; the vectors are added up in groups of the square root of
their number before the driver adds the rest.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..operators.cumulative import _range_id
from ..session import store

MAX_BINS = 32
MAX_LEVELS = 255
#: A vector for each year of a duration: durations beyond are an error, not a longer vector.
MAX_YEARS = 2000
#: Tasks whose vectors the driver adds up alone, and bytes of all their vectors, at most.
DIRECT, DIRECT_BYTES = 64, 64 << 20

#: Draws whose counts lie side by side in one column of a merged table; rows that one task merges, about.
DRAWS = 25
MERGE_ROWS = 500_000

ROW, YEAR, FLAG, BINS = "row", "year", "flag", "bins"
#: Rows of a merged row.
COUNT = "rows"


@dataclass
class Encoder:
    """Bins of each feature: ``edges`` of numeric ones (bin = edges below the value), ``levels`` of categories (0: any other)."""

    numeric: list[str]
    categorical: list[str]
    edges: list[list[float]] = field(default_factory=list)
    levels: list[list[str]] = field(default_factory=list)

    @property
    def widths(self) -> list[int]:
        return [len(e) + 1 for e in self.edges] + [len(v) + 1 for v in self.levels]

    @property
    def is_level(self) -> list[bool]:
        return [False] * len(self.numeric) + [True] * len(self.categorical)

    def fit(self, df: DataFrame, max_bins: int = MAX_BINS, max_levels: int = MAX_LEVELS, own_bins: bool = False) -> Encoder:
        """``own_bins``: each value of a number with few values has its bin, however rare; quantiles may join rare ones."""
        probs = [k / max_bins for k in range(1, max_bins)]
        got = df.approxQuantile(self.numeric, probs, 0.2 / max_bins) if self.numeric else []
        top = df.agg(*[F.max(c).alias(c) for c in self.numeric]).first() if self.numeric else []
        # an edge at the greatest value would leave its bin's other side empty
        self.edges = [sorted({x for x in q if m is not None and x < m}) for q, m in zip(got, top)]
        if own_bins and self.numeric:
            self.edges = [e if v is None else v for e, v in zip(self.edges, self._few_values(df, max_bins))]
        self.levels = []
        for c in self.categorical:
            v = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).count()
            self.levels.append([r["v"] for r in v.orderBy(F.desc("count"), "v").limit(max_levels).collect()])
        return self

    def _few_values(self, df: DataFrame, max_bins: int) -> list[list[float] | None]:
        """For each number, all its values but the greatest if they are at most ``max_bins``, else none."""
        about = df.agg(*[F.approx_count_distinct(c).alias(c) for c in self.numeric]).first()
        few = [c for c in self.numeric if about[c] <= 2 * max_bins]
        got = df.agg(*[F.sort_array(F.collect_set(F.col(c).cast("double"))).alias(c) for c in few]).first() if few else {}
        return [got[c][:-1] if c in few and len(got[c]) <= max_bins else None for c in self.numeric]

    def bins(self) -> Column:
        """Array with the bin of each feature; a null number falls into the first bin."""
        cols = [_range_id(F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))), e) for c, e in zip(self.numeric, self.edges)]
        for c, v in zip(self.categorical, self.levels):
            at = F.array_position(F.array(*[F.lit(x) for x in v]), F.col(c).cast("string")) if v else F.lit(0)
            cols.append(F.coalesce(at, F.lit(0)))
        return F.array(*[c.cast("short") for c in cols])


@dataclass
class Table:
    """A stored table of encoded rows with its number of rows, years and scan tasks."""

    df: DataFrame
    rows: int
    years: int
    tasks: int


def encode(df: DataFrame, encoder: Encoder, keys: list[str]) -> Table:
    """Encoded rows with a duration and an event flag; rows without either, or with a negative duration, are left out."""
    rows = df.where(F.col(S.DURATION).isNotNull() & F.col(S.EVENT).isNotNull() & (F.col(S.DURATION) >= 0))
    rows = rows.select(F.xxhash64(*keys).alias(ROW), F.col(S.DURATION).cast("int").alias(YEAR), F.col(S.EVENT).cast("int").alias(FLAG), encoder.bins().alias(BINS))
    t = store(rows, "learner-rows")
    n, last = t.agg(F.count(F.lit(1)), F.max(YEAR)).first()
    if (last or 0) >= MAX_YEARS:
        raise ValueError(f"durations reach {last} years, at most {MAX_YEARS - 1} are allowed")
    return Table(t, n, (last or 0) + 1, t.rdd.getNumPartitions())


def matrix(column: pa.Array, kind=np.int64) -> np.ndarray:
    """Rows of an array column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def sorted_alike(df: DataFrame, alike: list[str], tie: Column, rows: int) -> DataFrame:
    """Rows with equal ``alike`` columns next to each other; many equal ones are dealt over tasks by ``tie``."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // MERGE_ROWS))
    keyed = df.withColumn("_alike", F.xxhash64(*alike)).withColumn("_tie", tie)
    return keyed.repartitionByRange(n, "_alike", "_tie").sortWithinPartitions("_alike", "_tie").drop("_alike", "_tie")


def run_starts(*values: np.ndarray) -> np.ndarray:
    """Where rows differ from the row before, the first row included."""
    new = np.zeros(len(values[0]), bool)
    new[:1] = True
    for v in values:
        other = v[1:] != v[:-1]
        new[1:] |= other.any(axis=1) if other.ndim > 1 else other
    return np.flatnonzero(new)


def merged(table: Table, draws: range, names: list[str], draw: Callable[[np.ndarray, int], tuple[np.ndarray, ...]]) -> Table:
    """The table with runs of equal bins, duration and flag as one row each, and for each draw the sums of its values.

    ``draw`` gets the rows' own numbers and a draw's number and returns an array of small counts per name.  The sums
    lie in binary columns of ``DRAWS`` draws each (``drawn``); ``draws`` begins at a multiple of that.  A run may be
    cut at the end of a batch: its parts are then rows of their own, the sums over the table stay the same.
    """
    blocks = [range(k, min(k + DRAWS, draws.stop)) for k in range(draws.start, draws.stop, DRAWS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            row, y, e = (b.column(c).to_numpy(zero_copy_only=False) for c in (ROW, YEAR, FLAG))
            new = run_starts(matrix(b.column(BINS)), y, e)
            out = [b.column(c).take(pa.array(new)) for c in (YEAR, FLAG, BINS)]
            out.append(pa.array(np.diff(new, append=b.num_rows).astype(np.int64)))
            for block in blocks:
                sums = [np.empty((len(new), len(block)), "<u4") for _ in names]
                for j, k in enumerate(block):
                    for s, value in zip(sums, draw(row, k)):
                        s[:, j] = np.add.reduceat(value, new)
                width = 4 * len(block)
                offsets = pa.py_buffer(np.arange(0, width * len(new) + 1, width, dtype=np.int32))
                out += [pa.Array.from_buffers(pa.binary(), len(new), [None, offsets, pa.py_buffer(s)]) for s in sums]
            yield pa.record_batch(out, columns)

    sums = [f"{n}{block.start // DRAWS}" for block in blocks for n in names]
    columns = [YEAR, FLAG, BINS, COUNT, *sums]
    kinds = {f.name: f.dataType.simpleString() for f in table.df.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in (YEAR, FLAG, BINS)), f"{COUNT} bigint", *(f"{c} binary" for c in sums)])
    rows = sorted_alike(table.df, [BINS, YEAR, FLAG], F.col(ROW), table.rows)
    t = store(rows.mapInArrow(run, schema), "learner-cells")
    return Table(t, table.rows, table.years, t.rdd.getNumPartitions())


def drawn(b: pa.RecordBatch, name: str, draw: int) -> np.ndarray:
    """A draw's sums of a merged table's batch."""
    column = b.column(f"{name}{draw // DRAWS}").cast(pa.binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view("<u4").reshape(len(column), -1)[:, draw % DRAWS].astype(np.int64)


def vector_sums(df: DataFrame, size: int, add: Callable[[pa.RecordBatch, np.ndarray], None], tasks: int) -> np.ndarray:
    """Sum over all rows of a vector of ``size`` numbers; ``add`` adds a batch's rows to the vector it is given."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                add(b, total)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["v"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for v in b.column(0):
                total += np.frombuffer(v.as_py())
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["v"])

    parts = df.mapInArrow(part, "v binary")
    if tasks <= DIRECT and 8 * size * tasks <= DIRECT_BYTES:
        # one job: an iterator over partitions would run a job each, one after the other
        return sum((np.frombuffer(r["v"]) for r in parts.collect()), np.zeros(size))
    # the shuffle's tasks run side by side in the first of the iterator's jobs, the others only read it
    parts = parts.repartition(math.isqrt(max(tasks, 1))).mapInArrow(join, "v binary")
    return sum((np.frombuffer(r["v"]) for r in parts.toLocalIterator()), np.zeros(size))


def uniform(rows: np.ndarray, *salt: int) -> np.ndarray:
    """A number from 0 to 1 for each row that depends on the row's own number and the salt alone."""
    x = rows.astype(np.int64).view(np.uint64).copy()
    with np.errstate(over="ignore"):
        for s in salt:
            x = x + np.uint64(0x9E3779B97F4A7C15) * np.uint64(2 * s + 1)
            for mul, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(mul)
            x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53)
