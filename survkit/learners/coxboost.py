"""Boosting of stumps on the Cox partial likelihood, with the out-of-bag stop rule.

The gradient of a row is its event flag minus exp(score) times the cumulative baseline hazard at its duration. The
hazard follows from two sums per year, sum of exp(score) and number of events, so nothing is expanded by year and no
risk set is formed.  Per bin the gradient sum is

    events(bin) - sum over years of hazard(year) * sum of exp(score) of the bin's rows with that duration

and one pass adds up, per (bin, year), what every stump, the hazard and the out-of-bag loss of the round before
need: one scan a round.  A sum of stumps depends on one feature at a time, so the model is a table of one number
per (feature, bin), whatever the number of rounds.

Ties of events within a year take Breslow's form.  A round's in-bag rows are drawn by a seeded hash of the row. The
draws of ``AHEAD`` rounds at a time are made in one pass over the rows, which merges those of the same bins, duration
and flag with the number in each round's bag; the rounds then scan these merged rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .table import BINS, COUNT, DRAWS, FLAG, YEAR, Encoder, Table, drawn, matrix, merged, uniform, vector_sums

#: Rounds, step and in-bag share of the short run; rounds and step of the long one.
ROUNDS, STEP, SUBSAMPLE = 100, 0.5, 0.5
LONG_ROUNDS, LONG_STEP = 1000, 0.05
#: Rounds of the mean improvement, its least value, rounds without one until the fit stops.
WINDOW, LEAST, PATIENCE = 25, 1e-6, 50
#: Rounds whose bags are drawn in one pass.
AHEAD = 5 * DRAWS


@dataclass
class Stump:
    """Rows whose bin is at most ``cut`` (a category: equal to it) get ``left``, others ``right``."""

    feature: int
    cut: int
    left: float
    right: float


@dataclass
class CoxBoost:
    encoder: Encoder
    step: float
    stumps: list[Stump] = field(default_factory=list)
    #: Out-of-bag improvement of the mean loss, per round.
    improvements: list[float] = field(default_factory=list)

    def tables(self) -> list[np.ndarray]:
        """Score contribution of each feature's bins."""
        out = [np.zeros(w) for w in self.encoder.widths]
        for s in self.stumps:
            b = np.arange(len(out[s.feature]))
            left = b == s.cut if self.encoder.is_level[s.feature] else b <= s.cut
            out[s.feature] += self.step * np.where(left, s.left, s.right)
        return out

    def score(self) -> Column:
        """The model's risk score as a column over a table that has the encoder's features."""
        bins = self.encoder.bins()
        total = F.lit(0.0)
        for k, t in enumerate(self.tables()):
            total = total + F.get(F.array(*[F.lit(float(x)) for x in t]), F.get(bins, k).cast("int"))
        return total


def stop_after(improvements: list[float], window: int = WINDOW, least: float = LEAST, patience: int = PATIENCE) -> int | None:
    """Number of rounds after which the rule stops a fit with these improvements; None if it goes on.

    The first ``window`` rounds always pass.  Then a round counts as good if the mean of the last ``window``
    improvements exceeds ``least``; ``patience`` rounds after the last good one the fit stops.
    """
    best = -1
    for k in range(window, len(improvements)):
        if np.mean(improvements[k - window + 1 : k + 1]) > least:
            best = k
        elif k - best >= patience:
            return k + 1
    return None


def hazard(weight: np.ndarray, events: np.ndarray) -> np.ndarray:
    """Cumulative baseline hazard by year from the sums of exp(score) and the events of each duration."""
    risk = np.cumsum(weight[::-1])[::-1]
    return np.cumsum(np.divide(events, risk, out=np.zeros(len(risk)), where=risk > 0))


def loss(scores: float, weight: np.ndarray, events: np.ndarray, rows: float) -> float:
    """Mean negative log partial likelihood: ``scores`` is the sum over events, the others are sums by duration."""
    risk = np.cumsum(weight[::-1])[::-1]
    log_risk = np.log(risk, out=np.zeros(len(risk)), where=risk > 0)
    return float((events * log_risk).sum() - scores) / max(float(rows), 1.0)


def best_stump(encoder: Encoder, gradient: np.ndarray, n: np.ndarray) -> Stump | None:
    """The cut that separates the in-bag gradients most: nl * nr / n * (difference of means)^2; the first of equals."""
    best, found, at = 0.0, None, 0
    for f, (width, level) in enumerate(zip(encoder.widths, encoder.is_level)):
        g, c = gradient[at : at + width], n[at : at + width]
        at += width
        left_g, left_n = (g, c) if level else (np.cumsum(g)[:-1], np.cumsum(c)[:-1])
        right_g, right_n = g.sum() - left_g, c.sum() - left_n
        ok = (left_n > 0) & (right_n > 0)
        if not ok.any():
            continue
        l, r = (np.divide(a, b, out=np.zeros(len(a)), where=ok) for a, b in ((left_g, left_n), (right_g, right_n)))
        gain = np.where(ok, left_n * right_n / max(c.sum(), 1) * (l - r) ** 2, -1)
        k = int(np.argmax(gain))
        if gain[k] > best * (1 + 1e-12):
            best, found = float(gain[k]), Stump(f, k, float(l[k]), float(r[k]))
    return found


def bags(table: Table, rounds: range, seed: int, subsample: float) -> Table:
    """Merged rows with their number in the bag of each of these rounds."""
    return merged(table, rounds, ["bag"], lambda row, no: ((uniform(row, seed, no) < subsample).astype(np.int64),))


def fit(table: Table, encoder: Encoder, rounds: int = ROUNDS, step: float = STEP, subsample: float = SUBSAMPLE, seed: int = 0, stop: Callable[[list[float]], int | None] | None = None) -> CoxBoost:
    """Boosted stumps; ``stop`` gets the improvements so far and says after how many rounds to end."""
    model = CoxBoost(encoder, step)
    widths, years = encoder.widths, table.years
    offsets, cells = np.concatenate(([0], np.cumsum(widths)[:-1])), int(sum(widths))
    # in-bag exp(score) by (cell, year), in-bag events and rows by cell; exp(score) and events by year; out of bag:
    # exp(score) now, before the last stump, events by year; sums of event scores now, before; rows
    sizes = [cells * years, cells, cells, years, years, years, years, years, 3]
    cuts = np.cumsum(sizes)[:-1]
    before = model.tables()

    def passed(cells: Table, now: list[np.ndarray], old: list[np.ndarray], no: int) -> list[np.ndarray]:
        def add(b: pa.RecordBatch, total: np.ndarray) -> None:
            out = np.split(total, cuts)  # views
            x = matrix(b.column(BINS))
            y, e, n = (b.column(c).to_numpy(zero_copy_only=False) for c in (YEAR, FLAG, COUNT))
            s, t = (sum(tab[x[:, k]] for k, tab in enumerate(tabs)) for tabs in (now, old))
            w, bag = np.exp(s), drawn(b, "bag", no)
            for k, off in enumerate(offsets):
                cell = off + x[:, k]
                out[0] += np.bincount(cell * years + y, bag * w, out[0].size)
                out[1] += np.bincount(cell, bag * e, out[1].size)
                out[2] += np.bincount(cell, bag, out[2].size)
            out[3] += np.bincount(y, n * w, years)
            out[4] += np.bincount(y, n * e, years)
            if no:
                o = n - drawn(b, "bag", no - 1)
                out[5] += np.bincount(y, o * w, years)
                out[6] += np.bincount(y, o * np.exp(t), years)
                out[7] += np.bincount(y, o * e, years)
                out[8] += ((o * e * s).sum(), (o * e * t).sum(), o.sum())

        need = [f"bag{k}" for k in sorted({max(no - 1, 0) // DRAWS, no // DRAWS})]
        return np.split(vector_sums(cells.df.select(YEAR, FLAG, BINS, COUNT, *need), int(sum(sizes)), add, cells.tasks), cuts)

    cells_of, upto = None, 0
    for no in range(rounds + 1):
        now = model.tables()
        if no == rounds and stop is None:
            break
        if no >= upto:  # the last bag before is needed once more
            ahead = range(max(no - DRAWS, 0), min(no + AHEAD, rounds + 1))
            cells_of, upto = bags(table, ahead, seed, subsample), ahead.stop
        w_in, e_in, n_in, w, e, w_new, w_old, e_out, (s_new, s_old, n_out) = passed(cells_of, now, before, no)
        if no:
            model.improvements.append(float(loss(s_old, w_old, e_out, n_out) - loss(s_new, w_new, e_out, n_out)))
            if stop is not None and (last := stop(model.improvements)) is not None:
                model.stumps = model.stumps[:last]
                break
        if no == rounds:
            break
        gradient = e_in - w_in.reshape(cells, years) @ hazard(w, e)
        found = best_stump(encoder, gradient, n_in)
        if found is None:
            break
        before = now
        model.stumps.append(found)
    return model


def breslow(scored: DataFrame, score: str, time: str, event: str) -> DataFrame:
    """(year, hazard): Breslow's cumulative baseline hazard, a step at each year with an event.

    One aggregate per year; what is left is bounded by the number of years.
    """
    per = scored.where(F.col(time).isNotNull() & F.col(event).isNotNull()).groupBy(F.col(time).alias("year"))
    per = per.agg(F.sum(F.exp(F.col(score))).alias("w"), F.sum((F.col(event) == 1).cast("long")).alias("d"))
    rows = sorted((r["year"], r["w"], r["d"]) for r in per.collect())
    total = hazard(np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)) if rows else []
    steps = [(int(y), float(h)) for (y, _, d), h in zip(rows, total) if d]
    return scored.sparkSession.createDataFrame(steps, "year int, hazard double")


def curves(scored: DataFrame, score: str, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, year, survival) = exp(-hazard(year) * exp(score)) at each step of the baseline; a literal array, no join."""
    steps = sorted((r["year"], r["hazard"]) for r in baseline.collect())
    if not steps:
        return scored.select(*keys, F.lit(0).alias("year"), F.lit(1.0).alias("survival")).limit(0)
    table = F.array(*[F.struct(F.lit(y).alias("year"), F.lit(h).alias("hazard")) for y, h in steps])
    out = scored.select(*keys, F.exp(F.col(score)).alias("_risk"), F.explode(table).alias("_step"))
    return out.select(*keys, F.col("_step.year").alias("year"), F.exp(-F.col("_step.hazard") * F.col("_risk")).alias("survival"))
