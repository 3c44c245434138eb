"""Exact quantiles without gathering a column (or a group) into one task.

* ``grouped_quantiles_discrete`` -- for values with a small domain (years,
  lifetimes): a histogram per (group, value) is aggregated first, so a
  window only ever sees groups x distinct values rows, whatever the skew.
* ``column_quantiles`` -- for a continuous column (sizes): a sketch brackets
  each wanted rank, a second scan counts the rows below each bracket and the
  values inside it, and the rank is selected there.  Only the values inside
  the brackets are exchanged.  Output is one row per probability.

Both use the linear rule of pandas / numpy / SQL ``quantile_cont``:
position p*(n-1), interpolate between the values at floor and ceil.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import store


def _interpolate(picks: DataFrame, keys: list[str]) -> DataFrame:
    # picks: keys + p, pos, lo_v, hi_v
    return picks.select(
        *keys,
        "p",
        (F.col("lo_v") + (F.col("hi_v") - F.col("lo_v")) * (F.col("pos") - F.floor("pos"))).alias("q"),
    )


def grouped_quantiles_discrete(df: DataFrame, group_cols: list[str], value_col: str, probs: list[float]) -> DataFrame:
    """Exact quantiles of ``value_col`` per group -> (group..., p, q)."""
    v = F.col(value_col)
    hist = df.filter(v.isNotNull()).groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*group_cols).orderBy(value_col)
    hist = hist.withColumn("_cum", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    hist = hist.withColumn("_n", F.sum("_c").over(Window.partitionBy(*group_cols)))
    ps = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p")
    # rank r (0-based) lives in the row with cum-c <= r < cum
    with_p = hist.select(*group_cols, value_col, "_c", "_cum", "_n", ps).withColumn(
        "pos", F.col("p") * (F.col("_n") - 1)
    )
    lo_r = F.floor("pos")
    hi_r = F.ceil("pos")
    in_lo = (F.col("_cum") - F.col("_c") <= lo_r) & (lo_r < F.col("_cum"))
    in_hi = (F.col("_cum") - F.col("_c") <= hi_r) & (hi_r < F.col("_cum"))
    picks = with_p.groupBy(*group_cols, "p", "pos").agg(
        F.max(F.when(in_lo, v)).cast("double").alias("lo_v"), F.max(F.when(in_hi, v)).cast("double").alias("hi_v")
    )
    return _interpolate(picks, group_cols)


#: Rows of a bracket, about; rank errors of the sketch, at least and at most.
BRACKET_ROWS, LEAST_ERROR, MOST_ERROR = 1_000_000, 1e-6, 1e-3


def _brackets(df: DataFrame, value_col: str, n: int, ranks: list[int], error: float) -> list[tuple[float, float]]:
    """Disjoint ranges of values that hold the ranks, by a sketch with that rank error."""
    shares = [min(max((r + d * (2 * error * n + 1)) / max(n - 1, 1), 0.0), 1.0) for r in ranks for d in (-1, 1)]
    q = df.approxQuantile(value_col, shares, error)
    spans = sorted(zip(q[::2], q[1::2]))
    out = [list(spans[0])]
    for lo, hi in spans[1:]:
        if lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def column_quantiles(df: DataFrame, value_col: str, probs: list[float], error: float | None = None) -> DataFrame:
    """Exact quantiles of a whole column -> (p, q), one row per probability; nulls and NaN don't count.

    After a count, two scans (store an expensive ``df`` first): the sketch, then one aggregate that counts outside
    rows per gap between brackets and inside rows per value.  A bracket holds about 4 x ``error`` of the rows; by default that is about BRACKET_ROWS.  If a rank
    falls outside its bracket, which the sketch excludes, the brackets are widened.
    """
    spark = df.sparkSession
    v = F.col(value_col).cast("double")
    own = df.select(v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    n = own.count()
    rank = {float(p): float(p) * (n - 1) for p in probs}
    if not n:
        return spark.createDataFrame([(p, None) for p in rank], "p double, q double")
    ranks = sorted({r for pos in rank.values() for r in (math.floor(pos), math.ceil(pos))})
    error = error or min(max(BRACKET_ROWS / 4 / n, LEAST_ERROR), MOST_ERROR)
    spans = _brackets(own, "_v", n, ranks, error)
    while True:
        ends = [x for s in spans for x in s]
        # 2k: below span k, 2k + 1: inside it
        part = F.lit(0)
        for lo, hi in spans:
            part = part + (F.col("_v") >= F.lit(lo)).cast("int") + (F.col("_v") > F.lit(hi)).cast("int")
        part = part.alias("_part")
        counts = own.select(part, F.when(part % 2 == 1, F.col("_v")).alias("_v")).groupBy("_part", "_v").agg(F.count(F.lit(1)).alias("_c"))
        counts = store(counts, "quantile-brackets")
        below, total = {}, 0
        for r in counts.groupBy("_part").agg(F.sum("_c").alias("c")).orderBy("_part").collect():  # a row per bracket and gap
            below[r["_part"]], total = total, total + r["c"]
        offset = F.create_map(*[F.lit(x) for kv in below.items() for x in kv])[F.col("_part")]
        w = Window.partitionBy("_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
        inside = counts.where(F.col("_v").isNotNull()).withColumn("_to", offset + F.sum("_c").over(w))
        wanted = F.explode(F.filter(F.array(*[F.lit(r).cast("long") for r in ranks]), lambda r: (r < F.col("_to")) & (r >= F.col("_to") - F.col("_c"))))
        found = {r["r"]: r["_v"] for r in inside.select(wanted.alias("r"), "_v").collect()}
        if len(found) == len(ranks):
            break
        spans = [(-math.inf, math.inf)] if ends[0] == -math.inf or error >= 0.25 else _brackets(own, "_v", n, ranks, error := error * 16)
    rows = []
    for p, pos in rank.items():
        lo, hi = found[math.floor(pos)], found[math.ceil(pos)]
        rows.append((p, lo + (hi - lo) * (pos - math.floor(pos))))
    return spark.createDataFrame(rows, "p double, q double")
