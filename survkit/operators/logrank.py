"""Pairwise two-sample log-rank tests from counts.

With the window clock of the source analyses every censored row stays at
risk until the last failure year of its pair, and shifting all times by the
pair minimum changes nothing.  So for groups j of a pair, with d_j(y) the
failures in year y and N_j the rows,

    n_j(y) = N_j - sum_{u<y} d_j(u),  E1 = sum d n1/n,
    V = sum d (n1/n)(n2/n)(n-d)/(n-1),  chi2 = (O1 - E1)^2 / V,  p = erfc(sqrt(chi2/2)).

One scan reduces the rows to (partition, group, year) counts; the pairs are
formed on those counts only (k groups -> k(k-1)/2 pairs), never on rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.scalar import chi2_1df_pvalue
from ..session import store
from .counts import tuples
from .joins import join_lookup, ordered_pairs


def group_year_counts(df: DataFrame, group_col: str, part: list[str], time_col: str = S.FAILURE_YEAR, weight: str | None = None):
    base = df.filter(F.col(group_col).isNotNull()).select(
        *part, F.col(group_col).cast("string").alias("g"), F.col(time_col).alias("y"), (F.col(weight) if weight else F.lit(1)).alias("_w")
    )
    # one scan: counts per (group, year or null); rows and failures both derive from it
    cnt = base.groupBy(*part, "g", "y").agg(F.sum("_w").alias("_c"))
    rows = cnt.groupBy(*part, "g").agg(F.sum("_c").alias("N"))
    deaths = cnt.filter(F.col("y").isNotNull()).select(*part, "g", "y", F.col("_c").alias("d"))
    return rows, deaths


def pairwise(df: DataFrame, group_col: str, part: list[str] | None = None, time_col: str = S.FAILURE_YEAR, weight: str | None = None):
    """(part..., member_1, member_2, chi2, p_value, p_rounded) for every unordered pair (member_1 < member_2).

    ``weight``: column with the number of rows that a row stands for.
    """
    part = list(part or [])
    rows, deaths = group_year_counts(df, group_col, part, time_col, weight)
    a = rows.select(*part, F.col("g").alias("g1"), F.col("N").alias("tot1"))
    b = rows.select(*part, F.col("g").alias("g2"), F.col("N").alias("tot2"))
    # pairs of groups on the per-group count table (k = number of groups), never on rows
    pairs = ordered_pairs(a, b, "g1", "g2", part)
    d1 = deaths.select(*part, F.col("g").alias("g1"), "y", F.col("d").alias("d1"))
    d2 = deaths.select(*part, F.col("g").alias("g2"), "y", F.col("d").alias("d2"))
    keys = [*part, "g1", "g2"]
    years = (
        pairs.join(d1.select(*part, "g1", "y"), [*part, "g1"]).select(*keys, "y")
        .union(pairs.join(d2.select(*part, "g2", "y"), [*part, "g2"]).select(*keys, "y"))
        .distinct()
    )
    full = (
        years.join(pairs, keys)
        .join(d1, [*part, "g1", "y"], "left")
        .join(d2, [*part, "g2", "y"], "left")
        .fillna(0, ["d1", "d2"])
    )
    w = Window.partitionBy(*keys).orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    n1 = F.col("tot1") - F.coalesce(F.sum("d1").over(w), F.lit(0))
    n2 = F.col("tot2") - F.coalesce(F.sum("d2").over(w), F.lit(0))
    full = full.withColumn("r1", n1.cast("double")).withColumn("r2", n2.cast("double"))
    n = F.col("r1") + F.col("r2")
    d = (F.col("d1") + F.col("d2")).cast("double")
    e1 = d * F.col("r1") / n
    v = F.when(n > 1, d * (F.col("r1") / n) * (F.col("r2") / n) * (n - d) / (n - F.lit(1.0))).otherwise(F.lit(0.0))
    stats = full.groupBy(*keys).agg(
        F.sum("d1").cast("double").alias("o1"), F.sum(e1).alias("e1"), F.sum(v).alias("v")
    )
    chi2 = F.when(F.col("v") > 0, (F.col("o1") - F.col("e1")) ** 2 / F.col("v"))
    out = stats.withColumn("chi2", chi2).withColumn("p_value", chi2_1df_pvalue(F.col("chi2")))
    return out.select(
        *part,
        F.col("g1").alias("member_1"),
        F.col("g2").alias("member_2"),
        "chi2",
        "p_value",
        F.bround("p_value", 2).alias("p_rounded"),
    )


def split_similar(pvals: DataFrame, alpha: float = 0.05):
    """(similar, disparate): rounded p > alpha vs <= alpha (null p in neither)."""
    return pvals.filter(F.col("p_rounded") > alpha), pvals.filter(F.col("p_rounded") <= alpha)


def unpivot_columns(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """One row per (row, column): column_name, value (text) -- the stack of several group columns."""
    st = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]
    return df.select(*keep, F.explode(F.array(*st)).alias("_u")).select(*keep, "_u.*")


# ---------------------------------------------------------------- k-sample test

def _chi2_sf(x: float, k: int) -> float:
    """Upper tail of chi-square with k dof (regularised incomplete gamma by series / continued fraction)."""
    if x is None or not np.isfinite(x) or x < 0:
        return float("nan")
    a, z = k / 2.0, x / 2.0
    if z == 0:
        return 1.0
    from itertools import count
    from math import exp, lgamma, log

    if z < a + 1:  # series for P
        term = 1.0 / a
        s = term
        ap = a
        while True:  # the terms fall geometrically once ap > z
            ap += 1
            term *= z / ap
            s += term
            if abs(term) < abs(s) * 1e-15:
                break
        return max(0.0, 1.0 - s * exp(-z + a * log(z) - lgamma(a)))
    # continued fraction for Q (Lentz)
    tiny = 1e-300
    b = z + 1 - a
    c = 1 / tiny
    dd = 1 / b
    h = dd
    for i in count(1):
        an = -i * (i - a)
        b += 2
        dd = an * dd + b
        dd = tiny if abs(dd) < tiny else dd
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        dd = 1 / dd
        delta = dd * c
        h *= delta
        if abs(delta - 1) < 1e-15:
            break
    return exp(-z + a * log(z) - lgamma(a)) * h


def _ksample_solve(pdf: pd.DataFrame) -> pd.DataFrame:
    """One column's statistic from its (year, year) terms: at most years x years rows, whatever the groups."""
    r = pdf.iloc[0]
    k, chi2 = int(r["n_groups"]), float("nan")
    t = pdf[pdf["y1"].notna()]
    if k > 1 and len(t):
        years = sorted(set(t["y1"]) | set(t["y2"]))
        at = {y: i for i, y in enumerate(years)}
        i, j = t["y1"].map(at).to_numpy(), t["y2"].map(at).to_numpy()
        m, b, w = np.zeros((len(years), len(years))), np.zeros(len(years)), np.zeros(len(years))
        m[i, j] = t["m"]
        own = i == j
        b[i[own]], w[i[own]] = t["b"][own], t["w"][own]
        try:
            chi2 = float(r["c"] + b @ np.linalg.solve(np.diag(1 / w) - m, b))
        except np.linalg.LinAlgError:
            pass
    return pd.DataFrame(
        {"column_name": [r["column_name"]], "n_groups": [k], "dof": [k - 1], "chi2": [chi2], "p_value": [_chi2_sf(chi2, k - 1)]}
    )


def _ksample_groups(df: DataFrame, columns: list[str], time_col: str) -> DataFrame:
    """Per (column, group): size, u = observed - expected, var = sum of w p, and its points (year, p, w)."""
    long = unpivot_columns(tuples(df, [*columns, time_col], "_w"), columns, [time_col, "_w"]).filter(F.col("value").isNotNull())
    long = long.withColumnRenamed("value", "g").withColumnRenamed(time_col, "y")
    cnt = store(long.groupBy("column_name", "g", "y").agg(F.sum("_w").alias("d")), "ksample-counts")
    rows = cnt.groupBy("column_name", "g").agg(F.sum("d").alias("size"))
    deaths = cnt.filter(F.col("y").isNotNull())
    # one row per column: its failure years
    years = deaths.groupBy("column_name").agg(F.collect_set("y").alias("ys"))
    grid = join_lookup(rows, years, ["column_name"], "inner").select("column_name", "g", "size", F.explode("ys").alias("y"))
    grid = grid.join(deaths, ["column_name", "g", "y"], "left").fillna(0, ["d"])
    before = Window.partitionBy("column_name", "g").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("at_risk", (F.col("size") - F.coalesce(F.sum("d").over(before), F.lit(0))).cast("double"))
    grid = store(grid, "ksample-grid")

    tot = grid.groupBy("column_name", "y").agg(F.sum("at_risk").alias("total"), F.sum("d").cast("double").alias("dt"))
    w = F.when(F.col("total") > 1, F.col("dt") * (F.col("total") - F.col("dt")) / (F.col("total") - 1)).otherwise(F.lit(0.0))
    # groups x years against one row per column and year
    x = join_lookup(grid, tot.filter("total > 0").withColumn("w", w), ["column_name", "y"], "inner")
    x = x.withColumn("p", F.col("at_risk") / F.col("total"))
    point = F.when(F.col("w") > 0, F.struct("y", "p", "w"))
    return x.groupBy("column_name", "g").agg(
        F.max("size").alias("size"), F.sum(F.col("d") - F.col("dt") * F.col("p")).alias("u"), F.sum(F.col("w") * F.col("p")).alias("var"), F.collect_list(point).alias("ps")
    )


def ksample_terms(df: DataFrame, columns: list[str], time_col: str = S.FAILURE_YEAR) -> DataFrame:
    """The k-group test's terms per (column, group): size, observed - expected failures, variance of that difference."""
    per = _ksample_groups(df, columns, time_col)
    variance = F.aggregate("ps", F.lit(0.0), lambda s, x: s + x["w"] * x["p"] * (F.lit(1.0) - x["p"]))
    return per.select("column_name", F.col("g").alias("group_name"), "size", F.col("u").alias("excess"), variance.alias("variance"))


def ksample(df: DataFrame, columns: list[str], time_col: str = S.FAILURE_YEAR) -> DataFrame:
    """One k-group log-rank test per column (null statistic where it is undefined, e.g. one group).

    The rows become (column, group, year) at-risk / failure counts (censored
    rows stay at risk to the end, as in the pairwise test).  With p_j(y) a
    group's share of the rows at risk and w(y) = d (n - d) / (n - 1), the
    covariance of O - E is V = diag(D) - P W P', D_j = sum_y w p_j.  By the
    matrix inversion lemma (O - E)' V^-1 (O - E) needs sums over groups and
    one system of the size of the years, so no k x k matrix is formed and no
    task gets all groups of a column.  The largest group is left out, as V of
    all groups is singular.
    """
    per = _ksample_groups(df, columns, time_col)
    per = store(per, "ksample-groups")
    lead = per.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_groups"), F.max(F.struct("size", "g"))["g"].alias("left_out"))
    rest = join_lookup(per, lead, ["column_name"], "inner").filter((F.col("g") != F.col("left_out")) & (F.col("var") > 0))
    pair = rest.select("column_name", "u", "var", F.explode("ps").alias("a"), "ps").select("column_name", "u", "var", "a", F.explode("ps").alias("b"))
    terms = pair.groupBy("column_name", F.col("a.y").alias("y1"), F.col("b.y").alias("y2")).agg(
        F.sum(F.col("a.p") * F.col("b.p") / F.col("var")).alias("m"), F.sum(F.col("a.p") * F.col("u") / F.col("var")).alias("b"), F.max("a.w").alias("w")
    )
    c = rest.groupBy("column_name").agg(F.sum(F.col("u") * F.col("u") / F.col("var")).alias("c"))
    small = lead.join(c, "column_name", "left").join(terms, "column_name", "left")
    return small.drop("left_out").groupBy("column_name").applyInPandas(
        _ksample_solve, "column_name string, n_groups int, dof int, chi2 double, p_value double"
    )
