"""Stratified Kaplan-Meier on calendar-year clocks.

Clock (as in the source analyses): time zero is the first failure year of a
window population, a failure's duration is its year minus that minimum, a
row without failure is censored at (max - min).  The window population is
either the stratum itself (``own``) or a coarser parent (``parent_cols``;
``[]`` = everybody).

Scale: nothing here touches raw rows more than once.  Rows are first
reduced to counts per (stratum, window keys, year) with map-side partial
aggregation; the window min/max is a per-window aggregate joined to those
counts; the estimator runs as windows over the (stratum, time) count table,
whose size is strata x distinct times -- independent of the data volume and
of skew between strata.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from .joins import join_lookup

Z_975 = 1.959963984540054  # standard normal 97.5 % quantile (fixed value)


def _window_stats(df: DataFrame, cols: list[str], time_col: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.min(time_col).alias("_mn"), F.max(time_col).alias("_mx"))


def _attach(df: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    if cols:
        return df.join(stats, cols, "left")
    return df.crossJoin(F.broadcast(stats))  # one row


def durations(
    df: DataFrame, strata: list[str], parent_cols: list[str] | None = None, time_col: str = S.FAILURE_YEAR
) -> DataFrame:
    """Row-level (duration, event) on the window clock; rows of an undefined clock are dropped."""
    win = list(strata) if parent_cols is None else list(parent_cols)
    stats = _window_stats(df, win, time_col)
    t = F.col(time_col)
    # row-level rows meet one stats row per window group: broadcast after an
    # exact count, never a shuffle of the rows by a low-cardinality key
    out = join_lookup(df, stats, win, "left") if win else _attach(df, stats, win)
    out = out.withColumn(
        S.DURATION, F.when(t.isNull(), F.col("_mx") - F.col("_mn")).otherwise(t - F.col("_mn")).cast("int")
    ).withColumn(S.EVENT, t.isNotNull().cast("int"))
    return out.drop("_mn", "_mx").filter(F.col(S.DURATION).isNotNull())


def duration_counts(
    df: DataFrame, strata: list[str], parent_cols: list[str] | None = None, time_col: str = S.FAILURE_YEAR
) -> DataFrame:
    """(strata, duration, n_events, n_rows) without materialising row-level durations."""
    win = list(strata) if parent_cols is None else list(parent_cols)
    keys = list(dict.fromkeys(list(strata) + win))
    cond = F.lit(True)
    for c in strata:
        cond = cond & F.col(c).isNotNull()
    base = df.filter(cond)
    counts = base.groupBy(*keys, time_col).agg(F.count(F.lit(1)).alias("_n"))
    # the window min/max come from the (small) count table, not from a second scan
    stats = _window_stats(counts, win, time_col)
    t = F.col(time_col)
    j = _attach(counts, stats, win)
    dur = F.when(t.isNull(), F.col("_mx") - F.col("_mn")).otherwise(t - F.col("_mn")).cast("int")
    j = j.withColumn(S.DURATION, dur).filter(F.col(S.DURATION).isNotNull())
    return j.groupBy(*strata, S.DURATION).agg(
        F.sum(F.when(t.isNotNull(), F.col("_n")).otherwise(F.lit(0))).cast("bigint").alias("n_events"),
        F.sum("_n").cast("bigint").alias("n_rows"),
    )


def curve_from_counts(counts: DataFrame, strata: list[str], with_ci: bool = False) -> DataFrame:
    """KM table per stratum: duration, n_at_risk, n_events, n_censored, survival [+ CI]."""
    part = Window.partitionBy(*strata)
    at_risk = F.sum("n_rows").over(
        part.orderBy(F.col(S.DURATION).desc()).rowsBetween(Window.unboundedPreceding, 0)
    )
    run = part.orderBy(S.DURATION).rowsBetween(Window.unboundedPreceding, 0)
    out = counts.withColumn("n_at_risk", at_risk.cast("bigint")).withColumn(
        "n_censored", (F.col("n_rows") - F.col("n_events")).cast("bigint")
    )
    out = out.withColumn(
        "survival", F.product(F.lit(1.0) - F.col("n_events") / F.col("n_at_risk")).over(run)
    )
    cols = [*strata, S.DURATION, "n_at_risk", "n_events", "n_censored", "survival"]
    if with_ci:
        n, d = F.col("n_at_risk"), F.col("n_events")
        term = F.when(n > d, d / (n * (n - d))).otherwise(F.lit(None).cast("double"))
        out = out.withColumn("_v", F.sum(term).over(run))
        # a null term (n == d, survival hits 0) poisons the running sum -> null CI afterwards
        bad = F.max(F.when(n <= d, 1).otherwise(0)).over(run)
        s = F.col("survival")
        ln_s = F.log(s)
        ok = (s > 0) & (s < 1) & (bad == 0)
        out = out.withColumn(
            "ci_upper", F.when(ok, F.pow(s, F.exp(F.lit(Z_975) * F.sqrt("_v") / ln_s)))
        ).withColumn("ci_lower", F.when(ok, F.pow(s, F.exp(-F.lit(Z_975) * F.sqrt("_v") / ln_s))))
        cols += ["ci_lower", "ci_upper"]
    return out.select(*cols)


def km(
    df: DataFrame,
    strata: list[str],
    parent_cols: list[str] | None = None,
    time_col: str = S.FAILURE_YEAR,
    with_ci: bool = False,
) -> DataFrame:
    return curve_from_counts(duration_counts(df, strata, parent_cols, time_col), strata, with_ci)


def km_from_durations(df: DataFrame, strata: list[str], duration: Column, event: Column, with_ci: bool = False):
    """KM for any given (duration, event) columns (other time origins)."""
    base = df.select(*strata, duration.cast("int").alias(S.DURATION), event.cast("int").alias("_e")).filter(
        F.col(S.DURATION).isNotNull()
    )
    counts = base.groupBy(*strata, S.DURATION).agg(
        F.sum("_e").cast("bigint").alias("n_events"), F.count(F.lit(1)).cast("bigint").alias("n_rows")
    )
    return curve_from_counts(counts, strata, with_ci)
