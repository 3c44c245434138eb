"""Ranking evaluation: lift curve, ROC, time-dependent AUC, IPCW AUC, concordance.

Every metric is reduced to counts per distinct score first (partial
aggregation), and every "cumulative over the score order" uses the
distributed ``running_sums`` -- no window without PARTITION BY over a whole
score column, no pairwise join.  Tied scores are one point of a curve and
count one half in the AUCs (the Mann-Whitney form, equal to the trapezoid
area under the ROC through the tie groups).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import store
from .cumulative import running_sums
from .joins import join_lookup

SCORE, LABEL, TIME = "proba", "event", "duration"


def score_counts(df: DataFrame, score: str = SCORE, label: str = LABEL, group_cols: list[str] | None = None):
    """(group..., score, n, pos, neg) per distinct score."""
    g = list(group_cols or [])
    return (
        df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*g, score)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col(label).cast("long")).alias("pos"),
        )
        .withColumn("neg", F.col("n") - F.col("pos"))
    )


def _totals(counts: DataFrame, group_cols: list[str]) -> DataFrame:
    agg = [F.sum("pos").alias("tot_pos"), F.sum("neg").alias("tot_neg"), F.sum("n").alias("tot_rows")]
    if group_cols:
        return counts.groupBy(*group_cols).agg(*agg)
    return counts.agg(*agg)


def _with_totals(df: DataFrame, totals: DataFrame, group_cols: list[str]) -> DataFrame:
    if group_cols:
        # one row per group against a whole score column per group: broadcast
        return join_lookup(df, totals, group_cols, "left")
    return df.crossJoin(F.broadcast(totals))  # one row


def auc(df: DataFrame, score: str = SCORE, label: str = LABEL, group_cols: list[str] | None = None) -> DataFrame:
    """ROC AUC per group: sum over scores of pos * (neg below + neg tied / 2) / (P * N)."""
    g = list(group_cols or [])
    c = score_counts(df, score, label, g)
    cum = running_sums(c, score, ["neg"], ascending=True, group_cols=g)
    cum = cum.withColumn("_neg_below", F.col("cum_neg") - F.col("neg"))
    part = (F.col("pos") * (F.col("_neg_below") + F.col("neg") * F.lit(0.5))).cast("double")
    agg = [F.sum(part).alias("_u"), F.sum("pos").alias("sum_pos"), F.sum("neg").alias("sum_neg")]
    s = cum.groupBy(*g).agg(*agg) if g else cum.agg(*agg)
    val = F.when((F.col("sum_pos") > 0) & (F.col("sum_neg") > 0), F.col("_u") / (F.col("sum_pos").cast("double") * F.col("sum_neg")))
    return s.select(*g, val.alias("auc"))


def roc_curve(df: DataFrame, score: str = SCORE, label: str = LABEL, group_cols: list[str] | None = None) -> DataFrame:
    """(group..., threshold, fpr, tpr) at every distinct score, plus each group's origin (threshold null)."""
    g = list(group_cols or [])
    return _roc_points(score_counts(df, score, label, g), score, g)


def _roc_points(counts: DataFrame, score: str, g: list[str]) -> DataFrame:
    """Curve of (group..., score, n, pos, neg) counts; a rate without its rows is null."""
    cum = running_sums(counts, score, ["pos", "neg"], ascending=False, group_cols=g)
    t = _totals(cum, g)  # from the materialised counts, not from the upstream again
    cur = _with_totals(cum, t, g).select(
        *g,
        F.col(score).cast("double").alias("threshold"),
        F.when(F.col("tot_neg") > 0, F.col("cum_neg") / F.col("tot_neg")).alias("fpr"),
        F.when(F.col("tot_pos") > 0, F.col("cum_pos") / F.col("tot_pos")).alias("tpr"),
    )
    zero = F.lit(0.0)
    return cur.unionByName(t.select(*g, F.lit(None).cast("double").alias("threshold"), zero.alias("fpr"), zero.alias("tpr")))


def lift_curve(df: DataFrame, score: str = SCORE, label: str = LABEL) -> DataFrame:
    """Per distinct score (descending): average rank, x = rank / max rank, y = cumulative failures share."""
    c = score_counts(df, score, label).withColumn("_one", F.lit(1).cast("long"))
    cum = running_sums(c, score, ["n", "pos", "_one"], ascending=False)
    t = _totals(cum, [])
    # average rank of a tie group = rows strictly above + (n + 1) / 2
    cum = cum.withColumn("avg_rank", (F.col("cum_n") - F.col("n")) + (F.col("n") + F.lit(1)) / F.lit(2.0))
    max_rank = cum.agg(F.max("avg_rank").alias("_max_rank"))  # one row
    out = _with_totals(cum, t, []).crossJoin(F.broadcast(max_rank))
    return out.select(
        F.col(score),
        F.col("cum__one").alias("position"),
        "n",
        F.col("pos").alias("n_events"),
        "avg_rank",
        (F.col("avg_rank") / F.col("_max_rank")).alias("x"),
        F.when(F.col("tot_pos") > 0, F.col("cum_pos") / F.col("tot_pos")).alias("y"),
    )


def lift_area(curve: DataFrame) -> DataFrame:
    """Trapezoid area of the lift curve between consecutive points (no origin point)."""
    prev = curve.select(
        (F.col("position") + 1).alias("position"), F.col("x").alias("_px"), F.col("y").alias("_py")
    )
    seg = curve.join(prev, "position", "inner")  # a shuffle join on the point index, not a window
    area = seg.agg(F.sum((F.col("x") - F.col("_px")) * (F.col("y") + F.col("_py")) / 2.0).alias("area"))
    return area.select(F.coalesce("area", F.lit(0.0)).alias("area"), F.round(F.coalesce("area", F.lit(0.0)), 2).alias("area_rounded"))


def time_grid(df: DataFrame, time: str = TIME, lo: float = 5.0, hi: float = 81.0, k: int = 10) -> DataFrame:
    """Distinct percentiles of ``time`` at linspace(lo, hi, k) percent (exact, linear rule)."""
    from .quantiles import grouped_quantiles_discrete

    probs = [(lo + (hi - lo) * i / (k - 1)) / 100.0 for i in range(k)]
    q = grouped_quantiles_discrete(df.withColumn("_all", F.lit(1)), ["_all"], time, probs)
    return q.select(F.col("q").alias("t")).distinct()


def _time_counts(df: DataFrame, times: DataFrame, score: str) -> DataFrame:
    """(t, score, n, pos, neg): positives = event and duration <= t, everything else negative."""
    base = df.groupBy(score, LABEL, TIME).agg(F.count(F.lit(1)).alias("_w"))
    x = base.crossJoin(F.broadcast(times))  # times: at most k rows
    lab = ((F.col(LABEL) == 1) & (F.col(TIME) <= F.col("t"))).cast("long")
    per = x.groupBy("t", score).agg(F.sum("_w").alias("n"), F.sum(lab * F.col("_w")).alias("pos"))
    return per.withColumn("neg", F.col("n") - F.col("pos"))


def roc_curve_by_time(df: DataFrame, times: DataFrame, score: str = SCORE) -> DataFrame:
    """ROC curve at each t, by the labels of ``dynamic_auc``."""
    return _roc_points(_time_counts(df, times, score), score, ["t"])


def dynamic_auc(df: DataFrame, times: DataFrame, score: str = SCORE) -> DataFrame:
    """AUC at each t: positives = event and duration <= t, everything else negative."""
    cum = running_sums(_time_counts(df, times, score), score, ["neg"], ascending=True, group_cols=["t"])
    part = (F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") * F.lit(0.5))).cast("double")
    s = cum.groupBy("t").agg(F.sum(part).alias("_u"), F.sum("pos").alias("sum_pos"), F.sum("neg").alias("sum_neg"))
    val = F.when((F.col("sum_pos") > 0) & (F.col("sum_neg") > 0), F.col("_u") / (F.col("sum_pos").cast("double") * F.col("sum_neg")))
    return s.select("t", val.alias("auc"))


def censoring_survival(train: DataFrame) -> DataFrame:
    """(duration, g) per distinct duration of the training rows: g = P(C > t), the Kaplan-Meier of censoring.

    At a tied time failures come before censorings, so a time's failures have left its risk set.
    """
    c = train.filter(F.col(TIME).isNotNull() & F.col(LABEL).isNotNull()).groupBy(TIME).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col(LABEL) == 1).cast("long")).alias("d")
    )
    # windows over the distinct durations only (whole years)
    one = Window.partitionBy(F.lit(1))
    at_risk = F.sum("n").over(one.orderBy(F.col(TIME).desc()).rowsBetween(Window.unboundedPreceding, 0))
    c = c.withColumn("left", at_risk - F.col("d"))
    factor = F.when(F.col("left") > 0, F.lit(1.0) - (F.col("n") - F.col("d")) / F.col("left")).otherwise(F.lit(1.0))
    return c.select(TIME, F.product(factor).over(one.orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)).alias("g"))


def dynamic_auc_ipcw(df: DataFrame, times: DataFrame, train: DataFrame, score: str = SCORE) -> DataFrame:
    """Cumulative/dynamic AUC with inverse-probability-of-censoring weights.

    Cases at t: event and duration <= t, weight 1 / G(duration); controls:
    duration > t, weight 1.  G is the censoring KM of the training rows, a step
    function: 1 before its first duration, its last value after the last one.
    A case with G = 0 has no weight.
    """
    base = df.groupBy(score, LABEL, TIME).agg(F.count(F.lit(1)).alias("_w"))
    steps = base.select(TIME).distinct().join(censoring_survival(train), TIME, "full_outer")
    held = F.last("g", ignorenulls=True).over(Window.partitionBy(F.lit(1)).orderBy(TIME))
    # one weight per distinct duration (a few dozen years): broadcast after a count,
    # never a shuffle of the score table by duration (a duration can hold most rows)
    base = join_lookup(base, steps.select(TIME, F.coalesce(held, F.lit(1.0)).alias("g")), [TIME], "left")
    x = base.crossJoin(F.broadcast(times))
    case = (F.col(LABEL) == 1) & (F.col(TIME) <= F.col("t"))
    ctrl = F.col(TIME) > F.col("t")
    wcase = F.when(case & (F.col("g") > 0), F.col("_w") / F.col("g")).otherwise(F.lit(0.0))
    wctrl = F.when(ctrl, F.col("_w").cast("double")).otherwise(F.lit(0.0))
    per = x.groupBy("t", score).agg(F.sum(wcase).alias("pos"), F.sum(wctrl).alias("neg"))
    cum = running_sums(per, score, ["neg"], ascending=True, group_cols=["t"])
    part = F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") * F.lit(0.5))
    s = cum.groupBy("t").agg(F.sum(part).alias("_u"), F.sum("pos").alias("sum_pos"), F.sum("neg").alias("sum_neg"))
    val = F.when((F.col("sum_pos") > 0) & (F.col("sum_neg") > 0), F.col("_u") / (F.col("sum_pos") * F.col("sum_neg")))
    return s.select("t", val.alias("auc"))


def _time_places(base: DataFrame) -> tuple[DataFrame, int]:
    """``base`` with ``_r``, the place of each row's time in an order of times, and the number of places.

    Whole numbers keep their distance to the least one; other times get their rank among the distinct ones.
    """
    if isinstance(base.schema[TIME].dataType, T.IntegralType):
        low, high = base.agg(F.min(TIME), F.max(TIME)).first()
        return base.withColumn("_r", F.col(TIME).cast("long") - F.lit(low or 0)), (high or 0) - (low or 0) + 1
    times = base.select(TIME).distinct().withColumn("_one", F.lit(1).cast("long"))
    ranked = store(running_sums(times, TIME, ["_one"]).select(TIME, (F.col("cum__one") - 1).alias("_r")), "time-places")
    return join_lookup(base, ranked, [TIME], "inner", materialized=True), ranked.count()


def concordance(df: DataFrame, score: str = SCORE) -> DataFrame:
    """Harrell's C: for an event at T, comparable rows have time > T, or time = T and no event.

    Times are the leaves of a dyadic tree.  An event counts as a case in every node above its time; a row counts
    as a control in the nodes that make up the range of times before its own.  An event and a row comparable to it
    meet in exactly one node, so counts per (node, score) and a running count of lower scores per node give the
    concordant and tied pairs: 2 x log2(times) copies of each (score, time, event) count, no join of rows by time.
    Rows without a time, event flag or score are left out.
    """
    known = F.col(score).isNotNull() & F.col(LABEL).isNotNull() & F.col(TIME).isNotNull()
    base = store(df.where(known).groupBy(score, LABEL, TIME).agg(F.count(F.lit(1)).alias("_w")), "concordance")
    base, places = _time_places(base)
    levels = max(1, int(places).bit_length())
    event = F.col(LABEL) == 1
    # events at places before ``_before`` can be compared with the row
    base = base.withColumn("_before", F.col("_r") + F.when(event, 0).otherwise(1))
    level = lambda expr: F.expr(f"transform(sequence(0, {levels}), b -> {expr})")
    as_case = level("struct(b AS level, shiftright(_r, b) AS node, _w AS cases, 0L AS ctrl)")
    as_ctrl = F.expr(
        f"transform(filter(sequence(0, {levels}), b -> shiftright(_before, b) % 2 = 1), b -> struct(b AS level, shiftright(_before, b) - 1 AS node, 0L AS cases, _w AS ctrl))"
    )
    both = base.select(score, F.explode(F.when(event, F.concat(as_case, as_ctrl)).otherwise(as_ctrl)).alias("_n")).select(score, "_n.*")
    both = both.groupBy("level", "node", score).agg(F.sum("cases").alias("cases"), F.sum("ctrl").alias("ctrl"))
    cum = running_sums(both, score, ["ctrl"], ascending=True, group_cols=["level", "node"])
    below = F.col("cum_ctrl") - F.col("ctrl")
    per_t = cum.groupBy("level", "node").agg(
        F.sum(F.col("cases") * below).alias("conc"),
        F.sum(F.col("cases") * F.col("ctrl")).alias("tied"),
        F.sum("cases").alias("ncase"),
        F.sum("ctrl").alias("nctrl"),
    )
    tot = per_t.agg(
        F.sum("conc").alias("concordant"),
        F.sum("tied").alias("tied_risk"),
        F.sum(F.col("ncase") * F.col("nctrl")).alias("comparable"),
    )
    return tot.select(
        (F.col("concordant") + F.lit(0.5) * F.col("tied_risk")).cast("double").alias("_num"), "comparable",
        "concordant", "tied_risk",
    ).select(
        (F.col("_num") / F.col("comparable")).alias("c_index"),
        F.col("concordant").cast("long").alias("concordant"),
        F.col("tied_risk").cast("long").alias("tied_risk"),
        F.col("comparable").cast("long").alias("comparable"),
    )
