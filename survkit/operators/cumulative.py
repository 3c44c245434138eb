"""Distributed running sums over a global (or few-group) order.

A SQL window with no PARTITION BY runs in one task.  Curves such as lift and
ROC need running sums over *all* scores, so they use this operator instead:

1. cut the order key into ``n`` ranges at approximate quantiles (n-1 numbers
   reach the driver, a bounded amount) -> a deterministic range id per row;
   ``n`` follows the measured row count (~2M rows per range);
2. totals per (range, group) -- a tiny table (<= n x groups rows) -- and
   their exclusive running sum over ranges -> an offset per (range, group);
3. running sums inside each (range, group) by a window partitioned on the
   range id (a range holds ~1/n of the rows);
4. add the offset.

Every step is linear and partitioned; no step puts a whole group in one task.
The range id is a plain expression of literal bounds, so the two branches
(totals and rows) always agree, also after a task or an executor is retried.
Use it when a group is large (a whole score column); use a plain window when
groups are many and small.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, store

_B = "_range_id"
ROWS_PER_RANGE = 2_000_000


def _range_id(key: Column, bounds: list[float]) -> Column:
    """Number of the sorted bounds below key, by bisection of one literal array."""
    if not bounds:
        return F.lit(0)
    edges = F.lit(np.array(bounds, dtype="float64"))
    widths = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])

    def widen(found: Column, width: Column) -> Column:
        up = found + width
        return F.when((up <= len(bounds)) & (F.get(edges, up - 1) < key), up).otherwise(found)

    return F.aggregate(widths, F.lit(0), widen)


def running_sums(
    df: DataFrame,
    order_col: str,
    value_cols: list[str],
    ascending: bool = True,
    group_cols: list[str] | None = None,
    prefix: str = "cum_",
    num_ranges: int | None = None,
    ties: list[str] | None = None,
) -> DataFrame:
    """Add inclusive running sums ``prefix+v`` of ``value_cols`` ordered by ``order_col``.

    The order key must be numeric, non-null and unique within a group
    (aggregate ties first, or name in ``ties`` the columns that order them);
    ``group_cols`` restart the sums and must be non-null.
    """
    group_cols = list(group_cols or [])
    spark = df.sparkSession
    # The input (an aggregate per distinct key) is read three times: range
    # bounds, totals, rows.  Writing it once to the shared folder computes the
    # upstream once and cuts the lineage for retries.
    ensure_checkpoint_dir(spark)
    df = store(df, "running-sums-in")
    if num_ranges is None:
        # about ROWS_PER_RANGE rows per range (a window task)
        rows = df.count()  # parquet metadata of the stored input
        n = max(1, -(-rows // ROWS_PER_RANGE))
    else:
        n = num_ranges
    key = F.col(order_col).cast("double")
    if not ascending:
        key = -key
    probs = [i / n for i in range(1, n)]
    bounds = sorted(set(df.select(key.alias("_k")).approxQuantile("_k", probs, 0.25 / n))) if probs else []
    with_id = df.withColumn(_B, _range_id(key, bounds)).withColumn("_okey", key)

    totals = with_id.groupBy(_B, *group_cols).agg(*[F.sum(v).alias("_tot_" + v) for v in value_cols])
    w = Window.partitionBy(*group_cols).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        _B, *group_cols, *[F.coalesce(F.sum("_tot_" + v).over(w), F.lit(0)).alias("_off_" + v) for v in value_cols]
    )

    # in-range running sums: a window per (range, group) -- a range holds about
    # 1/n of the rows, so no task ever holds a whole group; JVM-side, codegen'd
    keycols = [_B] + group_cols
    types = {f.name: f.dataType for f in df.schema.fields}
    # long keys may be equal as doubles: the key itself then decides, after it ``ties``
    exact = F.col(order_col).asc() if ascending else F.col(order_col).desc()
    wr = Window.partitionBy(*keycols).orderBy("_okey", exact, *(ties or [])).rowsBetween(Window.unboundedPreceding, 0)
    local = with_id.select("*", *[F.sum(v).over(wr).alias("_loc_" + v) for v in value_cols])
    local_cols = ["_loc_" + v for v in value_cols]
    joined = local.join(offsets, keycols, "left")
    for v in value_cols:
        joined = joined.withColumn(
            prefix + v, (F.col("_loc_" + v) + F.coalesce(F.col("_off_" + v), F.lit(0))).cast(types[v])
        )
    return joined.drop(_B, "_okey", *local_cols, *["_off_" + v for v in value_cols])
