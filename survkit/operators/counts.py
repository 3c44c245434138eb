"""Counts, cross-tabs and failure rates (descriptive layer).

All counts drop null group keys, like a pandas ``groupby``.  Rates join a
failure count to an installed count *after* both are aggregated, so the
joins only ever see one row per key.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import safe_ratio


def count_by(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.filter(cond).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def rate(events: DataFrame, rows: DataFrame, keys: list[str], scale: float = 100.0, how: str = "inner") -> DataFrame:
    """failures / rows per key (x scale).  ``inner`` drops keys without failures."""
    ev = count_by(events, keys, "n_failures")
    al = count_by(rows, keys, "n_rows")
    if how == "inner":
        out = al.join(ev, keys, "inner")
    else:  # aligned division: keep every installed key, missing failures -> null rate
        out = al.join(ev, keys, "left")
    return out.withColumn("rate", safe_ratio("n_failures", "n_rows", scale))


def tuples(df: DataFrame, columns: list[str], name: str = "n") -> DataFrame:
    """Rows per combination of the columns, nulls included: what follows touches combinations, not rows."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))


def all_pair_crosstabs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Joint counts of every column pair plus each column's margin in ONE pass.

    One GROUPING SETS aggregate (Expand + partial aggregation) replaces the
    per-pair group-bys; ``gid`` tells the sets apart, unused keys are null.
    Rows with a null in a used key are dropped, like pandas.
    """
    sets = [list(p) for p in combinations(columns, 2)] + [[c] for c in columns]
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(
        F.grouping_id(*columns).cast("int").alias("gid"), F.count(F.lit(1)).alias("n")
    )
    # drop groups whose used keys contain a null (pandas drops null keys)
    keep = F.lit(False)
    for s in sets:
        gid = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s)
        cond = F.col("gid") == gid
        for c in s:
            cond = cond & F.col(c).isNotNull()
        keep = keep | cond
    return out.filter(keep)
