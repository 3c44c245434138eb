"""Equal-width and quantile bins, right-closed like ``pandas.cut`` / ``qcut``.

Edges are tiny (n+1 numbers) and are computed by one aggregate; the bin of a
row is then a plain column expression (number of inner edges below the
value), so binning is a narrow, codegen'd projection.  Bins are numbered
1..n; the label is ``(lo, hi]`` with the fewest decimals, three at least,
that keep the edges apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import interval_labels
from .quantiles import column_quantiles

# pandas lowers the first equal-width edge by 0.1 % of the range (fixed value).
CUT_ADJUST = 0.001


def equal_width_edges(df: DataFrame, col: str | Column, n: int) -> list[float]:
    c = F.col(col) if isinstance(col, str) else col
    row = df.agg(F.min(c).cast("double").alias("mn"), F.max(c).cast("double").alias("mx")).first()
    mn, mx = row["mn"], row["mx"]
    if mn is None:
        return []
    if mn == mx:
        lo = mn - CUT_ADJUST * abs(mn) if mn != 0 else -CUT_ADJUST
        hi = mx + CUT_ADJUST * abs(mx) if mx != 0 else CUT_ADJUST
        step = (hi - lo) / n
        return [lo + k * step for k in range(n)] + [hi]
    step = (mx - mn) / n
    edges = [mn + k * step for k in range(n)] + [mx]
    edges[0] = mn - CUT_ADJUST * (mx - mn)
    return edges


def quantile_edges(df: DataFrame, col: str, q: int) -> list[float]:
    qs = column_quantiles(df, col, [k / q for k in range(q + 1)]).orderBy("p").collect()
    return [r["q"] for r in qs]


def bin_expr(x: Column, edges: list[float]) -> Column:
    """1 + number of inner edges strictly below x (right-closed bins); null stays null."""
    if not edges:
        return F.lit(None).cast("int")
    inner = edges[1:-1]
    b = F.lit(1)
    for e in inner:
        b = b + (x > F.lit(e)).cast("int")
    return F.when(x.isNull(), F.lit(None)).otherwise(b).cast("int")


def label_expr(bin_col: Column, edges: list[float], lowest: bool = False) -> Column:
    if len(edges) < 2:
        return F.lit(None).cast("string")
    labels = F.array(*[F.lit(x) for x in interval_labels(edges, lowest)])
    return F.when(bin_col.isNull(), F.lit("nan")).otherwise(F.element_at(labels, bin_col))


def with_bins(df: DataFrame, col: str | Column, edges: list[float], name: str, lowest: bool = False) -> DataFrame:
    """``name``_bin and ``name``_range; ``lowest``: the labels' first interval includes its left edge."""
    x = (F.col(col) if isinstance(col, str) else col).cast("double")
    df = df.withColumn(name + "_bin", bin_expr(x, edges))
    return df.withColumn(name + "_range", label_expr(F.col(name + "_bin"), edges, lowest))


def cut(df: DataFrame, col: str | Column, n: int, name: str, edges_from: DataFrame | None = None) -> DataFrame:
    """Equal-width bins of ``col`` (edges from ``edges_from``, default df)."""
    edges = equal_width_edges(edges_from if edges_from is not None else df, col, n)
    return with_bins(df, col, edges, name)


def qcut(df: DataFrame, col: str, q: int, name: str, edges_from: DataFrame | None = None) -> DataFrame:
    """Quantile bins of ``col`` with exact linear-interpolated edges."""
    edges = quantile_edges(edges_from if edges_from is not None else df, col, q)
    return with_bins(df, col, edges, name, lowest=True)


# --- SQL text of the same rules (oracle) ---------------------------------

def sql_bin(x: str, inner_edges: list[str]) -> str:
    terms = " + ".join(f"CAST(({x}) > ({e}) AS INTEGER)" for e in inner_edges)
    return f"CAST(CASE WHEN ({x}) IS NULL THEN NULL ELSE 1 + {terms} END AS INTEGER)"


def sql_equal_width_inner(mn: str, mx: str, n: int) -> list[str]:
    return [f"({mn} + {k} * ((({mx}) - ({mn})) / {n}))" for k in range(1, n)]


def sql_labels(edges: str, lowest: bool = False) -> str:
    """List of interval texts of a list of edges, by the same rule."""
    rounded = lambda p: f"list_transform({edges}, lambda x: CASE WHEN x = 0 THEN x WHEN abs(x) < 1 THEN round_even(x, CAST(-floor(log10(abs(x))) - 1 + {p} AS INTEGER)) ELSE round_even(x, CAST({p} AS INTEGER)) END)"
    places = f"coalesce(list_filter(range(3, 20), lambda p: len(list_distinct({rounded('p')})) = len({edges}))[1], 3)"
    shown = rounded(places)
    first = f"({shown})[1] - power(10.0::DOUBLE, -{places})" if lowest else f"({shown})[1]"
    return f"list_transform(range(1, len({edges})), lambda k: '(' || CAST(CASE WHEN k = 1 THEN {first} ELSE ({shown})[k] END AS VARCHAR) || ', ' || CAST(({shown})[k + 1] AS VARCHAR) || ']')"
