"""Column expressions (all JVM-side, no Python UDF)."""

from __future__ import annotations

import math

import numpy as np

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def composite_key(region, asset_id) -> Column:
    """Global asset id ``<region>_<asset id>``; null when either part is null."""
    return F.concat(_c(region), F.lit("_"), _c(asset_id).cast("bigint").cast("string"))


def clamp_low(col, floor: int) -> Column:
    """Values below ``floor`` become ``floor``; null stays null."""
    c = _c(col)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.greatest(c, F.lit(floor)))


def category_code(col, mapping: dict[str, str], default: str) -> Column:
    """Look a category up in a small literal map, with a default for the rest."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.coalesce(F.create_map(*pairs)[_c(col)], F.lit(default))


def safe_ratio(num, den, scale: float = 1.0) -> Column:
    """num / den * scale, null when den is 0 or null (no ANSI error)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double")) * F.lit(scale)


# Step and number of terms of the trapezoidal sum in erfc (enough for double precision), and the
# argument below which the power series of erf is used instead.
_STEP, _TERMS = 0.5, 14
_NEAR, _SERIES = 0.25, 12


def erfc(x) -> Column:
    """erfc(x) for x >= 0 (Spark has no erf), with a small *relative* error in the far tail too.

    Trapezoidal rule on erfc(x) = (2x / pi) e^(-x^2) * integral of e^(-t^2) / (t^2 + x^2) over t > 0,
    corrected by the residue of the integrand's pole, which counts while x < pi / step.
    """
    x = _c(x)
    y, z = F.greatest(x, F.lit(_NEAR)), F.least(x, F.lit(math.pi / _STEP))
    total = F.lit(0.5) / (y * y)
    for k in range(1, _TERMS + 1):
        t = (k * _STEP) ** 2
        total = total + F.lit(math.exp(-t)) / (F.lit(t) + y * y)
    far = F.lit(2 * _STEP / math.pi) * y * F.exp(-(y * y)) * total
    pole = F.when(x < math.pi / _STEP, F.lit(2.0) / (F.lit(1.0) - F.exp(F.lit(2 * math.pi / _STEP) * F.greatest(z, F.lit(_NEAR))))).otherwise(F.lit(0.0))
    series = F.lit(0.0)
    for n in reversed(range(_SERIES)):
        series = series * (x * x) + F.lit((-1) ** n / (math.factorial(n) * (2 * n + 1)))
    near = F.lit(1.0) - F.lit(2 / math.sqrt(math.pi)) * x * series
    return F.when(x < _NEAR, near).when(x >= _NEAR, far + pole)


def chi2_1df_pvalue(chi2) -> Column:
    """Upper tail of a chi-square with one degree of freedom: erfc(sqrt(x/2))."""
    return erfc(F.sqrt(_c(chi2) / F.lit(2.0)))


def erfc_sql(x: str) -> str:
    """erfc as SQL text by other formulas (power series, then continued fraction), for the oracle."""
    x = f"({x})"
    series = "0.0::DOUBLE"
    for n in reversed(range(45)):
        series = f"({series} * {x} * {x} + ({(-1) ** n / (math.factorial(n) * (2 * n + 1))!r})::DOUBLE)"
    frac = x
    for k in range(60, 0, -1):
        frac = f"({x} + {k / 2} / {frac})"
    return f"(CASE WHEN {x} < 2.0 THEN 1.0 - 2.0 / sqrt(pi()) * {x} * {series} ELSE exp(-({x} * {x})) / (sqrt(pi()) * {frac}) END)"


def chi2_1df_pvalue_sql(chi2: str) -> str:
    return erfc_sql(f"sqrt(({chi2}) / 2.0)")


def _round_edge(x: float, digits: int) -> float:
    """``digits`` decimals; below one, as many digits after the leading zeros."""
    if x == 0 or not math.isfinite(x):
        return x
    if abs(x) < 1:
        digits = -int(math.floor(math.log10(abs(x)))) - 1 + digits
    return float(np.around(x, digits))


def interval_labels(edges: list[float], lowest: bool = False, digits: int = 3, most: int = 20) -> list[str]:
    """Texts ``(lo, hi]`` of right-closed intervals, rounded to the fewest decimals (``digits`` at least) that keep the edges apart.

    ``lowest``: the first interval includes its left edge, which is shown lowered by one unit of the last decimal.
    """
    places = next((p for p in range(digits, most) if len({_round_edge(e, p) for e in edges}) == len(edges)), digits)
    shown = [_round_edge(e, places) for e in edges]
    if lowest and shown:
        shown[0] = shown[0] - 10.0**-places
    return [f"({a}, {b}]" for a, b in zip(shown, shown[1:])]
