"""Row filters and date columns used by every analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S


def drop_value(df: DataFrame, column: str, value) -> DataFrame:
    """Remove rows equal to ``value``; null rows are kept (pandas mask semantics)."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(value)))


def clean(df: DataFrame, unknown_material: str = S.UNKNOWN_MATERIAL, junk: str = S.JUNK_MATERIAL_AGE) -> DataFrame:
    """Drop the unknown material and the junk material/period marker."""
    return drop_value(drop_value(df, S.MATERIAL, unknown_material), S.MATERIAL_AGE, junk)


def drop_zero_size(df: DataFrame) -> DataFrame:
    return drop_value(df, S.SIZE, 0.0)


def cap_size(df: DataFrame, cap: float) -> DataFrame:
    return df.filter(F.col(S.SIZE) <= F.lit(cap))


def with_years(df: DataFrame) -> DataFrame:
    """install_year and failure_year (null stays null)."""
    return df.withColumn(S.INSTALL_YEAR, F.year(S.INSTALLED_AT)).withColumn(S.FAILURE_YEAR, F.year(S.FAILED_AT))


def parse_dates(df: DataFrame, columns: list[str], fmt: str | None = None, lenient: bool = False) -> DataFrame:
    """Text -> timestamp.  Strict parsing raises on bad input (ANSI); lenient gives null."""
    fn = F.try_to_timestamp if lenient else F.to_timestamp
    for c in columns:
        if lenient:
            df = df.withColumn(c, fn(F.col(c), F.lit(fmt)) if fmt else fn(F.col(c)))
        else:
            df = df.withColumn(c, fn(F.col(c), fmt) if fmt else fn(F.col(c)))
    return df
