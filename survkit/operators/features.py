"""Feature preparation: standardisation, one-hot indicators, assembly, pruning.

Statistics (means, population standard deviations, category lists) are
one-row / bounded aggregates; applying them is a narrow projection.
"""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S


def scaler_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: mean and population std of every column (the source scaler divides by n)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"_mean_{c}"), F.stddev_pop(c).alias(f"_std_{c}")]
    return df.agg(*aggs)


def apply_scaler(df: DataFrame, stats: DataFrame, cols: list[str], out: dict[str, str] | None = None,
                 shift: dict[str, float] | None = None) -> DataFrame:
    """(x + shift - mean) / std for each column, with stats from another table (one row)."""
    out = out or {c: c + "_std" for c in cols}
    shift = shift or {}
    j = df.crossJoin(F.broadcast(stats))
    for c in cols:
        x = F.col(c) + F.lit(shift.get(c, 0))
        std = F.col(f"_std_{c}")
        j = j.withColumn(out[c], F.when(std > 0, (x - F.col(f"_mean_{c}")) / std).otherwise(F.lit(0.0)))
    return j.drop(*[f"_mean_{c}" for c in cols], *[f"_std_{c}" for c in cols])


def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    return apply_scaler(df, scaler_stats(df, cols), cols)


def category_values(df: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    """Distinct values of category columns (bounded lists, collected once)."""
    st = [F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in cols]
    rows = df.select(*cols).distinct().select(F.explode(F.array(*st)).alias("_kv")).select("_kv.*").filter("v IS NOT NULL").distinct().collect()
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in rows:
        out[r["k"]].append(r["v"])
    return {c: sorted(v) for c, v in out.items()}


def onehot_columns(df: DataFrame, cols: list[str], values: dict[str, list[str]] | None = None):
    """0/1 indicator column per category value (all levels kept); returns (df, names)."""
    values = values or category_values(df, cols)
    names = []
    exprs = []
    for c in cols:
        for v in values[c]:
            names.append(v)
            exprs.append((F.col(c).cast("string") == F.lit(v)).cast("bigint").alias(v))
    return df.select("*", *[F.coalesce(e, F.lit(0).cast("bigint")).alias(n) for e, n in zip(exprs, names)]), names


def nonzero_columns(df: DataFrame, cols: list[str]) -> list[str]:
    """Columns with any value != 0 (null counts as != 0), in one aggregate."""
    row = df.agg(*[F.max((F.coalesce(F.col(c).cast("double"), F.lit(1.0)) != 0).cast("int")).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] == 1]


def vector_pipeline_stages(numeric: list[str], categorical: list[str], out: str = "features"):
    """StringIndexer + OneHotEncoder(dropLast=False) + VectorAssembler stages."""
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep", stringOrderType="alphabetAsc")
           for c in categorical]
    ohe = OneHotEncoder(inputCols=[f"{c}_idx" for c in categorical], outputCols=[f"{c}_oh" for c in categorical],
                        dropLast=False, handleInvalid="keep")
    asm = VectorAssembler(inputCols=numeric + [f"{c}_oh" for c in categorical], outputCol=out, handleInvalid="keep")
    return idx + ([ohe] if categorical else []) + [asm]


HAZARD_NUMERIC = [S.START, "size_mm_std", "install_year_std"]
HAZARD_CATEGORICAL = [S.REGION, S.MATERIAL_AGE]
