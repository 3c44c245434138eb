"""Sinks: per-region and master tables, prepared episodes, test results, models.

Everything is written by executors straight to the shared store; nothing is
collected on the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .. import schema as S
from ..session import scratch_path


def unique_path(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def write_per_region(df: DataFrame, path: str) -> str:
    """One folder per region (partition pruning for region slices)."""
    df.write.mode("overwrite").partitionBy(S.REGION).parquet(path)
    return path


def write_masters(events: DataFrame, all_rows: DataFrame, path: str) -> tuple[str, str]:
    e, a = f"{path.rstrip('/')}/master_events", f"{path.rstrip('/')}/master_all"
    write_per_region(events, e)
    write_per_region(all_rows, a)
    return e, a


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write a table to the shared folder and scan it back (cuts lineage, survives executor loss)."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_pvalue_lists(pairs: DataFrame, path: str, alpha: float = 0.05) -> tuple[str, str]:
    """Similar (rounded p > alpha) and disparate pair lists as CSV files."""
    sim = pairs.filter(pairs.p_rounded > alpha)
    dis = pairs.filter(pairs.p_rounded <= alpha)
    s, d = f"{path.rstrip('/')}/similar", f"{path.rstrip('/')}/disparate"
    sim.write.mode("overwrite").option("header", True).csv(s)
    dis.write.mode("overwrite").option("header", True).csv(d)
    return s, d


def write_matrix(matrix: DataFrame, path: str) -> str:
    """A pivoted matrix as CSV with its column names."""
    matrix.write.mode("overwrite").option("header", True).csv(path)
    return path


def save_model(model, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_pipeline_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
