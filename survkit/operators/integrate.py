"""Integration: per-region failure and asset tables -> the two master tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.scalar import composite_key

MASTER_COLUMNS = [S.REGION, S.ASSET_ID, S.INSTALLED_AT, S.SIZE, S.MATERIAL, S.MATERIAL_AGE, S.FAILED_AT, S.ID]


def _join(failures: DataFrame, assets: DataFrame, how: str) -> DataFrame:
    f = failures.alias("f")
    a = assets.alias("a")
    cond = (F.col("f." + S.REGION) == F.col("a." + S.REGION)) & (F.col("f." + S.ASSET_ID) == F.col("a." + S.ASSET_ID))
    region = F.coalesce(F.col("f." + S.REGION), F.col("a." + S.REGION))
    # The failure-side key is redundant after the join and is dropped; an
    # orphan failure therefore keeps a null asset id and a null global id.
    out = f.join(a, cond, how).select(
        region.alias(S.REGION),
        F.col("a." + S.ASSET_ID).alias(S.ASSET_ID),
        F.col("a." + S.INSTALLED_AT).alias(S.INSTALLED_AT),
        F.col("a." + S.SIZE).alias(S.SIZE),
        F.col("a." + S.MATERIAL).alias(S.MATERIAL),
        F.col("a." + S.MATERIAL_AGE).alias(S.MATERIAL_AGE),
        F.col("f." + S.FAILED_AT).alias(S.FAILED_AT),
    )
    return out.withColumn(S.ID, composite_key(S.REGION, S.ASSET_ID))


def master_events(failures: DataFrame, assets: DataFrame) -> DataFrame:
    """Inner join: one row per failure of a known asset."""
    return _join(failures, assets, "inner")


def master_all(failures: DataFrame, assets: DataFrame) -> DataFrame:
    """Full outer join: one row per failure plus one per never-failed asset.

    Built as matched rows (inner join) + unmatched failures + unmatched assets
    (two anti joins against the distinct keys of the other side) -- the same
    rows as a full outer join, but every big join is one whose skewed keys
    AQE can split, and the anti joins only meet de-duplicated keys.
    """
    keys = [S.REGION, S.ASSET_ID]
    matched = master_events(failures, assets)
    fkeys = failures.select(*keys).distinct()
    akeys = assets.select(*keys).distinct()
    lone_f = failures.join(akeys, keys, "left_anti").select(
        S.REGION,
        F.lit(None).cast(assets.schema[S.ASSET_ID].dataType).alias(S.ASSET_ID),
        *[F.lit(None).cast(assets.schema[c].dataType).alias(c) for c in (S.INSTALLED_AT, S.SIZE, S.MATERIAL, S.MATERIAL_AGE)],
        S.FAILED_AT,
    )
    lone_a = assets.join(fkeys, keys, "left_anti").select(
        S.REGION, S.ASSET_ID, S.INSTALLED_AT, S.SIZE, S.MATERIAL, S.MATERIAL_AGE,
        F.lit(None).cast(failures.schema[S.FAILED_AT].dataType).alias(S.FAILED_AT),
    )
    rest = lone_f.unionByName(lone_a).withColumn(S.ID, composite_key(S.REGION, S.ASSET_ID))
    return matched.select(*MASTER_COLUMNS).unionByName(rest.select(*MASTER_COLUMNS))


def union_shared_columns(frames: list[DataFrame]) -> DataFrame:
    """Stack frames by name keeping only the columns all of them share."""
    shared = [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]
    return reduce(lambda x, y: x.unionByName(y), [f.select(*shared) for f in frames])


def union_fill_missing(frames: list[DataFrame]) -> DataFrame:
    """Stack frames by name; columns missing on one side become null."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
