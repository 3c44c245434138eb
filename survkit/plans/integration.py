"""L1 integration queries: master tables, key columns, cleaning, data checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions.scalar import composite_key
from ..operators import clean as C
from ..operators import integrate as I
from .base import Data, query, sql

MC = ", ".join(I.MASTER_COLUMNS)


@query("master_events", sql(f"SELECT {MC} FROM master_events"))
def master_events(spark, sf_dir):
    return Data(spark, sf_dir).events_integrated


@query("master_all", sql(f"SELECT {MC} FROM master_all"))
def master_all(spark, sf_dir):
    return Data(spark, sf_dir).all_integrated


# FURNITURE plays the unknown material in this query only (FIXTURES.md).
@query(
    "clean_assets",
    sql(f"SELECT {MC} FROM master_all WHERE material IS DISTINCT FROM 'FURNITURE' AND material_age IS DISTINCT FROM 'r'"),
)
def clean_assets(spark, sf_dir):
    return C.clean(Data(spark, sf_dir).all, unknown_material="FURNITURE")


@query(
    "composite_key",
    sql("SELECT region, asset_id, region || '_' || CAST(asset_id AS VARCHAR) AS id FROM assets"),
)
def composite_key_q(spark, sf_dir):
    a = Data(spark, sf_dir).assets
    return a.select(S.REGION, S.ASSET_ID, composite_key(S.REGION, S.ASSET_ID).alias(S.ID))


@query("scan_projected", sql("SELECT id, region, failed_at, installed_at FROM master_all"))
def scan_projected(spark, sf_dir):
    return Data(spark, sf_dir).all.select(S.ID, S.REGION, S.FAILED_AT, S.INSTALLED_AT)


@query("date_parts", sql("SELECT id, installed_at, failed_at, install_year, failure_year FROM all_c"))
def date_parts(spark, sf_dir):
    return Data(spark, sf_dir).all_c.select(S.ID, S.INSTALLED_AT, S.FAILED_AT, S.INSTALL_YEAR, S.FAILURE_YEAR)


@query("union_shared_columns", sql(f"SELECT {MC} FROM master_events"))
def union_shared_columns(spark, sf_dir):
    """Per-region frames with differing extra columns, stacked on shared columns."""
    ev = Data(spark, sf_dir).events
    even = F.coalesce(F.substring(S.REGION, -1, 1).isin(*"02468"), F.lit(False))
    first = ev.filter(even).withColumn("source_file", F.lit("a"))
    second = ev.filter(~even).withColumn("row_tag", F.lit(1))
    return I.union_shared_columns([first, second])


# Failures whose asset is not in the cleaned asset table.
@query(
    "dq_orphan_events",
    sql(
        """SELECT f.region, f.asset_id, f.failed_at FROM failures f
           WHERE NOT EXISTS (SELECT 1 FROM assets a WHERE a.region = f.region AND a.asset_id = f.asset_id
                             AND a.material IS DISTINCT FROM 'INCONNU' AND a.material_age IS DISTINCT FROM 'r')"""
    ),
)
def dq_orphan_events(spark, sf_dir):
    d = Data(spark, sf_dir)
    return d.failures().join(C.clean(d.assets), [S.REGION, S.ASSET_ID], "left_anti")


# Full-row duplicates of the master table.
@query(
    "dq_duplicates",
    sql(f"SELECT {MC}, count(*) AS n FROM master_all GROUP BY ALL HAVING count(*) > 1"),
)
def dq_duplicates(spark, sf_dir):
    return Data(spark, sf_dir).all.groupBy(*I.MASTER_COLUMNS).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


# Dates arriving as text are parsed strictly (ANSI: a bad value raises).
@query(
    "parse_dates",
    sql("""SELECT id, strftime(installed_at, '%Y-%m-%d') AS installed_text, installed_at,
                  CAST(year(installed_at) AS INTEGER) AS install_year FROM master_all"""),
)
def parse_dates(spark, sf_dir):
    a = Data(spark, sf_dir).all.select(S.ID, F.date_format(S.INSTALLED_AT, "yyyy-MM-dd").alias("installed_text"))
    p = C.parse_dates(a.withColumn(S.INSTALLED_AT, F.col("installed_text")), [S.INSTALLED_AT], "yyyy-MM-dd")
    p = p.withColumn(S.INSTALLED_AT, F.col(S.INSTALLED_AT).cast("timestamp_ntz"))
    return p.select(S.ID, "installed_text", S.INSTALLED_AT, F.year(S.INSTALLED_AT).alias(S.INSTALL_YEAR))
