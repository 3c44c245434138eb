"""Asset and failure tables derived from the TPC-H-like test tables.

Role mapping (see FIXTURES.md):
  asset id      <- orders.o_orderkey
  install date  <- orders.o_orderdate
  size          <- orders.o_totalprice
  material      <- customer.c_mktsegment
  material_age  <- 'r' for priority '4-NOT SPECIFIED', else segment || 2-year period
  region        <- nation.n_name of the customer
  failures      <- lineitem rows with l_returnflag = 'R' (clean: shipped on/after install)

Everything stays lazy; Catalyst prunes the columns and pushes the filters into
the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S

# Fixed values of the mapping.
JUNK_PRIORITY = "4-NOT SPECIFIED"
FAILURE_FLAG = "R"
PERIOD_ORIGIN = 1995
PERIOD_YEARS = 2


_TABLES: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one input table; the DataFrame is reused within a session, so the
    file listing / footer reads happen once and repeated subplans are identical
    (exchange reuse)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (id(spark), spark.sparkContext.applicationId, path)
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(path)
    return _TABLES[key]


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per asset: region, asset_id, installed_at, size_mm, material, material_age."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority"
    )
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    # nation has a fixed 25 rows: a broadcast of it is bounded.
    n = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    period = F.lit(PERIOD_ORIGIN) + F.lit(PERIOD_YEARS) * F.floor(
        (F.year("o_orderdate") - F.lit(PERIOD_ORIGIN)) / F.lit(PERIOD_YEARS)
    )
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .select(
            F.col("n_name").alias(S.REGION),
            F.col("o_orderkey").alias(S.ASSET_ID),
            F.col("o_orderdate").alias(S.INSTALLED_AT),
            F.col("o_totalprice").alias(S.SIZE),
            F.col("c_mktsegment").alias(S.MATERIAL),
            F.when(F.col("o_orderpriority") == JUNK_PRIORITY, F.lit(S.JUNK_MATERIAL_AGE))
            .otherwise(F.concat(F.col("c_mktsegment"), period.cast("bigint").cast("string")))
            .alias(S.MATERIAL_AGE),
        )
    )


def failures(spark: SparkSession, sf_dir: str, clean: bool = True) -> DataFrame:
    """One row per failure: region (of its file), asset_id, failed_at.

    ``clean`` keeps failures dated on or after the install date of their
    asset; the raw variant keeps all of them (about half precede install).
    """
    li = (
        table(spark, sf_dir, "lineitem")
        .filter(F.col("l_returnflag") == FAILURE_FLAG)
        .select(F.col("l_orderkey").alias(S.ASSET_ID), F.col("l_shipdate").alias(S.FAILED_AT))
    )
    a = assets(spark, sf_dir).select(S.ASSET_ID, S.REGION, S.INSTALLED_AT)
    out = li.join(a, S.ASSET_ID)
    if clean:
        out = out.filter(F.col(S.FAILED_AT) >= F.col(S.INSTALLED_AT))
    return out.select(S.REGION, S.ASSET_ID, S.FAILED_AT)


def _failure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .filter(F.col("l_returnflag") == FAILURE_FLAG)
        .select(F.col("l_orderkey").alias("_fid"), F.col("l_shipdate").alias(S.FAILED_AT))
    )


def master_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(master events, master all) of the fixture.

    A fixture failure belongs to the region of its asset, so the failure
    "file" and the asset table meet on the asset key alone, with the
    clean-date rule in the join condition.  Same rows as the two-step
    integration (``operators.integrate``), one shuffle of the failure rows
    instead of two.

    Skew: "all" is built as events UNION assets-without-failure instead of a
    left outer join.  An asset key holding a large share of the failure rows
    sits on the right side of the join; AQE can split it in an inner join but
    not in a left join, and the anti join only sees the (map-side reduced)
    distinct failed keys.
    """
    from ..functions.scalar import composite_key

    a = assets(spark, sf_dir)
    f = _failure_rows(spark, sf_dir)
    cond = (a[S.ASSET_ID] == f["_fid"]) & (f[S.FAILED_AT] >= a[S.INSTALLED_AT])
    cols = [S.REGION, S.ASSET_ID, S.INSTALLED_AT, S.SIZE, S.MATERIAL, S.MATERIAL_AGE, S.FAILED_AT]
    events = a.join(f, cond, "inner").select(*cols)
    failed = events.select(F.col(S.ASSET_ID).alias("_failed")).distinct()
    never = a.join(failed, a[S.ASSET_ID] == failed["_failed"], "left_anti").select(
        *[F.lit(None).cast(events.schema[c].dataType).alias(c) if c == S.FAILED_AT else F.col(c) for c in cols]
    )

    def shape(df: DataFrame) -> DataFrame:
        return df.withColumn(S.ID, composite_key(S.REGION, S.ASSET_ID))

    return shape(events), shape(events.unionByName(never))
