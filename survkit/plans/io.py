"""Source / sink queries (S1-S9), category pairs (J11) and the streaming count."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..operators import integrate as I
from ..session import store
from ..operators.joins import ordered_pairs
from ..sources import files as FI
from ..sources import sinks as SK
from ..streaming import incremental as ST
from .base import Data, query, sql
from .episodes import EPC, EP_COLS, PREP_SQL, prep
from .integration import MC
from .survival import _LR_MA, _MATRIX_SQL, logrank_matrix
from .survival import _LR_MAT as LR_MATERIAL_SQL


@query("src_discovery", sql(f"SELECT {MC} FROM master_events"))
def src_discovery(spark, sf_dir):
    """Per-region ';' files written into a tree in the shared folder, discovered by tag, folder and file name, and integrated."""
    d = Data(spark, sf_dir)
    root = SK.unique_path(spark, "region-files")
    FI.write_region_files(d.assets, d.failures(), f"{root}/study", "towns_clean")
    # another version of the files, which the tag passes over
    FI.write_region_files(d.assets.limit(5), d.failures().limit(5), f"{root}/study", "towns_raw")
    assets, failures = FI.read_region_files(spark, root, "_clean")
    return I.master_events(failures, assets)


@query(
    "sink_partitioned",
    sql(f"SELECT {MC} FROM master_events"),
)
def sink_partitioned(spark, sf_dir):
    """Master events written one folder per region and scanned back."""
    path = SK.write_per_region(Data(spark, sf_dir).events, SK.unique_path(spark, "master-events"))
    return spark.read.parquet(path).select(*I.MASTER_COLUMNS)


@query("sink_reload", sql(f"SELECT {EPC} FROM ep", PREP_SQL))
def sink_reload(spark, sf_dir):
    """Prepared episodes materialised to the shared folder and reloaded (the prepared-data switch)."""
    return SK.materialize(prep(Data(spark, sf_dir)).select(*EP_COLS), SK.unique_path(spark, "episodes"))


@query(
    "scan_region_slice",
    sql(f"SELECT {MC} FROM master_all WHERE region = 'NATION_22'"),
)
def scan_region_slice(spark, sf_dir):
    """Region slice of a region-partitioned master table: the scan reads one folder only."""
    path = SK.write_per_region(Data(spark, sf_dir).all, SK.unique_path(spark, "master-all"))
    return spark.read.parquet(path).filter(F.col(S.REGION) == "NATION_22").select(*I.MASTER_COLUMNS)


@query(
    "category_pairs",
    sql(
        """SELECT a.material AS member_1, b.material AS member_2, a.n AS n_1, b.n AS n_2
           FROM (SELECT material, count(*) AS n FROM all_c WHERE material IS NOT NULL GROUP BY ALL) a
           JOIN (SELECT material, count(*) AS n FROM all_c WHERE material IS NOT NULL GROUP BY ALL) b
           ON a.material < b.material"""
    ),
)
def category_pairs(spark, sf_dir):
    """Unordered pairs of material values with their row counts (pairs of a category list)."""
    c = Data(spark, sf_dir).all_c.filter(F.col(S.MATERIAL).isNotNull()).groupBy(S.MATERIAL).agg(
        F.count(F.lit(1)).alias("n")
    )
    a = c.select(F.col(S.MATERIAL).alias("member_1"), F.col("n").alias("n_1"))
    b = c.select(F.col(S.MATERIAL).alias("member_2"), F.col("n").alias("n_2"))
    return ordered_pairs(a, b, "member_1", "member_2", [])


@query(
    "stream_failures_by_region_year",
    sql(
        """SELECT region, CAST(year(failed_at) AS INTEGER) AS failure_year, count(*) AS n
           FROM master_events GROUP BY ALL"""
    ),
)
def stream_failures_by_region_year(spark, sf_dir):
    """Failure files consumed as a stream (available-now trigger) and counted per region and year."""
    d = Data(spark, sf_dir)
    root = SK.unique_path(spark, "stream-in")
    base = FI.write_region_files(d.assets, d.failures(), root)
    assets, _ = FI.read_region_files(spark, root, "clean")
    # every micro-batch reads the assets' keys: not by parsing their text files again
    assets = store(assets.select(S.REGION, S.ASSET_ID), "asset-keys")
    counts = ST.counts_by_region_year(ST.failure_stream(spark, base), assets)
    out = SK.unique_path(spark, "stream-out")
    ST.run_to_table(counts, out, SK.unique_path(spark, "stream-ckpt"))
    return spark.read.parquet(out)


@query("sink_masters", sql(f"SELECT {MC} FROM master_all"))
def sink_masters(spark, sf_dir):
    """Both master tables written region-partitioned to the shared folder; the full one scanned back."""
    d = Data(spark, sf_dir)
    _, all_path = SK.write_masters(d.events, d.all, SK.unique_path(spark, "masters"))
    return spark.read.parquet(all_path).select(*I.MASTER_COLUMNS)


@query("sink_master_events", sql(f"SELECT {MC} FROM master_events"))
def sink_master_events(spark, sf_dir):
    """Both master tables written; the failure rows scanned back."""
    d = Data(spark, sf_dir)
    events_path, _ = SK.write_masters(d.events, d.all, SK.unique_path(spark, "masters"))
    return spark.read.parquet(events_path).select(*I.MASTER_COLUMNS)


PVALUE_SCHEMA = "member_1 string, member_2 string, chi2 double, p_value double, p_rounded double"


@query("sink_disparate", sql("SELECT member_1, member_2, chi2, p_value, p_rounded FROM lr WHERE p_rounded <= 0.05", LR_MATERIAL_SQL))
def sink_disparate(spark, sf_dir):
    """Similar / disparate pair lists written as CSV; the disparate list read back."""
    from ..operators import logrank as LR

    _, path = SK.write_pvalue_lists(LR.pairwise(Data(spark, sf_dir).all_c, S.MATERIAL), SK.unique_path(spark, "pvalues"))
    return spark.read.schema(PVALUE_SCHEMA).option("header", True).csv(path)


@query("sink_pvalue_matrix", sql(_MATRIX_SQL, _LR_MA))
def sink_pvalue_matrix(spark, sf_dir):
    """The p-value matrix written as CSV and read back; unknown cells stay null."""
    m = logrank_matrix(spark, sf_dir)
    path = SK.write_matrix(m, SK.unique_path(spark, "pvalue-matrix"))
    return spark.read.schema(m.schema).option("header", True).csv(path)


@query(
    "sink_pvalues",
    sql(
        "SELECT member_1, member_2, chi2, p_value, p_rounded FROM lr WHERE p_rounded > 0.05",
        LR_MATERIAL_SQL,
    )
)
def sink_pvalues(spark, sf_dir):
    """Similar / disparate pair lists written as CSV; the similar list read back with its schema."""
    from ..operators import logrank as LR

    pairs = LR.pairwise(Data(spark, sf_dir).all_c, S.MATERIAL)
    sim_path, _ = SK.write_pvalue_lists(pairs, SK.unique_path(spark, "pvalues"))
    return spark.read.schema(PVALUE_SCHEMA).option("header", True).csv(sim_path)


@query("model_persist")
def model_persist(spark, sf_dir):
    """Hazard model saved to the shared folder, loaded back and used to score the test episodes."""
    from ..operators import models as M
    from .models import KEYS, P, _learn_test, _with_truth

    d = Data(spark, sf_dir)
    learn, test = _learn_test(d)
    model = M.fit_hazard(learn, M.boosting(max_iter=20))
    path = SK.save_model(model, SK.unique_path(spark, "hazard-model"))
    loaded = SK.load_pipeline_model(path)
    return _with_truth(d, M.horizon_scores(loaded, test, P, KEYS))
