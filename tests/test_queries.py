"""Registered queries against the DuckDB oracle on the smallest fixture, plus invariants."""

import math

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

CHECKED = [
    "master_all", "clean_assets", "crosstab_all_pairs", "pivot_year_region", "rate_by_material",
    "median_lifetime", "crosstab_rate", "km_material", "km_ci", "logrank_all_columns", "logrank_matrix",
    "episodes", "repair_sequence", "target_episodes", "first_episode_row", "lift_auc", "roc_curve",
    "dynamic_auc", "dynamic_auc_ipcw", "c_index", "roc_micro", "feat_onehot", "feat_prune", "logrank_region_columns",
    "km_region_material_age", "km_region_sizebin", "stream_failures_by_region_year",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, 6)
        return int(r) if r == int(r) else r
    if hasattr(v, "tolist") and not isinstance(v, str):
        return tuple(_norm(x) for x in v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return str(v) if hasattr(v, "isoformat") else v


def _rows(pdf):
    import pandas as pd

    cols = sorted(pdf.columns)
    pdf = pdf[cols].astype(object).where(pd.notna(pdf[cols]), None)
    return sorted((tuple(_norm(x) for x in r) for r in pdf.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF).toPandas()
    exp = con.execute(E.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(exp.columns)
    assert _rows(got) == _rows(exp)


def test_every_query_has_a_check_kind():
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 100


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) >= {"material", "duration", "survival"}


def test_survival_is_monotone_in_unit_interval(spark):
    rows = E.queries()["km_region"](spark, SF).collect()
    by = {}
    for r in rows:
        by.setdefault(r["region"], []).append((r["duration"], r["survival"]))
    for pts in by.values():
        s = [v for _, v in sorted(pts)]
        assert all(0.0 <= x <= 1.0 for x in s) and all(a >= b - 1e-12 for a, b in zip(s, s[1:]))


def test_grid_counts_sum_to_total(spark):
    from survkit.plans.base import Data

    grid = E.queries()["crosstab_grid"](spark, SF)
    n_all = Data(spark, SF).all_c.filter("region IS NOT NULL AND material IS NOT NULL").count()
    s = grid.filter("x_name = 'material' AND y_name = 'region'").agg({"n_rows": "sum"}).first()[0]
    assert s == n_all > 0


def test_episode_counts_at_sf001(spark):
    ep = E.queries()["episodes"](spark, SF01)
    r = ep.agg({"event": "sum", "*": "count"}).first()
    assert r["count(1)"] == 10049 and r["sum(event)"] == 2818
    assert ep.filter("duration < 0").count() == 0
