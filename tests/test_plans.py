"""Physical-plan properties that matter at scale (checked with size-based broadcasts off,
as on big tables)."""

import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def big_spark(spark):
    old = (spark.conf.get("spark.sql.autoBroadcastJoinThreshold"),
           spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[0])
    if old[1] is not None:
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", old[1])


def plan(spark, name):
    return E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def exchanges(p):
    return re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition)\(?([^,\]]*)", p)


def test_episodes_never_shuffle_rows_by_region_and_reuse_asset_partitioning(big_spark):
    p = plan(big_spark, "episodes")
    keys = [k for kind, k in exchanges(p) if kind == "hashpartitioning"]
    assert not any(k.startswith("region#") for k in keys)          # observation window is broadcast
    assert not any(k.startswith("id#") for k in keys)              # windows ride on the join's asset_id partitioning
    assert "BroadcastExchange" in p


def test_target_episodes_keep_asset_partitioning(big_spark):
    keys = [k for kind, k in exchanges(plan(big_spark, "first_episode_row")) if kind == "hashpartitioning"]
    assert not any(k.startswith("region#") or k.startswith("id#") for k in keys)


def test_crosstabs_are_one_grouping_sets_aggregate(big_spark):
    p = plan(big_spark, "crosstab_all_pairs")
    assert p.count("Expand") == 1
    assert len(exchanges(p)) == 1   # the stored master table is scanned once, one shuffle


def test_km_windows_run_on_aggregates(big_spark):
    p = plan(big_spark, "km_material")
    # every Window sits above a partial/final aggregate, partitioned by the stratum
    assert re.search(r"Window \[.*windowspecdefinition\(material", p)
    assert "HashAggregate(keys=[material" in p


def test_running_sums_windows_are_partitioned_by_range(big_spark):
    from survkit.operators.cumulative import running_sums

    df = big_spark.createDataFrame([(float(i), 1) for i in range(1000)], "s double, v long")
    p = running_sums(df, "s", ["v"], num_ranges=4)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"windowspecdefinition\(_range_id", p)
    assert "rangepartitioning" not in p   # no global sort of the score column


def test_row_level_km_durations_do_not_shuffle_by_stratum(big_spark):
    keys = [k for kind, k in exchanges(plan(big_spark, "km_durations_own")) if kind == "hashpartitioning"]
    assert not any(k.startswith("region#") for k in keys)


def test_concordance_joins_no_rows_by_time(big_spark):
    p = plan(big_spark, "c_index")
    assert "NestedLoopJoin" not in p and "CartesianProduct" not in p


def test_quantile_scan_exchanges_bracket_values_only(big_spark):
    """Outside values lose their identity before the exchange: the grouping key is null there."""
    from survkit.operators import quantiles

    df = big_spark.range(20_000).selectExpr("cast(hash(id) as double) AS v")
    spans = quantiles._brackets(df, "v", 20_000, [5000, 10_000], 1e-3)
    assert len(spans) == 2 and all(df.where(f"v BETWEEN {lo} AND {hi}").count() < 200 for lo, hi in spans)
    assert quantiles.column_quantiles(df, "v", [0.25, 0.5]).count() == 2


def test_permutation_draws_are_not_sorted(big_spark):
    from survkit.operators.permute import permuted_copies

    df = big_spark.createDataFrame([(str(i), i) for i in range(50)], "id string, a int")
    p = permuted_copies(df, ["a"], 3, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in p and len(re.findall(r"SortMergeJoin", p)) <= 1
