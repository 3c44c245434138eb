"""Censoring-aware failure episodes (the training / truth tables of risk ranking).

An *episode* of an asset starts at install (or at its previous failure) and
ends at its next failure (event) or at the end of the observation window
(censored).  Building them needs, per asset, its failures in date order; the
whole construction therefore runs on ONE hash partitioning by asset id:

* the observation window per region is a per-region aggregate (one row per
  region, joined map-side);
* survivor re-insertion, full-row de-duplication, the previous-failure lag,
  and the repair counter are window functions over ``PARTITION BY id`` -- they
  share one exchange and one sort, and a partition holds the failures of a
  set of assets (no region-level skew: a region may hold a third of the rows,
  an asset only its own failures).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from .integrate import union_fill_missing
from .joins import join_lookup

ROW_COLS = [S.REGION, S.ASSET_ID, S.INSTALLED_AT, S.SIZE, S.MATERIAL, S.MATERIAL_AGE, S.FAILED_AT, S.ID,
            S.INSTALL_YEAR, S.FAILURE_YEAR]


def obs_window(all_rows: DataFrame) -> DataFrame:
    """(region, obs_start, obs_end): first and last failure year per region (all rows, before the cutoff)."""
    return all_rows.filter(F.col(S.REGION).isNotNull()).groupBy(S.REGION).agg(
        F.min(S.FAILURE_YEAR).alias(S.OBS_START), F.max(S.FAILURE_YEAR).alias(S.OBS_END)
    )


def censor_at_cutoff(all_rows: DataFrame, cutoff: int) -> DataFrame:
    """Keep assets installed before the cutoff; failures at/after it are not known yet."""
    late = F.col(S.FAILURE_YEAR) >= F.lit(cutoff)
    return (
        all_rows.filter(F.col(S.INSTALL_YEAR) < F.lit(cutoff))
        .withColumn(S.FAILED_AT, F.when(late, F.lit(None)).otherwise(F.col(S.FAILED_AT)))
        .withColumn(S.FAILURE_YEAR, F.when(late, F.lit(None)).otherwise(F.col(S.FAILURE_YEAR)))
    )


def survivor_rows(events: DataFrame, cond: Column) -> DataFrame:
    """A failure-free copy of the rows of failed assets (the asset lives on after repair).

    The failure columns are left out; stacking with ``union_fill_missing``
    null-fills them (by-name union, as the source's concat)."""
    return events.filter(cond).select(*[c for c in ROW_COLS if c not in (S.FAILED_AT, S.FAILURE_YEAR)])


def _asset_order() -> list[Column]:
    # failures in date order, the failure-free row last; the remaining
    # columns only make the order total (equal rows are interchangeable)
    return [F.col(S.FAILED_AT).asc_nulls_last()] + [F.col(c).asc_nulls_last() for c in ROW_COLS if c != S.FAILED_AT]


# The per-asset windows partition on (asset_id, region) -- the same asset as
# ``id`` -- so they reuse the hash partitioning of the master-table join on
# asset_id instead of shuffling the rows again by the text id.
ASSET_KEY = [S.ASSET_ID, S.REGION]


def asset_window(key_cols: list[str] | None = None) -> Window:
    return Window.partitionBy(*(key_cols or ASSET_KEY)).orderBy(*_asset_order())


SALTED_KEY = "_asset_key"


def with_salted_key(rows: DataFrame) -> DataFrame:
    """``_asset_key`` = asset_id, or for rows of unknown assets a per-row negative hash.

    Failures of unknown assets share a null key; salting spreads them over
    the cluster instead of one window partition (each is its own history).
    """
    salt = F.lit(-1) - F.pmod(F.xxhash64(*[F.col(c) for c in ROW_COLS]), F.lit(1 << 62))
    return rows.withColumn(SALTED_KEY, F.coalesce(F.col(S.ASSET_ID), salt))


def dedup_rows(rows: DataFrame) -> DataFrame:
    """Full-row distinct (nulls equal) inside the asset partitioning: drop a row equal to its predecessor."""
    w = asset_window()
    cur = F.struct(*[F.col(c) for c in ROW_COLS])
    return rows.withColumn("_prev", F.lag(cur).over(w)).filter(
        F.col("_prev").isNull() | ~cur.eqNullSafe(F.col("_prev"))
    ).drop("_prev")


def with_start(rows: DataFrame, variant: str, init: int = 0, key_cols: list[str] | None = None) -> DataFrame:
    """Episode start ``last_failure_year``.

    reg : install year; previous failure year of the same asset when there is one.
    init: install year, moved to max(install, obs_start - init) for assets
          installed on/before obs_start - 2*init; then previous failure.
    obs : obs_start; then previous failure.
    A previous row without failure year gives 0 (source behaviour, trap G6).
    """
    w = asset_window(key_cols)
    prev_year = F.lag(S.FAILURE_YEAR).over(w)
    is_first = F.row_number().over(w) == 1
    iy = F.col(S.INSTALL_YEAR)
    if variant == "reg":
        base = iy
    elif variant == "init":
        old = iy <= F.col(S.OBS_START) - F.lit(2 * init)
        base = F.when(old, F.greatest(iy, F.col(S.OBS_START) - F.lit(init))).otherwise(iy)
    elif variant == "obs":
        base = F.col(S.OBS_START)
    else:
        raise ValueError(variant)
    # rows of unknown assets have no history: they start at their base value
    unknown = F.col(S.ASSET_ID).isNull() | F.col(S.REGION).isNull()
    start = F.when(unknown | is_first, base).otherwise(F.coalesce(prev_year, F.lit(0)))
    return rows.withColumn(S.START, start.cast("int"))


def attach_window(rows: DataFrame, obs: DataFrame, materialized: bool = False) -> DataFrame:
    # one row per region, broadcast after an exact count: never shuffle the
    # asset rows by region (skew), keep their partitioning by asset id
    return join_lookup(rows, obs, [S.REGION], "left", materialized=materialized)


def episodes(
    all_rows: DataFrame,
    events: DataFrame,
    cutoff: int,
    init: int = 0,
    variant: str = "reg",
    drop_unknown_history: bool | None = None,
    with_repairs: bool = False,
    obs: DataFrame | None = None,
) -> DataFrame:
    """Training episodes as of ``cutoff`` (cleaned inputs with year columns).

    Steps: window per region -> censor at cutoff -> re-insert survivors ->
    full-row distinct -> start -> event / censor time -> duration >= 0 ->
    [REG] drop starts not identifiable (<= obs_start - init) -> [repairs].
    """
    if drop_unknown_history is None:
        drop_unknown_history = variant == "reg"
    given = obs is not None
    obs = obs if given else obs_window(all_rows)
    censored = censor_at_cutoff(all_rows, cutoff).select(*ROW_COLS)
    surv = survivor_rows(
        events, (F.col(S.FAILURE_YEAR) < F.lit(cutoff)) & (F.col(S.INSTALL_YEAR) < F.lit(cutoff))
    )
    rows = dedup_rows(union_fill_missing([censored, surv]).select(*ROW_COLS))
    rows = attach_window(rows, obs, materialized=given)
    rows = with_start(rows, variant, init)
    if with_repairs:
        # assets with a failure before the cutoff, seen on the asset partition
        has_fail = F.max(F.col(S.FAILURE_YEAR).isNotNull().cast("int")).over(Window.partitionBy(*ASSET_KEY))
        rows = rows.withColumn("_has_fail", has_fail)
    rows = rows.withColumn(S.EVENT, F.col(S.FAILURE_YEAR).isNotNull().cast("int"))
    end = F.coalesce(F.col(S.FAILURE_YEAR), F.least(F.col(S.OBS_END), F.lit(cutoff - 1)))
    rows = rows.withColumn(S.FAILURE_YEAR, end.cast("int"))
    rows = rows.withColumn(S.DURATION, (F.col(S.FAILURE_YEAR) - F.col(S.START)).cast("int"))
    rows = rows.filter(F.col(S.DURATION) >= 0)
    if drop_unknown_history:
        unknown = F.col(S.START) <= F.col(S.OBS_START) - F.lit(init)
        rows = rows.filter(~F.coalesce(unknown, F.lit(False)))
    if with_repairs:
        base = F.when(F.col(S.INSTALL_YEAR) <= F.col(S.OBS_START) - F.lit(2 * init), 1).otherwise(0)
        pos = F.row_number().over(asset_window()) - 1
        rows = rows.withColumn(S.REPAIRS, (base + F.when(F.col("_has_fail") == 1, pos).otherwise(0)).cast("int"))
        rows = rows.drop("_has_fail")
    return rows


def target_episodes(all_rows: DataFrame, events: DataFrame, cutoff: int, obs: DataFrame | None = None) -> DataFrame:
    """Truth episodes: nothing is masked; every failed asset installed before the cutoff
    gets a failure-free row; censored rows end at obs_end; key (id, last_failure_year).
    Carries ``_asset_key`` (salted asset key) for the per-asset windows downstream."""
    given = obs is not None
    obs = obs if given else obs_window(all_rows)
    # one failure-free row per asset, whatever the number of its failures
    surv = survivor_rows(events, F.col(S.INSTALL_YEAR) < F.lit(cutoff)).dropDuplicates([S.ASSET_ID, S.REGION])
    rows = union_fill_missing([all_rows.select(*ROW_COLS), surv]).select(*ROW_COLS)
    rows = with_salted_key(attach_window(rows, obs, materialized=given))
    rows = with_start(rows, "reg", key_cols=[SALTED_KEY, S.REGION])
    rows = rows.withColumn(S.EVENT, F.col(S.FAILURE_YEAR).isNotNull().cast("int"))
    rows = rows.withColumn(S.FAILURE_YEAR, F.coalesce(F.col(S.FAILURE_YEAR), F.col(S.OBS_END)).cast("int"))
    return rows.withColumn(S.DURATION, (F.col(S.FAILURE_YEAR) - F.col(S.START)).cast("int"))


def first_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keep the first row of each key in asset order (failures by date, failure-free last)."""
    w = Window.partitionBy(*keys).orderBy(*_asset_order())
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def last_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keep the last row of each key in (failed_at ascending, nulls last) order."""
    w = Window.partitionBy(*keys).orderBy(*_reverse_order())
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def _reverse_order() -> list[Column]:
    return [F.col(S.FAILED_AT).desc_nulls_first()] + [F.col(c).desc_nulls_first() for c in ROW_COLS if c != S.FAILED_AT]


def jitter_events(ep: DataFrame, copies: int, min_duration: int) -> DataFrame:
    """Oversample long events: each event with duration >= min_duration is copied at
    +-1..+-copies years (year and duration shifted together)."""
    if copies <= 0:
        return ep
    shifts = [s * k for k in range(1, copies + 1) for s in (-1, 1)]
    long_ev = ep.filter((F.col(S.EVENT) == 1) & (F.col(S.DURATION) >= min_duration))
    extra = long_ev.withColumn("_shift", F.explode(F.array(*[F.lit(x) for x in shifts])))
    extra = extra.withColumn(S.FAILURE_YEAR, (F.col(S.FAILURE_YEAR) + F.col("_shift")).cast("int")).withColumn(
        S.DURATION, (F.col(S.DURATION) + F.col("_shift")).cast("int")
    ).drop("_shift")
    return ep.unionByName(extra)


def label_horizon(rows: DataFrame, cutoff: int, horizon: int) -> DataFrame:
    """Per asset: 1 if a failure falls in [cutoff, cutoff + horizon), else 0."""
    inwin = (F.col(S.FAILURE_YEAR) >= cutoff) & (F.col(S.FAILURE_YEAR) < cutoff + horizon)
    return rows.groupBy(S.ID).agg(F.max(F.when(inwin, 1).otherwise(0)).alias("label"))
