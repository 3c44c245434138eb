"""L4 episode construction queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import clean as C
from ..operators import counts as K
from ..operators import episodes as EP
from ..operators import integrate as I
from .base import Data, query, sql

ST = S.DEFAULT_STUDY
A, INIT, P = ST.cutoff, ST.init, ST.horizon
HOLDOUT_REGION = "NATION_22"
# Oversampling parameters for the fixture (its durations stay below 7 years).
JITTER_COPIES = 2
JITTER_MIN_DURATION = 2

RC = ", ".join(EP.ROW_COLS)
ORDER_SQL = "failed_at ASC NULLS LAST, " + ", ".join(f"{c} ASC NULLS LAST" for c in EP.ROW_COLS if c != "failed_at")
EP_COLS = EP.ROW_COLS + [S.OBS_START, S.OBS_END, S.START, S.EVENT, S.DURATION]
EPC = ", ".join(EP_COLS)


def _start_sql(variant: str) -> str:
    if variant == "reg":
        base = "install_year"
    elif variant == "init":
        base = (f"CASE WHEN install_year <= obs_start - {2 * INIT} THEN greatest(install_year, obs_start - {INIT}) "
                f"ELSE install_year END")
    else:
        base = "obs_start"
    return f"CAST(CASE WHEN rn = 1 THEN {base} ELSE coalesce(prev_year, 0) END AS INTEGER)"


def _null_rows(src: str, cond: str) -> str:
    cols = ", ".join(
        "CAST(NULL AS TIMESTAMP) AS failed_at" if c == "failed_at" else
        "CAST(NULL AS INTEGER) AS failure_year" if c == "failure_year" else c
        for c in EP.ROW_COLS
    )
    return f"SELECT {cols} FROM {src} WHERE {cond}"


def _prep_sql(variant: str = "reg", drop_unknown: bool | None = None, repairs: bool = False) -> str:
    if drop_unknown is None:
        drop_unknown = variant == "reg"
    cens_cols = ", ".join(
        f"CASE WHEN failure_year >= {A} THEN NULL ELSE {c} END AS {c}" if c in ("failed_at", "failure_year") else c
        for c in EP.ROW_COLS
    )
    extra_filter = f" AND NOT coalesce(last_failure_year <= obs_start - {INIT}, FALSE)" if drop_unknown else ""
    rep = ""
    if repairs:
        rep = f""",
    ep_rep AS (SELECT *, CAST(CASE WHEN install_year <= obs_start - {2 * INIT} THEN 1 ELSE 0 END
                              + CASE WHEN has_fail = 1 THEN row_number() OVER (PARTITION BY id ORDER BY {ORDER_SQL}) - 1 ELSE 0 END
                              AS INTEGER) AS repairs FROM ep)"""
    return f"""obs AS (SELECT region, min(failure_year) AS obs_start, max(failure_year) AS obs_end
                FROM all_c WHERE region IS NOT NULL GROUP BY region),
    cens AS (SELECT {cens_cols} FROM all_c WHERE install_year < {A}),
    surv AS ({_null_rows('ev_c', f'failure_year < {A} AND install_year < {A}')}),
    drows AS (SELECT DISTINCT * FROM (SELECT {RC} FROM cens UNION ALL SELECT {RC} FROM surv)),
    ro AS (SELECT r.*, o.obs_start, o.obs_end,
                  row_number() OVER w AS rn, lag(failure_year) OVER w AS prev_year,
                  max(CASE WHEN failure_year IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY id) AS has_fail
           FROM drows r LEFT JOIN obs o USING (region)
           WINDOW w AS (PARTITION BY id ORDER BY {ORDER_SQL})),
    st AS (SELECT * EXCLUDE (rn, prev_year), {_start_sql(variant)} AS last_failure_year FROM ro),
    ep0 AS (SELECT * EXCLUDE (failure_year), CASE WHEN failure_year IS NULL THEN 0 ELSE 1 END AS event,
                   CAST(coalesce(failure_year, least(obs_end, {A - 1})) AS INTEGER) AS failure_year FROM st),
    ep AS (SELECT *, CAST(failure_year - last_failure_year AS INTEGER) AS duration FROM ep0
           WHERE failure_year - last_failure_year >= 0{extra_filter}){rep}"""


PREP_SQL = _prep_sql()

TARGET_SQL = f"""obs AS (SELECT region, min(failure_year) AS obs_start, max(failure_year) AS obs_end
                FROM all_c WHERE region IS NOT NULL GROUP BY region),
    trows AS (SELECT {RC} FROM all_c UNION ALL {_null_rows('(SELECT * FROM ev_c QUALIFY row_number() OVER (PARTITION BY id ORDER BY failed_at DESC) = 1) AS last_failure_of_asset', f'install_year < {A}')}),
    tro AS (SELECT r.*, o.obs_start, o.obs_end, row_number() OVER w AS rn, lag(failure_year) OVER w AS prev_year
            FROM trows r LEFT JOIN obs o USING (region) WINDOW w AS (PARTITION BY id ORDER BY {ORDER_SQL})),
    tst AS (SELECT * EXCLUDE (rn, prev_year), {_start_sql('reg')} AS last_failure_year FROM tro),
    truth AS (SELECT * EXCLUDE (failure_year), CASE WHEN failure_year IS NULL THEN 0 ELSE 1 END AS event,
                     CAST(coalesce(failure_year, obs_end) AS INTEGER) AS failure_year,
                     CAST(coalesce(failure_year, obs_end) - last_failure_year AS INTEGER) AS duration FROM tst),
    truth1 AS (SELECT * EXCLUDE (rn1) FROM (
                 SELECT *, row_number() OVER (PARTITION BY id, last_failure_year ORDER BY {ORDER_SQL}) AS rn1 FROM truth)
               WHERE rn1 = 1)"""


# the target CTEs without the shared observation-window CTE (to combine with PREP_SQL)
TARGET_BODY = TARGET_SQL[TARGET_SQL.index("trows AS"):]


def prep(d: Data, variant: str = "reg", repairs: bool = False):
    return EP.episodes(d.all_c, d.events_c, A, INIT, variant=variant, with_repairs=repairs, obs=d.obs)


def truth(d: Data):
    return EP.target_episodes(d.all_c, d.events_c, A, obs=d.obs)


def truth_first(d: Data):
    # (salted asset key, region) = id: stays on the truth rows' partitioning
    return EP.first_per_key(truth(d), [EP.SALTED_KEY, S.REGION, S.START]).drop(EP.SALTED_KEY)


# ---------------------------------------------------------------- E1 / J3 / J4 / A17

@query("obs_window", sql("SELECT region, obs_start, obs_end FROM obs", PREP_SQL))
def obs_window(spark, sf_dir):
    return EP.obs_window(Data(spark, sf_dir).all_c)


@query(
    "obs_window_join",
    sql("SELECT a.id, a.region, a.failure_year, o.obs_start, o.obs_end FROM all_c a LEFT JOIN obs o USING (region)",
        PREP_SQL),
)
def obs_window_join(spark, sf_dir):
    a = Data(spark, sf_dir).all_c
    return EP.attach_window(a, EP.obs_window(a)).select(S.ID, S.REGION, S.FAILURE_YEAR, S.OBS_START, S.OBS_END)


# ---------------------------------------------------------------- E2 / E3

@query("censor_at_cutoff", sql(f"SELECT {RC} FROM cens", PREP_SQL))
def censor_at_cutoff(spark, sf_dir):
    return EP.censor_at_cutoff(Data(spark, sf_dir).all_c, A).select(*EP.ROW_COLS)


@query("reinsert_survivors", sql(f"SELECT {RC} FROM drows", PREP_SQL))
def reinsert_survivors(spark, sf_dir):
    d = Data(spark, sf_dir)
    cens = EP.censor_at_cutoff(d.all_c, A).select(*EP.ROW_COLS)
    surv = EP.survivor_rows(d.events_c, (F.col(S.FAILURE_YEAR) < A) & (F.col(S.INSTALL_YEAR) < A))
    return EP.dedup_rows(I.union_fill_missing([cens, surv]).select(*EP.ROW_COLS))


# ---------------------------------------------------------------- E4 variants

def _start_rows(d: Data, variant: str):
    cens = EP.censor_at_cutoff(d.all_c, A).select(*EP.ROW_COLS)
    surv = EP.survivor_rows(d.events_c, (F.col(S.FAILURE_YEAR) < A) & (F.col(S.INSTALL_YEAR) < A))
    rows = EP.attach_window(EP.dedup_rows(I.union_fill_missing([cens, surv]).select(*EP.ROW_COLS)), d.obs, materialized=True)
    return EP.with_start(rows, variant, INIT).select(S.ID, S.FAILED_AT, S.INSTALL_YEAR, S.START)


def _start_sql_q(variant: str) -> str:
    return sql(
        "SELECT id, failed_at, install_year, last_failure_year FROM st",
        PREP_SQL.replace(_start_sql("reg"), _start_sql(variant)),
    )


@query("last_failure", _start_sql_q("reg"))
def last_failure(spark, sf_dir):
    return _start_rows(Data(spark, sf_dir), "reg")


@query("last_failure_init", _start_sql_q("init"))
def last_failure_init(spark, sf_dir):
    return _start_rows(Data(spark, sf_dir), "init")


@query("last_failure_obs", _start_sql_q("obs"))
def last_failure_obs(spark, sf_dir):
    return _start_rows(Data(spark, sf_dir), "obs")


# ---------------------------------------------------------------- E5-E10

@query("episodes", sql(f"SELECT {EPC} FROM ep", PREP_SQL))
def episodes(spark, sf_dir):
    return prep(Data(spark, sf_dir)).select(*EP_COLS)


@query(
    "repair_sequence",
    sql(f"SELECT {EPC}, repairs FROM ep_rep", _prep_sql("init", repairs=True)),
)
def repair_sequence(spark, sf_dir):
    """INIT-variant episodes with the repair counter (row position per asset + initial value)."""
    return prep(Data(spark, sf_dir), "init", repairs=True).select(*EP_COLS, S.REPAIRS)


_JIT_SHIFTS = [s * k for k in range(1, JITTER_COPIES + 1) for s in (-1, 1)]


@query(
    "jitter_events",
    sql(
        f"""SELECT {EPC} FROM ep UNION ALL
            SELECT {', '.join(c if c not in ('failure_year', 'duration') else f'CAST({c} + s AS INTEGER) AS {c}' for c in EP_COLS)}
            FROM ep CROSS JOIN (VALUES {', '.join(f'({x})' for x in _JIT_SHIFTS)}) sh(s)
            WHERE event = 1 AND duration >= {JITTER_MIN_DURATION}""",
        PREP_SQL,
    ),
)
def jitter_events(spark, sf_dir):
    ep = prep(Data(spark, sf_dir)).select(*EP_COLS)
    return EP.jitter_events(ep, JITTER_COPIES, JITTER_MIN_DURATION)


# ---------------------------------------------------------------- E11 / W9 / E12

TC = ", ".join(EP_COLS)


@query("target_episodes", sql(f"SELECT {TC} FROM truth", TARGET_SQL))
def target_episodes(spark, sf_dir):
    return truth(Data(spark, sf_dir)).select(*EP_COLS)


@query("first_episode_row", sql(f"SELECT {TC} FROM truth1", TARGET_SQL))
def first_episode_row(spark, sf_dir):
    """Truth deduplicated on (id, last_failure_year), first row in failure order."""
    return truth_first(Data(spark, sf_dir)).select(*EP_COLS)


_LABEL_POP_SQL = f"""la AS (SELECT *, CAST(year(installed_at) AS INTEGER) AS iy, CAST(year(failed_at) AS INTEGER) AS fy
                 FROM master_all),
    lo AS (SELECT region, min(fy) AS s, max(fy) AS e FROM la WHERE region IS NOT NULL GROUP BY region),
    lt AS (SELECT la.*, CASE WHEN fy >= {A} AND fy < {A + P} THEN 1 ELSE 0 END AS lab
           FROM la LEFT JOIN lo USING (region) WHERE iy < {A} AND s < {A} AND e > {A})"""


def _label_population(d: Data):
    """Rows of assets installed before A in regions whose window spans A (uncleaned table, as the source)."""
    a = C.with_years(d.all)
    t = EP.attach_window(a, EP.obs_window(a))
    return t.filter((F.col(S.INSTALL_YEAR) < A) & (F.col(S.OBS_START) < A) & (F.col(S.OBS_END) > A))


@query("label_horizon", sql("SELECT id, max(lab) AS label FROM lt GROUP BY id", _LABEL_POP_SQL))
def label_horizon(spark, sf_dir):
    """1 when an asset fails in [A, A+P) -- any of its failures, not only the first."""
    return EP.label_horizon(_label_population(Data(spark, sf_dir)), A, P)


@query(
    "label_horizon_compat",
    sql(
        """SELECT id, lab AS label FROM (
             SELECT id, lab, row_number() OVER (PARTITION BY id ORDER BY fy ASC NULLS LAST, lab) AS rn FROM lt)
           WHERE rn = 1""",
        _LABEL_POP_SQL,
    ),
)
def label_horizon_compat(spark, sf_dir):
    """Source behaviour: the label of each asset's first failure row only (a later in-window failure is missed)."""
    t = _label_population(Data(spark, sf_dir))
    inwin = F.coalesce(((F.col(S.FAILURE_YEAR) >= A) & (F.col(S.FAILURE_YEAR) < A + P)).cast("int"), F.lit(0))
    w = Window.partitionBy(*EP.ASSET_KEY).orderBy(F.col(S.FAILURE_YEAR).asc_nulls_last(), inwin)
    first = t.withColumn("label", inwin).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    return first.select(S.ID, "label")


# ---------------------------------------------------------------- splits F9-F11

LEARN_COND_SQL = f"install_year < {A} AND obs_start < {A}"


def learning_rows(ep):
    return ep.filter((F.col(S.INSTALL_YEAR) < A) & (F.col(S.OBS_START) < A))


@query("split_learning", sql(f"SELECT {EPC} FROM ep WHERE {LEARN_COND_SQL}", PREP_SQL))
def split_learning(spark, sf_dir):
    return learning_rows(prep(Data(spark, sf_dir))).select(*EP_COLS)


TEST_COND_SQL = f"install_year < {A} AND obs_start < {A} AND obs_end > {A} AND failed_at IS NULL"


def test_rows(ep):
    return ep.filter(
        (F.col(S.INSTALL_YEAR) < A) & (F.col(S.OBS_START) < A) & (F.col(S.OBS_END) > A) & F.col(S.FAILED_AT).isNull()
    )


@query("split_test", sql(f"SELECT {EPC} FROM ep WHERE {TEST_COND_SQL}", PREP_SQL))
def split_test(spark, sf_dir):
    return test_rows(prep(Data(spark, sf_dir))).select(*EP_COLS)


@query(
    "split_holdout_region",
    sql(
        f"""SELECT id, last_failure_year, CASE WHEN region = '{HOLDOUT_REGION}' THEN 'test' ELSE 'train' END AS split
            FROM ep WHERE install_year < {A} AND obs_start < {A} AND region IS NOT NULL""",
        PREP_SQL,
    ),
)
def split_holdout_region(spark, sf_dir):
    ep = prep(Data(spark, sf_dir)).filter((F.col(S.INSTALL_YEAR) < A) & (F.col(S.OBS_START) < A))
    ep = ep.filter(F.col(S.REGION).isNotNull())
    split = F.when(F.col(S.REGION) == HOLDOUT_REGION, "test").otherwise("train")
    return ep.select(S.ID, S.START, split.alias("split"))


# ---------------------------------------------------------------- W1 / W2 / W7 / W8 / A18 / J9

@query(
    "interval_gaps",
    sql(
        """SELECT region, failure_year, n, failure_year - lag(failure_year) OVER (PARTITION BY region ORDER BY failure_year) AS gap
           FROM (SELECT region, failure_year, count(*) AS n FROM ev_c
                 WHERE region IS NOT NULL AND failure_year IS NOT NULL GROUP BY ALL)"""
    ),
)
def interval_gaps(spark, sf_dir):
    """Failure counts per region and year with the gap to the previous failure year (first gap null)."""
    c = K.count_by(Data(spark, sf_dir).events_c, [S.REGION, S.FAILURE_YEAR])
    w = Window.partitionBy(S.REGION).orderBy(S.FAILURE_YEAR)
    return c.withColumn("gap", F.col(S.FAILURE_YEAR) - F.lag(S.FAILURE_YEAR).over(w))


@query(
    "life_table",
    sql(
        """SELECT e.region, e.failure_year, e.n AS n_failures,
                  CAST(a.n_rows - coalesce(sum(e.n) OVER (PARTITION BY e.region ORDER BY e.failure_year
                                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_at_risk
           FROM (SELECT region, failure_year, count(*) AS n FROM ev_c
                 WHERE region IS NOT NULL AND failure_year IS NOT NULL GROUP BY ALL) e
           JOIN (SELECT region, count(*) AS n_rows FROM all_c WHERE region IS NOT NULL GROUP BY ALL) a USING (region)"""
    ),
)
def life_table(spark, sf_dir):
    """n at risk per region and year = rows of the region minus earlier failures."""
    d = Data(spark, sf_dir)
    e = K.count_by(d.events_c, [S.REGION, S.FAILURE_YEAR]).withColumnRenamed("n", "n_failures")
    a = K.count_by(d.all_c, [S.REGION], "n_rows")
    w = Window.partitionBy(S.REGION).orderBy(S.FAILURE_YEAR).rowsBetween(Window.unboundedPreceding, -1)
    out = e.join(a, S.REGION).withColumn(
        "n_at_risk", F.col("n_rows") - F.coalesce(F.sum("n_failures").over(w), F.lit(0))
    )
    return out.select(S.REGION, S.FAILURE_YEAR, "n_failures", "n_at_risk")


@query(
    "sorted_events",
    sql(f"SELECT id, failed_at, row_number() OVER (PARTITION BY id ORDER BY {ORDER_SQL}) AS pos FROM ev_c"),
)
def sorted_events(spark, sf_dir):
    """Failures sorted by (id, date) nulls last, as a position per asset."""
    ev = Data(spark, sf_dir).events_c
    return ev.select(S.ID, S.FAILED_AT, F.row_number().over(EP.asset_window()).cast("bigint").alias("pos"))


@query(
    "latest_failure_row",
    sql(f"""SELECT {RC} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY
                failed_at DESC NULLS FIRST, {', '.join(f'{c} DESC NULLS FIRST' for c in EP.ROW_COLS if c != 'failed_at')}) AS rn
            FROM ev_c) WHERE rn = 1"""),
)
def latest_failure_row(spark, sf_dir):
    """Last failure row of each asset (keep='last' after sorting by date)."""
    return EP.last_per_key(Data(spark, sf_dir).events_c, EP.ASSET_KEY).select(*EP.ROW_COLS)


REPAIR_COUNT_SQL = f"rc AS (SELECT id, count(*) AS n_repairs FROM ev_c WHERE failure_year < {A} GROUP BY id)"


def repair_count_df(d: Data):
    ev = d.events_c.filter(F.col(S.FAILURE_YEAR) < A)
    return ev.groupBy(S.ID).agg(F.count(F.lit(1)).alias("n_repairs"))


@query("repair_count", sql("SELECT id, n_repairs FROM rc", REPAIR_COUNT_SQL))
def repair_count(spark, sf_dir):
    return repair_count_df(Data(spark, sf_dir))


@query(
    "repair_count_join",
    sql(f"SELECT ep.id, ep.last_failure_year, coalesce(rc.n_repairs, 0) AS n_repairs FROM ep LEFT JOIN rc USING (id)",
        PREP_SQL + ",\n" + REPAIR_COUNT_SQL),
)
def repair_count_join(spark, sf_dir):
    """Episodes with the total repair count of their asset (0 when none)."""
    d = Data(spark, sf_dir)
    ep = prep(d).select(S.ID, S.START)
    return ep.join(repair_count_df(d), S.ID, "left").select(
        S.ID, S.START, F.coalesce("n_repairs", F.lit(0)).alias("n_repairs")
    )
