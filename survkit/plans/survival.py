"""L3 survival statistics: Kaplan-Meier curves and log-rank tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions.scalar import chi2_1df_pvalue_sql
from ..operators import bins as B
from ..operators import km as KM
from ..operators import logrank as LR
from ..operators.counts import tuples
from .base import MATERIAL_AGES, Data, query, sql
from .descriptive import _bin_sql, _q_edges_sql

# ---------------------------------------------------------------- SQL generators


def _dur_sql(src: str, strata: list[str], parent: list[str] | None, name: str = "dur") -> str:
    """CTEs: window stats + row-level (strata..., id, failed_at, duration, event)."""
    win = strata if parent is None else parent
    nn = " AND ".join(f"{c} IS NOT NULL" for c in strata) or "TRUE"
    base = f"{name}_b AS (SELECT * FROM {src} WHERE {nn})"
    if win:
        gw = ", ".join(win)
        st = f"{name}_st AS (SELECT {gw}, min(failure_year) AS mn, max(failure_year) AS mx FROM {name}_b GROUP BY {gw})"
        join = f"LEFT JOIN {name}_st USING ({gw})"
    else:
        st = f"{name}_st AS (SELECT min(failure_year) AS mn, max(failure_year) AS mx FROM {name}_b)"
        join = f"CROSS JOIN {name}_st"
    d = f"""{name} AS (SELECT * FROM (
        SELECT b.*, CAST(CASE WHEN b.failure_year IS NULL THEN mx - mn ELSE b.failure_year - mn END AS INTEGER) AS duration,
               CASE WHEN b.failure_year IS NULL THEN 0 ELSE 1 END AS event
        FROM {name}_b b {join}) WHERE duration IS NOT NULL)"""
    return ",\n".join([base, st, d])


def _km_sql(dur: str, strata: list[str], with_ci: bool = False) -> str:
    s = ", ".join(strata)
    part = f"PARTITION BY {s}" if strata else ""
    cnt = f"(SELECT {s + ', ' if s else ''}duration, CAST(sum(event) AS BIGINT) AS n_events, count(*) AS n_rows FROM {dur} GROUP BY ALL)"
    run = f"({part} ORDER BY duration ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    inner = f"""SELECT *, CAST(sum(n_rows) OVER ({part} ORDER BY duration DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS n_at_risk,
                n_rows - n_events AS n_censored FROM {cnt}"""
    cols = f"{s + ', ' if s else ''}duration, n_at_risk, n_events, n_censored"
    surv = f"product(1.0 - CAST(n_events AS DOUBLE) / n_at_risk) OVER {run} AS survival"
    if not with_ci:
        return f"SELECT {cols}, {surv} FROM ({inner})"
    term = "CASE WHEN n_at_risk > n_events THEN CAST(n_events AS DOUBLE) / (n_at_risk * (n_at_risk - n_events)) END"
    mid = f"""SELECT {cols}, {surv}, sum({term}) OVER {run} AS v,
              max(CASE WHEN n_at_risk <= n_events THEN 1 ELSE 0 END) OVER {run} AS bad FROM ({inner})"""
    ok = "survival > 0 AND survival < 1 AND bad = 0"
    return f"""SELECT {cols}, survival,
        CASE WHEN {ok} THEN pow(survival, exp({KM.Z_975} * sqrt(v) / ln(survival))) END AS ci_upper,
        CASE WHEN {ok} THEN pow(survival, exp(-{KM.Z_975} * sqrt(v) / ln(survival))) END AS ci_lower
        FROM ({mid})"""


def _logrank_sql(src: str, group_expr: str, part: list[str], name: str = "lr") -> str:
    """CTEs ending in ``{name}`` = (part..., member_1, member_2, chi2, p_value, p_rounded)."""
    p = ", ".join(part)
    pc = (p + ", ") if part else ""
    on = " AND ".join([f"a.{c} = b.{c}" for c in part] + ["a.g < b.g"])
    pk = [*part, "g1", "g2"]
    kk = ", ".join(pk)
    return f"""
    {name}_base AS (SELECT {pc}CAST({group_expr} AS VARCHAR) AS g, failure_year AS y FROM {src} WHERE ({group_expr}) IS NOT NULL),
    {name}_rows AS (SELECT {pc}g, count(*) AS N FROM {name}_base GROUP BY ALL),
    {name}_deaths AS (SELECT {pc}g, y, count(*) AS d FROM {name}_base WHERE y IS NOT NULL GROUP BY ALL),
    {name}_pairs AS (SELECT {''.join(f'a.{c}, ' for c in part)}a.g AS g1, b.g AS g2, a.N AS tot1, b.N AS tot2
                     FROM {name}_rows a JOIN {name}_rows b ON {on}),
    {name}_years AS (
        SELECT {''.join(f'p.{c}, ' for c in part)}p.g1, p.g2, d.y FROM {name}_pairs p JOIN {name}_deaths d ON {' AND '.join([f'd.{c} = p.{c}' for c in part] + ['d.g = p.g1'])}
        UNION
        SELECT {''.join(f'p.{c}, ' for c in part)}p.g1, p.g2, d.y FROM {name}_pairs p JOIN {name}_deaths d ON {' AND '.join([f'd.{c} = p.{c}' for c in part] + ['d.g = p.g2'])}),
    {name}_full AS (
        SELECT {''.join(f'yy.{c}, ' for c in part)}yy.g1, yy.g2, yy.y, p.tot1, p.tot2,
               coalesce(d1.d, 0) AS d1, coalesce(d2.d, 0) AS d2
        FROM {name}_years yy JOIN {name}_pairs p USING ({kk})
        LEFT JOIN {name}_deaths d1 ON {' AND '.join([f'd1.{c} = yy.{c}' for c in part] + ['d1.g = yy.g1', 'd1.y = yy.y'])}
        LEFT JOIN {name}_deaths d2 ON {' AND '.join([f'd2.{c} = yy.{c}' for c in part] + ['d2.g = yy.g2', 'd2.y = yy.y'])}),
    {name}_risk AS (
        SELECT *, CAST(tot1 - coalesce(sum(d1) OVER w, 0) AS DOUBLE) AS r1, CAST(tot2 - coalesce(sum(d2) OVER w, 0) AS DOUBLE) AS r2
        FROM {name}_full WINDOW w AS (PARTITION BY {kk} ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    {name}_terms AS (
        SELECT {kk}, d1, CAST(d1 + d2 AS DOUBLE) * r1 / (r1 + r2) AS e1,
               CASE WHEN r1 + r2 > 1 THEN CAST(d1 + d2 AS DOUBLE) * (r1 / (r1 + r2)) * (r2 / (r1 + r2))
                         * ((r1 + r2) - (d1 + d2)) / ((r1 + r2) - 1.0) ELSE 0.0 END AS v
        FROM {name}_risk),
    {name}_stat AS (
        SELECT {kk}, CAST(sum(d1) AS DOUBLE) AS o1, sum(e1) AS e1, sum(v) AS v FROM {name}_terms GROUP BY ALL),
    {name}_chi AS (SELECT {kk}, CASE WHEN v > 0 THEN (o1 - e1) * (o1 - e1) / v END AS chi2 FROM {name}_stat),
    {name} AS (
        SELECT {pc}g1 AS member_1, g2 AS member_2, chi2, {chi2_1df_pvalue_sql('chi2')} AS p_value,
               round_even({chi2_1df_pvalue_sql('chi2')}, 2) AS p_rounded
        FROM {name}_chi)"""


SIZE6_SQL = (
    _q_edges_sql("size_mm", "all_c", 6, "qe6")
    + f",\n all6 AS (SELECT all_c.*, {_bin_sql('size_mm', 'qe6.e', 6)} AS size_bin FROM all_c CROSS JOIN qe6)"
)


def _all6(d: Data):
    """all_c with size sextiles (qcut 6, as in the survival analyses)."""
    return B.qcut(d.all_c_stored, S.SIZE, 6, "size")


# ---------------------------------------------------------------- K1 / K2


@query(
    "km_durations_own",
    sql("SELECT region, id, failed_at, duration, event FROM dur", _dur_sql("all_c", ["region"], None)),
)
def km_durations_own(spark, sf_dir):
    a = Data(spark, sf_dir).all_c.filter(F.col(S.REGION).isNotNull())
    return KM.durations(a, [S.REGION]).select(S.REGION, S.ID, S.FAILED_AT, S.DURATION, S.EVENT)


@query(
    "km_durations_parent",
    sql("SELECT material, id, failed_at, duration, event FROM dur", _dur_sql("all_c", ["material"], [])),
)
def km_durations_parent(spark, sf_dir):
    a = Data(spark, sf_dir).all_c.filter(F.col(S.MATERIAL).isNotNull())
    return KM.durations(a, [S.MATERIAL], parent_cols=[]).select(S.MATERIAL, S.ID, S.FAILED_AT, S.DURATION, S.EVENT)


# ---------------------------------------------------------------- K3 / K4 / K9 / K10


@query("km_region", sql(_km_sql("dur", ["region"]), _dur_sql("all_c", ["region"], None)))
def km_region(spark, sf_dir):
    return KM.km(Data(spark, sf_dir).all_c, [S.REGION])


@query("km_material", sql(_km_sql("dur", ["material"]), _dur_sql("all_c", ["material"], [])))
def km_material(spark, sf_dir):
    """Flagship: one survival curve per material on the population clock."""
    return KM.km(Data(spark, sf_dir).all_c, [S.MATERIAL], parent_cols=[])


@query("km_material_age", sql(_km_sql("dur", ["material_age"]), _dur_sql("all_c", ["material_age"], [])))
def km_material_age(spark, sf_dir):
    return KM.km(Data(spark, sf_dir).all_c, [S.MATERIAL_AGE], parent_cols=[])


@query("km_sizebin", sql(_km_sql("dur", ["size_bin"]), SIZE6_SQL + ",\n" + _dur_sql("all6", ["size_bin"], [])))
def km_sizebin(spark, sf_dir):
    return KM.km(_all6(Data(spark, sf_dir)), ["size_bin"], parent_cols=[])


@query(
    "km_region_material",
    sql(_km_sql("dur", ["region", "material"]), _dur_sql("all_c", ["region", "material"], ["region"])),
)
def km_region_material(spark, sf_dir):
    """Material curves inside each region, on the region's clock."""
    return KM.km(Data(spark, sf_dir).all_c, [S.REGION, S.MATERIAL], parent_cols=[S.REGION])


@query(
    "km_region_material_age",
    sql(_km_sql("dur", ["region", "material_age"]), _dur_sql("all_c", ["region", "material_age"], ["region"])),
)
def km_region_material_age(spark, sf_dir):
    """Material / period curves inside each region, on the region's clock."""
    return KM.km(Data(spark, sf_dir).all_c, [S.REGION, S.MATERIAL_AGE], parent_cols=[S.REGION])


@query(
    "km_region_sizebin",
    sql(_km_sql("dur", ["region", "size_bin"]), SIZE6_SQL + ",\n" + _dur_sql("all6", ["region", "size_bin"], ["region"])),
)
def km_region_sizebin(spark, sf_dir):
    """Curves of the whole table's size sextiles inside each region, on the region's clock."""
    return KM.km(_all6(Data(spark, sf_dir)), [S.REGION, "size_bin"], parent_cols=[S.REGION])


@query("km_size_exact", sql(_km_sql("dur", ["size_mm"]), _dur_sql("all_c", ["size_mm"], [])))
def km_size_exact(spark, sf_dir):
    """One curve per exact size value on the population clock (many small strata)."""
    return KM.km(Data(spark, sf_dir).all_c, [S.SIZE], parent_cols=[])


@query("km_ci", sql(_km_sql("dur", ["region"], with_ci=True), _dur_sql("all_c", ["region"], None)))
def km_ci(spark, sf_dir):
    """KM by region with the 95 % log-log (exponential Greenwood) band."""
    return KM.km(Data(spark, sf_dir).all_c, [S.REGION], with_ci=True)


@query(
    "km_cumulative_density",
    sql(
        f"SELECT region, duration, 1.0 - survival AS cumulative_density FROM ({_km_sql('dur', ['region'])})",
        _dur_sql("all_c", ["region"], None),
    ),
)
def km_cumulative_density(spark, sf_dir):
    k = KM.km(Data(spark, sf_dir).all_c, [S.REGION])
    return k.select(S.REGION, S.DURATION, (F.lit(1.0) - F.col("survival")).alias("cumulative_density"))


@query(
    "km_since_install",
    sql(
        _km_sql("dur", ["region"]),
        """last AS (SELECT max(failure_year) AS last_year FROM all_c),
           dur AS (SELECT a.region,
                          CAST(CASE WHEN a.failure_year IS NULL THEN last_year - a.install_year
                                    ELSE a.failure_year - a.install_year END AS INTEGER) AS duration,
                          CASE WHEN a.failure_year IS NULL THEN 0 ELSE 1 END AS event
                   FROM all_c a CROSS JOIN last WHERE a.region IS NOT NULL)""",
    ),
)
def km_since_install(spark, sf_dir):
    """Years since install; survivors censored at the last observed failure year."""
    a = Data(spark, sf_dir).all_c.filter(F.col(S.REGION).isNotNull())
    last = a.agg(F.max(S.FAILURE_YEAR).alias("_last"))  # one row
    a = a.crossJoin(F.broadcast(last))
    dur = F.coalesce(F.col(S.FAILURE_YEAR), F.col("_last")) - F.col(S.INSTALL_YEAR)
    return KM.km_from_durations(a, [S.REGION], dur, F.col(S.FAILURE_YEAR).isNotNull())


# ---------------------------------------------------------------- K5 - K8, K11

_LR_MAT = _logrank_sql("all_c", "material", [])


@query("logrank_pairs", sql("SELECT * FROM lr", _LR_MAT))
def logrank_pairs(spark, sf_dir):
    return LR.pairwise(Data(spark, sf_dir).all_c, S.MATERIAL)


@query("logrank_similar", sql("SELECT member_1, member_2, p_rounded FROM lr WHERE p_rounded > 0.05", _LR_MAT))
def logrank_similar(spark, sf_dir):
    sim, _ = LR.split_similar(LR.pairwise(Data(spark, sf_dir).all_c, S.MATERIAL))
    return sim.select("member_1", "member_2", "p_rounded")


@query("logrank_disparate", sql("SELECT member_1, member_2, p_rounded FROM lr WHERE p_rounded <= 0.05", _LR_MAT))
def logrank_disparate(spark, sf_dir):
    _, dis = LR.split_similar(LR.pairwise(Data(spark, sf_dir).all_c, S.MATERIAL))
    return dis.select("member_1", "member_2", "p_rounded")


_LR_MA = _logrank_sql("all_c", "material_age", [])


_MATRIX_SQL = (
    "SELECT member_1, "
    + ", ".join(f"max(p_rounded) FILTER (WHERE member_2 = '{m}') AS \"{m}\"" for m in MATERIAL_AGES[1:])
    + " FROM lr GROUP BY member_1"
)


@query("logrank_matrix", sql(_MATRIX_SQL, _LR_MA))
def logrank_matrix(spark, sf_dir):
    """Upper-triangle p-value matrix (long form pivoted); null = not computed."""
    p = LR.pairwise(Data(spark, sf_dir).all_c, S.MATERIAL_AGE)
    return p.groupBy("member_1").pivot("member_2").agg(F.first("p_rounded"))


_ALLCOLS = [S.MATERIAL, S.MATERIAL_AGE, "size_bin", S.REGION]
_LR_ALL = (
    SIZE6_SQL
    + ",\n long6 AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, failure_year FROM all6" for c in _ALLCOLS
    )
    + "),"
    + _logrank_sql("long6", "value", ["column_name"])
)


@query("logrank_all_columns", sql("SELECT * FROM lr", _LR_ALL))
def logrank_all_columns(spark, sf_dir):
    """Pairwise tests inside every text column at once (unpivot, partition by column)."""
    a = _all6(Data(spark, sf_dir))
    long = LR.unpivot_columns(tuples(a, [*_ALLCOLS, S.FAILURE_YEAR]), _ALLCOLS, [S.FAILURE_YEAR, "n"])
    return LR.pairwise(long, "value", part=["column_name"], weight="n")


_REGION_COLS = [S.MATERIAL, S.MATERIAL_AGE, "size_bin"]
_LR_REGION = (
    SIZE6_SQL
    + ",\n longr AS ("
    + " UNION ALL ".join(
        f"SELECT region, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, failure_year FROM all6 WHERE region IS NOT NULL" for c in _REGION_COLS
    )
    + "),"
    + _logrank_sql("longr", "value", ["region", "column_name"])
)


@query("logrank_region_columns", sql("SELECT * FROM lr", _LR_REGION))
def logrank_region_columns(spark, sf_dir):
    """Pairwise tests of every text column inside each region."""
    a = _all6(Data(spark, sf_dir)).filter(F.col(S.REGION).isNotNull())
    long = LR.unpivot_columns(tuples(a, [*_REGION_COLS, S.REGION, S.FAILURE_YEAR]), _REGION_COLS, [S.REGION, S.FAILURE_YEAR, "n"])
    return LR.pairwise(long, "value", part=[S.REGION, "column_name"], weight="n")


@query("logrank_ksample")
def logrank_ksample(spark, sf_dir):
    """k-group test per text column (one system of the size of the failure years per column)."""
    return LR.ksample(_all6(Data(spark, sf_dir)), _ALLCOLS)


_KSAMPLE_TERMS = (
    SIZE6_SQL
    + ",\n long6 AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, failure_year AS y FROM all6 WHERE {c} IS NOT NULL" for c in _ALLCOLS
    )
    + """),
    ks_size AS (SELECT column_name, value, count(*) AS size FROM long6 GROUP BY ALL),
    ks_d AS (SELECT column_name, value, y, count(*) AS d FROM long6 WHERE y IS NOT NULL GROUP BY ALL),
    ks_y AS (SELECT DISTINCT column_name, y FROM ks_d),
    ks_grid AS (
      SELECT s.column_name, s.value, s.size, t.y, coalesce(d, 0) AS d,
             s.size - coalesce(sum(coalesce(d, 0)) OVER (PARTITION BY s.column_name, s.value ORDER BY t.y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r
      FROM ks_size s JOIN ks_y t ON t.column_name = s.column_name
      LEFT JOIN ks_d k ON k.column_name = s.column_name AND k.value = s.value AND k.y = t.y),
    ks_tot AS (SELECT column_name, y, CAST(sum(r) AS DOUBLE) AS total, CAST(sum(d) AS DOUBLE) AS dt FROM ks_grid GROUP BY ALL)"""
)


@query(
    "logrank_ksample_terms",
    sql(
        """SELECT g.column_name, g.value AS group_name, g.size, sum(g.d - t.dt * (g.r / t.total)) AS excess,
                  sum(CASE WHEN t.total > 1 THEN t.dt * (t.total - t.dt) / (t.total - 1) ELSE 0 END * (g.r / t.total) * (1 - g.r / t.total)) AS variance
           FROM ks_grid g JOIN ks_tot t ON t.column_name = g.column_name AND t.y = g.y WHERE t.total > 0 GROUP BY ALL""",
        _KSAMPLE_TERMS,
    ),
)
def logrank_ksample_terms(spark, sf_dir):
    """Observed minus expected failures and their variance, per column and group of the k-group test."""
    return LR.ksample_terms(_all6(Data(spark, sf_dir)), _ALLCOLS)
