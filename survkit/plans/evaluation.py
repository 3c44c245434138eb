"""L4 evaluation queries on a deterministic baseline score.

The scored table is the reference's test population (censored episodes of
assets in an active window) joined to the truth episodes on
(id, last_failure_year).  Its score is a transparent SQL baseline -- episode
age plus a size tie-breaker -- so every metric has a full DuckDB oracle; the
learned models (plans/models.py) produce the same (id, proba) shape.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..operators import evaluate as EV
from ..session import ensure_checkpoint_dir, store
from .base import Data, query, sql
from .episodes import A, LEARN_COND_SQL, PREP_SQL, TARGET_BODY, TEST_COND_SQL, learning_rows, prep, test_rows, truth_first

SIZE_WEIGHT = 1e-6
GRID_PROBS = [(5.0 + 76.0 * i / 9) / 100.0 for i in range(10)]


def baseline_score(df):
    return (F.lit(A) - F.col(S.START)).cast("double") + F.col(S.SIZE) * F.lit(SIZE_WEIGHT)


def scored(d: Data):
    """(id, region, last_failure_year, proba, event, duration) of the test population."""
    d.once()
    t = test_rows(prep(d)).select(S.ID, S.REGION, S.START, S.SIZE)
    t = t.withColumn("proba", baseline_score(t)).drop(S.SIZE)
    tr = truth_first(d).select(S.ID, S.START, S.EVENT, S.DURATION)
    # the scored table feeds several metrics: write it once to the shared folder
    ensure_checkpoint_dir(d.spark)
    return store(t.join(tr, [S.ID, S.START], "inner"), "scored")


SCORED_SQL = (
    PREP_SQL + ",\n" + TARGET_BODY + f""",
    scored AS (SELECT t.id, t.region, t.last_failure_year,
                      CAST({A} - t.last_failure_year AS DOUBLE) + t.size_mm * {SIZE_WEIGHT!r} AS proba,
                      tr.event, tr.duration
               FROM (SELECT * FROM ep WHERE {TEST_COND_SQL}) t
               JOIN truth1 tr ON t.id = tr.id AND t.last_failure_year = tr.last_failure_year),
    sc AS (SELECT proba, count(*) AS n, CAST(sum(event) AS BIGINT) AS pos, count(*) - CAST(sum(event) AS BIGINT) AS neg
           FROM scored GROUP BY proba),
    tot AS (SELECT sum(pos) AS tot_pos, sum(neg) AS tot_neg FROM sc),
    tg AS (SELECT DISTINCT unnest(quantile_cont(duration, [{', '.join(repr(p) for p in GRID_PROBS)}])) AS t FROM scored)"""
)


def _mw_sql(src: str, group: str | None) -> str:
    """Mann-Whitney AUC over (group?, score, pos, neg) rows of ``src``."""
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return f"""SELECT {g}CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                     THEN sum(pos * (below + 0.5 * neg)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) END AS auc
        FROM (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                     AS below FROM {src})
        {'GROUP BY ' + group if group else ''}"""


@query(
    "pred_truth_join",
    sql("SELECT id, region, last_failure_year, proba, event, duration FROM scored", SCORED_SQL),
)
def pred_truth_join(spark, sf_dir):
    return scored(Data(spark, sf_dir))


@query(
    "risk_rank",
    sql(
        """SELECT id, last_failure_year, proba,
                  rank() OVER (ORDER BY proba DESC) + (count(*) OVER (PARTITION BY proba) - 1) / 2.0 AS avg_rank
           FROM scored""",
        SCORED_SQL,
    ),
)
def risk_rank(spark, sf_dir):
    """Descending rank with ties averaged, per row (from per-score running counts)."""
    s = scored(Data(spark, sf_dir))
    curve = EV.lift_curve(s).select("proba", "avg_rank")
    return s.join(curve, "proba").select(S.ID, S.START, "proba", "avg_rank")


_LIFT_SQL = """lc AS (SELECT proba, row_number() OVER w AS position, n, pos AS n_events,
                     (sum(n) OVER w - n) + (n + 1) / 2.0 AS avg_rank, sum(pos) OVER w AS cum_pos
              FROM sc WINDOW w AS (ORDER BY proba DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    lift AS (SELECT proba, position, n, n_events, avg_rank, avg_rank / max(avg_rank) OVER () AS x,
                    CASE WHEN tot.tot_pos > 0 THEN CAST(cum_pos AS DOUBLE) / tot.tot_pos END AS y FROM lc CROSS JOIN tot)"""


@query("lift_curve", sql("SELECT * FROM lift", SCORED_SQL + ",\n" + _LIFT_SQL))
def lift_curve(spark, sf_dir):
    return EV.lift_curve(scored(Data(spark, sf_dir)))


@query(
    "lift_auc",
    sql(
        """SELECT coalesce(sum((a.x - b.x) * (a.y + b.y) / 2.0), 0.0) AS area,
                  round(coalesce(sum((a.x - b.x) * (a.y + b.y) / 2.0), 0.0), 2) AS area_rounded
           FROM lift a JOIN lift b ON a.position = b.position + 1""",
        SCORED_SQL + ",\n" + _LIFT_SQL,
    )
)
def lift_auc(spark, sf_dir):
    """Area under the lift curve (trapezoids between points, no origin), as in the source report."""
    return EV.lift_area(EV.lift_curve(scored(Data(spark, sf_dir))))


@query(
    "roc_curve",
    sql(
        """SELECT proba AS threshold, CAST(sum(neg) OVER w AS DOUBLE) / tot.tot_neg AS fpr,
                  CAST(sum(pos) OVER w AS DOUBLE) / tot.tot_pos AS tpr
           FROM sc CROSS JOIN tot WINDOW w AS (ORDER BY proba DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
           UNION ALL SELECT NULL, 0.0, 0.0""",
        SCORED_SQL,
    ),
)
def roc_curve(spark, sf_dir):
    return EV.roc_curve(scored(Data(spark, sf_dir)))


@query("roc_auc", sql(_mw_sql("(SELECT proba AS score, pos, neg FROM sc)", None), SCORED_SQL))
def roc_auc(spark, sf_dir):
    return EV.auc(scored(Data(spark, sf_dir)))


@query("time_grid", sql("SELECT t FROM tg", SCORED_SQL))
def time_grid(spark, sf_dir):
    """Distinct duration percentiles at linspace(5, 81, 10) %."""
    return EV.time_grid(scored(Data(spark, sf_dir)))


_DYN_SQL = """dyn_in AS (SELECT tg.t, s.proba AS score,
                       CAST(sum(CASE WHEN s.event = 1 AND s.duration <= tg.t THEN 1 ELSE 0 END) AS BIGINT) AS pos,
                       CAST(sum(CASE WHEN s.event = 1 AND s.duration <= tg.t THEN 0 ELSE 1 END) AS BIGINT) AS neg
                FROM scored s CROSS JOIN tg GROUP BY ALL),
    dyn AS (""" + _mw_sql("dyn_in", "t") + ")"


@query("dynamic_auc", sql("SELECT t, auc FROM dyn", SCORED_SQL + ",\n" + _DYN_SQL))
def dynamic_auc(spark, sf_dir):
    """AUC per grid time: positives = failed within t, all others negative."""
    s = scored(Data(spark, sf_dir))
    return EV.dynamic_auc(s, EV.time_grid(s))


def _curve_sql(src: str, group: str) -> str:
    """ROC points of (group, score, pos, neg) rows of ``src``, and each group's origin."""
    w = f"PARTITION BY {group} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""SELECT {group}, CAST(score AS DOUBLE) AS threshold, CASE WHEN n_neg > 0 THEN CAST(c_neg AS DOUBLE) / n_neg END AS fpr,
                      CASE WHEN n_pos > 0 THEN CAST(c_pos AS DOUBLE) / n_pos END AS tpr
               FROM (SELECT *, sum(neg) OVER ({w}) AS c_neg, sum(pos) OVER ({w}) AS c_pos,
                            sum(neg) OVER (PARTITION BY {group}) AS n_neg, sum(pos) OVER (PARTITION BY {group}) AS n_pos FROM {src})
               UNION ALL SELECT DISTINCT {group}, CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM {src}"""


@query("roc_curve_by_time", sql(_curve_sql("dyn_in", "t"), SCORED_SQL + ",\n" + _DYN_SQL))
def roc_curve_by_time(spark, sf_dir):
    """ROC curve per grid time."""
    s = scored(Data(spark, sf_dir))
    return EV.roc_curve_by_time(s, EV.time_grid(s))


@query(
    "dynamic_auc_mean",
    sql(
        f"""SELECT g.auc AS auc_global, m.auc_mean FROM ({_mw_sql("(SELECT proba AS score, pos, neg FROM sc)", None)}) g
            CROSS JOIN (SELECT avg(auc) AS auc_mean FROM dyn) m""",
        SCORED_SQL + ",\n" + _DYN_SQL,
    )
)
def dynamic_auc_mean(spark, sf_dir):
    """(global AUC, mean of the per-time AUCs) as returned by the source routine."""
    s = scored(Data(spark, sf_dir))
    g = EV.auc(s).select(F.col("auc").alias("auc_global"))
    m = EV.dynamic_auc(s, EV.time_grid(s)).agg(F.avg("auc").alias("auc_mean"))
    return g.crossJoin(m)


@query(
    "dynamic_auc_ipcw",
    sql(
        "SELECT t, auc FROM ipcw",
        SCORED_SQL
        + f""",
    tr_cnt AS (SELECT duration, CAST(sum(event) AS BIGINT) AS d, count(*) AS n FROM ep WHERE {LEARN_COND_SQL} GROUP BY duration),
    tr_left AS (SELECT a.duration, a.n - a.d AS c, sum(b.n) - a.d AS left_over
                FROM tr_cnt a JOIN tr_cnt b ON b.duration >= a.duration GROUP BY a.duration, a.n, a.d),
    ip_cens AS (SELECT a.duration, product(CASE WHEN b.left_over > 0 THEN 1.0 - CAST(b.c AS DOUBLE) / b.left_over ELSE 1.0 END) AS g
             FROM tr_left a JOIN tr_left b ON b.duration <= a.duration GROUP BY a.duration),
    ip_in AS (SELECT tg.t, s.proba AS score,
                     sum(CASE WHEN s.event = 1 AND s.duration <= tg.t AND s.g > 0 THEN 1.0 / s.g ELSE 0.0 END) AS pos,
                     sum(CASE WHEN s.duration > tg.t THEN 1.0 ELSE 0.0 END) AS neg
              FROM (SELECT sc0.*, coalesce(k.g, 1.0) AS g FROM scored sc0 ASOF LEFT JOIN ip_cens k ON sc0.duration >= k.duration) s
              CROSS JOIN tg GROUP BY ALL),
    ipcw AS ("""
        + _mw_sql("ip_in", "t")
        + ")",
    )
)
def dynamic_auc_ipcw(spark, sf_dir):
    """Cumulative/dynamic AUC, weights of the learning episodes' censoring (defined but never called in the source)."""
    d = Data(spark, sf_dir)
    s = scored(d)
    return EV.dynamic_auc_ipcw(s, EV.time_grid(s), learning_rows(prep(d)).select(S.EVENT, S.DURATION))


@query(
    "c_index",
    sql(
        """SELECT (sum(conc) + 0.5 * sum(tied)) / sum(ncase * nctrl) AS c_index,
                  CAST(sum(conc) AS BIGINT) AS concordant, CAST(sum(tied) AS BIGINT) AS tied_risk,
                  CAST(sum(ncase * nctrl) AS BIGINT) AS comparable
           FROM (SELECT T, sum(cases * below) AS conc, sum(cases * ctrl) AS tied, sum(cases) AS ncase, sum(ctrl) AS nctrl
                 FROM (SELECT *, coalesce(sum(ctrl) OVER (PARTITION BY T ORDER BY proba
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
                       FROM (SELECT coalesce(c.T, k.T) AS T, coalesce(c.proba, k.proba) AS proba,
                                    coalesce(c.ctrl, 0) AS ctrl, coalesce(k.cases, 0) AS cases
                             FROM ci_ctrl c FULL OUTER JOIN ci_cases k ON c.T = k.T AND c.proba = k.proba))
                 GROUP BY T)""",
        SCORED_SQL
        + """,
    ci_b AS (SELECT proba, event, duration, count(*) AS w FROM scored GROUP BY ALL),
    ci_t AS (SELECT DISTINCT duration AS T FROM ci_b WHERE event = 1),
    ci_ctrl AS (SELECT T, proba, sum(w) AS ctrl FROM ci_b JOIN ci_t
                ON ci_b.duration > ci_t.T OR (ci_b.duration = ci_t.T AND ci_b.event = 0) GROUP BY ALL),
    ci_cases AS (SELECT duration AS T, proba, sum(w) AS cases FROM ci_b WHERE event = 1 GROUP BY ALL)""",
    )
)
def c_index(spark, sf_dir):
    """Harrell's concordance from per-(time, score) counts (commented out in the source)."""
    return EV.concordance(scored(Data(spark, sf_dir)))


@query(
    "run_summary",
    sql(
        """SELECT (SELECT count(DISTINCT region) FROM truth1) AS n_regions, count(*) AS n_assets,
                  CAST(sum(event) AS BIGINT) AS n_failures FROM scored""",
        SCORED_SQL,
    ),
)
def run_summary(spark, sf_dir):
    """Report numbers: regions of the truth table, scored assets, failures among them."""
    d = Data(spark, sf_dir)
    s = scored(d).agg(F.count(F.lit(1)).alias("n_assets"), F.sum(F.col(S.EVENT).cast("long")).alias("n_failures"))
    r = truth_first(d).agg(F.countDistinct(S.REGION).alias("n_regions"))
    return r.crossJoin(s)


# ---------------------------------------------------------------- V6 multi-class demo

# Most classes whose centroids (a few kB each) are broadcast.
MAX_BROADCAST_CLASSES = 10_000


_CLASS_SQL = """WITH ex AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x
                FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
        cent AS (SELECT cls, list(m ORDER BY i) AS v FROM (SELECT label AS cls, i, avg(x) AS m FROM ex GROUP BY ALL) GROUP BY cls),
        mrows AS (SELECT e.label, c.cls, list_dot_product(CAST(e.embedding AS DOUBLE[]), c.v) AS score
                  FROM embeddings e CROSS JOIN cent c WHERE e.label IS NOT NULL AND e.embedding IS NOT NULL),
        mc AS (SELECT cls, score, CAST(sum(CASE WHEN label = cls THEN 1 ELSE 0 END) AS BIGINT) AS pos,
                      CAST(sum(CASE WHEN label = cls THEN 0 ELSE 1 END) AS BIGINT) AS neg FROM mrows GROUP BY ALL),
        mc_micro AS (SELECT score, CAST(sum(pos) AS BIGINT) AS pos, CAST(sum(neg) AS BIGINT) AS neg FROM mc GROUP BY ALL)
"""


@query(
    "roc_micro",
    f"""{_CLASS_SQL} SELECT CAST(cls AS VARCHAR) AS class_name, auc FROM ({_mw_sql('mc', 'cls')})
        UNION ALL SELECT 'micro', auc FROM ({_mw_sql('mc_micro', None)})""",
)
def roc_micro(spark, sf_dir):
    """Per-class and micro-averaged ROC AUC of a one-vs-rest score: product of the whole vector with the class centroid.

    The classes are the labels that occur; one score per row and class is the input of a one-vs-rest curve.
    """
    rows = _class_rows(spark, sf_dir)
    per = EV.auc(rows, group_cols=["cls"]).select(F.col("cls").cast("string").alias("class_name"), "auc")
    micro = EV.auc(rows).select(F.lit("micro").alias("class_name"), "auc")
    return per.unionByName(micro)


@query(
    "roc_curve_by_class",
    f"""{_CLASS_SQL}, named AS (SELECT CAST(cls AS VARCHAR) AS class_name, score, pos, neg FROM mc
                               UNION ALL SELECT 'micro', score, pos, neg FROM mc_micro)
        {_curve_sql('named', 'class_name')}""",
)
def roc_curve_by_class(spark, sf_dir):
    """One-vs-rest ROC curve per class and the micro-averaged one, by the scores of ``roc_micro``."""
    rows = _class_rows(spark, sf_dir)
    per = EV.roc_curve(rows, group_cols=["cls"]).withColumn("class_name", F.col("cls").cast("string")).drop("cls")
    return per.unionByName(EV.roc_curve(rows).withColumn("class_name", F.lit("micro")))


def _class_rows(spark, sf_dir):
    """(cls, proba, event): each row's score for each class."""
    emb = Data(spark, sf_dir).table("embeddings").select("label", F.col("embedding").cast("array<double>").alias("x")).dropna()
    means = emb.select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"))
    cent = means.groupBy(F.col("label").alias("cls")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("c"))
    cent = store(cent, "centroids")
    if cent.count() <= MAX_BROADCAST_CLASSES:
        cent = F.broadcast(cent)
    product = F.aggregate(F.zip_with("x", "c", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return emb.crossJoin(cent).select("cls", product.alias("proba"), (F.col("label") == F.col("cls")).cast("int").alias("event"))
