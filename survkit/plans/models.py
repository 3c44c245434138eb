"""L4 feature and model queries.

Feature queries with a SQL meaning have DuckDB oracles; model queries are
rows-only: the survival learners (``survkit/learners``) are tested against
brute force, the others are Spark ML re-aims of the source's estimators.
"""

from __future__ import annotations

from pyspark.ml.classification import OneVsRest
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import evaluate as EV
from ..operators import features as FE
from ..operators import models as M
from ..learners import aft, coxboost, forest, nystrom, ranksvm, svc, table
from ..operators.episodes import jitter_events
from ..session import ensure_checkpoint_dir, store
from .base import MATERIAL_AGES, REGIONS, Data, query, sql
from .episodes import A, HOLDOUT_REGION, JITTER_COPIES, JITTER_MIN_DURATION, LEARN_COND_SQL, P, PREP_SQL, TEST_COND_SQL
from .episodes import learning_rows, prep, test_rows, truth_first

KEYS = [S.ID, S.START]
STD_COLS = [S.SIZE, S.INSTALL_YEAR]

# Model sizes (the source's forest has 500 trees, its boosting 100 stumps).
FOREST_TREES = 500
# Rows on which the error of the kernel features is measured.
ERROR_ROWS = 500
INTERVAL = 2
SVC_C = [0.1, 1.0, 10.0, 30.0]
# Weight of the pairs' mean loss in the ranking objective.
RANK_ALPHA = 100.0


# Columns of the prepared table that splits, features and learners use.
MODEL_COLS = [*KEYS, S.EVENT, S.DURATION, S.REGION, S.MATERIAL_AGE, S.SIZE, S.INSTALL_YEAR, S.OBS_START, S.OBS_END, S.FAILED_AT]


def _prepared(d: Data):
    """The prepared table, standardised and written once: fits and scores read it instead of deriving the master again."""
    ep = FE.standardize(prep(d.once()), STD_COLS)  # fitted on the whole prepared table, as in the source
    return store(ep.select(*MODEL_COLS, *[f"{c}_std" for c in STD_COLS]), "prepared")


def _learn_test(d: Data):
    ep = _prepared(d)
    return learning_rows(ep), test_rows(ep)


def _with_truth(d: Data, scores):
    tr = truth_first(d).select(S.ID, S.START, S.EVENT, S.DURATION)
    return scores.join(tr, KEYS, "inner")


# ---------------------------------------------------------------- X1 - X4, F15

@query(
    "feat_standardize",
    sql(
        """SELECT id, last_failure_year,
                  (size_mm - avg(size_mm) OVER ()) / stddev_pop(size_mm) OVER () AS size_mm_std,
                  (install_year - avg(install_year) OVER ()) / stddev_pop(install_year) OVER () AS install_year_std
           FROM ep""",
        PREP_SQL,
    )
)
def feat_standardize(spark, sf_dir):
    """(x - mean) / population std over the whole prepared table (one-row stats, broadcast)."""
    ep = FE.standardize(prep(Data(spark, sf_dir)), STD_COLS)
    return ep.select(S.ID, S.START, "size_mm_std", "install_year_std")


@query(
    "feat_shift_horizon",
    sql(
        f"""SELECT id, last_failure_year,
                   (duration - m) / s AS duration_std, (duration + {P} - m) / s AS duration_shift_std
            FROM (SELECT * FROM ep WHERE {TEST_COND_SQL}) t
            CROSS JOIN (SELECT avg(duration) AS m, stddev_pop(duration) AS s FROM ep) st""",
        PREP_SQL,
    )
)
def feat_shift_horizon(spark, sf_dir):
    """Scaler fitted on durations, re-applied to test durations shifted by the horizon."""
    ep = prep(Data(spark, sf_dir))
    stats = FE.scaler_stats(ep, [S.DURATION])
    t = test_rows(ep)
    t = FE.apply_scaler(t, stats, [S.DURATION], out={S.DURATION: "duration_std"})
    t = FE.apply_scaler(t, stats, [S.DURATION], out={S.DURATION: "duration_shift_std"}, shift={S.DURATION: P})
    return t.select(S.ID, S.START, "duration_std", "duration_shift_std")


# Episodes exist only of assets installed before the cutoff.
EPISODE_AGES = [v for v in MATERIAL_AGES if int(v[-4:]) < A]


def _levels_sql(col: str, values: list[str]) -> str:
    """Indicator columns of the listed values, as SQL."""
    return ", ".join(f"CAST(coalesce({col} = '{v}', FALSE) AS BIGINT) AS \"{v}\"" for v in values)


@query(
    "feat_onehot",
    sql(
        "SELECT id, last_failure_year, " + _levels_sql("region", REGIONS) + ", " + _levels_sql("material_age", EPISODE_AGES) + " FROM ep",
        PREP_SQL,
    ),
)
def feat_onehot(spark, sf_dir):
    """Indicator column per region and per material/period value (all levels kept)."""
    ep = prep(Data(spark, sf_dir))
    out, names = FE.onehot_columns(ep, [S.REGION, S.MATERIAL_AGE])
    return out.select(S.ID, S.START, *names)


@query("feat_assembled")
def feat_assembled(spark, sf_dir):
    """Feature vectors: start year, standardised size and install year, one-hot region and material/period."""
    learn, _ = _learn_test(Data(spark, sf_dir))
    from pyspark.ml import Pipeline

    model = Pipeline(stages=FE.vector_pipeline_stages(FE.HAZARD_NUMERIC, FE.HAZARD_CATEGORICAL)).fit(learn)
    return model.transform(learn).select(*KEYS, S.EVENT, S.DURATION, "features")


@query(
    "feat_prune",
    sql(
        f"""SELECT id, last_failure_year, {_levels_sql("region", REGIONS)}, {_levels_sql("material_age", EPISODE_AGES)},
                   (size_mm - sm) / ss AS size_mm_std, (install_year - im) / iy AS install_year_std
            FROM (SELECT * FROM ep WHERE {LEARN_COND_SQL}) t
            CROSS JOIN (SELECT avg(size_mm) AS sm, stddev_pop(size_mm) AS ss, avg(install_year) AS im, stddev_pop(install_year) AS iy FROM ep) st""",
        PREP_SQL,
    ),
)
def feat_prune(spark, sf_dir):
    """Learning table without the columns that are zero in all its rows; levels are those of the whole prepared table."""
    d = Data(spark, sf_dir)
    learn, _ = _learn_test(d)
    cats = [S.REGION, S.MATERIAL_AGE]
    wide, names = FE.onehot_columns(learn, cats, FE.category_values(prep(d), cats))
    cand = names + ["size_mm_std", "install_year_std", S.START]
    keep = FE.nonzero_columns(wide, cand)
    return wide.select(*KEYS, *[c for c in keep if c not in KEYS])


# ---------------------------------------------------------------- M1 / M2 / M3 / M8 / M9

def _scores(d: Data, learn, test, estimator, numeric=None):
    """Failure probability over the horizon of each test episode, with its truth."""
    model = M.fit_hazard(learn, estimator, numeric)
    return _with_truth(d, M.horizon_scores(model, test, P, KEYS))


def _curves(spark, sf_dir, ahead: int = P, chosen=None):
    """Curves of the test episodes, or of those whose keys ``chosen`` picks from them."""
    learn, test = _learn_test(Data(spark, sf_dir))
    model = M.fit_hazard(learn, M.boosting())
    return M.survival_curves(model, test if chosen is None else test.join(F.broadcast(chosen(test)), KEYS), ahead, KEYS)


@query("model_hazard_forest")
def model_hazard_forest(spark, sf_dir):
    """Discrete-time hazard forest; proba = failure probability over the horizon; joined to truth."""
    d = Data(spark, sf_dir)
    return _scores(d, *_learn_test(d), M.forest(FOREST_TREES))


@query("model_hazard_gbt")
def model_hazard_gbt(spark, sf_dir):
    """Boosted stumps on person-years (100 rounds, step 0.5, depth 1, subsample 0.5)."""
    d = Data(spark, sf_dir)
    return _scores(d, *_learn_test(d), M.boosting())


def _learn_test_repairs(d: Data):
    """Episodes of the initial-window variant with the repair count so far, written once like the others."""
    ep = FE.standardize(prep(d.once(), "init", repairs=True), STD_COLS)
    ep = store(ep.select(*MODEL_COLS, S.REPAIRS, *[f"{c}_std" for c in STD_COLS]), "prepared")
    return learning_rows(ep), test_rows(ep)


@query("model_forest_repairs")
def model_forest_repairs(spark, sf_dir):
    """Hazard forest with the repair count as a feature."""
    d = Data(spark, sf_dir)
    return _scores(d, *_learn_test_repairs(d), M.forest(FOREST_TREES), [*FE.HAZARD_NUMERIC, S.REPAIRS])


@query("model_gbt_repairs")
def model_gbt_repairs(spark, sf_dir):
    """Boosted stumps with the repair count as a feature."""
    d = Data(spark, sf_dir)
    return _scores(d, *_learn_test_repairs(d), M.boosting(), [*FE.HAZARD_NUMERIC, S.REPAIRS])


@query("model_holdout_region")
def model_holdout_region(spark, sf_dir):
    """Hazard forest learnt from all regions but one and scored on that one."""
    d = Data(spark, sf_dir)
    learn, test = _learn_test(d)
    return _scores(d, learn.filter(F.col(S.REGION) != HOLDOUT_REGION), test.filter(F.col(S.REGION) == HOLDOUT_REGION), M.forest(FOREST_TREES))


@query("model_hazard_gbt_earlystop")
def model_hazard_gbt_earlystop(spark, sf_dir):
    """Up to 1000 rounds at step 0.05 with validation-based early stopping (hash-split validation rows)."""
    d = Data(spark, sf_dir)
    learn, test = _learn_test(d)
    learn = learn.withColumn("is_val", (F.abs(F.hash(S.ID)) % 5) == 0)
    est = M.boosting(max_iter=1000, step=0.05, depth=1, subsample=0.5, validation_col="is_val", tol=0.001)
    return _scores(d, learn, test, est)


# ---------------------------------------------------------------- survival learners M1 M2 M3 M8

def _encoded(d: Data):
    """Encoder, encoded learning rows and test rows of the survival learners."""
    learn, test = _learn_test(d)
    enc = table.Encoder(FE.HAZARD_NUMERIC, FE.HAZARD_CATEGORICAL).fit(learn)
    return enc, table.encode(learn, enc, KEYS), learn, test


def _long_run(d: Data):
    """Small steps until the mean out-of-bag improvement has stayed away for long enough."""
    enc, rows, learn, test = _encoded(d)
    model = coxboost.fit(rows, enc, coxboost.LONG_ROUNDS, coxboost.LONG_STEP, stop=coxboost.stop_after)
    return model, learn, test


@query("model_cox_boosting")
def model_cox_boosting(spark, sf_dir):
    """Stumps boosted on the partial likelihood (100 rounds, step 0.5, half of the rows each); proba = risk score."""
    d = Data(spark, sf_dir)
    enc, rows, _, test = _encoded(d)
    model = coxboost.fit(rows, enc)
    return _with_truth(d, test.select(*KEYS, model.score().alias("proba")))


@query("model_cox_boosting_stop")
def model_cox_boosting_stop(spark, sf_dir):
    """Up to 1000 rounds at step 0.05, ended by the out-of-bag rule (mean of 25 rounds, patience 50)."""
    d = Data(spark, sf_dir)
    model, _, test = _long_run(d)
    return _with_truth(d, test.select(*KEYS, model.score().alias("proba")))


@query("cox_stop_trace")
def cox_stop_trace(spark, sf_dir):
    """The long run's rounds: out-of-bag improvement, mean of the last 25, whether the fit ends there."""
    model, _, _ = _long_run(Data(spark, sf_dir))
    x, w = model.improvements, coxboost.WINDOW
    mean = [sum(x[k - w + 1 : k + 1]) / w if k >= w else None for k in range(len(x))]
    rows = [(k + 1, x[k], mean[k], coxboost.stop_after(x[: k + 1]) is not None) for k in range(len(x))]
    return spark.createDataFrame(rows, "round int, improvement double, mean_improvement double, stops boolean")


@query("cox_curves")
def cox_curves(spark, sf_dir):
    """Survival curves of the boosted score on its own Breslow baseline, at each failure year of the learning rows."""
    enc, rows, learn, test = _encoded(Data(spark, sf_dir))
    score = coxboost.fit(rows, enc).score()
    base = coxboost.breslow(learn.withColumn("score", score), "score", S.DURATION, S.EVENT)
    return coxboost.curves(test.withColumn("score", score), "score", base, KEYS)


# A transparent risk score on which baseline and curves have an oracle.
PLAIN_SCORE = 0.5
PLAIN_SQL = f"""{PREP_SQL},
std AS (SELECT *, {PLAIN_SCORE} * (size_mm - avg(size_mm) OVER ()) / stddev_pop(size_mm) OVER () AS score FROM ep),
per AS (SELECT duration AS year, sum(exp(score)) AS w, count(*) FILTER (event = 1) AS d FROM std WHERE {LEARN_COND_SQL} AND duration IS NOT NULL GROUP BY 1),
risk AS (SELECT year, d, sum(w) OVER (ORDER BY year DESC) AS r FROM per),
base AS (SELECT CAST(year AS INTEGER) AS year, sum(d / r) OVER (ORDER BY year) AS hazard, d FROM risk)"""


def _plain(d: Data):
    ep = _prepared(d).withColumn("score", F.lit(PLAIN_SCORE) * F.col("size_mm_std"))
    return coxboost.breslow(learning_rows(ep), "score", S.DURATION, S.EVENT), test_rows(ep)


@query("breslow_baseline", sql("SELECT year, hazard FROM base WHERE d > 0", PLAIN_SQL))
def breslow_baseline(spark, sf_dir):
    """Cumulative baseline hazard of a given risk score: a step at each failure year."""
    return _plain(Data(spark, sf_dir))[0]


@query(
    "breslow_curves",
    sql(f"SELECT s.id, s.last_failure_year, b.year, exp(-b.hazard * exp(s.score)) AS survival FROM (SELECT * FROM std WHERE {TEST_COND_SQL}) s, base b WHERE b.d > 0", PLAIN_SQL),
)
def breslow_curves(spark, sf_dir):
    """Survival curves of a given risk score: baseline hazard times exp(score), at each failure year."""
    base, test = _plain(Data(spark, sf_dir))
    return coxboost.curves(test, "score", base, KEYS)


def _forest(d: Data):
    enc, rows, _, test = _encoded(d)
    return forest.fit(rows, enc).hazards(test, KEYS)


@query("model_survival_forest")
def model_survival_forest(spark, sf_dir):
    """Survival forest (500 log-rank trees, 15 rows a leaf, square root of the columns a node); proba = ensemble mortality."""
    d = Data(spark, sf_dir)
    return _with_truth(d, forest.mortality(_forest(d), KEYS))


@query("forest_curves")
def forest_curves(spark, sf_dir):
    """Survival curves from the leaves' Nelson-Aalen hazards, averaged over the trees."""
    return forest.curves(_forest(Data(spark, sf_dir)), KEYS)


@query("survival_curves")
def survival_curves(spark, sf_dir):
    """Per test episode: hazard and S(k) for k = 0 .. duration + horizon (boosted hazard model)."""
    return _curves(spark, sf_dir)


@query("score_interval")
def score_interval(spark, sf_dir):
    """Sum of S over [duration - 1, duration + 1] per test episode; the curves reach the interval's end."""
    return M.interval_score(_curves(spark, sf_dir, max(P, -(-INTERVAL // 2))), INTERVAL, KEYS)


@query("sample_curves")
def sample_curves(spark, sf_dir):
    """k survival curves picked at random (seeded): the episodes with the smallest hash keys."""

    def chosen(test):
        pick = test.select(*KEYS).distinct().withColumn("_h", F.xxhash64(*KEYS, F.lit(0)))
        return pick.orderBy("_h").limit(5).drop("_h")  # the feature: a top-k sample, taken before any curve is made

    return _curves(spark, sf_dir, chosen=chosen)


# ---------------------------------------------------------------- kernel models M4 - M6

# Columns that the kernel models' frames use.
KERNEL_COLS = [*MODEL_COLS, S.FAILURE_YEAR]


def _kernel_frames(d: Data, shift_duration: bool, jitter: bool = False):
    """Learning / test tables with assembled features, and the rbf kernels by name; ``jitter`` adds the shifted copies of long events.

    Only the kernels' inputs are stored: their features, many times as wide, are made in the scan that uses them.
    """
    ep = store(prep(d.once()).select(*KERNEL_COLS), "prepared")
    if jitter:
        ep = jitter_events(ep, JITTER_COPIES, JITTER_MIN_DURATION).filter(F.col(S.DURATION) >= 0)
    stats = store(FE.scaler_stats(ep, [S.SIZE, S.DURATION]), "scaler")
    ep = FE.apply_scaler(ep, stats, [S.SIZE, S.DURATION])
    learn = ep.filter((F.col(S.INSTALL_YEAR) < A) & (F.col(S.OBS_START) < A))
    test = test_rows(ep)
    if shift_duration:
        test = FE.apply_scaler(test.drop("duration_std"), stats, [S.DURATION], out={S.DURATION: "duration_std"},
                               shift={S.DURATION: P})
    numeric = [S.START, "size_mm_std", S.INSTALL_YEAR, "duration_std"] if shift_duration else \
        [S.START, "size_mm_std", S.INSTALL_YEAR]
    from pyspark.ml import Pipeline

    prepm = Pipeline(stages=FE.vector_pipeline_stages(numeric, FE.HAZARD_CATEGORICAL, out="raw")).fit(learn)
    learn, test = prepm.transform(learn), prepm.transform(test)
    # the raw install year dominates the scale; standardise the vector with learning stats
    from pyspark.ml.feature import StandardScaler

    sc = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(learn)
    learn, test = (sc.transform(x).select(*KEYS, S.EVENT, S.DURATION, "features") for x in (learn, test))
    ensure_checkpoint_dir(learn.sparkSession)
    learn = store(learn, "kernel-in")
    dim, var = M.feature_variance(learn, "features")
    landmarks = nystrom.drawn(learn, "features", nystrom.LANDMARKS)
    return learn, test, {name: nystrom.of_landmarks(landmarks, g) for name, g in M.gamma_values(dim, var).items()}


@query("model_rank_svm")
def model_rank_svm(spark, sf_dir):
    """Survival SVM with the ranking objective (squared hinge over comparable pairs, rbf by Nyström features)."""
    d = Data(spark, sf_dir)
    learn, test, kernels = _kernel_frames(d, shift_duration=False)
    w = ranksvm.fit(ranksvm.pairs(learn, "features", kernels["scale"]), RANK_ALPHA)
    test = kernels["scale"].transform(test, "features", "kernel_scale")
    return _with_truth(d, test.select(*KEYS, ranksvm.risk(w, "kernel_scale").alias("proba")))


@query("model_regression_svm")
def model_regression_svm(spark, sf_dir):
    """Survival SVM (regression objective, rbf by Nyström features); risk = minus predicted time."""
    d = Data(spark, sf_dir)
    learn, test, kernels = _kernel_frames(d, shift_duration=False)
    model = M.survival_regression_svm(learn, "features", kernel=kernels["scale"])
    pred = model.transform(test).select(*KEYS, (-F.col("prediction")).alias("proba"))
    return _with_truth(d, pred)


GRID_FOLDS = 3


def _svc_scores(rows, kernels, best, test):
    """Decision values of the problem's model, fitted on all rows."""
    weights, intercept = svc.solve(rows, kernels, [best])[0]
    # decision value of class 1; the source reports minus it as "proba" (sign kept explicit)
    raw = F.col("prediction")
    line = M.Line(weights, intercept, "features", kernels[best.kernel])
    return line.transform(test).select(*KEYS, raw.alias("decision"), (-raw).alias("proba"))


@query("model_classifier")
def model_classifier(spark, sf_dir):
    """Linear SVM on rbf Nyström features, label = event; proba = minus decision value (source sign)."""
    d = Data(spark, sf_dir)
    learn, test, kernels = _kernel_frames(d, shift_duration=True)
    rows = svc.rows_of(learn, "features", S.EVENT)
    n = rows.count()
    return _with_truth(d, _svc_scores(rows, kernels, svc.Problem("scale", 1.0 / (0.1 * n)), test))


@query("model_grid_search")
def model_grid_search(spark, sf_dir):
    """C x gamma grid (8 combinations) on jittered rows by 3-fold cross-validation, all fits in the same scans."""
    d = Data(spark, sf_dir)
    learn, test, kernels = _kernel_frames(d, shift_duration=True, jitter=True)
    rows = svc.rows_of(learn, "features", S.EVENT, GRID_FOLDS)
    n = rows.count()
    grid = [(kernel, 1.0 / (c * n)) for c in SVC_C for kernel in ("scale", "auto")]
    best, _ = svc.cross_validated(rows, kernels, grid, GRID_FOLDS)
    return _with_truth(d, _svc_scores(rows, kernels, best, test))


@query("kernel_error")
def kernel_error(spark, sf_dir):
    """What the Nyström features leave of each kernel: mean and greatest error over pairs of 500 learning rows."""
    learn, _, kernels = _kernel_frames(Data(spark, sf_dir), shift_duration=False)
    sample = nystrom.drawn(learn, "features", ERROR_ROWS, seed=1)
    rows = [(name, kernel.gamma, len(kernel.landmarks), *kernel.error(sample)) for name, kernel in kernels.items()]
    return spark.createDataFrame(rows, "kernel string, gamma double, landmarks int, mean_error double, max_error double")


# ---------------------------------------------------------------- M11 parametric baseline

@query("model_aft")
def model_aft(spark, sf_dir):
    """Accelerated failure time (Weibull) on the assembled vectors; proba = minus log of the predicted time."""
    from pyspark.ml import Pipeline

    d = Data(spark, sf_dir)
    learn, test = _learn_test(d)
    prepm = Pipeline(stages=FE.vector_pipeline_stages(FE.HAZARD_NUMERIC, FE.HAZARD_CATEGORICAL)).fit(learn)
    model = aft.fit(prepm.transform(learn))
    return _with_truth(d, aft.scores(model, prepm.transform(test), KEYS))


# ---------------------------------------------------------------- M7 one-vs-rest demo

@query("model_one_vs_rest")
def model_one_vs_rest(spark, sf_dir):
    """One-vs-rest linear SVM on the embeddings; per-class and micro ROC AUC of its decision values."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    emb = Data(spark, sf_dir).table("embeddings")
    emb = emb.select("vec_id", F.col("label").cast("double").alias("label"),
                     array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    train, test = emb.randomSplit([0.5, 0.5], seed=0)  # half / half, as the demo's split
    ovr = OneVsRest(classifier=M.linear_svc(reg=0.01, features="features"), parallelism=4).fit(train)
    pred = ovr.transform(test).select("label", vector_to_array("rawPrediction").alias("raw"))
    rows = pred.select("label", F.posexplode("raw").alias("cls", "proba")).withColumn(
        "event", (F.col("label") == F.col("cls")).cast("int")
    )
    per = EV.auc(rows, group_cols=["cls"]).select(F.col("cls").cast("string").alias("class_name"), "auc")
    micro = EV.auc(rows).select(F.lit("micro").alias("class_name"), "auc")
    return per.unionByName(micro)


# ---------------------------------------------------------------- M10 permutation importance

PERM_REPEATS = 15
PERM_FEATURES = [S.START, "size_mm_std", "install_year_std", S.REGION, S.MATERIAL_AGE]


@query("perm_importance")
def perm_importance(spark, sf_dir):
    """AUC drop when one feature column of the test table is permuted (15 seeded repeats).

    The model sees only the features' bins, so they are permuted in place of the
    values: short numbers, dealt to the rows without a join.  All (feature,
    repeat) copies are scored in one job.
    """
    from ..operators.permute import permuted_copies

    d = Data(spark, sf_dir)
    learn, test = _learn_test(d)
    model = M.fit_hazard(learn, M.boosting())
    tr = truth_first(d).select(S.ID, S.START, F.col(S.EVENT).alias("true_event"))
    # the truth goes with its row: the start year is a key and a permuted feature, a second join would lose rows
    test = test.join(tr, KEYS, "inner").select(F.xxhash64(*KEYS).alias("row"), *PERM_FEATURES, S.DURATION, "true_event")
    test, model = M.boosted(model).coded(test)
    test = store(test, "perm-test")
    base = M.horizon_scores(model, test, P, ["true_event"])
    base_auc = EV.auc(base.select("proba", F.col("true_event").alias("event")))
    copies = permuted_copies(test, PERM_FEATURES, PERM_REPEATS, keys=["row"])
    risk = M.horizon_scores(model, copies, P, ["feature", "repeat", "true_event"])
    aucs = EV.auc(risk.select("feature", "repeat", "proba", F.col("true_event").alias("event")),
                  group_cols=["feature", "repeat"])
    b = base_auc.select(F.col("auc").alias("base_auc"))
    return aucs.crossJoin(F.broadcast(b)).groupBy("feature").agg(
        F.avg(F.col("base_auc") - F.col("auc")).alias("importance_mean"),
        F.stddev_pop(F.col("base_auc") - F.col("auc")).alias("importance_std"),
    )
