"""Survival learners against brute force on small tables, stop rule, held-out ranking on rows with a known risk."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from survkit import schema as S
from survkit.learners import coxboost, forest, ranksvm, table
from survkit.operators import evaluate as EV


def simulated(spark, n, seed=0):
    """Rows whose hazard rises with x1 and in category 'b'; censored at random."""
    r = np.random.default_rng(seed)
    x1, x2 = r.normal(size=n), r.integers(0, 6, n)
    cat = r.choice(["a", "b", "c"], n)
    rate = 0.08 * np.exp(1.2 * x1 + 1.5 * (cat == "b"))
    life, cens = r.exponential(1 / rate), r.uniform(1, 25, n)
    rows = [(f"k{i}", int(2000), int(min(a, b)), int(a <= b), float(p), int(q), str(c)) for i, (a, b, p, q, c) in enumerate(zip(life, cens, x1, x2, cat))]
    return spark.createDataFrame(rows, f"{S.ID} string, {S.START} int, {S.DURATION} int, {S.EVENT} int, x1 double, x2 int, cat string")


def encoded(spark, n, seed=0):
    df = simulated(spark, n, seed)
    enc = table.Encoder(["x1", "x2"], ["cat"]).fit(df, max_bins=8)
    return df, enc, table.encode(df, enc, [S.ID, S.START])


def local(t):
    rows = t.df.collect()
    return np.array([r["row"] for r in rows]), np.array([r["year"] for r in rows]), np.array([r["flag"] for r in rows]), np.array([r["bins"] for r in rows])


def test_encoder(spark):
    df = simulated(spark, 300)
    enc = table.Encoder(["x1", "x2"], ["cat"]).fit(df, max_bins=8, max_levels=2)
    assert enc.widths[1] == 6 and enc.widths[2] == 3 and len(enc.levels[0]) == 2
    odd = spark.createDataFrame([(None, 9, None), (1e9, -1, "zzz"), (float("nan"), 2, enc.levels[0][1])], "x1 double, x2 int, cat string")
    got = [r[0] for r in odd.select(enc.bins()).collect()]
    assert got[0] == [0, 5, 0] and got[1] == [enc.widths[0] - 1, 0, 0] and got[2][2] == 2
    rows = df.select("x1", enc.bins().alias("b")).collect()
    assert all(r["b"][0] == sum(e < r["x1"] for e in enc.edges[0]) for r in rows)


def test_vector_sums_in_groups(spark):
    df = spark.range(1000).repartition(80).withColumn("k", F.col("id").cast("int"))

    def add(b, out):
        out[0] += b.num_rows
        out[1] += b.column("id").to_numpy().sum()

    assert table.vector_sums(df, 2, add, 80).tolist() == table.vector_sums(df, 2, add, 8).tolist() == [1000, 499500]


def brute_stumps(row, y, e, x, enc, rounds, step, seed):
    """Risk sets and cuts row by row; also each round's out-of-bag loss before and after."""
    f, out, gains = np.zeros(len(y)), [], []

    def nll(f, on):
        return np.mean([0 if not (on[i] and e[i]) else math.log(sum(math.exp(f[j]) for j in range(len(y)) if on[j] and y[j] >= y[i])) - f[i] for i in np.flatnonzero(on)])

    for k in range(rounds):
        at_risk = {t: sum(math.exp(f[j]) for j in range(len(y)) if y[j] >= t) for t in set(y)}
        g = np.array([e[i] - math.exp(f[i]) * sum(sum((y == t) & (e == 1)) / at_risk[t] for t in set(y) if t <= y[i]) for i in range(len(y))])
        bag = table.uniform(row, seed, k) < 0.5
        best = None
        for c, (width, level) in enumerate(zip(enc.widths, enc.is_level)):
            for cut in range(width):
                left = (x[:, c] == cut) if level else (x[:, c] <= cut)
                l, r = g[bag & left], g[bag & ~left]
                if len(l) and len(r):
                    gain = len(l) * len(r) / (len(l) + len(r)) * (l.mean() - r.mean()) ** 2
                    if best is None or gain > best[0] + 1e-12:
                        best = gain, c, cut, l.mean(), r.mean(), left
        new = f + step * np.where(best[5], best[3], best[4])
        gains.append(nll(f, ~bag) - nll(new, ~bag))
        out.append(best[1:5])
        f = new
    return out, gains, f


def test_boosting_equals_brute_force(spark):
    df, enc, t = encoded(spark, 150)
    model = coxboost.fit(t, enc, rounds=4, step=0.5, seed=3, stop=lambda x: None)
    want, gains, f = brute_stumps(*local(t), enc, 4, 0.5, 3)
    assert [(s.feature, s.cut) for s in model.stumps] == [w[:2] for w in want]
    assert np.allclose([(s.left, s.right) for s in model.stumps], [w[2:] for w in want])
    assert np.allclose(model.improvements, gains)
    scores = {r["row"]: r["s"] for r in df.select(F.xxhash64(S.ID, S.START).alias("row"), model.score().alias("s")).collect()}
    assert np.allclose([scores[r] for r in local(t)[0]], f)


def test_stop_rule():
    flat = [0.0] * 200
    assert coxboost.stop_after(flat) == 50 and coxboost.stop_after(flat[:49]) is None
    good = [1.0] * 40 + flat  # the mean of 25 stays above zero until the last good one leaves the window, at round 63
    assert coxboost.stop_after(good) == 63 + 50 + 1
    assert coxboost.stop_after([1e-6] * 300) == 50 and coxboost.stop_after([1.1e-6] * 300) is None


def test_early_stop_follows_the_recorded_list(spark):
    _, enc, t = encoded(spark, 400, 5)
    short = coxboost.fit(t, enc, rounds=40, step=0.5, stop=lambda x: coxboost.stop_after(x, 3, 1e-4, 5))
    whole = coxboost.fit(t, enc, rounds=40, step=0.5, stop=lambda x: None)
    n = len(short.stumps)
    assert 5 <= n < 40 and coxboost.stop_after(whole.improvements, 3, 1e-4, 5) == n
    assert np.allclose(whole.improvements[:n], short.improvements[:n]) and len(whole.improvements) == 40


def c_index(scored):
    return EV.concordance(scored.select("proba", F.col(S.EVENT), F.col(S.DURATION))).first()["c_index"]


def test_boosting_ranks_held_out_rows(spark):
    _, enc, t = encoded(spark, 3000)
    model = coxboost.fit(t, enc, rounds=40)
    test = simulated(spark, 1500, 9)
    assert c_index(test.withColumn("proba", model.score())) > 0.75


def test_breslow_curves(spark):
    df = spark.createDataFrame([("a", 2, 1, 0.1), ("b", 2, 1, -0.3), ("c", 4, 0, 0.5), ("d", 5, 1, 0.0), ("e", None, 1, 9.0), ("f", 5, None, 9.0)], "id string, duration int, event int, s double")
    base = coxboost.breslow(df, "s", "duration", "event")
    w = [math.exp(x) for x in (0.1, -0.3, 0.5, 0.0)]
    h2 = 2 / sum(w)
    assert np.allclose([tuple(r) for r in base.orderBy("year").collect()], [(2, h2), (5, h2 + 1 / w[3])])
    got = coxboost.curves(df.where("id = 'a'"), "s", base, ["id"]).orderBy("year").collect()
    assert np.allclose([r["survival"] for r in got], [math.exp(-h * w[0]) for h in (h2, h2 + 1 / w[3])])
    assert coxboost.curves(df, "s", coxboost.breslow(df.limit(0), "s", "duration", "event"), ["id"]).count() == 0


def brute_pairs(x, y, e, w, alpha):
    f = x @ w
    value, grad, hess = w @ w / 2, w.copy(), np.eye(len(w))
    for j in np.flatnonzero(e):
        for i in np.flatnonzero(y > y[j]):
            m = 1 - f[i] + f[j]
            if m > 0:
                d = x[i] - x[j]
                value += alpha / 2 * m * m
                grad -= alpha * m * d
                hess += alpha * np.outer(d, d)
    return value, grad, hess


@pytest.fixture(scope="module")
def ranked(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(200, 5))
    y, e = r.integers(0, 9, 200), r.integers(0, 2, 200)
    df = spark.createDataFrame([(int(a), int(b), [float(v) for v in c]) for a, b, c in zip(y, e, x)], f"{S.DURATION} int, {S.EVENT} int, a array<double>")
    return x, y, e, ranksvm.pairs(df.withColumn("features", array_to_vector("a")), "features")


def test_ranking_objective_equals_pair_loss(ranked):
    x, y, e, data = ranked
    for w in (np.zeros(5), np.array([0.3, -0.2, 0.1, 0.4, -0.5]), np.array([2.0, -1, 0.5, 3, -2])):
        value, grad, hess = brute_pairs(x, y, e, w, 0.01)
        o = ranksvm.Objective(data, w, 0.01)
        assert abs(o.value - value) < 1e-6 * value
        assert np.abs(o.gradient() - grad).max() < 1e-3 * np.abs(grad).max()
        v = np.array([1.0, 2, -1, 0.5, 0])
        assert np.abs(o.product(v) - hess @ v).max() < 5e-3 * np.abs(hess @ v).max()


def test_ranking_fit_reaches_the_optimum(ranked):
    x, y, e, data = ranked
    n = sum((y > y[j]).sum() for j in np.flatnonzero(e))
    w = np.zeros(5)
    for _ in range(30):
        _, grad, hess = brute_pairs(x, y, e, w, 5.0 / n)
        w = w - np.linalg.solve(hess, grad)
    got = ranksvm.fit(data, 5.0)
    assert np.abs(got - w).max() < 1e-3 * max(1e-2, np.abs(w).max())


def test_ranking_beats_squared_loss_on_a_signal(spark):
    """Lifetimes over orders of magnitude: only their order follows the risk; squared loss fits the few long ones."""
    from survkit.operators import models as M

    def rows(n, seed):
        r = np.random.default_rng(seed)
        x = r.normal(size=(n, 4))
        life = np.exp(1.2 * x[:, 0] - 0.8 * x[:, 1] + 0.4 * x[:, 2] + 0.3 * r.normal(size=n) + 1.5) * (1 + 20 * (r.random(n) < 0.03))
        cens = r.uniform(0, 150, n)
        out = [(int(min(a, b)), int(a <= b), [float(v) for v in c]) for a, b, c in zip(life, cens, x)]
        return spark.createDataFrame(out, f"{S.DURATION} int, {S.EVENT} int, a array<double>").withColumn("features", array_to_vector("a"))

    learn, test = rows(800, 1), rows(800, 2)
    w = ranksvm.fit(ranksvm.pairs(learn, "features"), 100.0)
    ranking = c_index(test.withColumn("proba", ranksvm.risk(w, "features")))
    squared = M.survival_regression_svm(learn, "features").transform(test).withColumn("proba", -F.col("prediction"))
    assert ranking > 0.85 and ranking > c_index(squared) + 0.005


def brute_tree(row, y, e, x, columns, years, seed, no, levels, min_leaf):
    """Recursion over row sets; log-rank by loops over years. Nodes as (depth-first path, column, cut) and leaf hazards by path."""
    w = forest.weights(row, seed, no)
    cuts, leaves, queue, made = {}, {}, [("", np.flatnonzero(w), 0)], 1
    while queue:  # breadth first: nodes are numbered in this order
        path, on, node = queue.pop(0)
        best = None
        if len(path) < levels:
            for c in columns.sample(seed, no, node).tolist():
                b = columns.bins(x[on], np.full(len(on), c))
                for cut in range(columns.width[c] - 1):
                    left = b <= cut
                    if left.sum() < min_leaf or (~left).sum() < min_leaf:
                        continue
                    apart = var = 0.0
                    for t in range(years):
                        r, rl = w[on][y[on] >= t].sum(), w[on][left & (y[on] >= t)].sum()
                        dead = (y[on] == t) & (e[on] == 1)
                        d, dl = w[on][dead].sum(), w[on][left & dead].sum()
                        if r > 1:
                            apart += dl - d * rl / r
                            var += d * (rl / r) * (1 - rl / r) * (r - d) / (r - 1)
                    if var > 1e-12 and (best is None or apart**2 / var > best[0] * (1 + 1e-9)):
                        best = apart**2 / var, c, cut, left
        if best and best[0] > 0:
            cuts[path] = best[1:3]
            queue += [(path + "l", on[best[3]], made), (path + "r", on[~best[3]], made + 1)]
            made += 2
        else:
            h, total = [], 0.0
            for t in range(years):
                r = w[on][y[on] >= t].sum()
                total += w[on][(y[on] == t) & (e[on] == 1)].sum() / r if r else 0
                h.append(total)
            leaves[path] = h
    return cuts, leaves


def paths(tree):
    cuts, leaves, todo = {}, {}, [("", 0)]
    while todo:
        path, k = todo.pop()
        if tree.column[k] < 0:
            leaves[path] = tree.hazard[k]
        else:
            cuts[path] = tree.column[k], tree.cut[k]
            todo += [(path + "l", tree.left[k]), (path + "r", tree.left[k] + 1)]
    return cuts, leaves


def test_trees_equal_brute_force(spark):
    _, enc, t = encoded(spark, 300, 2)
    model = forest.fit(t, enc, trees=3, levels=3, seed=1, counts=2000)  # groups of few trees
    for no, tree in enumerate(model.trees):
        cuts, leaves = brute_tree(*local(t), model.columns, t.years, 1, no, 3, forest.MIN_LEAF)
        got_cuts, got_leaves = paths(tree)
        assert got_cuts == cuts and len(cuts) >= 2 and set(got_leaves) == set(leaves)
        assert all(np.allclose(got_leaves[k], leaves[k]) for k in leaves)


def test_forest_curves_are_monotone_and_rank_held_out_rows(spark):
    _, enc, t = encoded(spark, 2000)
    model = forest.fit(t, enc, trees=30)
    test = simulated(spark, 1000, 9)
    keys = [S.ID, S.START]
    h = model.hazards(test, keys)
    assert c_index(forest.mortality(h, keys).join(test, keys)) > 0.75
    per = {}
    for r in forest.curves(h, keys).orderBy(S.ID, "year").collect():
        per.setdefault(r[S.ID], []).append(r["survival"])
    assert len(per) == 1000 and all(len(s) == t.years and s == sorted(s, reverse=True) and 0 <= s[-1] <= s[0] <= 1 for s in per.values())
    # whatever the partitioning of the rows: weights and columns are drawn by hashes
    again = forest.fit(table.Table(t.df.repartition(7), t.rows, t.years, 7), enc, trees=3)
    assert [(a.column, a.cut) for a in again.trees] == [(a.column, a.cut) for a in model.trees[:3]]


def test_learners_on_empty_tables(spark):
    df = simulated(spark, 20).limit(0)
    enc = table.Encoder(["x1", "x2"], ["cat"]).fit(df)
    assert enc.widths == [1, 1, 1] and coxboost.fit(table.encode(df, enc, [S.ID]), enc, rounds=3).stumps == []
    none = forest.fit(table.encode(df, enc, [S.ID]), enc, trees=2)
    assert [x.column for x in none.trees] == [[-1], [-1]] and none.hazards(df, [S.ID]).count() == 0
    empty = spark.createDataFrame([], f"{S.DURATION} int, {S.EVENT} int, a array<double>").withColumn("features", array_to_vector("a"))
    assert ranksvm.fit(ranksvm.pairs(empty, "features")).tolist() == []


def test_nystrom_features(spark):
    from survkit.learners import nystrom

    r = np.random.default_rng(3)
    x = np.concatenate((r.normal(size=(500, 6)), np.repeat(r.normal(size=(1, 6)), 400, axis=0)))  # one row many times
    df = spark.createDataFrame([([float(v) for v in row],) for row in x], "a array<double>").withColumn("f", array_to_vector("a"))
    few, many, whole = (nystrom.fit(df, "f", 0.05, m) for m in (20, 150, 1000))
    assert len(few.landmarks) == 20 and len(whole.landmarks) == 501 == len(np.unique(whole.landmarks, axis=0))
    sample = nystrom.drawn(df, "f", 500, seed=1)
    errors = [k.error(sample) for k in (few, many, whole)]
    assert errors[0][0] > errors[1][0] > errors[2][0] and errors[1][0] < 0.005 and errors[1][1] < 0.2 and errors[2][1] < 1e-4
    z = many.of(many.landmarks)
    assert np.abs(z @ z.T - nystrom.rbf(many.landmarks, many.landmarks, 0.05)).max() < 1e-6
    got = many.transform(df.limit(5), "f", "z").collect()
    assert np.allclose([g["z"].toArray() for g in got], many.of(np.array([g["a"] for g in got])))
    again = nystrom.fit(df.repartition(7), "f", 0.05, 20)
    assert np.array_equal(again.landmarks, few.landmarks)


def test_accelerated_failure_time_recovers_parameters(spark):
    from survkit.learners import aft

    r = np.random.default_rng(6)
    x = r.normal(size=(4000, 2))
    # log time = 3 + 0.8 x0 - 0.5 x1 + 0.4 * (standard extreme value), censored at random
    life = np.exp(3 + x @ [0.8, -0.5] + 0.4 * np.log(r.exponential(size=4000)))
    cens = r.uniform(5, 120, 4000)
    rows = [(int(min(a, b)), int(a <= b), [float(v) for v in c]) for a, b, c in zip(life, cens, x)]
    df = spark.createDataFrame(rows, f"{S.DURATION} int, {S.EVENT} int, a array<double>").withColumn("features", array_to_vector("a"))
    model = aft.fit(df)
    assert np.allclose(model.coefficients.toArray(), [0.8, -0.5], atol=0.05) and abs(model.intercept - 3) < 0.05 and abs(model.scale - 0.4) < 0.05
    assert c_index(aft.scores(model, df, [S.DURATION, S.EVENT])) > 0.8


def test_reloaded_model_scores_alike(spark, tmp_path):
    from survkit.operators import models as M
    from survkit.sources import sinks

    df = simulated(spark, 300).withColumnsRenamed({"x1": "size_mm_std", "x2": "install_year_std"}).withColumn(S.REGION, F.col("cat")).withColumn(S.MATERIAL_AGE, F.col("cat"))
    model = M.fit_hazard(df, M.boosting(max_iter=5))
    loaded = sinks.load_pipeline_model(sinks.save_model(model, str(tmp_path / "model")))
    scores = [sorted(map(tuple, M.horizon_scores(m, df, 2, [S.ID]).collect())) for m in (model, loaded)]
    assert scores[0] == scores[1] and len({s[1] for s in scores[0]}) > 5


def coarse(spark, n):
    """Rows with few different cells."""
    df = simulated(spark, n, 7).withColumn("x1", F.round("x1")).withColumn("x2", F.col("x2") % 2)
    enc = table.Encoder(["x1", "x2"], ["cat"]).fit(df, max_bins=8)
    return df, enc, table.encode(df, enc, [S.ID, S.START])


def test_forest_passes_over_cells_not_rows(spark):
    _, _, t = coarse(spark, 4000)
    m = forest.bootstrapped(t, 1, 30)
    row, y, e, x = local(t)
    got = m.df.toPandas()
    kinds = len(np.unique(np.column_stack((x, y, e)), axis=0))
    assert kinds <= len(got) <= 2 * kinds < 1500 and got["rows"].sum() == 4000
    for tree in (0, 24, 25, 29):
        k, j = divmod(tree, table.DRAWS)
        parts = [np.array([np.frombuffer(v, "<u4")[j] for v in got[f"{c}{k}"]]) for c in ("w", "c")]
        w = forest.weights(row, 1, tree)
        for value, part in zip((w, w > 0), parts):
            assert part[got["flag"] == 1].sum() == value[e == 1].sum() and part[got["year"] == 3].sum() == value[y == 3].sum()


def test_trees_of_merged_rows_equal_brute_force(spark):
    _, enc, t = coarse(spark, 600)
    model = forest.fit(t, enc, trees=2, levels=2, seed=1)
    for no, tree in enumerate(model.trees):
        cuts, leaves = brute_tree(*local(t), model.columns, t.years, 1, no, 2, forest.MIN_LEAF)
        got_cuts, got_leaves = paths(tree)
        assert got_cuts == cuts and set(got_leaves) == set(leaves) and all(np.allclose(got_leaves[k], leaves[k]) for k in leaves)


def test_boosting_rounds_pass_over_cells_not_rows(spark, monkeypatch):
    _, enc, t = coarse(spark, 600)
    m = coxboost.bags(t, range(25, 60), 3, 0.5)
    row, y, _, _ = local(t)
    got = m.df.toPandas()
    assert len(got) < 400 and got["rows"].sum() == 600
    for no in (25, 49, 50, 59):
        k, j = divmod(no, table.DRAWS)
        bag = np.array([np.frombuffer(v, "<u4")[j] for v in got[f"bag{k}"]])
        for year in (0, 3):
            assert bag[got["year"] == year].sum() == (table.uniform(row, 3, no)[y == year] < 0.5).sum()
    monkeypatch.setattr(coxboost, "AHEAD", table.DRAWS)  # bags of the 27 rounds and the last loss in two passes
    model = coxboost.fit(t, enc, rounds=27, step=0.05, seed=3, stop=lambda x: None)
    want, gains, _ = brute_stumps(*local(t), enc, 3, 0.05, 3)
    assert [(s.feature, s.cut) for s in model.stumps[:3]] == [w[:2] for w in want] and np.allclose(model.improvements[:3], gains)
    monkeypatch.setattr(coxboost, "AHEAD", 5 * table.DRAWS)
    whole = coxboost.fit(t, enc, rounds=27, step=0.05, seed=3, stop=lambda x: None)
    assert np.allclose(model.improvements, whole.improvements) and len(whole.stumps) == 27


def test_vectors_of_all_tasks_come_in_one_job(spark, monkeypatch):
    df = spark.range(100).repartition(8)
    tracker = spark.sparkContext.statusTracker()

    def sums(group):
        spark.sparkContext.setJobGroup(group, group)
        got = table.vector_sums(df, 1, lambda b, out: out.__iadd__(b.num_rows), 8).tolist()
        return got, len(tracker.getJobIdsForGroup(group))

    got, jobs = sums("small-vectors")
    assert got == [100] and jobs <= 2
    monkeypatch.setattr(table, "DIRECT_BYTES", 0)
    assert sums("large-vectors")[0] == [100]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_person_years_of_a_task_are_bounded(spark):
    from survkit.operators import models as M

    ep = spark.range(1000).select(F.col("id").alias(S.ID), F.pmod("id", F.lit(7)).cast("int").alias(S.DURATION), F.lit(1).alias(S.EVENT)).coalesce(1)
    assert M.dealt(ep).rdd.getNumPartitions() == 1
    many = M.person_period(M.dealt(ep, 400))
    per = [r["count"] for r in many.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per) == M.person_period(ep).count() and len(per) == 10 and max(per) < 800


def vectors(spark, n, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 4))
    life, cens = np.exp(0.6 * x[:, 0] + 0.3 * r.normal(size=n) + 2), r.uniform(1, 20, n)
    rows = [(int(min(a, b)), int(a <= b), [float(v) for v in c]) for a, b, c in zip(life, cens, x)]
    return spark.createDataFrame(rows, f"{S.DURATION} int, {S.EVENT} int, a array<double>").withColumn("f", array_to_vector("a")).repartition(3).cache()


def test_regression_rounds_equal_repeated_least_squares(spark):
    """With the kernel made in the scans, each round is the least-squares fit of the rows that carry loss."""
    from pyspark.ml.regression import LinearRegression

    from survkit.learners import nystrom
    from survkit.operators import models as M

    df = vectors(spark, 400, 2)
    kernel = nystrom.fit(df, "f", 0.1, 12)
    base = kernel.transform(df, "f", "z").withColumn("y", F.col(S.DURATION).cast("double"))
    active, lowest = base, float("inf")
    for rounds in range(1, 50):
        want = LinearRegression(featuresCol="z", labelCol="y", regParam=0.01).fit(active)
        active = want.transform(base).where((F.col(S.EVENT) == 1) | (F.col("prediction") < F.col("y")))
        loss = active.agg(F.sum((F.col("prediction") - F.col("y")) ** 2)).first()[0]
        active = active.drop("prediction")
        if loss >= lowest * (1 - 1e-6):
            break
        lowest = loss
    got = M.survival_regression_svm(df, "f", kernel=kernel)
    assert rounds > 2 and np.allclose(got.weights, want.coefficients.toArray(), rtol=1e-4, atol=1e-4)
    pairs = zip(got.transform(df).orderBy("a").collect(), want.transform(base).orderBy("a").collect())
    assert all(abs(a["prediction"] - b["prediction"]) < 1e-4 for a, b in pairs)


def test_ranking_with_the_kernel_in_the_scan_equals_ready_features(spark):
    from survkit.learners import nystrom

    df = vectors(spark, 300, 3)
    kernel = nystrom.fit(df, "f", 0.1, 12)
    lazy, ready = ranksvm.pairs(df, "f", kernel), ranksvm.pairs(kernel.transform(df, "f", "z"), "z")
    assert lazy.df.agg(F.max(F.size("x"))).first()[0] == 4 and lazy.dim == ready.dim == 12
    w, v = np.linspace(-0.2, 0.3, 12), np.linspace(1, -1, 12)
    a, b = (ranksvm.Objective(p, w, 0.01) for p in (lazy, ready))
    assert abs(a.value - b.value) < 1e-9 * b.value and np.allclose(a.gradient(), b.gradient()) and np.allclose(a.product(v), b.product(v))


def test_kernel_features_are_never_stored(spark, monkeypatch):
    """Frames, regression and grid search write the kernels' inputs alone."""
    from survkit.plans import models as PM
    from survkit.plans.base import Data

    kept = []
    keep = PM.store
    monkeypatch.setattr(PM, "store", lambda df, name: (kept.append(df.columns), keep(df, name))[1])
    learn, test, kernels = PM._kernel_frames(Data(spark, "/root/testdata/sf0.001"), shift_duration=False)
    assert kept and not any(c.startswith("kernel") for cols in kept for c in cols) and "features" in test.columns
    both = PM.nystrom.Kernels(kernels, "features").transform(learn)
    row = both.select("features", "kernel_scale", "kernel_auto").first()
    x = row["features"].toArray()[None]
    assert np.allclose(row["kernel_scale"].toArray(), kernels["scale"].of(x)[0]) and np.allclose(row["kernel_auto"].toArray(), kernels["auto"].of(x)[0])


def test_cross_validation_makes_the_kernel_features_in_its_folds(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    from survkit.learners import nystrom
    from survkit.operators import models as M

    df = vectors(spark, 200, 5).withColumn("label", (F.col("a")[0] > 0).cast("double"))
    landmarks = nystrom.drawn(df, "f", 12)
    kernels = {name: nystrom.of_landmarks(landmarks, g) for name, g in (("scale", 0.2), ("auto", 1e-6))}
    svc = M.linear_svc(features="kernel_scale", max_iter=5)
    grid = ParamGridBuilder().addGrid(svc.featuresCol, ["kernel_auto", "kernel_scale"]).build()
    steps = Pipeline(stages=[nystrom.Kernels(kernels, "f"), svc])
    cv = CrossValidator(estimator=steps, estimatorParamMaps=grid, numFolds=2, parallelism=2, seed=0, evaluator=BinaryClassificationEvaluator())
    model = cv.fit(df)
    best = ["kernel_auto", "kernel_scale"][int(np.argmax(model.avgMetrics))]
    assert min(model.avgMetrics) > 0.9 and model.bestModel.stages[-1].getFeaturesCol() == best
    assert model.bestModel.transform(df).where("prediction = label").count() > 170


def test_every_permuted_copy_is_judged_on_all_rows(spark, monkeypatch):
    """The start year is a key and a feature: its permuted copies keep their rows' truth."""
    from survkit.plans import models as PM

    seen, auc, boosting = [], PM.EV.auc, PM.M.boosting
    monkeypatch.setattr(PM.EV, "auc", lambda rows, *a, **k: (seen.append(rows), auc(rows, *a, **k))[1])
    monkeypatch.setattr(PM.M, "boosting", lambda: boosting(max_iter=2))
    monkeypatch.setattr(PM, "PERM_REPEATS", 2)
    PM.perm_importance(spark, "/root/testdata/sf0.001")
    base, copies = seen
    per = {(r["feature"], r["repeat"]): (r["n"], r["e"]) for r in copies.groupBy("feature", "repeat").agg(F.count("proba").alias("n"), F.sum("event").alias("e")).collect()}
    assert len(per) == 10 and set(per.values()) == {(base.count(), base.agg(F.sum("event")).first()[0])}


def years_of(spark, n):
    """Person-years of rows with few different cells, as the hazard models get them."""
    from survkit.operators import models as M

    return M.person_period(coarse(spark, n)[0])


def brute_gini(x, n, d, columns, seed, no, levels, min_leaf):
    """Recursion over cells with weights n and failures d: cuts and leaf shares by depth-first path."""
    impure = lambda n, d: 1 - (d / n) ** 2 - (1 - d / n) ** 2
    cuts, leaves, queue, made = {}, {}, [("", np.flatnonzero(n), 0)], 1
    while queue:
        path, on, node = queue.pop(0)
        best, all_n, all_d = None, n[on].sum(), d[on].sum()
        for c in columns.sample(seed, no, node).tolist() if len(path) < levels else []:
            b = columns.bins(x[on], np.full(len(on), c))
            for cut in range(columns.width[c] - 1):
                left = b <= cut
                nl, dl = n[on][left].sum(), d[on][left].sum()
                if nl >= min_leaf and all_n - nl >= min_leaf:
                    gain = impure(all_n, all_d) - nl / all_n * impure(nl, dl) - (1 - nl / all_n) * impure(all_n - nl, all_d - dl)
                    if gain > 1e-12 and (best is None or gain > best[0] * (1 + 1e-9)):
                        best = gain, c, cut, left
        if best:
            cuts[path] = best[1:3]
            queue += [(path + "l", on[best[3]], made), (path + "r", on[~best[3]], made + 1)]
            made += 2
        else:
            leaves[path] = all_d / all_n
    return cuts, leaves


def test_hazard_trees_equal_brute_force_and_score_by_their_leaves(spark):
    from survkit.learners import hazard

    rows = years_of(spark, 500)
    enc = table.Encoder(["x1", "x2", "k"], ["cat"]).fit(rows, own_bins=True)
    plain = rows.select(enc.bins().alias("b"), F.col("label").cast("int").alias("l"))
    kinds = plain.groupBy("b", "l").agg(F.count("*").alias("n")).select("b", "l", "n", F.xxhash64("b", "l").alias("h")).collect()
    x, label = np.array([r["b"] for r in kinds]), np.array([r["l"] for r in kinds])
    w = np.array([hazard.weights(r["h"], r["n"], 3, 30) for r in kinds])
    model = hazard.HazardForest(30, seed=3, levels=3).fit(rows, enc.numeric, enc.categorical)
    forest_of, cut = model.trees, 0
    for no in (0, 24, 25, 29):
        cuts, leaves = brute_gini(x, w[:, no], w[:, no] * label, forest_of.columns, 3, no, 3, hazard.MIN_LEAF)
        got_cuts, got_leaves = paths(forest_of.trees[no])
        assert got_cuts == cuts and set(got_leaves) == set(leaves) and all(np.allclose(got_leaves[p], leaves[p]) for p in leaves)
        cut += len(cuts)
    assert cut >= 8
    want = np.mean([np.array([h[0] if h is not None else 0 for h in t.hazard])[forest_of.columns.descend(x, t.arrays())] for t in forest_of.trees], axis=0)
    assert np.allclose(hazard.Scorer(forest_of, 3).of(x), want)


def test_hazard_forest_keeps_cells_not_person_years(spark):
    from survkit.learners import hazard

    rows = years_of(spark, 300)
    enc = table.Encoder(["x1", "x2", "k"], ["cat"]).fit(rows, own_bins=True)
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(40))))
    one, many = (hazard.bootstrapped(r, enc, "label", 0, 60) for r in (rows, copies))
    a, b = one.df.count(), many.df.toPandas()
    assert a == len(b) < rows.count() / 2 and many.rows == 40 * one.rows == b["rows"].sum()
    # the bootstrap is that of single person-years: a sum of n Poisson(1) numbers
    w = np.hstack([np.array([np.frombuffer(v, "<u4") for v in b[c]]) for c in ("w0", "w1", "w2")]).astype(float)
    z = (w - b["rows"].to_numpy()[:, None]) / np.sqrt(b["rows"].to_numpy())[:, None]
    assert w.shape[1] == 60 and abs(z.mean()) < 0.05 and abs(z.var() - 1) < 0.1
    assert (np.diff(w, axis=1) != 0).any(axis=1).all()


def test_hazard_forest_tells_rare_failures_apart(spark):
    """No leaf has a failure share above one half: the scores still differ and rank held-out rows."""
    from survkit.operators import models as M

    def named(df):
        df = df.withColumnsRenamed({"x1": "size_mm_std", "x2": "install_year_std"})
        return df.withColumn(S.REGION, F.col("cat")).withColumn(S.MATERIAL_AGE, F.col("cat"))

    model = M.fit_hazard(named(simulated(spark, 2000)), M.forest(40))
    test = named(simulated(spark, 500, 9))
    proba = M.horizon_scores(model, test, 2, [S.ID])
    rows = proba.join(test, S.ID)
    assert rows.count() == 500 and rows.select("proba").distinct().count() > 50
    # a risk high early is a life cut short
    assert c_index(rows.withColumn(S.START, F.lit(2000))) > 0.7
    curve = M.horizon_risk(M.survival_curves(model, test, 2, [S.ID]), 2, [S.ID]).withColumnRenamed("proba", "other")
    assert proba.join(curve, S.ID).where(F.abs(F.col("proba") - F.col("other")) > 1e-9).count() == 0


def test_few_values_have_their_own_bins_however_rare(spark):
    df = spark.range(20000).select(F.when(F.col("id") < 5, F.col("id") + 2).otherwise(1).cast("int").alias("a"), F.col("id").cast("double").alias("b"))
    enc = table.Encoder(["a", "b"], []).fit(df, max_bins=8, own_bins=True)
    assert enc.edges[0] == [1, 2, 3, 4, 5] and enc.widths[1] == 8


def test_person_years_of_a_task_are_bounded_beside_empty_tasks(spark):
    from survkit.operators import models as M

    full = spark.range(1000).select(F.col("id").alias(S.ID), F.lit(3).alias(S.DURATION), F.lit(1).alias(S.EVENT)).coalesce(1)
    ep = full.union(full.where("false").repartition(20))  # many tasks, one of which holds all rows
    per = [r["count"] for r in M.person_period(M.dealt(ep, 400)).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per) == 4000 and max(per) < 800


def named_cells(spark, n):
    """Episodes with few different cells and the hazard models' columns."""
    df = coarse(spark, n)[0].withColumnsRenamed({"x1": "size_mm_std", "x2": "install_year_std"})
    return df.withColumn(S.REGION, F.col("cat")).withColumn(S.MATERIAL_AGE, F.concat("cat", F.pmod(F.xxhash64(S.ID), F.lit(2)).cast("string")))


def test_boosted_stumps_equal_brute_force(spark, monkeypatch):
    from survkit.learners import boost
    from survkit.operators import models as M

    ep = named_cells(spark, 400).where(F.col(S.DURATION) < 40)
    found, rounds = [], boost.rounds
    monkeypatch.setattr(boost, "rounds", lambda *a: (found.append((a, rounds(*a))), found[-1][1])[1])
    model = M.fit_hazard(ep, M.boosting(max_iter=30, seed=3))
    (table_, shape, *_), tables = found[0]
    cells = table_.df.toPandas()
    assert cells["rows"].sum() == M.person_period(ep).count() and len(tables) == 6 and any(t.any() for t in tables)
    x, y, n = np.array(cells["bins"].tolist()), 2.0 * cells["flag"].to_numpy() - 1, cells["rows"].to_numpy()
    f = np.zeros(len(n))
    for no in range(30):
        w = np.array([np.frombuffer(v, "<u4")[no % 25] for v in cells[f"w{no // 25}"]]).astype(float)
        assert (w <= n).all()
        r = y if no == 0 else 4 * y / (1 + np.exp(2 * y * f))
        best = None
        for c, (width, level) in enumerate(zip(shape.widths, shape.is_level)):
            for cut in range(width if level else width - 1):
                left = x[:, c] == cut if level else x[:, c] <= cut
                if w[left].sum() and w[~left].sum():
                    means = [np.average(r[s], weights=w[s]) for s in (left, ~left)]
                    fit = np.where(left, *means)
                    loss = (w * (r - fit) ** 2).sum()
                    if best is None or loss < best[0] - 1e-9 * abs(best[0]):
                        best = loss, fit
        f += best[1] * (1 if no == 0 else 0.5)
    assert np.allclose(sum(t[x[:, k]] for k, t in enumerate(tables)), f)
    # scanned by tasks: the same tables
    monkeypatch.setattr(boost, "LOCAL_BYTES", 0)
    assert all(np.allclose(a, b) for a, b in zip(tables, rounds(table_, shape, 30, 0.5)))
    # an episode's own curve and score are those of the rows scored a year at a time, copied episodes included
    test = named_cells(spark, 60).limit(40).withColumn("size_mm_std", F.when(F.col("size_mm_std") > 0, F.col("size_mm_std"))).cache()
    keys = [S.ID]
    grid = model.transform(test.withColumn("k", F.explode(F.sequence(F.lit(0), F.col(S.DURATION) + 2))))
    want = {(r[0], r[1]): r[2] for r in grid.select(S.ID, "k", vector_to_array("probability")[1]).collect()}
    got = M.survival_curves(model, test, 2, keys)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r[S.ID], r["k"]): r["hazard"] for r in got.collect()} == pytest.approx(want) and len(want) == grid.count()
    risk = {r[S.ID]: r["proba"] for r in M.horizon_risk(got, 2, keys).collect()}
    assert {r[S.ID]: r["proba"] for r in M.horizon_scores(model, test, 2, keys).collect()} == pytest.approx(risk)
    rows, coded = model.stages[0].coded(test)
    assert dict(rows.dtypes)["size_mm_std"] == dict(rows.dtypes)[S.REGION] == "smallint"
    assert sorted(r[1] for r in coded.transform(rows.withColumn("k", F.lit(1))).select(S.ID, vector_to_array("probability")[1]).collect()) == pytest.approx(
        sorted(r[1] for r in model.transform(test.withColumn("k", F.lit(1))).select(S.ID, vector_to_array("probability")[1]).collect()))


def test_boosting_passes_over_cells_not_person_years(spark):
    from survkit.learners import boost

    ep = named_cells(spark, 200)
    enc = table.Encoder(["size_mm_std"], [S.REGION]).fit(ep, own_bins=True)
    one = boost.cells(ep, enc, [1.0, 5.0])
    many = boost.cells(ep.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(40)))), enc, [1.0, 5.0])
    assert one.count() == many.count() < ep.count() and many.agg(F.sum("rows")).first()[0] == 40 * one.agg(F.sum("rows")).first()[0]
    w = np.array([boost.bag(7, 50, 1, 4000, 0.5), boost.bag(8, 50, 1, 4000, 0.5)])
    assert abs(w.mean() - 25) < 0.2 and abs(w.var() - 12.5) < 1 and (w[0] != w[1]).any()


def test_svms_fitted_side_by_side_reach_the_optimum_of_each(spark):
    from survkit.learners import nystrom, svc
    from survkit.operators import models as M

    rng = np.random.default_rng(4)
    df = vectors(spark, 600, 5).select("f", "a", (F.col("a")[0] + F.col("a")[1] * F.col("a")[1] / 2 + F.randn(3) > 0.4).cast("int").alias("label")).cache()
    landmarks = nystrom.drawn(df, "f", 10)
    kernels = {name: nystrom.of_landmarks(landmarks, g) for name, g in (("scale", 0.2), ("auto", 0.05))}
    rows = svc.rows_of(df, "f", "label", 3)
    problems = [svc.Problem(k, reg, fold) for k, reg, fold in (("scale", 1e-3, -1), ("scale", 1e-3, 0), ("auto", 1e-1, 2))]
    models = svc.solve(rows, kernels, problems, steps=200)
    t = rows.toPandas()
    x, y, fold = np.array(t["x"].tolist()), 2 * t["label"].to_numpy() - 1, t["fold"].to_numpy()
    assert len(x) == 600 and set(fold) == {0, 1, 2}

    def value(p, w, b):
        own = fold != p.fold
        z = kernels[p.kernel].of(x[own])
        return np.maximum(0, 1 - y[own] * (z @ w + b)).mean() + p.reg / 2 * ((w * z.std(axis=0, ddof=1)) ** 2).sum()

    for p, (w, b) in zip(problems, models):
        plain = kernels[p.kernel].transform(spark.createDataFrame([(int(l), v.tolist()) for l, v, o in zip(t["label"], x, fold) if o != p.fold], "label int, a array<double>").withColumn("f", array_to_vector("a")), "f", "z")
        other = M.linear_svc(reg=p.reg, max_iter=200, features="z").fit(plain.withColumn("label", F.col("label").cast("double")))
        best = value(p, other.coefficients.toArray(), other.intercept)
        assert value(p, w, b) < best * 1.005 + 1e-9
        assert all(value(p, w + 0.05 * rng.normal(size=len(w)), b + 0.05 * rng.normal()) > value(p, w, b) * 0.995 for _ in range(20))
    alone = svc.solve(rows, kernels, problems[2:], steps=200)[0]
    assert np.allclose(alone[0], models[2][0], rtol=1e-3, atol=1e-4)
    held = [k for k, p in enumerate(problems) if p.fold != -1]
    areas = svc.areas(rows, kernels, [problems[k] for k in held], [models[k] for k in held])
    for a, k in zip(areas, held):
        p, (w, b) = problems[k], models[k]
        s, l = kernels[p.kernel].of(x[fold == p.fold]) @ w, y[fold == p.fold] > 0
        gap = s[l][:, None] - s[~l][None, :]
        assert abs(a - ((gap > 0) + (gap == 0) / 2).mean()) < 2e-3 and a > 0.6
    best, mean = svc.cross_validated(rows, kernels, [("auto", 1e-1), ("scale", 1e-3)], 3, steps=5)
    assert best.kernel == ["auto", "scale"][int(np.argmax(mean))] and best.fold == -1


def test_grid_search_scans_do_not_grow_with_the_fits(spark, monkeypatch):
    from survkit.learners import nystrom, svc

    df = vectors(spark, 300, 6).withColumn("label", (F.col("a")[0] + F.randn(1) > 0).cast("int"))
    kernels = {"scale": nystrom.fit(df, "f", 0.2, 8)}
    rows = svc.rows_of(df, "f", "label", 3)
    scans, plain = [], svc.vector_sums
    monkeypatch.setattr(svc, "vector_sums", lambda *a: (scans.append(1), plain(*a))[1])
    svc.solve(rows, kernels, [svc.Problem("scale", r, f) for r in (1e-3, 1e-2, 1e-1, 1) for f in (0, 1, 2)], steps=8)
    assert len(scans) < 8 * 4
