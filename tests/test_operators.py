"""Hand-computed fixtures (FIXTURES.md part 3) and brute-force cross-checks."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from survkit import schema as S
from survkit.functions.scalar import chi2_1df_pvalue
from survkit.operators import bins as B
from survkit.operators import evaluate as EV
from survkit.operators import features as FE
from survkit.operators import integrate as I
from survkit.operators import km as KM
from survkit.operators import logrank as LR
from survkit.operators.cumulative import running_sums
from survkit.operators.permute import permuted_copies


def test_scored_4_roc_area_is_one(spark):
    df = spark.createDataFrame(list(zip([0, 1, 1, 1], [0.3, 0.75, 0.77, 0.88])), "event int, proba double")
    assert EV.auc(df).first()["auc"] == pytest.approx(1.0)


def test_ties_4_average_ranks(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "proba double, event int")
    got = {r["proba"]: r["avg_rank"] for r in EV.lift_curve(df).collect()}
    assert got == {0.9: 1.0, 0.8: 2.5, 0.1: 4.0}


def test_km_3_survival_reaches_zero(spark):
    # times 1, 2, 3 with 10, 8, 4 at risk and 2, 4, 4 failures
    counts = spark.createDataFrame(
        [(1, 1, 2, 2), (1, 2, 4, 4), (1, 3, 4, 4)], "g int, duration int, n_events long, n_rows long"
    )
    rows = sorted(KM.curve_from_counts(counts, ["g"], with_ci=True).collect(), key=lambda r: r["duration"])
    assert [r["n_at_risk"] for r in rows] == [10, 8, 4]
    assert [round(r["survival"], 10) for r in rows] == [0.8, 0.4, 0.0]
    assert rows[2]["ci_lower"] is None and rows[0]["ci_lower"] < 0.8 < rows[0]["ci_upper"]


def test_orphan_3_joins(spark):
    assets = spark.createDataFrame(
        [("R", 1, None, 1.0, "M", "M1"), ("R", 2, None, 2.0, "M", "M1")],
        "region string, asset_id long, installed_at timestamp, size_mm double, material string, material_age string",
    )
    fails = spark.createDataFrame([("R", 1, None), ("R", 1, None), ("R", 9, None)],
                                  "region string, asset_id long, failed_at timestamp")
    assert I.master_events(fails, assets).count() == 2
    allr = I.master_all(fails, assets).collect()
    assert len(allr) == 4
    orphan = [r for r in allr if r[S.ASSET_ID] is None]
    assert len(orphan) == 1 and orphan[0][S.ID] is None and orphan[0][S.REGION] == "R"
    ids = sorted(r[S.ID] for r in allr if r[S.ID] is not None)
    assert ids == ["R_1", "R_1", "R_2"]  # no float formatting of the key


def test_qcut_10_edges_and_bins(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 11)], "x double")
    edges = B.quantile_edges(df, "x", 5)
    assert [round(e, 10) for e in edges] == [1.0, 2.8, 4.6, 6.4, 8.2, 10.0]
    out = B.with_bins(df, "x", edges, "x").groupBy("x_bin").count().collect()
    assert sorted((r["x_bin"], r["count"]) for r in out) == [(b, 2) for b in range(1, 6)]


def test_cut_4_right_closed_bins(spark):
    df = spark.createDataFrame([(1900,), (1950,), (2000,), (None,)], "y int")
    out = B.cut(df, "y", 5, "y").orderBy(F.col("y").asc_nulls_last()).collect()
    assert [r["y_bin"] for r in out] == [1, 3, 5, None]
    assert out[3]["y_range"] == "nan"


def test_running_sums_match_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 3000), "s": rng.permutation(3000).astype(float),
                        "v": rng.integers(0, 5, 3000)})
    got = running_sums(spark.createDataFrame(pdf), "s", ["v"], ascending=False, group_cols=["g"], num_ranges=7).toPandas()
    exp = pdf.sort_values(["g", "s"], ascending=[True, False]).assign(cv=lambda d: d.groupby("g").v.cumsum())
    m = exp.merge(got, on=["g", "s"])
    assert len(m) == 3000 and (m.cv == m.cum_v).all()


def _brute_logrank(t1, e1, t2, e2):
    times = sorted(set([t for t, e in zip(t1, e1) if e] + [t for t, e in zip(t2, e2) if e]))
    o = ex = v = 0.0
    for t in times:
        n1 = sum(1 for x in t1 if x >= t)
        n2 = sum(1 for x in t2 if x >= t)
        d1 = sum(1 for x, e in zip(t1, e1) if e and x == t)
        d2 = sum(1 for x, e in zip(t2, e2) if e and x == t)
        n, d = n1 + n2, d1 + d2
        o += d1
        ex += d * n1 / n
        if n > 1:
            v += d * (n1 / n) * (n2 / n) * (n - d) / (n - 1)
    chi2 = (o - ex) ** 2 / v
    return chi2, math.erfc(math.sqrt(chi2 / 2))


def test_logrank_from_counts_matches_row_level(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in ("a", "b"):
        for _ in range(60):
            y = int(rng.integers(2000, 2008)) if rng.random() < (0.6 if g == "a" else 0.4) else None
            rows.append((g, y))
    df = spark.createDataFrame(rows, "grp string, failure_year int")
    got = LR.pairwise(df, "grp").first()
    # row-level durations on the pair's own window (censored at max - min)
    ys = [y for _, y in rows if y is not None]
    mn, mx = min(ys), max(ys)
    t = {g: [(y - mn) if y is not None else (mx - mn) for gg, y in rows if gg == g] for g in ("a", "b")}
    e = {g: [y is not None for gg, y in rows if gg == g] for g in ("a", "b")}
    chi2, p = _brute_logrank(t["a"], e["a"], t["b"], e["b"])
    assert got["chi2"] == pytest.approx(chi2, rel=1e-9)
    assert got["p_value"] == pytest.approx(p, rel=1e-9)


def test_logrank_is_symmetric(spark):
    df = spark.createDataFrame([("a", 2000), ("a", None), ("b", 2001), ("b", 2002), ("b", None)],
                               "grp string, failure_year int")
    p1 = LR.pairwise(df, "grp").first()["chi2"]
    df2 = df.withColumn("grp", F.when(F.col("grp") == "a", "z").otherwise("b"))
    p2 = LR.pairwise(df2, "grp").first()["chi2"]
    assert p1 == pytest.approx(p2)


def _brute_cindex(t, e, s):
    conc = tied = comp = 0
    for i in range(len(t)):
        if not e[i]:
            continue
        for j in range(len(t)):
            if t[j] > t[i] or (t[j] == t[i] and not e[j]):
                comp += 1
                conc += s[i] > s[j]
                tied += s[i] == s[j]
    return (conc + 0.5 * tied) / comp


def test_running_sums_single_range_for_small_input(spark):
    pdf = pd.DataFrame({"s": np.arange(500, dtype=float)[::-1], "v": np.ones(500, dtype=int)})
    got = running_sums(spark.createDataFrame(pdf), "s", ["v"]).toPandas().sort_values("s")
    assert got.cum_v.tolist() == list(range(1, 501))


def test_concordance_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    t = rng.integers(0, 6, 300).tolist()
    e = (rng.random(300) < 0.4).astype(int).tolist()
    s = np.round(rng.random(300), 2).tolist()
    df = spark.createDataFrame(list(zip(s, e, t)), "proba double, event int, duration int")
    assert EV.concordance(df).first()["c_index"] == pytest.approx(_brute_cindex(t, e, s))


def test_dynamic_auc_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    t = rng.integers(0, 6, 200).tolist()
    e = (rng.random(200) < 0.5).astype(int).tolist()
    s = np.round(rng.random(200), 2).tolist()
    df = spark.createDataFrame(list(zip(s, e, t)), "proba double, event int, duration int")
    times = spark.createDataFrame([(2.0,), (4.0,)], "t double")
    got = {r["t"]: r["auc"] for r in EV.dynamic_auc(df, times).collect()}
    for tt in (2.0, 4.0):
        lab = [1 if (ee == 1 and ti <= tt) else 0 for ee, ti in zip(e, t)]
        pos = [si for si, li in zip(s, lab) if li]
        neg = [si for si, li in zip(s, lab) if not li]
        u = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
        assert got[tt] == pytest.approx(u / (len(pos) * len(neg)))


def test_levels_without_a_learning_row_are_pruned(spark):
    whole = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    wide, names = FE.onehot_columns(whole.where("k <> 'b'"), ["k"], FE.category_values(whole, ["k"]))
    assert names == ["a", "b", "c"] and FE.nonzero_columns(wide, names) == ["a", "c"]


def test_censoring_weights_at_tied_times(spark):
    # time 1: 1 failure, 1 censored of 6 -> failures leave first: 1 - 1/5; time 2: 2 failures, 1 censored of 4 -> 1 - 1/2
    rows = [(1, 1), (0, 1), (1, 2), (1, 2), (0, 2), (1, 4)]
    train = spark.createDataFrame(rows, "event int, duration int")
    g = {r["duration"]: r["g"] for r in EV.censoring_survival(train).collect()}
    assert g == {1: pytest.approx(0.8), 2: pytest.approx(0.4), 4: pytest.approx(0.4)}
    # scored table: cases at t = 3 are (0.9, duration 0: weight 1), (0.2, duration 3: weight 1 / 0.4); one control
    df = spark.createDataFrame([(0.9, 1, 0), (0.2, 1, 3), (0.5, 0, 5), (0.4, 0, 2)], "proba double, event int, duration int")
    got = EV.dynamic_auc_ipcw(df, spark.createDataFrame([(3.0,)], "t double"), train).first()["auc"]
    assert got == pytest.approx(1.0 / (1.0 + 2.5))


def test_pvalues_have_a_small_relative_error(spark):
    chi2 = [0.0, 1e-12, 1e-4, 0.1, 0.124, 0.126, 1.0, 3.84, 8.0, 20.0, 78.0, 80.0, 100.0, 400.0, 1000.0]
    df = spark.createDataFrame([(c,) for c in chi2], "c double")
    for r in df.select("c", chi2_1df_pvalue("c").alias("p")).collect():
        assert r["p"] == pytest.approx(math.erfc(math.sqrt(r["c"] / 2)), rel=1e-10, abs=0)
    assert spark.sql("SELECT CAST(NULL AS DOUBLE) AS c").select(chi2_1df_pvalue("c")).first()[0] is None


def test_running_sums_order_long_keys_exactly(spark):
    # neighbouring keys are equal as doubles; equal keys follow ``ties``
    base = 1 << 60
    rows = [(base + i // 2, i % 2, 1) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, j int, v long")
    got = running_sums(df, "k", ["v"], num_ranges=5, ties=["j"]).collect()
    assert all(r["cum_v"] == 2 * (r["k"] - base) + r["j"] + 1 for r in got) and len(got) == 200


def test_permuted_copies_are_permutations(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(50)], "id long, x double")
    out = permuted_copies(df, ["x"], 3, keys=["id"]).toPandas()
    for _, g in out.groupby("repeat"):
        assert sorted(g.x) == [float(i) for i in range(50)] and sorted(g.id) == list(range(50))


def test_running_sums_split_a_hot_group(spark):
    # one group holds ~90 % of the rows; it is spread over all ranges
    rng = np.random.default_rng(9)
    g = np.where(rng.random(4000) < 0.9, 0, rng.integers(1, 4, 4000))
    pdf = pd.DataFrame({"g": g, "s": rng.permutation(4000).astype(float), "v": rng.integers(0, 3, 4000)})
    out = running_sums(spark.createDataFrame(pdf), "s", ["v"], group_cols=["g"], num_ranges=8)
    got = out.toPandas()
    exp = pdf.sort_values(["g", "s"]).assign(cv=lambda d: d.groupby("g").v.cumsum())
    m = exp.merge(got, on=["g", "s"])
    assert (m.cv == m.cum_v).all()


def test_join_lookup_falls_back_to_shuffle_join(spark):
    from survkit.operators.joins import join_lookup

    big = spark.createDataFrame([(i, f"r{i % 3}") for i in range(30)], "k long, region string")
    small = spark.createDataFrame([("r0", 1), ("r1", 2)], "region string, w int")
    a = sorted(join_lookup(big, small, ["region"]).collect())
    b = sorted(join_lookup(big, small, ["region"], max_rows=0).collect())
    assert a == b and len(a) == 30 and sum(1 for r in a if r["w"] is None) == 10


# ---------------------------------------------------------------- k-sample test, pairs, horizon scores

def _dense_ksample(rows):
    """The textbook statistic with the whole covariance matrix: (group, year or None) rows."""
    groups = sorted({g for g, _ in rows})
    o, e, v = np.zeros(len(groups)), np.zeros(len(groups)), np.zeros((len(groups), len(groups)))
    for y in sorted({y for _, y in rows if y is not None}):
        n = np.array([sum(1 for h, t in rows if h == g and (t is None or t >= y)) for g in groups], float)
        d = np.array([sum(1 for h, t in rows if h == g and t == y) for g in groups], float)
        o, e = o + d, e + d.sum() * n / n.sum()
        if n.sum() > 1:
            p = n / n.sum()
            v += d.sum() * (n.sum() - d.sum()) / (n.sum() - 1) * (np.diag(p) - np.outer(p, p))
    u = (o - e)[:-1]
    return float(u @ np.linalg.solve(v[:-1, :-1], u))


def test_ksample_equals_dense_matrix_form(spark):
    rng = np.random.default_rng(5)
    rows = [(f"g{int(g)}", None if y > 6 else 2000 + int(y)) for g, y in zip(rng.integers(0, 7, 400), rng.integers(0, 12, 400))]
    df = spark.createDataFrame([(g, "one", y) for g, y in rows], "many string, single string, failure_year int")
    got = {r["column_name"]: r for r in LR.ksample(df, ["many", "single"]).collect()}
    assert got["many"]["n_groups"] == 7 and got["many"]["dof"] == 6
    assert got["many"]["chi2"] == pytest.approx(_dense_ksample(rows), rel=1e-9)
    assert got["single"]["n_groups"] == 1 and (got["single"]["chi2"] is None or math.isnan(got["single"]["chi2"]))


def test_ksample_of_two_groups_equals_the_pair_test(spark):
    rng = np.random.default_rng(6)
    rows = [("ab"[int(g)], None if y > 5 else 2000 + int(y)) for g, y in zip(rng.integers(0, 2, 120), rng.integers(0, 9, 120))]
    df = spark.createDataFrame(rows, "grp string, failure_year int")
    assert LR.ksample(df, ["grp"]).first()["chi2"] == pytest.approx(LR.pairwise(df, "grp").first()["chi2"], rel=1e-9)


def test_ordered_pairs_are_all_pairs_once(spark):
    from survkit.operators.joins import ordered_pairs

    m = spark.createDataFrame([(p, f"m{i}") for p in "xy" for i in range(40)], "part string, m string")
    for part in (["part"], []):
        own = m if part else m.select("m").distinct()
        got = ordered_pairs(own.withColumnRenamed("m", "a"), own.withColumnRenamed("m", "b"), "a", "b", part).collect()
        assert len(got) == len(set(got)) == 780 * (2 if part else 1)


def test_join_lookup_is_bounded_by_bytes(spark):
    from survkit.operators.joins import join_lookup, measured

    big = spark.createDataFrame([("hot", i) for i in range(200)] + [("rare", 1), (None, 2)], "region string, v int")
    small = spark.createDataFrame([("hot", "x" * 50), ("other", "y")], "region string, note string")
    assert measured(small)[0] == 2 and measured(small)[1] > 50
    want = sorted(big.join(small, "region", "left").collect(), key=str)
    for how in ("left", "inner"):
        j = join_lookup(big, small, ["region"], how, max_bytes=10)
        assert "salt" not in j.columns and "BroadcastHint" not in j._jdf.queryExecution().logical().toString()
        assert sorted(j.collect(), key=str) == (want if how == "left" else [r for r in want if r["note"]])


def test_horizon_scores_equal_the_curves_ratio(spark):
    from pyspark.ml.classification import LogisticRegression

    from survkit.operators import models as M

    rng = np.random.default_rng(7)
    rows = [(f"a{i}", 1990 + int(s), float(x), int(d), int(e)) for i, (s, x, d, e) in enumerate(zip(rng.integers(0, 5, 60), rng.normal(size=60), rng.integers(0, 6, 60), rng.integers(0, 2, 60)))]
    ep = spark.createDataFrame(rows, "id string, last_failure_year int, x double, duration int, event int").withColumn("region", F.lit("r"))
    model = M.hazard_pipeline(LogisticRegression(labelCol="label", featuresCol="features", regParam=0.01), ["x"], ["region"]).fit(M.person_period(ep))
    keys = ["id", "last_failure_year"]
    want = {r["id"]: r["proba"] for r in M.horizon_risk(M.survival_curves(model, ep, 3, keys), 3, keys).collect()}
    scores = M.horizon_scores(model, ep, 3, keys)
    got = {r["id"]: r["proba"] for r in scores.collect()}
    assert got == pytest.approx(want, abs=1e-12)
    assert "Exchange" not in scores._jdf.queryExecution().executedPlan().toString()


def test_roc_curve_by_group_has_origin_and_end(spark):
    from survkit.operators import evaluate as EV

    df = spark.createDataFrame([("a", 0.9, 1), ("a", 0.5, 0), ("a", 0.5, 1), ("b", 0.4, 0)], "g string, proba double, event int")
    got = sorted(((r["g"], r["threshold"], r["fpr"], r["tpr"]) for r in EV.roc_curve(df, group_cols=["g"]).collect()), key=str)
    assert got == sorted([("a", None, 0.0, 0.0), ("a", 0.9, 0.0, 0.5), ("a", 0.5, 1.0, 1.0), ("b", None, 0.0, 0.0), ("b", 0.4, 1.0, None)], key=str)


def test_interval_labels_equal_pandas():
    import pandas as pd

    from survkit.functions.scalar import interval_labels

    r = np.random.default_rng(0)
    sets = [
        r.uniform(1995, 2003, 50), np.array([0.00012, 0.00031, 0.00047, 0.0009]), np.array([1e6, 1e6 + 1, 1e6 + 2.5]),
        np.array([1.0001, 1.0002, 1.0003, 1.0004, 1.0005]), np.array([-5.0, 0.0, 5.0, 12.0]), np.arange(1900, 2011, 10), np.array([7.0, 7.0, 7.0]),
    ]
    for x in sets:
        for n in (2, 4):
            got, edges = pd.cut(x, n, retbins=True)
            assert interval_labels(edges.tolist()) == [str(c) for c in got.categories]
    for x in sets[:-1]:
        got, edges = pd.qcut(x, 3, retbins=True, duplicates="drop")
        assert interval_labels(edges.tolist(), lowest=True) == [str(c) for c in got.categories]


def test_labels_of_sql_equal_python():
    import duckdb

    from survkit.functions.scalar import interval_labels

    for edges in ([1994.994, 1995.6, 1996.2], [0.00012, 0.00031, 0.00047], [-0.001, 0.0, 5.0], [1.0001, 1.0002, 1.00025], [850.25, 14710.0, 20000.5]):
        for lowest in (False, True):
            got = duckdb.connect().execute(f"SELECT {B.sql_labels(f'{edges}::DOUBLE[]', lowest)}").fetchone()[0]
            assert got == interval_labels(edges, lowest)


@pytest.mark.parametrize("error", [None, 0.1, 0.001])
def test_bracketed_quantiles_equal_numpy(spark, error):
    from survkit.operators.quantiles import column_quantiles

    r = np.random.default_rng(1)
    probs = [0.0, 0.001, 0.05, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]
    for x in (r.normal(size=3000), np.concatenate((np.full(2500, 3.0), r.uniform(size=500))), np.array([5.0]), np.array([1.0, 2.0]), r.integers(0, 4, 999).astype(float)):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double")
        got = {q["p"]: q["q"] for q in column_quantiles(df, "v", probs, error).collect()}
        assert np.allclose([got[p] for p in probs], np.quantile(x, probs))
    assert [q["q"] for q in column_quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]).collect()] == [None]


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1001])
def test_keyed_bijection(spark, n):
    from survkit.operators.permute import permuted

    rows = spark.range(n).select("id", *[permuted(F.col("id"), n, k, 5).alias(f"p{k}") for k in range(3)]).collect()
    images = [[r[f"p{k}"] for r in rows] for k in range(3)]
    assert all(sorted(x) == list(range(n)) for x in images)
    if n > 50:
        assert images[0] != images[1] != images[2] and abs(np.corrcoef(images[0], range(n))[0, 1]) < 0.3


def test_permuted_copies_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(f"k{i}", i, float(i * i)) for i in range(101)], "id string, a int, b double")
    one, other = (sorted(map(tuple, permuted_copies(x, ["a", "b"], 2, ["id"], seed=4).collect())) for x in (df.coalesce(1), df.repartition(9)))
    assert one == other and len(one) == 404


def test_concordance_of_other_times(spark):
    r = np.random.default_rng(2)
    t, e, s = r.uniform(0, 5, 60).round(1), r.integers(0, 2, 60), r.integers(0, 9, 60)
    rows = [(float(a), int(b), float(c)) for a, b, c in zip(t, e, s)]
    df = spark.createDataFrame(rows + [(None, 1, 1.0), (1.0, None, 2.0), (1.0, 1, None)], "duration double, event int, proba double")
    assert EV.concordance(df).first()["c_index"] == pytest.approx(_brute_cindex(t, e, s))
    far = spark.createDataFrame([(1, 1, 5.0), (1 << 40, 0, 2.0), (1 << 40, 1, 7.0)], "duration long, event int, proba double")
    assert EV.concordance(far).first()["comparable"] == 3


def test_short_numbers_are_dealt_without_a_join(spark, monkeypatch):
    from survkit.operators import permute

    monkeypatch.setattr(permute, "LEAST_BLOCK", 30)
    rows = [(f"k{i}", i % 7, None if i % 5 == 0 else i % 3, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "id string, a short, b byte, c int")
    plan = permuted_copies(df, ["a", "b"], 3, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    one, other = (permuted_copies(x, ["a", "b"], 3, ["id"], seed=4) for x in (df.coalesce(1), df.repartition(9)))
    assert one.dtypes == [("feature", "string"), ("repeat", "int"), *df.dtypes]
    one, other = (sorted(map(tuple, x.collect()), key=str) for x in (one, other))
    assert one == other and len(one) == 2 * 3 * 2000
    by = {}
    for f, r, i, a, b, c in one:
        by.setdefault((f, r), {})[i] = a, b, c
    images = set()
    for (f, r), got in by.items():
        assert all(got[i][2] == c and got[i][f == "a"] == (b if f == "a" else a) for i, a, b, c in rows)
        at = 0 if f == "a" else 1
        assert sorted(map(str, (v[at] for v in got.values()))) == sorted(str(x[1 + at]) for x in rows)
        images.add(tuple(str(got[i][at]) for i, *_ in rows))
        same = np.mean([got[x[0]][at] == x[1 + at] for x in rows])
        assert abs(same - (1 / 7 if f == "a" else 0.253)) < 0.05
    assert len(images) == 6
    assert permuted_copies(df.where("false"), ["a"], 2, ["id"]).count() == 0
