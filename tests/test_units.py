"""Invariants, brute-force comparisons and negative controls."""

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.functions import expr as E
from evenhand.operators import aggregate as A
from evenhand.operators import core
from evenhand.operators import harmonise as H
from evenhand.operators import joins as J
from evenhand.operators import metrics as M
from evenhand.operators import models as L
from evenhand.operators import quality as Q
from evenhand.operators import resample as B
from evenhand.operators import selection as S
from evenhand.operators import setops as U
from evenhand.operators import splits as K
from evenhand.operators import stattests as T
from evenhand.operators import windows as Wn
from evenhand.session import scratch_path
from evenhand.sources import tables as Src
from evenhand.streaming.incremental import process_new_files

TIES = [("a", "A", 1, 0.5), ("b", "A", 0, 0.5), ("c", "A", 1, 0.9), ("d", "A", 0, 0.1), ("e", "B", 1, 0.5), ("f", "B", 0, 0.2), ("g", "C", 1, 0.7), ("h", "C", 1, 0.7)]


@pytest.fixture(scope="module")
def obs(spark):
    rng = np.random.default_rng(3)
    n = 200
    site = np.array(["A", "B", "C"])[rng.choice(3, n, p=[0.7, 0.2, 0.1])]
    y = (rng.random(n) < np.where(site == "A", 0.7, 0.4)).astype(int)
    score = np.round(rng.normal(y * 0.6, 1.0), 1)
    rows = [(int(i), str(site[i]), int(y[i]), float(score[i]), float(rng.integers(1, 5))) for i in range(n)]
    return spark.createDataFrame(rows, "key bigint, site string, y int, score double, w double").cache()


@pytest.fixture(scope="module")
def feats(spark):
    rng = np.random.default_rng(5)
    n, p = 120, 6
    site = np.array(["A", "B", "C"])[rng.integers(0, 3, n)]
    y = rng.integers(0, 2, n)
    x = rng.normal(0, 1, (n, p)) + (site == "B")[:, None] * 1.5 + y[:, None] * np.linspace(0, 1, p)
    x[:, 5] = x[:, 4] * 0.98 + rng.normal(0, 0.05, n)
    rows = [(int(i), str(site[i]), int(y[i]), j, float(x[i, j])) for i in range(n) for j in range(p)]
    return spark.createDataFrame(rows, "key bigint, site string, y int, feature int, value double").cache(), x, y, site


def brute_auc(y, s, w):
    y, s, w = map(np.asarray, (y, s, w))
    a, b = y == 1, y == 0
    if not a.any() or not b.any():
        return None
    win = (s[a][:, None] > s[b][None, :]) + 0.5 * (s[a][:, None] == s[b][None, :])
    ww = w[a][:, None] * w[b][None, :]
    return float((win * ww).sum() / ww.sum())


def test_weighted_auc_matches_all_pairs(obs, both_paths):
    p = obs.toPandas()
    assert M.weighted_auc(obs, w="w").first()["auc"] == pytest.approx(brute_auc(p.y, p.score, p.w), abs=1e-12)
    for r in M.auc_by_group(obs, "site").collect():
        g = p[p.site == r["site"]]
        assert r["n"] == len(g) and r["auc"] == pytest.approx(brute_auc(g.y, g.score, np.ones(len(g))), abs=1e-12)


def test_tied_scores_and_single_class_site(spark, both_paths):
    d = spark.createDataFrame(TIES, "key string, site string, y int, score double")
    by = {r["site"]: r["auc"] for r in M.auc_by_group(d, "site").collect()}
    assert by == {"A": pytest.approx(0.875), "B": 1.0, "C": None}
    assert M.mean_group_auc(d, "site").first()["n_groups"] == 2
    ranks = {r["key"]: r["mid_rank"] for r in T.mid_ranks(d, [], "score").collect()}
    assert ranks["a"] == ranks["b"] == ranks["e"] == 4.0 and ranks["g"] == 6.5


def test_site_only_score_is_exactly_half(obs, both_paths):
    prev = obs.groupBy("site").agg(F.avg("y").alias("prev"))
    d = obs.drop("score").join(prev, "site").withColumnRenamed("prev", "score")
    assert M.site_balanced_auc(d).first()["sb_auc"] == pytest.approx(0.5, abs=1e-12)
    assert M.weighted_auc(d).first()["auc"] > 0.55


def test_average_precision(obs, both_paths):
    p = obs.toPandas()
    want, tp, prev = 0.0, 0, 0.0
    for t in sorted(p.score.unique(), reverse=True):
        hit = p[p.score >= t]
        tp = (hit.y == 1).sum()
        rec = tp / (p.y == 1).sum()
        want += (rec - prev) * tp / len(hit)
        prev = rec
    assert M.pr_auc(obs).first()["pr_auc"] == pytest.approx(want, abs=1e-12)


def test_quantiles(obs, both_paths):
    p = obs.toPandas()
    got = {r["site"]: r for r in core.quantiles(obs, ["site"], "score", {"a": 0.1, "b": 0.5, "c": 0.975}).collect()}
    for s, g in p.groupby("site"):
        assert [got[s][c] for c in "abc"] == pytest.approx(list(np.percentile(g.score, [10, 50, 97.5])), abs=1e-12)
    ex = core.quantiles(obs, ["site"], "score", {"a": 0.25, "b": 0.5, "c": 0.75}, "exclusive")
    for r in ex.collect():
        assert [r["a"], r["b"], r["c"]] == pytest.approx(statistics.quantiles(p[p.site == r["site"]].score, n=4), abs=1e-12)


def test_row_numbers_are_total_per_group(obs, both_paths):
    d = core.row_numbers(obs, ["site"], "score", ["key"], out="rn", total="n").toPandas()
    for _, g in d.groupby("site"):
        g = g.sort_values(["score", "key"])
        assert list(g.rn) == list(range(1, len(g) + 1)) and (g.n == len(g)).all()


def test_kfold_contract(obs, both_paths):
    split = K.stratified_kfold(obs, "key", ["site", "y"], 5, 1)
    assert U.covering_gaps(split, obs).count() == 0
    sizes = split.where("role = 'test'").join(obs, "key").groupBy("fold", "site", "y").count().toPandas()
    spread = sizes.groupby(["site", "y"])["count"].agg(["min", "max"])
    assert (spread["max"] - spread["min"]).max() <= 1
    again = K.stratified_kfold(obs.orderBy(F.desc("key")), "key", ["site", "y"], 5, 1)
    assert split.exceptAll(again).count() == 0


def test_strata_weights(obs):
    w = K.strata_weights(obs.drop("w"), ["site", "y"]).toPandas()
    assert w.weight.mean() == pytest.approx(1.0)
    totals = w.groupby(["site", "y"]).weight.sum()
    assert totals.max() == pytest.approx(totals.min())


def test_holdout_bounds(spark):
    d = spark.createDataFrame([(i, 1 if i < 3 else 0) for i in range(43)], "key int, y int")
    c = K.holdout_split(d, "key", "y", 0.01, min_val=1, min_train=2).groupBy("y", "role").count().toPandas()
    n = {(r.y, r.role): r["count"] for _, r in c.iterrows()}
    assert n == {(1, "val"): 1, (1, "train"): 2, (0, "val"): 1, (0, "train"): 39}


def test_bootstrap_keeps_stratum_sizes(obs):
    d = B.draws(obs, ["site", "y"], "key", 5, 1)
    assert d.count() == 5 * obs.count()
    sizes = obs.groupBy("site", "y").count()
    drawn = d.groupBy("b", "site", "y").agg(F.count(F.lit(1)).alias("m"))
    assert drawn.join(sizes, ["site", "y"]).where("m <> count").count() == 0
    assert drawn.count() == 5 * sizes.count()


def test_paired_bootstrap_of_equal_scores_is_zero(obs):
    r = B.paired_bootstrap_summary(obs.withColumn("again", F.col("score")), "score", "again", b=10).collect()
    assert all(x["observed"] == 0 and x["lo"] == 0 and x["hi"] == 0 and x["includes_zero"] for x in r)


def test_softmax_and_concentration(obs, both_paths):
    a = Wn.bag_softmax(obs, "site", "score").groupBy("site").agg(F.sum("alpha").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in a)
    even = obs.withColumn("u", F.lit(1.0) / F.count(F.lit(1)).over(__import__("pyspark").sql.Window.partitionBy("site")))
    for r in Wn.concentration(even, "site", "u", "key").collect():
        assert r["entropy"] == pytest.approx(1.0) and r["max_times_n"] == pytest.approx(1.0)


def test_combinations(spark):
    items = spark.createDataFrame([(c,) for c in "abcd"], "item string")
    c = U.all_combinations(items, "item")
    assert c.select("combo").distinct().count() == 15 and c.count() == 4 * 8


def test_jaccard_of_empty_sets(spark):
    m = spark.createDataFrame([("a", None), ("b", None), ("c", 1), ("d", 1)], "g string, i int")
    got = {(r["a"], r["b"]): r["jaccard"] for r in U.pairwise_jaccard(m, "g", "i", empty=1.0).collect()}
    assert got[("a", "b")] == 1.0 and got[("c", "d")] == 1.0 and got[("a", "c")] == 0.0
    assert {r["jaccard"] for r in U.pairwise_jaccard(m, "g", "i").collect() if (r["a"], r["b"]) == ("a", "b")} == {None}


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_nearest_neighbours_exact(spark, feats, block_rows):
    long, x, _, site = feats
    wide = long.groupBy("key", "site").agg(F.transform(F.sort_array(F.collect_list(F.struct("feature", "value"))), lambda z: z["value"]).alias("f"))
    got = {r["key"]: r for r in J.nearest_neighbours(wide, "key", "site", "f", block_rows).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    same = site[:, None] == site[None]
    assert len(got) == len(x)
    for i in range(len(x)):
        assert got[i]["d_within"] == pytest.approx(np.where(same, d, np.inf)[i].min(), abs=1e-9)
        assert got[i]["d_across"] == pytest.approx(np.where(~same, d, np.inf)[i].min(), abs=1e-9)


def numpy_combat(x, site, balanced, y):
    loc, var, n = {}, {}, {}
    for s in sorted(set(site)):
        m = site == s
        if balanced:
            m1, m0 = x[m & (y == 1)].mean(0), x[m & (y == 0)].mean(0)
            loc[s] = (m1 + m0) / 2
            var[s] = (((x[m & (y == 1)] - m1) ** 2).sum(0) + ((x[m & (y == 0)] - m0) ** 2).sum(0)) / m.sum()
        else:
            loc[s], var[s] = x[m].mean(0), x[m].var(0)
        n[s] = 1 if balanced else m.sum()
    tot = sum(n.values())
    alpha = sum(n[s] * loc[s] for s in n) / tot
    sigma = np.sqrt(sum(n[s] * var[s] for s in n) / tot)
    return {s: (alpha, sigma, (loc[s] - alpha) / sigma, var[s] / sigma**2) for s in n}


@pytest.mark.parametrize("balanced", [False, True])
def test_combat_matches_numpy(feats, balanced):
    long, x, y, site = feats
    want = numpy_combat(x, site, balanced, y)
    for r in H.combat_fit(long, balanced=balanced, eb=False).collect():
        a, s, g, d = (v[r["feature"]] for v in want[r["site"]])
        assert (r["alpha"], r["sigma"], r["gamma"], r["delta"]) == pytest.approx((a, s, g, d), abs=1e-9)


def test_combined_state_equals_step_by_step(feats):
    long, *_ = feats
    d = long.withColumn("role", F.when(F.col("key") % 4 == 0, "test").otherwise("train"))
    d = d.withColumn("value", F.when((F.col("key") * 7 + F.col("feature")) % 11 != 0, F.col("value")))
    fast = H.fit_apply(d, [], "combat")
    s = H.impute(d, H.median_fit(H.train_rows(d)))
    s = H.keep_features(s, H.variance_screen(H.train_rows(s)))
    s = H.combat_apply(s, H.combat_fit(H.train_rows(s)))
    slow = H.zscore_apply(s, H.zscore_fit(H.train_rows(s))).withColumnRenamed("value", "want")
    gap = fast.join(slow.select("key", "feature", "want"), ["key", "feature"]).agg(F.max(F.abs(F.col("value") - F.col("want"))), F.count(F.lit(1))).first()
    assert gap[0] < 1e-9 and gap[1] == d.count()


def test_fit_uses_training_rows_only(feats):
    long, *_ = feats
    d = long.withColumn("role", F.when(F.col("key") % 3 == 0, "test").otherwise("train"))
    bent = d.withColumn("value", F.when(F.col("role") == "test", F.col("value") + 50).otherwise(F.col("value")))
    state = lambda f: {(r["site"], r["feature"]): (r["mul"], r["add"]) for r in H.fit_state(f).collect()}
    base = state(d)
    assert state(bent) == base
    assert state(bent.withColumn("role", F.lit("train"))) != base


def test_prior_shift_matches_plain_iteration(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.beta(5, 2, 300), rng.beta(2, 6, 100)])
    pi = 0.5
    for _ in range(100):
        q = pi / 0.5 * p / (pi / 0.5 * p + (1 - pi) / 0.5 * (1 - p))
        done, pi = abs(q.mean() - pi) < 1e-6, q.mean()
        if done:
            break
    d = spark.createDataFrame([("x", float(v)) for v in p], "g string, p double")
    assert H.prior_shift_em(d, "g").first()["pi"] == pytest.approx(pi, abs=1e-10)


def test_mrmr_and_prune_against_brute_force(feats):
    long, x, y, _ = feats
    f = np.array([sum((y == c).sum() * (x[y == c, j].mean() - x[:, j].mean()) ** 2 for c in (0, 1)) /
                  (sum(((x[y == c, j] - x[y == c, j].mean()) ** 2).sum() for c in (0, 1)) / (len(y) - 2)) for j in range(x.shape[1])])
    r = np.abs(np.corrcoef(x.T))
    order = [int(f.argmax())]
    while len(order) < 4:
        left = [j for j in range(x.shape[1]) if j not in order]
        order.append(max(left, key=lambda j: (f[j] - r[j, order].mean(), -j)))
    vec = H.to_vectors(long, ["key"])
    corr = S.abs_corr_matrix(vec, "values")
    got = S.mrmr_rank(S.anova_f(long), corr, [], 4).orderBy("position").collect()
    assert [g["feature"] for g in got] == order
    assert {(c["i"], c["j"]): c["r"] for c in corr.collect()} == {(i, j): pytest.approx(r[i, j], abs=1e-10) for i in range(6) for j in range(i + 1, 6)}
    kept = {k["feature"] for k in S.corr_prune_topk(S.within_site_auc_rank(long), corr, [], 0.9, 25).collect()}
    assert len(kept & {4, 5}) == 1 and len(kept) == 5


def test_logistic_penalty_scale(spark, feats):
    from pyspark.ml.functions import array_to_vector

    long, x, y, _ = feats
    vec = H.to_vectors(long, ["key", "y"]).withColumn("_x", array_to_vector("values"))
    model = L.fit_logistic(vec, 0.5, features="_x")
    b, b0 = np.zeros(x.shape[1]), 0.0
    for _ in range(50):
        m = 1 / (1 + np.exp(-(x @ b + b0)))
        xx = np.c_[x, np.ones(len(x))]
        pen = np.diag([1 / 0.5] * x.shape[1] + [0.0])
        step = np.linalg.solve((xx * (m * (1 - m))[:, None]).T @ xx + pen, xx.T @ (y - m) - pen @ np.r_[b, b0])
        b, b0 = b + step[:-1], b0 + step[-1]
    assert model.coefficients.toArray() == pytest.approx(b, abs=1e-3)


def test_calibration_of_true_probabilities(spark):
    rng = np.random.default_rng(2)
    p = rng.uniform(0.05, 0.95, 4000)
    d = spark.createDataFrame([(float(np.round(v, 3)), int(rng.random() < v)) for v in p], "p double, y int")
    r = M.calibration(d).first()
    assert abs(r["slope"] - 1) < 0.15 and abs(r["intercept"]) < 0.15
    a, b, ok = L.platt_fit(d, "p")
    assert ok and a == pytest.approx(r["slope"], abs=1e-6)
    assert L.platt_fit(d.withColumn("y", F.lit(1)), "p") == (1.0, 0.0, False)


def test_line_fit_reaches_the_least_loss_where_whole_steps_swing(spark):
    import duckdb
    from evenhand.plans import catalog, frames as X
    from tools.compare import TABLES

    sf = "/root/testdata/sf0.1"
    d = X.prob_pair(spark, sf)
    r = np.array(d.select("pa", "y").collect(), dtype=float)
    p = np.clip(r[:, 0], 1e-6, 1 - 1e-6)
    z, y = np.log(p / (1 - p)), r[:, 1]
    a, b, ok = L.platt_fit(d, "pa")
    m = 1 / (1 + np.exp(-(a * z + b)))
    assert ok and abs((y - m).sum()) < 1e-4 and abs(((y - m) * z).sum() - a / 1e6) < 1e-4
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    n, slope, _ = con.execute(catalog()["calibration_slope_intercept"].sql).fetchone()
    assert n == len(y) and slope == pytest.approx(a, abs=1e-4)
    shown = np.array(con.execute(catalog()["platt_calibrate"].sql.replace("SELECT * REPLACE", "SELECT key, p_cal FROM (SELECT * REPLACE") + ") ORDER BY key").fetchall())
    want = np.array(d.select("key", L.platt_apply("pa", a, b)).orderBy("key").collect(), dtype=float)
    assert np.abs(shown - want).max() < 1e-4


def test_fourier_features_approximate_the_kernel(spark):
    from pyspark.ml.functions import vector_to_array

    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (20, 3))
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "key int, f array<double>")
    z = np.array([r["z"] for r in L.fourier_map(d, "f", 3, 0.3, 4000).orderBy("key").select(vector_to_array("features").alias("z")).collect()])
    want = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(z @ z.T - want).max() < 0.1


def test_capped_elastic_net_caps(feats):
    long, *_ = feats
    d = H.to_vectors(long, ["key", "y"])
    s = L.capped_elastic_net(d, d, 1.0, 0.5, cap=2)
    assert s.select("n_selected").distinct().collect()[0][0] == 2
    none = L.capped_elastic_net(d, d, 1e-6, 1.0)
    assert none.select("n_selected", "score").distinct().count() == 1


def test_mann_whitney_p(spark):
    d = spark.createDataFrame([(float(v), 1) for v in range(10, 30)] + [(float(v), 0) for v in range(0, 22)], "value double, y int")
    r = T.mann_whitney(d).first()
    u = sum((a > b) + 0.5 * (a == b) for a in range(10, 30) for b in range(22))
    assert r["u"] == u and r["auc"] == pytest.approx(u / 440) and 0 < r["p"] < 0.001


def test_contingency_with_an_empty_cell(spark):
    rows = [("x", 0)] * 8 + [("x", 1)] * 2 + [("y", 1)] * 5
    r = T.chi2_independence(spark.createDataFrame(rows, "a string, b int"), "a", "b").first()
    o, e = np.array([[8, 2], [0, 5]]), np.outer([10, 5], [8, 7]) / 15
    assert r["chi2"] == pytest.approx(((np.abs(o - e) - 0.5) ** 2 / e).sum()) and r["df"] == 1
    three = T.chi2_independence(spark.createDataFrame([*rows, ("z", 0)], "a string, b int"), "a", "b").first()
    o, e = np.array([[8, 2], [0, 5], [1, 0]]), np.outer([10, 5, 1], [9, 7]) / 16
    assert three["chi2"] == pytest.approx(((o - e) ** 2 / e).sum()) and three["df"] == 2


def test_bh_rejects_step_up(spark, both_paths):
    p = [0.001, 0.012, 0.014, 0.041, 0.2, 0.5, 0.6, 0.7, 0.8, 0.9]
    d = spark.createDataFrame(list(enumerate(p)), "feature int, p double")
    assert sorted(r["feature"] for r in T.bh_fdr(d).where("reject").collect()) == [0, 1, 2]


def test_rank_tests_of_values_that_differ_in_the_last_bit_if_computed_again(spark):
    import random

    swing = F.udf(lambda v: v * (1 + random.randrange(8) * 2.0**-51), "double").asNondeterministic()
    rng = np.random.default_rng(3)
    rows = [(f"S{i % 4}", float(v)) for i, v in enumerate(rng.normal(size=400))]
    d = spark.createDataFrame(rows, "site string, value double")
    want, got = T.kruskal_wallis(d).first(), T.kruskal_wallis(d.withColumn("value", swing("value"))).first()
    assert got["n"] == 400 and got["h"] == pytest.approx(want["h"], abs=1e-9)
    p = spark.createDataFrame([(i, 0.001 + i * 1e-5) for i in range(200)], "feature int, p double")
    for _ in range(3):
        assert T.bh_fdr(p.withColumn("p", swing("p"))).where("reject").count() == 200


def test_gap_stats_flags_even_spacing(spark):
    d = spark.createDataFrame([("a", 0.0), ("a", 2.0), ("a", 2.0001), ("a", 4.0), ("b", 0.0), ("b", 1.0), ("b", 5.0)], "k string, v double")
    g = {r["k"]: r for r in Wn.gap_stats(d, "k", "v").collect()}
    assert g["a"]["n_gaps"] == 2 and g["a"]["uniform"] and not g["b"]["uniform"] and g["b"]["median_gap"] == 2.5


def test_adaptive_k(spark, both_paths):
    rows = [(f"n{n}", i, float(i)) for n in (1, 2, 25, 200) for i in range(n)]
    f = Wn.adaptive_top_bottom(spark.createDataFrame(rows, "bag string, inst int, s double"), "bag", "s", "inst")
    k = {r["bag"]: (r["k"], r["t"], r["b"]) for r in f.groupBy("bag").agg(F.max("k").alias("k"), F.count_if("is_top").alias("t"), F.count_if("is_bottom").alias("b")).collect()}
    assert k == {"n1": (0, 0, 0), "n2": (1, 1, 1), "n25": (2, 2, 2), "n200": (8, 8, 8)}


def test_text_rules_and_parsing(spark):
    d = spark.createDataFrame([(" Red oak",), ("blue ash",), ("red blue",), (None,)], "t string")
    rules = [("contains", "red", 1, "blue"), ("startswith", "blue", 0)]
    assert [r[0] for r in d.select(E.map_label_rules("t", rules)).collect()] == [1, 0, None, None]
    e = spark.createDataFrame([("063Y", "120\\130", " YES ", " Unknown ", "St. Mary's (A)")], "a string, b string, c string, d string, e string")
    r = e.select(E.parse_age("a"), E.to_number("b", "\\"), E.parse_bool("c"), E.normalise_category("d"), E.slugify("e")).first()
    assert tuple(r) == (63.0, 120.0, True, None, "st__mary_s__a")


def test_finite_turns_nan_and_inf_to_null(spark):
    d = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (-float("inf"),), (None,)], "v double")
    assert A.mean_sd(d, [], "v").first() == (1.0, 0.0, 1)


def test_csv_with_bom_and_bad_numbers(spark):
    path = scratch_path(spark, "bom") + ".csv"
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write("id,v\n007,1.5\n008,x\n")
    assert [tuple(r) for r in Src.read_table_csv(spark, path, ["id"], ["v"]).collect()] == [("007", 1.5), ("008", None)]


def test_stream_processes_each_file_once(spark):
    src, out, ck = (scratch_path(spark, n) for n in ("src", "out", "ck"))
    d = spark.range(10)
    d.write.parquet(src)
    for _ in range(2):
        process_new_files(spark, src, d.schema, out, ck, lambda x: x)
    assert spark.read.parquet(out).count() == 10


def test_frozen_table_that_moved_raises(spark):
    d = spark.range(5)
    frozen = Q.freeze([("t", d)])
    assert Q.verify_frozen([("t", spark.range(5).orderBy(F.desc("id")))], frozen).first()["intact"]
    with pytest.raises(Exception, match="frozen table moved: t"):
        Q.verify_frozen([("t", spark.range(6))], frozen).collect()


def test_scoring_twice_is_refused(spark):
    pred = spark.createDataFrame([(1, 0.3), (2, 0.8)], "key int, p double")
    lab = spark.createDataFrame([(1, 0), (2, 1)], "key int, y int")
    frozen, out = Q.freeze([("predictions", pred)]), scratch_path(spark, "once")
    assert Q.score_once(pred, frozen, lab, "key", out).count() == 2
    with pytest.raises(Exception, match="(?i)exist"):
        Q.score_once(pred, frozen, lab, "key", out)


def test_gate_needs_both_conditions_and_known_metrics(spark):
    m = spark.createDataFrame([("auc", 0.7), ("gap", 0.2)], "metric string, observed double")
    schema = "id int, metric string, op string, value double, and_metric string, and_op string, and_value double"
    rules = spark.createDataFrame([(1, "auc", ">=", 0.6, "gap", "<", 0.1), (2, "auc", ">", 0.6, None, None, None), (3, "none", ">", 0.0, None, None, None)], schema)
    got = {r["id"]: r["pass"] for r in Q.evaluate_gate(m, rules).collect()}
    assert got == {1: False, 2: True, 3: False}


def test_text_keys_and_ties_rank_alike_in_any_number_of_cells(spark, both_paths):
    d = spark.range(500).select(F.when(F.col("id") % 10 < 9, "hot").alias("site"), F.concat(F.lit("k"), F.col("id") % 3).alias("v"), F.col("id").cast("string").alias("tie"))
    got = core.row_numbers(d, ["site"], "v", ["tie"], out="rn", total="n").collect()
    rows = [(r["site"], r["v"], r["tie"]) for r in d.collect()]
    for site in ("hot", None):
        own = sorted(r for r in rows if r[0] == site) if site else sorted(((r[1], r[2]) for r in rows if r[0] is None))
        own = [r[-2:] for r in own]
        assert [(r["v"], r["tie"]) for r in sorted((g for g in got if g["site"] == site), key=lambda r: r["rn"])] == own
        assert {r["n"] for r in got if r["site"] == site} == {len(own)}


def test_equal_scores_fill_several_cells(spark, both_paths):
    d = spark.range(400).select(F.lit("a").alias("bag"), F.lit(0.25).alias("w"), F.col("id").alias("inst"))
    r = Wn.concentration(d, "bag", "w", "inst").first()
    assert r["n"] == 400 and abs(r["top_mass"] - 10.0) < 1e-9


def test_apply_refuses_an_unseen_site(spark):
    d = spark.createDataFrame([(i, s, i % 2, f, float(i * 7 % 5 + f)) for i in range(12) for s in "ab" for f in range(3)], "key int, site string, y int, feature int, value double")
    params = H.combat_fit(d.where("site = 'a'"), eb=False)
    with pytest.raises(Exception, match="no harmoniser state for site b"):
        H.combat_apply(d, params).collect()
    assert H.combat_apply(d.where("site = 'a'"), params).count() == 36


def test_draws_keep_strata_with_bars_and_nulls_apart(spark):
    from evenhand.operators.resample import draws

    rows = [(1, "a|b", "c"), (2, "a", "b|c"), (3, None, "a"), (4, "a", None), (5, None, "a"), (6, "a", None)]
    got = draws(spark.createDataFrame(rows, "key int, s string, t string"), ["s", "t"], "key", 3, 1)
    assert got.count() == 18
    assert got.groupBy("b", "s", "t").count().where("count NOT IN (1, 2)").count() == 0


def test_indented_records_are_read(spark, tmp_path):
    from evenhand.sources.tables import read_entity_records

    for i in range(3):
        (tmp_path / f"r{i}.json").write_text('{\n  "id": %d,\n  "meta": {\n    "kind": "x"\n  }\n}\n' % i)
    d = read_entity_records(spark, str(tmp_path), "id int, meta struct<kind:string>", {"id": "id", "kind": "meta.kind"}, multi_line=True)
    assert sorted(r["id"] for r in d.collect()) == [0, 1, 2]


def test_fingerprint_tells_fields_apart(spark):
    one = lambda a, b: Q.frame_fingerprint(spark.createDataFrame([(a, b)], "x string, y string")).first()["fingerprint"]
    assert len({one("a|b", "c"), one("a", "b|c"), one(None, "c"), one("<null>", "c"), one("a1:b", ""), one("", "a1:b")}) == 6


def test_fixed_bins_keep_every_row(spark):
    d = spark.createDataFrame([(v,) for v in (-5.0, 0.0, 9.9, 10.0, 11.0, None)], "v double")
    assert {r["bin"]: r["n"] for r in Wn.fixed_bins(d, [], "v", 0.0, 10.0, 2).collect()} == {-1: 1, 0: 1, 1: 2, 2: 1, None: 1}
    assert sum(r["n"] for r in Wn.fixed_bins(d, [], "v", None, None, 4).collect()) == 6


def test_text_features_and_keys(spark):
    ranked = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "feature string, rank int")
    corr = spark.createDataFrame([("a", "b", 0.95), ("a", "c", 0.1), ("b", "c", 0.2)], "i string, j string, r double")
    assert [r["feature"] for r in S.corr_prune_topk(ranked, corr).orderBy("position").collect()] == ["a", "c"]
    f = spark.createDataFrame([("a", 5.0), ("b", 4.9), ("c", 1.0)], "feature string, f double")
    assert [r["feature"] for r in S.mrmr_rank(f, corr, k=3).orderBy("position").collect()] == ["a", "b", "c"]
    sizes = spark.createDataFrame([(f"k{i}", float(i % 4)) for i in range(9)], "key string, size double")
    got = {r["key"]: r["priority"] for r in Wn.pick_probes(sizes, "key", "size").collect()}
    assert got["k0"] == 1 and got["k3"] == 2 and len(got) == 6


def test_violated_expectations_fail_on_request(spark):
    from evenhand.operators.clean import with_entity_key

    d = spark.createDataFrame([("x", "1"), ("y", "1"), ("x", "2")], "site string, id string")
    assert with_entity_key(d, "site", "id").count() == 3
    with pytest.raises(Exception, match="local id of several sites: 1"):
        with_entity_key(d, "site", "id", fail=True).collect()
    assert with_entity_key(d.where("id = '2'"), "site", "id", fail=True).count() == 1
    a = spark.createDataFrame([(1, 0, 0.2), (2, 1, 0.5)], "key int, y int, score double")
    b = spark.createDataFrame([(1, 0, 0.3), (2, 0, 0.4)], "key int, y int, score double")
    assert J.paired_predictions(a, b, "key", "y", "score").where("NOT sound").count() == 1
    with pytest.raises(Exception, match="unsound pair: 2"):
        J.paired_predictions(a, b, "key", "y", "score", fail=True).collect()


@pytest.mark.parametrize("piece", [1 << 27, 5000])
def test_file_digests_in_pieces(spark, tmp_path, monkeypatch, piece):
    import gzip
    import hashlib

    from evenhand.sources import digest, tables

    rnd = np.random.default_rng(3)
    noise = rnd.integers(0, 256, 40_000, dtype=np.uint8).tobytes()
    bodies = {"noise.parquet": noise, "feed.parquet": b"\n", "feeds.parquet": b"a\r\n\n\n", "mark.parquet": b"\xef\xbb\xbf", "marked.parquet": b"\xef\xbb\xbfx\ny\n",
              "bare.parquet": noise[:999] + b"\nz", "zeros.parquet": bytes(30_000), "deep/er/noise.parquet": noise[7:] + b"\n", "a.gz": gzip.compress(noise[:100]), "space in it.parquet": b"q"}
    for name, body in bodies.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    rounds, step = [], digest.advance
    monkeypatch.setattr(digest, "advance", lambda state, part: rounds.append(part.agg(F.sum("size")).first()[0]) or step(state, part))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = sorted(tuple(r) for r in tables.file_digests(spark, str(tmp_path), piece=piece).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((n.rpartition("/")[2], len(b), hashlib.sha256(b).hexdigest()) for n, b in bodies.items())
    assert len(rounds) == (1 if piece > 40_000 else 8)

