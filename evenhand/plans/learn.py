"""Estimators, nested selection, fusion and diagnostics over embeddings, documents and events."""

from __future__ import annotations


from pyspark.sql import functions as F

from evenhand.operators import diagnose as D
from evenhand.operators import harmonise as H
from evenhand.operators import metrics as M
from evenhand.operators import models as L
from evenhand.operators import search as S
from evenhand.operators import selection as R
from evenhand.operators import setops as U
from evenhand.operators import splits as K
from evenhand.plans import frames as X
from evenhand.plans.evaluate import CONF, ERFC, NEWTON, RATES, _auc_sql, _kw_sql, _mw_sql, draws_sql
from evenhand.plans.fit import ANOVA, COMBAT, CORR
from evenhand.plans.registry import query
from evenhand.session import cut_lineage

GRID = L.candidate_grid()


@query("candidate_grid", ctes=["emb_split"], rounded=["setting"], sql="""
WITH g AS (SELECT 0 AS part, 'logreg' AS kind, k, c FROM unnest([10, 25, 50]) a(k), unnest([0.01, 0.1, 1.0]) b(c) UNION ALL
  SELECT 1, 'svm', k, c FROM unnest([10, 25, 50]) a(k), unnest([0.1, 1.0, 10.0]) b(c) UNION ALL SELECT 2, 'gbt', k, c FROM unnest([10, 25, 50]) a(k), unnest([4.0, 8.0]) b(c) UNION ALL
  SELECT 3, 'ridge_all', 0, c FROM unnest([0.0001, 0.0003, 0.001, 0.003, 0.01]) b(c)),
n AS (SELECT fold, count(*) AS n_train FROM emb_split WHERE role = 'train' GROUP BY fold)
SELECT fold, n_train, (row_number() OVER (PARTITION BY fold ORDER BY part, k, c) - 1)::INT AS candidate, kind, k::INT AS k, c::DOUBLE AS setting FROM n, g""")
def _(spark, sf):
    n = X.emb_split(spark, sf).where("role = 'train'").groupBy("fold").agg(F.count(F.lit(1)).alias("n_train"))
    return L.fits_of(n)


def _weighted_rows(spark, sf):
    """Embedding rows with their fold-0 role and balanced training weights."""
    d = X.emb_split(spark, sf).where("fold = 0").join(X.wide_emb(spark, sf), "key").withColumnRenamed("features", "values")
    w = K.strata_weights(d.where("role = 'train'"), ["site", "y"], [], "w")
    return d.join(w.select("key", "w"), "key", "left")


def sparse_sql(name, rows, c, l1, width):
    """CTE ``name`` (i, fold, b, m): accelerated gradient steps on the penalised loss, soft thresholds for the l1 part; the bound of the curvature
    is the trace of the Gram matrix. ``rows``: fold, y, w, z with the constant last."""
    return f"""lp_{name} AS (SELECT fold, {1 - l1} + {c} / 4 * sum(w * list_dot_product(z, z)) AS l FROM {rows} GROUP BY fold),
{name} AS (SELECT 0 AS i, fold, list_transform(range({width + 1}), lambda j: 0.0::DOUBLE) AS b, list_transform(range({width + 1}), lambda j: 0.0::DOUBLE) AS m FROM lp_{name}
  UNION ALL
  SELECT i + 1, fold, list(nb ORDER BY j), list(nb + (sqrt(l) - 1) / (sqrt(l) + 1) * (nb - b) ORDER BY j) FROM (
   SELECT *, CASE WHEN j <= {width} THEN sign(gb) * greatest(abs(gb) - {l1} / l, 0) ELSE gb END AS nb FROM (
    SELECT i, fold, l, j, any_value(b[j]) AS b, any_value(m[j]) - ({1 - l1} * CASE WHEN j <= {width} THEN any_value(m[j]) ELSE 0 END + {c} * sum(r * z[j])) / l AS gb FROM (
      SELECT n.i, n.fold, n.b, n.m, lp.l, t.z, w * (1 / (1 + exp(-list_dot_product(t.z, n.m))) - t.y) AS r FROM {name} n JOIN {rows} t USING (fold) JOIN lp_{name} lp USING (fold) WHERE n.i < 400), range(1, {width + 2}) d(j)
    GROUP BY i, fold, l, j)) GROUP BY i, fold)"""


# standardised training rows of the three folds with their weights
ROWS = """tz AS (SELECT fold, feature, avg(value) AS m, stddev_pop(value) + 1e-8 AS s FROM long_folds WHERE role = 'train' GROUP BY ALL),
ws AS (SELECT fold, site, y, count(*) AS n FROM emb_split WHERE role = 'train' GROUP BY ALL),
wt AS (SELECT fold, site, y, sum(n) OVER (PARTITION BY fold) / (count(*) OVER (PARTITION BY fold) * n) AS w FROM ws),
zr AS (SELECT l.fold, l.key, l.role, l.site, l.y, list((value - m) / s ORDER BY feature) || [1.0::DOUBLE] AS z FROM long_folds l JOIN tz USING (fold, feature) GROUP BY ALL),
tr AS (SELECT zr.*, w FROM zr JOIN wt USING (fold, site, y) WHERE role = 'train')"""


def _folds(spark, sf):
    return S.pooled_plan(X.wide_emb(spark, sf), seeds=(7,), k=3)


@query("logreg", ctes=["long_folds"], rounded=["score"], digits=4, sql=f"""WITH RECURSIVE {ROWS}, {sparse_sql('nag', 'tr', 0.01, 0, 64)}
SELECT fold, key, list_dot_product(z, b) AS score FROM zr JOIN nag USING (fold) WHERE role = 'test' AND i = 400""")
def _(spark, sf):
    return S.fixed(_folds(spark, sf), [{"candidate": 0, "kind": "logreg", "k": 0, "setting": 0.01}]).select("fold", "key", "score")


@query("rbf_svm", rounded=["score"], digits=3)
def _(spark, sf):
    return S.fixed(_folds(spark, sf), [{"candidate": 0, "kind": "svm", "k": 25, "setting": 1.0}]).select("fold", "key", "score")


@query("gbt", rounded=["score"], digits=4)
def _(spark, sf):
    from pyspark.ml.functions import array_to_vector

    d = _weighted_rows(spark, sf).withColumn("_x", array_to_vector("values"))
    return L.margin(L.fit_gbt(d.where("role = 'train'"), 4, weight="w", features="_x", maxIter=20), d).select("key", "role", "score")


@query("lasso_select", ctes=["long_folds"], rounded=["coef"], digits=4, sql=f"""WITH RECURSIVE {ROWS}, {sparse_sql('nag', 'tr', 0.1, 1, 64)}
SELECT fold, j::INT - 1 AS feature, b[j] AS coef FROM nag, range(1, 65) t(j) WHERE i = 400 AND abs(b[j]) > 1e-8""")
def _(spark, sf):
    return S.lasso_select(_folds(spark, sf), 0.1).drop("seed")


@query("capped_elastic_net", ctes=["long_folds"], rounded=["score"], digits=4, sql=f"""WITH RECURSIVE {ROWS}, {sparse_sql('nag', 'tr', 0.05, 0.5, 64)},
pick AS (SELECT fold, j, row_number() OVER (PARTITION BY fold ORDER BY abs(b[j]) DESC, j) AS rn FROM nag, range(1, 65) t(j) WHERE i = 400 AND b[j] <> 0),
keep AS (SELECT fold, list(j ORDER BY j) AS js FROM pick WHERE rn <= 8 GROUP BY fold),
zk AS (SELECT zr.* EXCLUDE (z), len(js) AS n_selected, list_transform(js, lambda j: z[j]) || list_transform(range(8 - len(js)), lambda j: 0.0::DOUBLE) || [1.0::DOUBLE] AS z FROM zr JOIN keep USING (fold)),
tk AS (SELECT zk.*, w FROM zk JOIN wt USING (fold, site, y) WHERE role = 'train'), {sparse_sql('again', 'tk', 0.05, 0.5, 8)}
SELECT fold, key, list_dot_product(z, b) AS score, n_selected::INT AS n_selected FROM zk JOIN again USING (fold) WHERE role = 'test' AND i = 400""")
def _(spark, sf):
    return S.capped_elastic_net(_folds(spark, sf), 0.05, 0.5).select("fold", "key", "score", "n_selected")


@query("mrmr_ridge", ctes=["long_folds"], rounded=["score"], digits=4, sql=f"""WITH RECURSIVE fs AS ({ANOVA}), pairs AS ({CORR}),
bo AS (SELECT fold, i AS feature, j AS other, r FROM pairs UNION ALL SELECT fold, j, i, r FROM pairs),
walk AS (SELECT DISTINCT fold, 0 AS i, []::INT[] AS sel FROM fs UNION ALL SELECT fold, i + 1, list_append(sel, feature) FROM (
  SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, feature) AS rn FROM (
   SELECT w.fold, w.i, w.sel, c.feature, c.f - coalesce(avg(b.r), 0) AS score FROM walk w JOIN fs c ON w.fold = c.fold AND NOT list_contains(w.sel, c.feature)
    LEFT JOIN bo b ON b.fold = c.fold AND b.feature = c.feature AND list_contains(w.sel, b.other) WHERE w.i < 8 GROUP BY w.fold, w.i, w.sel, c.feature, c.f)) WHERE rn = 1), {ROWS},
zk AS (SELECT zr.* EXCLUDE (z), list_transform(list_sort(sel), lambda j: z[j + 1]) || [1.0::DOUBLE] AS z FROM zr JOIN walk USING (fold) WHERE i = 8),
tk AS (SELECT zk.*, w FROM zk JOIN wt USING (fold, site, y) WHERE role = 'train'), {sparse_sql('nag', 'tk', 0.5, 0, 8)}
SELECT fold, key, list_dot_product(z, b) AS score FROM zk JOIN nag USING (fold) WHERE role = 'test' AND i = 400""")
def _(spark, sf):
    long = X.long_folds(spark, sf).where("role = 'train'")
    wide = X.emb_split(spark, sf).where("role = 'train'").join(X.wide_emb(spark, sf), "key")
    order = R.mrmr_rank(R.anova_f(long, ["fold"]), R.abs_corr_matrix(wide, "features", ["fold"]), ["fold"], 8)
    return S.fixed_on(_folds(spark, sf), order.withColumnRenamed("fold", "slot"), [{"candidate": 0, "kind": "logreg", "k": 0, "setting": 0.5}]).select("fold", "key", "score")


def _plan(spark, sf):
    """Five seeds of five outer folds, three inner ones each."""
    return S.pooled_plan(X.wide_emb(spark, sf))


@query("inner_surface", rounded=["sb_auc"], digits=4)
def _(spark, sf):
    return S.search(_plan(spark, sf), GRID).surface


@query("nested_choices", rounded=["inner_mean", "inner_sd"], digits=4)
def _(spark, sf):
    return S.search(_plan(spark, sf), GRID).chosen


@query("nested_cv", rounded=["score"], digits=4)
def _(spark, sf):
    return S.ensemble(S.search(_plan(spark, sf), GRID).outer, ["seed", "fold"])


@query("seed_summary", rounded=["mean", "sd", "seed_avg", "lo", "hi"], digits=4)
def _(spark, sf):
    return S.seed_summary(S.with_ensemble(S.search(_plan(spark, sf), GRID).outer, ["seed", "fold"]))


@query("held_out_auc", rounded=["auc"], digits=4)
def _(spark, sf):
    return S.held_out_auc(S.search(S.held_out_plan(X.wide_emb(spark, sf)), GRID).outer)


@query("site_leak_auc", rounded=["site_leak_auc"], digits=4)
def _(spark, sf):
    return S.site_leak(_plan(spark, sf), "combat")


@query("domain_classifier", rounded=["pooled_auc"], digits=4)
def _(spark, sf):
    return S.domain_classifier(_plan(spark, sf))


@query("naive_baseline", rounded=["pooled_auc", "sb_auc", "site_auc"], digits=4)
def _(spark, sf):
    return D.baseline_metrics(S.naive_scores(_plan(spark, sf)), ["seed"])


@query("fit_once_predict", rounded=["score"], digits=4)
def _(spark, sf):
    d = X.wide_emb(spark, sf).select("key", "site", "y", F.slice("features", 1, 32).alias("low"), F.slice("features", 33, 32).alias("high"))
    return S.locked_scores(d.where("site <> 'S3'"), d.where("site = 'S3'").drop("y"), {"low": "low", "high": "high"}, GRID)


@query("transport_scores", rounded=["auc", "bacc", "sens", "spec", "prior"], digits=3)
def _(spark, sf):
    return S.transport(S.transport_plan(X.wide_emb(spark, sf)), GRID)


@query("pca_project", rounded=["pc1", "pc2"], digits=4)
def _(spark, sf):
    p = L.pca_project(X.wide_emb(spark, sf), "features")
    return p.select("key", "site", F.abs("pc1").alias("pc1"), F.abs("pc2").alias("pc2"))


@query("kde_curve", rounded=["x", "density"], digits=5, ctes=["obs"], sql="""
WITH d AS (SELECT site, ln(score) AS v FROM obs), e AS (SELECT quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM d),
s AS (SELECT site, stddev_samp(v) * pow(count(*), -0.2) AS h, count(*) AS n FROM d GROUP BY site)
SELECT site, i::INT AS i, any_value(lo + (hi - lo) * i / 299) AS x, sum(exp(-pow((lo + (hi - lo) * i / 299 - v) / h, 2) / 2) / (h * n * sqrt(2 * pi()))) AS density
FROM d JOIN s USING (site), e, range(300) t(i) GROUP BY ALL""")
def _(spark, sf):
    d = X.obs(spark, sf).withColumn("v", F.log("score"))
    return L.kde_curve(d, "v", "site")


# ---- ensembles and fusion -----------------------------------------------------------------------------------
SCORED = """sc AS (SELECT s.fold, s.role, s.key, s.site, s.y, t.m AS kind, embedding[t.m + 1]::DOUBLE AS score
 FROM emb_split s JOIN embeddings ON s.key = vec_id, range(3) t(m))"""


def _scored(spark, sf):
    v = X.wide_emb(spark, sf).select("key", "site", "y", F.posexplode(F.slice("features", 1, 3)).alias("kind", "score"))
    return X.emb_split(spark, sf).join(v, "key")


@query("ensemble_z", ctes=["emb_split"], rounded=["score"], sql=f"""WITH {SCORED},
st AS (SELECT fold, kind, avg(score) AS m, stddev_pop(score) AS s FROM sc WHERE role = 'train' GROUP BY ALL)
SELECT fold, key, site, y, avg((score - m) / (s + 1e-8)) AS score FROM sc JOIN st USING (fold, kind) WHERE role = 'test' GROUP BY ALL""")
def _(spark, sf):
    return L.ensemble_z(_scored(spark, sf))


COMBO = """co AS (SELECT string_agg('b' || b, '+' ORDER BY b) AS combo, count(*)::INT AS n_items, list(b) AS bs FROM range(1, 8) m(mask), range(3) t(b) WHERE (mask >> b) & 1 = 1 GROUP BY mask),
cb AS (SELECT combo, n_items, unnest(bs) AS kind FROM co)"""


def _blocks(spark, sf):
    """Out-of-fold scores of three blocks, the outer fold standing in for the seed."""
    d = _scored(spark, sf).where("role = 'test'")
    return d.select(F.concat(F.lit("b"), "kind").alias("block"), F.lit(0).alias("seed"), "key", "site", "y", "score")


@query("late_fusion", ctes=["emb_split"], rounded=["sb_auc", "site_auc", "loso_mean", "ci_lo", "ci_hi"], sql=f"""WITH {SCORED}, {COMBO},
base AS (SELECT kind, key, site, y, score FROM sc WHERE role = 'test'),
z AS (SELECT *, (score - avg(score) OVER (PARTITION BY kind)) / stddev_samp(score) OVER (PARTITION BY kind) AS z,
   (score - avg(score) OVER (PARTITION BY kind, site)) / stddev_samp(score) OVER (PARTITION BY kind, site) AS zl FROM base),
f AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY combo, site, y) AS w FROM (SELECT combo, n_items, key, site, y, avg(z) AS score, avg(zl) AS lscore FROM z JOIN cb USING (kind) GROUP BY ALL)),{draws_sql('obs_emb', 'site, y', 2000, 1)},
rep AS (SELECT f.combo, hit.b, f.y, f.score, 1.0 / hit.n AS dw FROM f JOIN hit USING (key)),
a AS ({_auc_sql('rep', 'combo, b', w='dw')}), ci AS (SELECT combo, quantile_cont(auc, 0.025) AS ci_lo, quantile_cont(auc, 0.975) AS ci_hi FROM a GROUP BY combo),
sb AS ({_auc_sql('f', 'combo, n_items', w='w')}), sa AS (SELECT combo, avg(auc) AS site_auc FROM ({_auc_sql('f', 'combo, site')}) GROUP BY combo),
lo AS (SELECT combo, avg(auc) AS loso_mean FROM ({_auc_sql('f', 'combo, site', s='lscore')}) GROUP BY combo)
SELECT combo, n_items, sb.auc AS sb_auc, site_auc, loso_mean, ci_lo, ci_hi FROM sb JOIN sa USING (combo) JOIN lo USING (combo) JOIN ci USING (combo)""")
def _(spark, sf):
    oof = _blocks(spark, sf)
    combos = U.all_combinations(oof.select("block").distinct(), "block")
    return L.late_fusion(oof, oof.withColumn("held_out", F.col("site")), combos)


@query("fusion_summary", ctes=["emb_split"], rounded=["best", "worst", "named", "median", "loso_median"], sql=f"""WITH {SCORED}, {COMBO},
z AS (SELECT *, (score - avg(score) OVER (PARTITION BY kind)) / stddev_samp(score) OVER (PARTITION BY kind) AS z,
   (score - avg(score) OVER (PARTITION BY kind, site)) / stddev_samp(score) OVER (PARTITION BY kind, site) AS zl FROM sc WHERE role = 'test'),
f AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY combo, site, y) AS w FROM (SELECT combo, n_items, key, site, y, avg(z) AS score, avg(zl) AS lscore FROM z JOIN cb USING (kind) GROUP BY ALL)),
r AS (SELECT combo, sb.auc AS sb_auc, loso_mean FROM ({_auc_sql('f', 'combo', w='w')}) sb JOIN (SELECT combo, avg(auc) AS loso_mean FROM ({_auc_sql('f', 'combo, site', s='lscore')}) GROUP BY combo) USING (combo))
SELECT arg_max(combo, sb_auc) AS best_combo, max(sb_auc) AS best, min(sb_auc) AS worst, count(*) AS n, max(sb_auc) FILTER (combo = 'b0') AS named, median(sb_auc) AS median, median(loso_mean) AS loso_median FROM r""")
def _(spark, sf):
    oof = _blocks(spark, sf)
    combos = U.all_combinations(oof.select("block").distinct(), "block")
    f = L.fuse(oof, combos, ["seed"])
    lo = L.fuse(oof.withColumn("held_out", F.col("site")), combos, ["held_out", "seed"])
    sb = M.site_balanced_auc(f, by=["combo"])
    lm = M.weighted_auc(lo, by=["combo", "held_out"]).groupBy("combo").agg(F.avg("auc").alias("loso_mean"))
    return D.fusion_summary(sb.join(lm, "combo"), "b0")


@query("stacked_fusion", ctes=["emb_split"], rounded=["score"], digits=4, sql=f"""WITH RECURSIVE {SCORED},
pr AS (SELECT fold, role, key, y, max(score) FILTER (kind = 0) AS za, max(score) FILTER (kind = 1) AS zb FROM sc GROUP BY ALL),
tk AS (SELECT fold, y, 1.0::DOUBLE AS w, [za, zb, 1.0::DOUBLE] AS z FROM pr WHERE role = 'train'), {sparse_sql('nag', 'tk', 1.0, 0, 2)}
SELECT fold, key, za * b[1] + zb * b[2] + b[3] AS score FROM pr JOIN nag USING (fold) WHERE role = 'test' AND i = 400""")
def _(spark, sf):
    d = _scored(spark, sf)
    pair = d.groupBy("fold", "role", "key", "site", "y").agg(F.max(F.when(F.col("kind") == 0, F.col("score"))).alias("za"),
                                                             F.max(F.when(F.col("kind") == 1, F.col("score"))).alias("zb"))
    return L.stacked_fusion(pair, "za", "zb").select("fold", "key", "score")


@query("platt_calibrate", ctes=["prob_pair"], rounded=["p_cal"], digits=4, sql=f"""WITH RECURSIVE {NEWTON},
g AS (SELECT arg_max(a, i) AS a, arg_max(b, i) AS b, (SELECT sum(w1) > 0 AND sum(w1) < sum(n) AND count(*) >= 2 FROM z) AS fits FROM nw),
f AS (SELECT a, b, fits AND isfinite(a) AND isfinite(b) AND a > 0 AS valid FROM g)
SELECT key, y, CASE WHEN pa IS NOT NULL THEN 1 / (1 + exp(-(CASE WHEN valid THEN f.a ELSE 1 END * ln(greatest(least(pa, 1 - 1e-6), 1e-6) / (1 - greatest(least(pa, 1 - 1e-6), 1e-6)))
 + CASE WHEN valid THEN f.b ELSE 0 END))) END AS p_cal, valid FROM prob_pair, f""")
def _(spark, sf):
    d = X.prob_pair(spark, sf)
    a, b, valid = L.platt_fit(d, "pa")
    return d.select("key", "y", L.platt_apply("pa", a, b).alias("p_cal"), F.lit(valid).alias("valid"))


# ---- diagnostics --------------------------------------------------------------------------------------------
PREV = """pv AS (SELECT s.fold, s.site, avg(s.y) AS score FROM emb_split s WHERE role = 'train' GROUP BY ALL),
oof AS (SELECT s.fold, s.key, s.site, s.y, pv.score, 1.0 / count(*) OVER (PARTITION BY s.site, s.y) AS w FROM emb_split s JOIN pv USING (fold, site) WHERE role = 'test')"""


@query("site_only_baseline", ctes=["emb_split"], rounded=["pooled_auc", "sb_auc"], sql=f"""WITH {PREV}
SELECT (SELECT auc FROM ({_auc_sql('oof')})) AS pooled_auc, (SELECT auc FROM ({_auc_sql('oof', w='w')})) AS sb_auc""")
def _(spark, sf):
    return D.site_only_baseline(X.obs_emb(spark, sf), X.emb_split(spark, sf))


SHIFT = ["q1_a", "q1_b", "median_a", "median_b", "q3_a", "q3_b", "median_diff", "delta"]


@query("prediction_shift", ctes=["prob_pair"], rounded=SHIFT, sql=f"""
WITH q AS (SELECT y, site, quantile_cont(pa, 0.25) AS q1, median(pa) AS med, quantile_cont(pa, 0.75) AS q3 FROM prob_pair GROUP BY ALL),
sites AS (SELECT DISTINCT site FROM prob_pair), pairs AS (SELECT a.site AS site_a, b.site AS site_b FROM sites a JOIN sites b ON a.site < b.site),
sh AS (SELECT y AS cls, site_a, site_b, pa, (site = site_a)::INT AS y FROM prob_pair JOIN pairs ON site = site_a OR site = site_b), d AS ({_auc_sql('sh', 'cls, site_a, site_b', s='pa')})
SELECT a.y, d.site_a, d.site_b, a.q1 AS q1_a, a.med AS median_a, a.q3 AS q3_a, b.q1 AS q1_b, b.med AS median_b, b.q3 AS q3_b, a.med - b.med AS median_diff, 2 * auc - 1 AS delta
FROM d JOIN q a ON a.y = d.cls AND a.site = d.site_a JOIN q b ON b.y = d.cls AND b.site = d.site_b""")
def _(spark, sf):
    return D.prediction_shifts(X.prob_pair(spark, sf), s="pa")


@query("subgroup_metrics", ctes=["obs_pair"], rounded=["auc"], sql=f"""
WITH g AS (SELECT *, unnest(list_filter([CASE WHEN pb <= 6 THEN 'short words' END, CASE WHEN pb > 6 THEN 'long words' END, CASE WHEN site = 'en' THEN 'english' END], lambda x: x IS NOT NULL)) AS subgroup FROM obs_pair)
SELECT a.subgroup, n, n_pos, auc FROM ({_auc_sql('g', 'subgroup', s='pa')}) a JOIN (SELECT subgroup, count(*) AS n, sum(y)::BIGINT AS n_pos FROM g GROUP BY 1) c ON a.subgroup = c.subgroup""")
def _(spark, sf):
    groups = {"short words": F.col("pb") <= 6, "long words": F.col("pb") > 6, "english": F.col("site") == "en"}
    return D.subgroup_metrics(X.obs_pair(spark, sf), groups, s="pa")


@query("univariate_leak_check", ctes=["obs_pair"], rounded=["auc"], sql=f"""
WITH u AS (SELECT site, y, 'pa' AS variable, pa AS value FROM obs_pair UNION ALL SELECT site, y, 'pb', pb FROM obs_pair) {_auc_sql('u', 'site, variable', s='value')}""")
def _(spark, sf):
    return D.univariate_leak_check(X.obs_pair(spark, sf), ["pa", "pb"])


@query("block_summary", rounded=["m_F", "s_F", "m_O", "s_O"], digits=4, sql="""
SELECT l_returnflag AS block, avg(l_discount) FILTER (l_linestatus = 'F') AS "m_F", stddev_samp(l_discount) FILTER (l_linestatus = 'F') AS "s_F",
 avg(l_discount) FILTER (l_linestatus = 'O') AS "m_O", stddev_samp(l_discount) FILTER (l_linestatus = 'O') AS "s_O" FROM lineitem GROUP BY 1""")
def _(spark, sf):
    m = X.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("block"), F.col("l_linestatus").alias("harm")).agg(
        F.avg("l_discount").alias("m"), F.stddev_samp("l_discount").alias("s"))
    return D.block_summary(m, "block", "harm", ["F", "O"], ["m", "s"])


@query("hyperparam_counts", rounded=["share"], sql="""
SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY o_orderstatus) AS share FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)""")
def _(spark, sf):
    return D.hyperparam_counts(X.table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("small_bag_report", sql="""
WITH b AS (SELECT conv_id AS key, count(*) AS n_inst FROM conversations GROUP BY 1 HAVING count(*) < 20)
SELECT b.key, n_inst, l.toxic AS y, l.quality::DOUBLE AS score, (l.quality >= 0.5) = (l.toxic = 1) AS correct, e.vec_id IS NOT NULL AS shared
FROM b JOIN labels l ON l.doc_id = b.key LEFT JOIN embeddings e ON e.vec_id = b.key""")
def _(spark, sf):
    oof = X.table(spark, sf, "labels").select(F.col("doc_id").alias("key"), F.col("toxic").alias("y"), F.col("quality").cast("double").alias("score"))
    bags = X.table(spark, sf, "conversations").select(F.col("conv_id").alias("key"))
    shared = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"))
    return D.small_bag_report(oof, bags, shared, "key").select("key", "n_inst", "y", "score", "correct", "shared")


CONC2 = """SELECT bag % 5 AS fold, mx * n AS max_times_n, mx / nullif(mn, 0) AS max_over_min, CASE WHEN n > 1 THEN h / ln(n) ELSE 0 END AS entropy, top_mass FROM (
 SELECT bag, max(n) AS n, max({w}) AS mx, min({w}) AS mn, sum(CASE WHEN {w} > 0 THEN -{w} * ln({w}) ELSE 0 END) AS h,
  sum({w}) FILTER (r <= greatest(1, n // 10)) AS top_mass FROM (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY {w} DESC, inst) AS r FROM bw) GROUP BY bag)"""


@query("attention_compare", ctes=["bags"], rounded=["median_a", "median_b"], digits=4, sql=f"""
WITH bw AS (SELECT *, 1 / (1 + value) / sum(1 / (1 + value)) OVER (PARTITION BY bag) AS w2, count(*) OVER (PARTITION BY bag) AS n FROM bags),
a AS ({CONC2.format(w='weight')}), b AS ({CONC2.format(w='w2')}),
ua AS (SELECT fold, measure, median(v) AS m FROM (UNPIVOT a ON max_times_n, max_over_min, entropy, top_mass INTO NAME measure VALUE v) GROUP BY ALL),
ub AS (SELECT fold, measure, median(v) AS m FROM (UNPIVOT b ON max_times_n, max_over_min, entropy, top_mass INTO NAME measure VALUE v) GROUP BY ALL)
SELECT fold, measure, ua.m AS median_a, ub.m AS median_b FROM ua JOIN ub USING (fold, measure)""")
def _(spark, sf):
    from evenhand.operators.core import attach_stats

    a = X.bags(spark, sf).select("bag", "inst", "value", "weight", (F.col("bag") % 5).alias("fold"))
    b = attach_stats(a.drop("weight").withColumn("_u", 1 / (1 + F.col("value"))), ["bag"], F.sum("_u").alias("_t")).withColumn("weight", F.col("_u") / F.col("_t"))
    return D.attention_compare(a.drop("value"), b.select("bag", "inst", "weight", "fold"), "bag", "fold", "weight", "inst")


@query("transport_summary", ctes=["emb_split"], rounded=["auc_m0", "auc_m1"], sql=f"""
WITH t AS (SELECT CASE WHEN site IN ('S0', 'S1') THEN 'in' ELSE 'out' END AS direction, t.b AS block, t.m AS mapping, key, y, embedding[t.b * 2 + t.m + 1]::DOUBLE AS score
  FROM obs_emb JOIN embeddings ON key = vec_id, (SELECT b, m FROM range(2) x(b), range(2) z(m)) t),
z AS (SELECT *, (score - avg(score) OVER w) / stddev_samp(score) OVER w AS z FROM t WINDOW w AS (PARTITION BY direction, mapping, block)),
f AS (SELECT direction, mapping, key, y, avg(z) AS score FROM z GROUP BY ALL), a AS ({_auc_sql('f', 'direction, mapping')})
SELECT direction, max(auc) FILTER (mapping = 0) AS auc_m0, max(auc) FILTER (mapping = 1) AS auc_m1 FROM a GROUP BY direction""")
def _(spark, sf):
    v = X.wide_emb(spark, sf).select("key", "y", F.when(F.col("site").isin("S0", "S1"), "in").otherwise("out").alias("direction"),
                                     F.posexplode(F.slice("features", 1, 4)).alias("i", "score"))
    v = v.withColumn("block", F.floor(F.col("i") / 2)).withColumn("mapping", F.concat(F.lit("m"), F.col("i") % 2)).withColumn("seed", F.lit(0))
    return D.transport_summary(v, ["m0", "m1"])


@query("site_threshold_metrics", ctes=["obs_pair"], rounded=["sensitivity", "specificity", "balanced_accuracy"], sql=f"""
SELECT site, sensitivity, specificity, balanced_accuracy FROM (SELECT site, {RATES} FROM (SELECT site, {CONF.format(hit='pb > 6')} FROM obs_pair GROUP BY GROUPING SETS ((), (site))))""")
def _(spark, sf):
    return D.site_threshold_metrics(X.obs_pair(spark, sf), "pb", 6.0)


STAGED = f"""l AS (SELECT 0 AS fold, 'train' AS role, * FROM long_emb), pm AS ({COMBAT['plain'].replace('long_folds', 'l')}),
st AS (SELECT 'before' AS stage, feature, site, y, value FROM l UNION ALL
 SELECT 'after', l.feature, l.site, y, sigma * ((value - alpha) / sigma - gamma) / sqrt(delta) + alpha FROM l JOIN pm USING (site, feature))"""


def _staged(spark, sf):
    d = X.long_emb(spark, sf)
    after = H.combat_apply(d, cut_lineage(H.combat_fit(d, eb=False)))  # every use of the rows sees the same fit
    return d.withColumn("stage", F.lit("before")).unionByName(after.withColumn("stage", F.lit("after")))


REPORT = f"""kw AS ({_kw_sql('st', 'stage, feature', 'value')}), kr AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY p, feature) AS i, count(*) OVER (PARTITION BY stage) AS m FROM kw),
ks AS (SELECT stage, feature, h, eta2, coalesce(p <= (SELECT max(p) FROM kr x WHERE x.stage = kr.stage AND p <= i * 0.05 / m), false) AS site_effect FROM kr),
mw AS ({_mw_sql('st', 'stage, feature, site', 'value')}), mr AS (SELECT *, row_number() OVER (PARTITION BY stage, site ORDER BY p, feature) AS i, count(*) OVER (PARTITION BY stage, site) AS m FROM mw),
mc AS (SELECT stage, site, max(p) FILTER (p <= i * 0.05 / m) AS cut FROM mr GROUP BY ALL),
ml AS (SELECT stage, feature, count(*) FILTER (p <= cut) AS n_sites_label_effect, avg(abs(auc - 0.5)) AS mean_auc_gap FROM mr JOIN mc USING (stage, site) GROUP BY ALL),
rep AS (SELECT stage, feature, h, eta2, site_effect, n_sites_label_effect, mean_auc_gap FROM ks JOIN ml USING (stage, feature))"""


@query("feature_test_report", ctes=["long_emb"], rounded=["h", "eta2", "mean_auc_gap"], digits=4, sql=f"WITH {STAGED}, {REPORT} SELECT * FROM rep")
def _(spark, sf):
    return D.feature_test_report(_staged(spark, sf)).select("stage", "feature", "h", "eta2", "site_effect", "n_sites_label_effect", "mean_auc_gap")


@query("feature_test_summary", ctes=["long_emb"], rounded=["eta2_median", "pairs_gt_07", "pairs_gt_09"], digits=4, sql=f"""WITH {STAGED}, {REPORT},
lk AS (SELECT 'before' AS stage, key, feature, value FROM l UNION ALL SELECT 'after', key, l.feature, sigma * ((value - alpha) / sigma - gamma) / sqrt(delta) + alpha FROM l JOIN pm USING (site, feature)),
cr AS (SELECT a.stage, abs(corr(a.value, b.value)) AS r FROM lk a JOIN lk b ON a.stage = b.stage AND a.key = b.key AND a.feature < b.feature GROUP BY a.stage, a.feature, b.feature)
SELECT rep.stage, count(*) AS n_features, count(*) FILTER (site_effect) AS site_effect, count(*) FILTER (n_sites_label_effect >= 1) AS label_ge1,
 count(*) FILTER (n_sites_label_effect >= 2) AS label_ge2, count(*) FILTER (n_sites_label_effect = 4) AS label_all, median(eta2) AS eta2_median,
 (SELECT avg((r > 0.7)::INT) FROM cr WHERE cr.stage = rep.stage) AS pairs_gt_07, (SELECT avg((r > 0.9)::INT) FROM cr WHERE cr.stage = rep.stage) AS pairs_gt_09 FROM rep GROUP BY rep.stage""")
def _(spark, sf):
    from evenhand.operators.selection import abs_corr_matrix

    d = X.long_emb(spark, sf)
    after = H.combat_apply(d, cut_lineage(H.combat_fit(d, eb=False)))
    vec = H.to_vectors(d, ["key"]).withColumn("stage", F.lit("before")).unionByName(H.to_vectors(after, ["key"]).withColumn("stage", F.lit("after")))
    return D.feature_test_summary(D.feature_test_report(_staged(spark, sf)), abs_corr_matrix(vec, "values", ["stage"]), 4)


@query("clinical_test_report", ctes=["obs_pair"], rounded=["p_class", "p_site", "within_site_auc"], digits=4, sql=f"""
WITH u AS (SELECT site, y, 'pa' AS covariate, pa AS value FROM obs_pair UNION ALL SELECT site, y, 'pb', pb FROM obs_pair),
fl AS (SELECT site, y, 'is_long' AS covariate, (pa > 1000)::INT::DOUBLE AS value FROM obs_pair), al AS (SELECT * FROM u UNION ALL SELECT * FROM fl),
a AS ({_mw_sql('u', 'covariate', 'value')}), b AS ({_kw_sql('u', 'covariate', 'value')}),
w AS (SELECT covariate, avg(auc) AS within_site_auc FROM ({_auc_sql('al', 'covariate, site', s='value')}) GROUP BY covariate),
cy AS (SELECT sum(pow(abs(coalesce(o, 0) - e) - least(0.5, abs(coalesce(o, 0) - e)), 2) / e) AS x FROM (SELECT r.value, c.y, r.n::DOUBLE * c.n / (SELECT count(*) FROM fl) AS e, (SELECT count(*) FROM fl f WHERE f.value = r.value AND f.y = c.y) AS o
  FROM (SELECT value, count(*) AS n FROM fl GROUP BY 1) r, (SELECT y, count(*) AS n FROM fl GROUP BY 1) c)),
cs AS (SELECT sum(pow(o - e, 2) / e) AS x FROM (SELECT r.n::DOUBLE * c.n / (SELECT count(*) FROM fl) AS e, (SELECT count(*) FROM fl f WHERE f.value = r.value AND f.site = c.site) AS o
  FROM (SELECT value, count(*) AS n FROM fl GROUP BY 1) r, (SELECT site, count(*) AS n FROM fl GROUP BY 1) c))
SELECT a.covariate, a.p AS p_class, b.p AS p_site, within_site_auc FROM a JOIN b ON a.covariate = b.covariate JOIN w ON w.covariate = a.covariate
UNION ALL SELECT 'is_long', (SELECT {ERFC.format(x='sqrt(x / 2)')} FROM cy), (SELECT {ERFC.format(x='sqrt(x / 2)')} + sqrt(2 * x / pi()) * exp(-x / 2) FROM cs), within_site_auc FROM w WHERE covariate = 'is_long'""")
def _(spark, sf):
    d = X.obs_pair(spark, sf).withColumn("is_long", F.col("pa") > 1000)
    return D.clinical_test_report(d, ["pa", "pb"], ["is_long"])


@query("state_summary", ctes=["long_folds"], rounded=["min_mean", "max_mean", "avg_mean", "min_sd", "max_sd", "avg_sd", "median_sd"], sql="""
WITH s AS (SELECT fold, feature, avg(value) AS mean, stddev_pop(value) AS sd, stddev_pop(value) > 0.12 AS kept FROM long_folds WHERE role = 'train' GROUP BY ALL)
SELECT fold, count(*) AS offered, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS dropped, min(mean) FILTER (kept) AS min_mean, max(mean) FILTER (kept) AS max_mean,
 avg(mean) FILTER (kept) AS avg_mean, min(sd) FILTER (kept) AS min_sd, max(sd) FILTER (kept) AS max_sd, avg(sd) FILTER (kept) AS avg_sd, median(sd) FILTER (kept) AS median_sd FROM s GROUP BY fold""")
def _(spark, sf):
    from evenhand.operators.aggregate import state_summary

    t = H.train_rows(X.long_folds(spark, sf))
    s = t.groupBy("fold", "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")).withColumn("kept", F.col("sd") > 0.12)
    return state_summary(s, ["fold"], "kept", "mean", "sd")
