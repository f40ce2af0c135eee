"""Fold-local preprocessing, harmonisation, ranking and pruning over the embedding features."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenhand.operators import harmonise as H
from evenhand.operators import selection as S
from evenhand.plans import frames as X
from evenhand.plans.evaluate import _auc_sql
from evenhand.plans.registry import query

FOLD_MISSING = "(SELECT s.fold, s.role, l.* FROM emb_split s JOIN long_missing l ON s.key = l.key)"
MISS = ["emb_split", "long_missing"]


def _folds(spark, sf):
    return X.emb_split(spark, sf).join(X.long_missing(spark, sf), "key")


@query("missing_screen", ctes=MISS, rounded=["missing_share"], sql=f"""SELECT fold, feature, avg((value IS NULL)::INT) AS missing_share
 FROM {FOLD_MISSING} WHERE role = 'train' GROUP BY ALL HAVING avg((value IS NULL)::INT) <= 0.05""")
def _(spark, sf):
    return H.missing_screen(H.train_rows(_folds(spark, sf)), ["fold"], 0.05)


@query("median_impute", ctes=MISS, rounded=["total", "fill"], sql=f"""
WITH f AS ({FOLD_MISSING.strip('()')}), m AS (SELECT fold, feature, coalesce(quantile_cont(value, 0.5), 0) AS fill FROM f WHERE role = 'train' GROUP BY ALL)
SELECT fold, role, feature, any_value(fill) AS fill, sum(coalesce(value, fill)) AS total, count(*) AS n FROM f JOIN m USING (fold, feature) GROUP BY ALL""")
def _(spark, sf):
    f = _folds(spark, sf)
    m = H.median_fit(H.train_rows(f), ["fold"])
    g = H.impute(f, m, ["fold"]).groupBy("fold", "role", "feature").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
    return g.join(m, ["fold", "feature"])


@query("variance_screen", ctes=["long_folds"], rounded=["mean", "sd"], sql="""SELECT fold, feature, avg(value) AS mean, stddev_pop(value) AS sd FROM long_folds
 WHERE role = 'train' GROUP BY ALL HAVING stddev_pop(value) > 0.12 AND stddev_pop(value) / (abs(avg(value)) + 1e-12) > 4""")
def _(spark, sf):
    return H.variance_screen(H.train_rows(X.long_folds(spark, sf)), ["fold"], 0.12, 4.0)


@query("zscore_fit_apply", ctes=["long_folds"], rounded=["value"], sql="""
WITH s AS (SELECT fold, feature, avg(value) AS m, stddev_pop(value) + 1e-8 AS d FROM long_folds WHERE role = 'train' GROUP BY ALL)
SELECT fold, role, key, feature, (value - m) / d AS value FROM long_folds JOIN s USING (fold, feature)""")
def _(spark, sf):
    f = X.long_folds(spark, sf)
    return H.zscore_apply(f, H.zscore_fit(H.train_rows(f), ["fold"]), ["fold"]).select("fold", "role", "key", "feature", "value")


CLIN = """c AS (SELECT c_custkey AS key, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS segment,
 c_nationkey < 20 AS train FROM customer)"""


@query("clinical_encode", rounded=["value"], sql=f"""
WITH {CLIN}, cat AS (SELECT DISTINCT segment AS category FROM c WHERE train AND segment IS NOT NULL)
SELECT key, 'balance' AS feature, coalesce(balance, (SELECT median(balance) FROM c WHERE train)) AS value FROM c
UNION ALL SELECT key, 'balance_missing', (balance IS NULL)::INT::DOUBLE FROM c
UNION ALL SELECT key, 'segment=' || category, coalesce((segment = category)::INT, 0)::DOUBLE FROM c, cat
UNION ALL SELECT key, 'segment_missing', (segment IS NULL)::INT::DOUBLE FROM c""")
def _(spark, sf):
    c = X.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"), (F.col("c_nationkey") < 20).alias("train"))
    state = H.clinical_fit(c.where("train"), ["balance"], ["segment"])
    return H.clinical_encode(c, state, "key", ["balance"], ["segment"])


MOM = {
    "plain": "SELECT fold, site, feature, count(*) AS n, avg(value) AS loc, var_pop(value) AS var FROM long_folds WHERE role = 'train' GROUP BY ALL",
    "balanced": """SELECT fold, site, feature, sum(c)::BIGINT AS n, (coalesce(max(m) FILTER (y = 1), 0) + coalesce(max(m) FILTER (y = 0), 0)) / 2 AS loc,
      sum(c * v) / sum(c) AS var FROM (SELECT fold, site, feature, y, count(*) AS c, avg(value) AS m, var_pop(value) AS v FROM long_folds WHERE role = 'train' GROUP BY ALL) GROUP BY ALL""",
}
COMBAT = {
    "plain": f"""SELECT fold, site, feature, n, alpha, sigma, (loc - alpha) / sigma AS gamma, greatest(var / (sigma * sigma), 1e-8) AS delta FROM ({MOM['plain']}) m
      JOIN (SELECT fold, feature, sum(n * loc) / sum(n) AS alpha, sqrt(greatest(sum(n * var) / sum(n), 1e-12)) AS sigma FROM ({MOM['plain']}) GROUP BY ALL) USING (fold, feature)""",
    "balanced": f"""SELECT fold, site, feature, n, alpha, sigma, (loc - alpha) / sigma AS gamma, greatest(var / (sigma * sigma), 1e-8) AS delta FROM ({MOM['balanced']}) m
      JOIN (SELECT fold, feature, avg(loc) AS alpha, sqrt(greatest(avg(var), 1e-12)) AS sigma FROM ({MOM['balanced']}) GROUP BY ALL) USING (fold, feature)""",
}


@query("site_moments", ctes=["long_folds"], rounded=["loc", "var"], sql=MOM["plain"])
def _(spark, sf):
    return H.site_moments(H.train_rows(X.long_folds(spark, sf)), ["fold"])


@query("site_moments_balanced", ctes=["long_folds"], rounded=["loc", "var"], sql=MOM["balanced"])
def _(spark, sf):
    return H.site_moments(H.train_rows(X.long_folds(spark, sf)), ["fold"], balanced=True)


@query("site_moments_soft", ctes=["long_emb"], rounded=["loc", "var"], sql="""
WITH w AS (SELECT *, CASE WHEN y = 1 THEN 0.8 ELSE 0.3 END::DOUBLE AS q FROM long_emb),
m AS (SELECT site, feature, sum(q * value) / greatest(sum(q), 1e-8) AS m1, sum((1 - q) * value) / greatest(sum(1 - q), 1e-8) AS m0 FROM w GROUP BY ALL)
SELECT site, feature, count(*) AS n, any_value(m1 + m0) / 2 AS loc, avg(q * pow(value - m1, 2) + (1 - q) * pow(value - m0, 2)) AS var FROM w JOIN m USING (site, feature) GROUP BY ALL""")
def _(spark, sf):
    d = X.long_emb(spark, sf).withColumn("q", F.when(F.col("y") == 1, 0.8).otherwise(0.3))
    return H.site_moments(d, [], balanced=True, soft="q")


STATE = ["alpha", "sigma", "gamma", "delta"]


@query("combat_fit", ctes=["long_folds"], rounded=STATE, sql=COMBAT["plain"])
def _(spark, sf):
    return H.combat_fit(H.train_rows(X.long_folds(spark, sf)), ["fold"], eb=False)


@query("combat_fit_balanced", ctes=["long_folds"], rounded=STATE, sql=COMBAT["balanced"])
def _(spark, sf):
    return H.combat_fit(H.train_rows(X.long_folds(spark, sf)), ["fold"], balanced=True, eb=False)


def _eb_sql(state):
    """The shrinkage as a recursive query: one step per level, stopping a site once its features have settled."""
    return f"""RECURSIVE st AS ({state}),
 pr AS (SELECT fold, site, avg(gamma) AS gb, greatest(var_samp(gamma), 1e-12) AS t2, avg(delta) AS m, greatest(var_samp(delta), 1e-12) AS v FROM st GROUP BY ALL),
 it AS (SELECT 0 AS i, fold, site, feature, n, gamma AS gh, delta AS dh, gamma AS g, delta AS d, gb, t2, (2 * v + m * m) / v AS a, (m * v + m * m * m) / v AS b, false AS done
   FROM st JOIN pr USING (fold, site)
  UNION ALL
  SELECT i + 1, fold, site, feature, n, gh, dh, g2, d2, gb, t2, a, b,
    max(greatest(abs(g2 - g) / (abs(g) + 1e-8), abs(d2 - d) / (abs(d) + 1e-8))) OVER (PARTITION BY fold, site) < 1e-4 AS done
  FROM (SELECT *, (0.5 * n * (dh + (gh - g2) * (gh - g2)) + b) / (n / 2.0 + a - 1) AS d2 FROM
    (SELECT *, (n * t2 * gh + d * gb) / (n * t2 + d) AS g2 FROM it WHERE NOT done AND i < 100))),
 eb AS (SELECT fold, site, feature, n, arg_max(g, i) AS gamma, arg_max(d, i) AS delta FROM it GROUP BY ALL)"""


@query("eb_shrink", ctes=["long_folds"], rounded=["gamma", "delta"], digits=5, sql=f"WITH {_eb_sql(COMBAT['plain'])} SELECT fold, site, feature, n, gamma, delta FROM eb")
def _(spark, sf):
    return H.combat_fit(H.train_rows(X.long_folds(spark, sf)), ["fold"]).select("fold", "site", "feature", "n", "gamma", "delta")


APPLIED = f"""SELECT l.fold, l.role, l.key, l.site, l.y, l.feature, sigma * ((value - alpha) / sigma - gamma) / sqrt(delta) + alpha AS value
 FROM long_folds l JOIN ({COMBAT['plain']}) p ON l.fold = p.fold AND l.site = p.site AND l.feature = p.feature"""


@query("combat_apply", ctes=["long_folds"], rounded=["value"], sql=f"SELECT fold, role, key, feature, value FROM ({APPLIED})")
def _(spark, sf):
    f = X.long_folds(spark, sf)
    params = H.combat_fit(H.train_rows(f), ["fold"], eb=False)
    return H.combat_apply(f, params, ["fold"]).select("fold", "role", "key", "feature", "value")


LOSO_STATE = """fit AS (SELECT site, feature, count(*) AS n, avg(value) AS loc, var_pop(value) AS var FROM long_emb WHERE site <> 'S3' GROUP BY ALL),
ref AS (SELECT feature, sum(n * loc) / sum(n) AS alpha, sqrt(greatest(sum(n * var) / sum(n), 1e-12)) AS sigma FROM fit GROUP BY feature)"""


@query("combat_new_site", ctes=["long_emb"], rounded=STATE, sql=f"""WITH {LOSO_STATE}
SELECT 'S3' AS site, feature, count(*) AS n, any_value(alpha) AS alpha, any_value(sigma) AS sigma, (avg(value) - any_value(alpha)) / any_value(sigma) AS gamma,
 greatest(var_pop(value) / pow(any_value(sigma), 2), 1e-8) AS delta FROM long_emb JOIN ref USING (feature) WHERE site = 'S3' GROUP BY feature""")
def _(spark, sf):
    f = X.long_emb(spark, sf)
    return H.combat_new_site(f.where("site = 'S3'"), H.combat_fit(f.where("site <> 'S3'"), eb=False))


@query("unseen_sites", ctes=["long_emb"], sql="SELECT DISTINCT site FROM long_emb WHERE site = 'S3'")
def _(spark, sf):
    f = X.long_emb(spark, sf)
    return H.unseen_sites(f, f.where("site <> 'S3'"))


@query("prior_shift_em", ctes=["prob_pair"], rounded=["pi"], sql="""
WITH RECURSIVE p AS (SELECT site, greatest(least(pa, 1 - 1e-6), 1e-6) AS p FROM prob_pair),
em AS (SELECT 0 AS i, site, 0.5::DOUBLE AS pi, false AS done FROM (SELECT DISTINCT site FROM p)
 UNION ALL
 SELECT i + 1, site, npi, abs(npi - pi) < 1e-6 FROM (SELECT em.i, em.site, em.pi,
   avg((em.pi / 0.5 * p.p) / (em.pi / 0.5 * p.p + (1 - em.pi) / 0.5 * (1 - p.p))) AS npi FROM em JOIN p ON em.site = p.site WHERE NOT em.done AND em.i < 100 GROUP BY em.i, em.site, em.pi))
SELECT site, arg_max(pi, i) AS pi FROM em GROUP BY site""")
def _(spark, sf):
    return H.prior_shift_em(X.prob_pair(spark, sf), "site", "pa")


DEST = """src AS (SELECT * FROM long_emb WHERE site = 'S0'), dst AS (SELECT * FROM long_emb WHERE site <> 'S0'),
rf AS (SELECT feature, (avg(value) FILTER (y = 1) + avg(value) FILTER (y = 0)) / 2 AS src_loc, avg(value) FILTER (y = 1) - avg(value) FILTER (y = 0) AS src_delta,
 sqrt(greatest((var_pop(value) FILTER (y = 1) * count(*) FILTER (y = 1) + var_pop(value) FILTER (y = 0) * count(*) FILTER (y = 0)) / count(*), 1e-12)) AS src_sd FROM src GROUP BY feature),
pl AS (SELECT site, feature, avg(value) AS loc, var_pop(value) AS var FROM dst GROUP BY ALL),
orc AS (SELECT site, feature, (avg(value) FILTER (y = 1) + avg(value) FILTER (y = 0)) / 2 AS loc,
 (var_pop(value) FILTER (y = 1) * count(*) FILTER (y = 1) + var_pop(value) FILTER (y = 0) * count(*) FILTER (y = 0)) / count(*) AS var FROM dst GROUP BY ALL)"""


def _dest(spark, sf):
    f = X.long_emb(spark, sf)
    return f.where("site <> 'S0'"), H.source_reference(f.where("site = 'S0'"))


@query("map_destination", ctes=["long_emb"], rounded=["plain", "oracle", "balanced"], sql=f"""WITH {DEST},
w AS (SELECT *, CASE WHEN y = 1 THEN 0.7 ELSE 0.4 END::DOUBLE AS q FROM dst),
m AS (SELECT site, feature, sum(q * value) / sum(q) AS m1, sum((1 - q) * value) / sum(1 - q) AS m0 FROM w GROUP BY ALL),
sf AS (SELECT site, feature, any_value(m1 + m0) / 2 AS loc, avg(q * pow(value - m1, 2) + (1 - q) * pow(value - m0, 2)) AS var FROM w JOIN m USING (site, feature) GROUP BY ALL)
SELECT key, feature, (value - pl.loc) / sqrt(pl.var) * src_sd + src_loc AS plain, (value - orc.loc) / sqrt(orc.var) * src_sd + src_loc AS oracle,
 (value - sf.loc) / sqrt(sf.var) * src_sd + src_loc AS balanced
FROM dst JOIN rf USING (feature) JOIN pl USING (site, feature) JOIN orc USING (site, feature) JOIN sf USING (site, feature)""")
def _(spark, sf):
    d, ref = _dest(spark, sf)
    d = d.withColumn("q", F.when(F.col("y") == 1, 0.7).otherwise(0.4))
    one = lambda m: H.map_destination(d, ref, mode=m, soft="q").select("key", "feature", F.col("value").alias(m))
    return one("plain").join(one("oracle"), ["key", "feature"]).join(one("balanced"), ["key", "feature"])


@query("map_destination_prior", ctes=["long_emb"], rounded=["value"], sql=f"""WITH {DEST}, pi AS (SELECT site, avg(y) AS pi0, greatest(least(avg(y) + 0.15, 0.98), 0.02) AS pi FROM dst GROUP BY site),
r AS (SELECT site, feature, loc, pi, src_loc, src_delta, sqrt(var / (src_sd * src_sd + pi * (1 - pi) * src_delta * src_delta)) AS r FROM pl JOIN rf USING (feature) JOIN pi USING (site))
SELECT key, feature, (value - (loc - (pi - 0.5) * r * src_delta)) / r + src_loc AS value FROM dst JOIN r USING (site, feature)""")
def _(spark, sf):
    d, ref = _dest(spark, sf)
    return H.map_destination_prior(d, ref, shift=0.15).select("key", "feature", "value")


@query("instance_harmonise", ctes=["long_bag"], rounded=["mean", "sd"], digits=5, sql=f"""
WITH RECURSIVE b AS (SELECT *, 0 AS fold, CASE WHEN site = 'S3' THEN 'test' ELSE 'train' END AS role FROM long_bag),
 cb AS ({COMBAT['plain'].replace('long_folds', 'b')}), {_eb_sql('SELECT * FROM cb')[len('RECURSIVE '):]},
 ref AS (SELECT DISTINCT feature, alpha, sigma FROM cb),
 ns AS (SELECT site, feature, (avg(value) - any_value(alpha)) / any_value(sigma) AS gamma, greatest(var_pop(value) / pow(any_value(sigma), 2), 1e-8) AS delta
   FROM b JOIN ref USING (feature) WHERE role = 'test' GROUP BY ALL),
 pm AS (SELECT site, feature, gamma, delta FROM eb UNION ALL SELECT * FROM ns),
 x AS (SELECT b.* REPLACE (sigma * ((value - alpha) / sigma - gamma) / sqrt(delta) + alpha AS value) FROM b JOIN ref USING (feature) JOIN pm USING (site, feature)),
 z AS (SELECT feature, avg(value) AS m, stddev_pop(value) + 1e-6 AS d FROM x WHERE role = 'train' GROUP BY feature)
SELECT role, site, feature, count(*) AS n, avg((value - m) / d) AS mean, stddev_pop((value - m) / d) AS sd FROM x JOIN z USING (feature) GROUP BY ALL""")
def _(spark, sf):
    b = X.long_bag(spark, sf).withColumn("role", F.when(F.col("site") == "S3", "test").otherwise("train"))
    return H.instance_harmonise(b).groupBy("role", "site", "feature").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))


CHAIN = f"""RECURSIVE f0 AS (SELECT s.fold, s.role, l.* FROM emb_split s JOIN long_missing l ON s.key = l.key),
 md AS (SELECT fold, feature, coalesce(quantile_cont(value, 0.5), 0) AS fill FROM f0 WHERE role = 'train' GROUP BY ALL HAVING avg((value IS NULL)::INT) <= 0.2),
 f1 AS (SELECT f0.* REPLACE (coalesce(value, fill) AS value) FROM f0 JOIN md USING (fold, feature)),
 cb AS ({COMBAT['balanced'].replace('long_folds', 'f1')}), {_eb_sql('SELECT * FROM cb')[len('RECURSIVE '):]},
 f2 AS (SELECT f1.* REPLACE (sigma * ((value - alpha) / sigma - eb.gamma) / sqrt(eb.delta) + alpha AS value) FROM f1
   JOIN cb ON f1.fold = cb.fold AND f1.site = cb.site AND f1.feature = cb.feature JOIN eb ON f1.fold = eb.fold AND f1.site = eb.site AND f1.feature = eb.feature),
 zs AS (SELECT fold, feature, avg(value) AS m, stddev_pop(value) + 1e-8 AS d FROM f2 WHERE role = 'train' GROUP BY ALL),
 f3 AS (SELECT f2.* REPLACE ((value - m) / d AS value) FROM f2 JOIN zs USING (fold, feature))"""


@query("fit_apply_chain", ctes=MISS, rounded=["mean", "sd"], digits=5, sql=f"""WITH {CHAIN}
SELECT fold, role, site, feature, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd FROM f3 GROUP BY ALL""")
def _(spark, sf):
    d = H.fit_apply(_folds(spark, sf), ["fold"], "balanced_combat")
    return d.groupBy("fold", "role", "site", "feature").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))


# ---- ranking ------------------------------------------------------------------------------------------------
TRAIN = "(SELECT * FROM long_folds WHERE role = 'train')"
RANK = f"""SELECT fold, feature, score, row_number() OVER (PARTITION BY fold ORDER BY round(score, 12) DESC, feature)::INT AS rank FROM (
  SELECT fold, feature, avg(abs(auc - 0.5)) AS score FROM ({_auc_sql(TRAIN, 'fold, site, feature', s='value')}) GROUP BY ALL)"""
CORR = """SELECT a.fold, a.feature AS i, b.feature AS j, abs(corr(a.value, b.value)) AS r FROM long_folds a JOIN long_folds b
  ON a.fold = b.fold AND a.key = b.key AND a.feature < b.feature AND a.role = 'train' AND b.role = 'train' GROUP BY ALL"""


def _train(spark, sf):
    return H.train_rows(X.long_folds(spark, sf))


def _train_vectors(spark, sf):
    return H.train_rows(X.emb_split(spark, sf)).join(X.wide_emb(spark, sf), "key")


@query("within_site_auc_rank", ctes=["long_folds"], rounded=["score"], sql=RANK)
def _(spark, sf):
    return S.within_site_auc_rank(_train(spark, sf), ["fold"])


ANOVA = """
WITH t AS (SELECT * FROM long_folds WHERE role = 'train'), c AS (SELECT fold, feature, y, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM t GROUP BY ALL),
g AS (SELECT fold, feature, avg(value) AS gm FROM t GROUP BY ALL)
SELECT fold, feature, sum(n * pow(m - gm, 2)) / (count(*) - 1) / (sum(n * v) / (sum(n) - count(*))) AS f FROM c JOIN g USING (fold, feature) GROUP BY ALL"""


@query("anova_f", ctes=["long_folds"], rounded=["f"], digits=4, sql=ANOVA)
def _(spark, sf):
    return S.anova_f(_train(spark, sf), ["fold"])


@query("abs_corr_matrix", ctes=["long_folds"], rounded=["r"], sql=CORR)
def _(spark, sf):
    return S.abs_corr_matrix(_train_vectors(spark, sf), "features", ["fold"])


@query("corr_prune_topk", ctes=["long_folds"], sql=f"""
WITH RECURSIVE rk AS ({RANK}), pairs AS ({CORR}),
bad AS (SELECT fold, f, list(o) AS bad FROM (SELECT fold, i AS f, j AS o FROM pairs WHERE r > 0.25 UNION ALL SELECT fold, j, i FROM pairs WHERE r > 0.25) GROUP BY ALL),
todo AS (SELECT rk.fold, rk.rank, rk.feature, coalesce(bad, []::INT[]) AS bad FROM rk LEFT JOIN bad ON rk.fold = bad.fold AND rk.feature = bad.f),
walk AS (SELECT DISTINCT fold, 0 AS i, []::INT[] AS kept FROM todo
 UNION ALL SELECT w.fold, i + 1, CASE WHEN len(kept) >= 10 OR list_has_any(bad, kept) THEN kept ELSE list_append(kept, feature) END FROM walk w JOIN todo t ON w.fold = t.fold AND t.rank = w.i + 1)
SELECT fold, unnest(kept) AS feature, unnest(range(1, len(kept) + 1))::INT AS position FROM (SELECT fold, arg_max(kept, i) AS kept FROM walk GROUP BY fold)""")
def _(spark, sf):
    ranked = S.within_site_auc_rank(_train(spark, sf), ["fold"])
    return S.corr_prune_topk(ranked, S.abs_corr_matrix(_train_vectors(spark, sf), "features", ["fold"]), ["fold"], 0.25, 10)


@query("mrmr_rank", ctes=["long_folds"], rounded=["relevance", "redundancy", "score"], digits=4, sql=f"""
WITH RECURSIVE fs AS ({ANOVA}), pairs AS ({CORR}), bo AS (SELECT fold, i AS feature, j AS other, r FROM pairs UNION ALL SELECT fold, j, i, r FROM pairs),
walk AS (SELECT DISTINCT fold, 0 AS i, []::INT[] AS sel, NULL::INT AS feature, NULL::DOUBLE AS f, NULL::DOUBLE AS red, NULL::DOUBLE AS score FROM fs
 UNION ALL SELECT fold, i + 1, list_append(sel, feature), feature, f, red, score FROM (
  SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, feature) AS rn FROM (
   SELECT w.fold, w.i, w.sel, c.feature, c.f, avg(b.r) AS red, c.f - coalesce(avg(b.r), 0) AS score FROM walk w JOIN fs c ON w.fold = c.fold AND NOT list_contains(w.sel, c.feature)
    LEFT JOIN bo b ON b.fold = c.fold AND b.feature = c.feature AND list_contains(w.sel, b.other) WHERE w.i < 10 GROUP BY w.fold, w.i, w.sel, c.feature, c.f)) WHERE rn = 1)
SELECT fold, feature, i AS position, f AS relevance, red AS redundancy, score FROM walk WHERE i > 0""")
def _(spark, sf):
    return S.mrmr_rank(S.anova_f(_train(spark, sf), ["fold"]), S.abs_corr_matrix(_train_vectors(spark, sf), "features", ["fold"]), ["fold"], 10)
