"""Metrics, curves, bootstrap and tests over labelled documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenhand.operators import metrics as M
from evenhand.operators import resample as B
from evenhand.operators import stattests as T
from evenhand.plans import frames as X
from evenhand.plans.registry import query

# AUC by running class totals over distinct scores, in SQL.
AUC = """sum(w1 * (below + 0.5 * w0)) / nullif(sum(w1) * sum(w0), 0)"""


def _auc_sql(src, by="", w="1.0", s="score", y="y"):
    part = f"PARTITION BY {by}" if by else ""
    head = f"{by}, " if by else ""
    return f"""SELECT {head}{AUC} AS auc FROM (
      SELECT *, coalesce(sum(w0) OVER ({part} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
        SELECT {head}{s} AS s, sum(CASE WHEN {y} = 1 THEN {w} ELSE 0 END) AS w1, sum(CASE WHEN {y} = 0 THEN {w} ELSE 0 END) AS w0
        FROM {src} GROUP BY {head}s)) {'GROUP BY ' + by if by else ''}"""


WTD = "(SELECT *, 1.0 / count(*) OVER (PARTITION BY site, y) AS w FROM obs)"


@query("evaluation_headline", ctes=["obs"], rounded=["pooled_auc", "sb_auc", "mean_site_auc"], sql=f"""
WITH sa AS ({_auc_sql('obs', 'site')})
SELECT (SELECT auc FROM ({_auc_sql('obs')})) AS pooled_auc, (SELECT auc FROM ({_auc_sql(WTD, w='w')})) AS sb_auc,
  (SELECT avg(auc) FROM sa) AS mean_site_auc, (SELECT count(auc) FROM sa) AS n_groups""")
def _(spark, sf):
    o = X.obs(spark, sf)
    pooled = M.weighted_auc(o).select(F.col("auc").alias("pooled_auc"))
    return T.attach_one(T.attach_one(pooled, M.site_balanced_auc(o)), M.mean_group_auc(o, "site").select(
        F.col("mean_auc").alias("mean_site_auc"), "n_groups"))


@query("weighted_auc", ctes=["obs"], rounded=["auc"], sql=_auc_sql("obs"))
def _(spark, sf):
    return M.weighted_auc(X.obs(spark, sf))


@query("site_balanced_auc", ctes=["obs"], rounded=["sb_auc"], sql=f"SELECT auc AS sb_auc FROM ({_auc_sql(WTD, w='w')})")
def _(spark, sf):
    return M.site_balanced_auc(X.obs(spark, sf))


@query("auc_by_site", ctes=["obs"], rounded=["auc"], sql=f"""
SELECT a.site, a.auc, c.n, c.n_pos FROM ({_auc_sql('obs', 'site')}) a
JOIN (SELECT site, count(*) AS n, sum(y)::BIGINT AS n_pos FROM obs GROUP BY site) c ON a.site = c.site""")
def _(spark, sf):
    return M.auc_by_group(X.obs(spark, sf), "site")


@query("feature_auc_by_site", ctes=["long_emb"], rounded=["auc"], sql=_auc_sql("long_emb", "site, feature", s="value"))
def _(spark, sf):
    return M.weighted_auc(X.long_emb(spark, sf), s="value", by=["site", "feature"])


CURVE = """SELECT site, score AS threshold, sum(w1) OVER d AS tp, sum(w0) OVER d AS fp, sum(w1) OVER g AS pos,
    sum(w0) OVER g AS neg, w1 AS d_tp FROM (SELECT site, score, sum(y)::DOUBLE AS w1, sum(1 - y)::DOUBLE AS w0 FROM obs GROUP BY ALL)
  WINDOW d AS (PARTITION BY site ORDER BY score DESC ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY site)"""


@query("pr_auc_by_site", ctes=["obs"], rounded=["pr_auc"], sql=f"""
SELECT site, sum(d_tp / nullif(pos, 0) * tp / (tp + fp)) AS pr_auc FROM ({CURVE}) GROUP BY site""")
def _(spark, sf):
    return M.pr_auc(X.obs(spark, sf), by=["site"])


@query("cumulative_counts", ctes=["obs"], sql=CURVE)
def _(spark, sf):
    return M.cumulative_counts(X.obs(spark, sf), by=["site"])


@query("roc_points", ctes=["obs"], rounded=["fpr", "tpr"], sql=f"""
SELECT site, threshold, fp / nullif(neg, 0) AS fpr, tp / nullif(pos, 0) AS tpr FROM ({CURVE})
UNION ALL SELECT DISTINCT site, NULL, 0.0, 0.0 FROM obs""")
def _(spark, sf):
    return M.roc_points(X.obs(spark, sf), by=["site"])


@query("pr_points", ctes=["obs"], rounded=["recall", "precision"], sql=f"""
SELECT site, threshold, tp / nullif(pos, 0) AS recall, tp / (tp + fp) AS precision FROM ({CURVE})
UNION ALL SELECT DISTINCT site, NULL, 0.0, 1.0 FROM obs""")
def _(spark, sf):
    return M.pr_points(X.obs(spark, sf), by=["site"])


CONF = """count(*) FILTER ({hit} AND y = 1) AS tp, count(*) FILTER ({hit} AND y = 0) AS fp,
 count(*) FILTER (NOT ({hit}) AND y = 0) AS tn, count(*) FILTER (NOT ({hit}) AND y = 1) AS fn"""
RATES = """tp, fp, tn, fn, tp::DOUBLE / nullif(tp + fn, 0) AS sensitivity, tn::DOUBLE / nullif(tn + fp, 0) AS specificity,
 coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, tn::DOUBLE / nullif(tn + fn, 0) AS npv,
 coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, (tp + tn)::DOUBLE / (tp + fp + tn + fn) AS accuracy,
 (tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0) AS mcc,
 CASE WHEN tp + fn = 0 THEN tn::DOUBLE / nullif(tn + fp, 0) WHEN tn + fp = 0 THEN tp::DOUBLE / (tp + fn)
   ELSE (tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2 END AS balanced_accuracy"""
RATE_COLS = ["sensitivity", "specificity", "precision", "npv", "f1", "accuracy", "mcc", "balanced_accuracy"]


@query("confusion_row_threshold", ctes=["obs"], sql=f"""
SELECT site, {CONF.format(hit='score >= thr')} FROM (SELECT *, avg(score) OVER (PARTITION BY site) AS thr FROM obs) GROUP BY site""")
def _(spark, sf):
    from evenhand.operators.core import attach_stats

    o = attach_stats(X.obs(spark, sf), ["site"], F.avg("score").alias("thr"))
    return M.confusion(o, "score", "thr", by=["site"])


@query("threshold_metrics", ctes=["obs"], rounded=RATE_COLS, sql=f"""
SELECT site, {RATES} FROM (SELECT site, {CONF.format(hit='score >= 500')} FROM obs GROUP BY site)""")
def _(spark, sf):
    return M.threshold_metrics(X.obs(spark, sf), threshold=500.0, by=["site"])


@query("weighted_threshold_metrics", ctes=["obs"], rounded=["tp", "fp", "tn", "fn", *RATE_COLS], sql=f"""
WITH w AS (SELECT *, (SELECT count(*) FROM obs)::DOUBLE / ((SELECT count(*) FROM (SELECT DISTINCT site, y FROM obs))
   * count(*) OVER (PARTITION BY site, y)) AS w FROM obs),
c AS (SELECT coalesce(sum(w) FILTER (score > 1000 AND y = 1), 0) AS tp, coalesce(sum(w) FILTER (score > 1000 AND y = 0), 0) AS fp,
  coalesce(sum(w) FILTER (score <= 1000 AND y = 0), 0) AS tn, coalesce(sum(w) FILTER (score <= 1000 AND y = 1), 0) AS fn FROM w)
SELECT {RATES} FROM c""")
def _(spark, sf):
    from evenhand.operators.splits import strata_weights

    o = strata_weights(X.obs(spark, sf), ["site", "y"])
    return M.threshold_metrics(o, threshold=1000.0, w="weight", strict=True)


@query("brier", ctes=["prob_pair"], rounded=["brier"], sql="SELECT site, avg(pow(pa - y, 2)) AS brier FROM prob_pair GROUP BY site")
def _(spark, sf):
    return M.brier(X.prob_pair(spark, sf), "pa", by=["site"])


# Newton steps of the one-feature logistic as a recursive query, the slope lightly penalised. A step is halved until its loss is least
# (0 stays): whole steps run off or swing where most labels are 1.
SHARES = "(SELECT CASE WHEN k < 30 THEN pow(0.5, k) ELSE 0 END AS s FROM range(31) t(k))"
LOSS = "sum(n * (greatest(t, 0) + ln(1 + exp(-abs(t)))) - w1 * t)"
NEWTON = f"""z AS (SELECT ln(greatest(least(pa, 1 - 1e-6), 1e-6) / (1 - greatest(least(pa, 1 - 1e-6), 1e-6))) AS z, sum(y)::DOUBLE AS w1, count(*)::DOUBLE AS n
 FROM prob_pair WHERE pa IS NOT NULL AND y IS NOT NULL GROUP BY 1),
nw AS (SELECT 0 AS i, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b UNION ALL SELECT i + 1, arg_min(a, loss), arg_min(b, loss) FROM (
 SELECT i, a, b, {LOSS} + a * a / 2e6 AS loss FROM (SELECT *, a * z + b AS t FROM (
  SELECT i, a + s * (hbb * ga - hab * gb) / det AS a, greatest(-20, least(20, b + s * (haa * gb - hab * ga) / det)) AS b FROM (
   SELECT *, greatest(haa * hbb - hab * hab, 1e-300) AS det FROM (
    SELECT i, a, b, sum(w1 - n * m) AS gb, sum((w1 - n * m) * z) - a / 1e6 AS ga, sum(n * m * (1 - m)) AS hbb, sum(n * m * (1 - m) * z) AS hab, sum(n * m * (1 - m) * z * z) + 1 / 1e6 AS haa
    FROM (SELECT *, 1 / (1 + exp(-(a * z + b))) AS m FROM nw, z WHERE i < 60) GROUP BY i, a, b)), {SHARES}), z) GROUP BY i, a, b) GROUP BY i),
ic AS (SELECT 0 AS i, 0.0::DOUBLE AS b UNION ALL SELECT i + 1, arg_min(b, loss) FROM (
 SELECT i, b, {LOSS} AS loss FROM (SELECT *, z + b AS t FROM (SELECT i, greatest(-20, least(20, b + s * db)) AS b FROM (
  SELECT i, b, sum(w1 - n * m) / greatest(sum(n * m * (1 - m)), 1e-12) AS db FROM (SELECT *, 1 / (1 + exp(-(z + b))) AS m FROM ic, z WHERE i < 60) GROUP BY i, b), {SHARES}), z)
 GROUP BY i, b) GROUP BY i)"""


@query("calibration_slope_intercept", ctes=["prob_pair"], rounded=["slope", "intercept"], digits=4, sql=f"""WITH RECURSIVE {NEWTON}
SELECT (SELECT sum(n)::BIGINT FROM z) AS n, (SELECT arg_max(a, i) FROM nw) AS slope, (SELECT arg_max(b, i) FROM ic) AS intercept""")
def _(spark, sf):
    return M.calibration(X.prob_pair(spark, sf), "pa")


def _stacked(spark, sf):
    d = X.prob_pair(spark, sf)
    return d.select("key", "site", "y", F.explode(F.array(
        F.struct(F.lit("a").alias("model"), F.col("pa").alias("score")),
        F.struct(F.lit("b").alias("model"), F.col("pb").alias("score")))).alias("x")).select("key", "site", "y", "x.*")


STACK = "(SELECT key, site, y, 'a' AS model, pa AS score FROM prob_pair UNION ALL SELECT key, site, y, 'b', pb FROM prob_pair)"
FOLD_METRICS = f"""SELECT a.model, a.site, a.auc, p.pr_auc, t.brier, {', '.join('t.' + c for c in ['tp', 'fp', 'tn', 'fn', *RATE_COLS])} FROM
 (SELECT * FROM ({_auc_sql(STACK, 'model, site')})) a
 JOIN (SELECT model, site, sum(w1 / nullif(pos, 0) * tp / (tp + fp)) AS pr_auc FROM (
   SELECT *, sum(w1) OVER d AS tp, sum(w0) OVER d AS fp, sum(w1) OVER (PARTITION BY model, site) AS pos FROM (
     SELECT model, site, score, sum(y)::DOUBLE AS w1, sum(1 - y)::DOUBLE AS w0 FROM {STACK} GROUP BY ALL)
   WINDOW d AS (PARTITION BY model, site ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) GROUP BY ALL) p
   ON a.model = p.model AND a.site = p.site
 JOIN (SELECT model, site, brier, {RATES} FROM (SELECT model, site, avg(pow(score - y, 2)) AS brier,
   {CONF.format(hit='score >= 0.5')} FROM {STACK} GROUP BY ALL)) t ON a.model = t.model AND a.site = t.site"""


@query("fold_metrics", ctes=["prob_pair"], rounded=["auc", "pr_auc", "brier", *RATE_COLS], sql=FOLD_METRICS)
def _(spark, sf):
    return M.fold_metrics(_stacked(spark, sf), ["model", "site"])


@query("model_differences", ctes=["prob_pair"], rounded=["mean_diff", "min_diff", "max_diff"], sql=f"""
WITH m AS ({FOLD_METRICS}), u AS (UNPIVOT (SELECT model, site, auc, pr_auc, brier FROM m) ON auc, pr_auc, brier INTO NAME metric VALUE value)
SELECT a.metric, avg(a.value - b.value) AS mean_diff, min(a.value - b.value) AS min_diff, max(a.value - b.value) AS max_diff,
  count(*) FILTER (a.value - b.value > 0) AS n_better
FROM u a JOIN u b ON a.site = b.site AND a.metric = b.metric AND a.model = 'a' AND b.model = 'b' GROUP BY a.metric""")
def _(spark, sf):
    m = M.fold_metrics(_stacked(spark, sf), ["model", "site"])
    return M.model_differences(m, "a", "b", ["auc", "pr_auc", "brier"], ["site"])


@query("dice_overlap", ctes=["cells"], rounded=["dice"], sql="""
SELECT "case", count(*) FILTER (mask AND region) AS n_both, count(*) FILTER (mask) AS n_a, count(*) FILTER (region) AS n_b,
 coalesce(2.0::DOUBLE * count(*) FILTER (mask AND region) / nullif(count(*) FILTER (mask) + count(*) FILTER (region), 0), 1) AS dice,
 count(*) FILTER (mask AND region) > 0 AS hit FROM cells GROUP BY "case" """)
def _(spark, sf):
    return M.dice(X.cells(spark, sf), "mask", "region", ["case"])


@query("label_agreement", ctes=["prob_pair"], rounded=["agreement"], sql="""
SELECT site, avg(((pa >= 0.5) = (pb >= 0.5))::INT) AS agreement FROM prob_pair GROUP BY site""")
def _(spark, sf):
    return M.label_agreement(X.prob_pair(spark, sf), "pa", "pb", by=["site"])


@query("select_threshold", ctes=["prob_pair"], rounded=["threshold", "balanced_accuracy"], sql="""
WITH c AS (SELECT site, pa AS threshold, sum(w1) OVER d AS tp, sum(w0) OVER d AS fp, sum(w1) OVER g AS pos, sum(w0) OVER g AS neg
  FROM (SELECT site, pa, sum(y)::DOUBLE AS w1, sum(1 - y)::DOUBLE AS w0 FROM prob_pair GROUP BY ALL)
  WINDOW d AS (PARTITION BY site ORDER BY pa DESC ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY site)),
b AS (SELECT *, (tp / nullif(pos, 0) + 1 - fp / nullif(neg, 0)) / 2 AS balanced_accuracy FROM c)
SELECT site, threshold, balanced_accuracy FROM (SELECT *, row_number() OVER (PARTITION BY site
  ORDER BY round(balanced_accuracy, 12) DESC, abs(threshold - 0.5), threshold) AS rn FROM b) WHERE rn = 1""")
def _(spark, sf):
    return M.select_threshold(X.prob_pair(spark, sf), s="pa", by=["site"])


# ---- bootstrap ----------------------------------------------------------------------------------------------
def draws_sql(src, strata, b, seed):
    """CTE ``hit``: the rows of ``src`` once per draw. Draws are numbers of a scrambled sequence per (replicate, stratum, block); strata of several
    blocks first spread their draws over the blocks."""
    part = f"PARTITION BY {strata}" if strata else ""
    label = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in strata.split(", ")) if strata else "''"
    start = lambda block: f"('0x' || substr(md5('{seed}|' || b || '|' || stratum || '|' || {block}), 1, 8))::BIGINT"
    turn = lambda x: f"((xor({x}, {x} >> 16) * 73244475) & 4294967295)"

    def number(begin, i):
        twice = turn(turn(f"(({begin} + {i} * 2654435769) & 4294967295)"))
        return f"xor({twice}, {twice} >> 16)"

    return f"""
pos AS (SELECT *, {label} AS stratum, row_number() OVER ({part} ORDER BY ('0x' || substr(md5('order|' || key), 1, 15))::BIGINT, key) AS j, count(*) OVER ({part}) AS n FROM {src}),
reps AS (SELECT stratum, n, t.b FROM (SELECT DISTINCT stratum, n FROM pos), range(1, {b + 1}) t(b)),
spread AS (SELECT stratum, n, b, floor((({number('high', 'i')}) * 2097152 + ({number('low', 'i')} >> 11)) / 9007199254740992.0::DOUBLE * n)::BIGINT // 65536 AS blk
  FROM (SELECT *, {start("'high'")} AS high, {start("'low'")} AS low, unnest(range(1, n + 1)) AS i FROM reps WHERE n > 65536)),
shares AS (SELECT stratum, n, b, 0 AS blk, n AS c FROM reps WHERE n <= 65536 UNION ALL SELECT stratum, n, b, blk, count(*) FROM spread GROUP BY ALL),
begun AS (SELECT stratum, b, blk, least(n - blk * 65536, 65536) AS size, {start('blk')} AS st, unnest(range(1, c + 1)) AS i FROM shares),
drawn AS (SELECT stratum, b, blk * 65536 + (({number('st', 'i')} * size) >> 32) + 1 AS j FROM begun),
hit AS (SELECT d.b, p.* EXCLUDE (stratum) FROM drawn d JOIN pos p USING (stratum, j))"""


@query("stratified_bootstrap_ci", ctes=["obs"], rounded=["lo", "median", "hi"], sql=f"""
WITH {draws_sql('obs', 'site, y', 2000, 1)},
a AS ({_auc_sql('hit', 'b', w='1.0 / n')})
SELECT quantile_cont(auc, 0.025) AS lo, quantile_cont(auc, 0.5) AS median, quantile_cont(auc, 0.975) AS hi FROM a""")
def _(spark, sf):
    return B.stratified_bootstrap_ci(X.obs(spark, sf))


@query("class_bootstrap_ci", ctes=["obs"], rounded=["lo", "median", "hi"], sql=f"""
WITH {draws_sql('obs', 'y', 2000, 1)},
a AS ({_auc_sql('hit', 'b')})
SELECT quantile_cont(auc, 0.025) AS lo, quantile_cont(auc, 0.5) AS median, quantile_cont(auc, 0.975) AS hi FROM a""")
def _(spark, sf):
    return B.class_bootstrap_ci(X.obs(spark, sf))


def _ap_sql(src, by, s):
    head = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""SELECT {head}sum(w1 / nullif(pos, 0) * tp / (tp + fp)) AS ap FROM (
   SELECT *, sum(w1) OVER d AS tp, sum(w0) OVER d AS fp, sum(w1) OVER ({part}) AS pos FROM (
     SELECT {head}{s} AS s, sum(y)::DOUBLE AS w1, sum(1 - y)::DOUBLE AS w0 FROM {src} GROUP BY ALL)
   WINDOW d AS ({part} ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) {'GROUP BY ' + by if by else ''}"""


def _paired_sql(strata):
    return f"""
WITH {draws_sql('obs_pair', strata, 2000, 1)},
ra AS ({_auc_sql('hit', 'b', s='pa')}), rb AS ({_auc_sql('hit', 'b', s='pb')}),
qa AS ({_ap_sql('hit', 'b', 'pa')}), qb AS ({_ap_sql('hit', 'b', 'pb')}),
vals AS (SELECT 'd_roc' AS metric, ra.auc - rb.auc AS value FROM ra JOIN rb USING (b)
  UNION ALL SELECT 'd_pr', qa.ap - qb.ap FROM qa JOIN qb USING (b)),
seen AS (SELECT 'd_roc' AS metric, (SELECT auc FROM ({_auc_sql('obs_pair', s='pa')})) - (SELECT auc FROM ({_auc_sql('obs_pair', s='pb')})) AS observed
  UNION ALL SELECT 'd_pr', (SELECT ap FROM ({_ap_sql('obs_pair', '', 'pa')})) - (SELECT ap FROM ({_ap_sql('obs_pair', '', 'pb')})))
SELECT metric, any_value(observed) AS observed, avg(value) AS mean, stddev_samp(value) AS sd, count(*) - count(value) AS n_skipped,
 avg((value > 0)::INT) AS share_above, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.5) AS median,
 quantile_cont(value, 0.975) AS hi, quantile_cont(value, 0.025) <= 0 AND quantile_cont(value, 0.975) >= 0 AS includes_zero
FROM vals JOIN seen USING (metric) GROUP BY metric"""


PAIR_COLS = ["observed", "mean", "sd", "share_above", "lo", "median", "hi"]


@query("paired_bootstrap", ctes=["obs_pair"], rounded=PAIR_COLS, sql=_paired_sql(""))
def _(spark, sf):
    return B.paired_bootstrap_summary(X.obs_pair(spark, sf), "pa", "pb")


@query("site_stratified_paired_bootstrap", ctes=["obs_pair"], rounded=PAIR_COLS, sql=_paired_sql("site"))
def _(spark, sf):
    return B.paired_bootstrap_summary(X.obs_pair(spark, sf), "pa", "pb", strata=["site"])


# ---- tests --------------------------------------------------------------------------------------------------
MID = "rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0"


@query("mid_ranks", ctes=["obs"], rounded=["mid_rank"], sql=f"SELECT key, site, {MID.format(by='site', v='score')}::DOUBLE AS mid_rank FROM obs")
def _(spark, sf):
    return T.mid_ranks(X.obs(spark, sf), ["site"], "score").select("key", "site", "mid_rank")


# complementary error function to a relative 1e-7, enough for the rounding used here
ERFC = """(1 / (1 + 0.5 * {x})) * exp(-{x} * {x} - 1.26551223 + (1 / (1 + 0.5 * {x})) * (1.00002368 + (1 / (1 + 0.5 * {x})) * (0.37409196
 + (1 / (1 + 0.5 * {x})) * (0.09678418 + (1 / (1 + 0.5 * {x})) * (-0.18628806 + (1 / (1 + 0.5 * {x})) * (0.27886807
 + (1 / (1 + 0.5 * {x})) * (-1.13520398 + (1 / (1 + 0.5 * {x})) * (1.48851587 + (1 / (1 + 0.5 * {x})) * (-0.82215223
 + (1 / (1 + 0.5 * {x})) * 0.17087277)))))))))"""


def _mw_sql(src, by, v):
    return f"""SELECT {by}, n1::BIGINT AS n1, n0::BIGINT AS n0, u, u / nullif(n1 * n0, 0) AS auc, z, {ERFC.format(x='(z / sqrt(2.0::DOUBLE))')} AS p FROM (
  SELECT *, greatest(abs(u - n1 * n0 / 2) - 0.5, 0) / nullif(sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - t / ((n1 + n0) * (n1 + n0 - 1)))), 0) AS z FROM (
   SELECT {by}, sum(c1) AS n1, sum(c0) AS n0, sum(c1 * (cum - 0.5 * c0)) AS u, sum(pow(c1 + c0, 3) - (c1 + c0)) AS t FROM (
    SELECT *, sum(c0) OVER (PARTITION BY {by} ORDER BY {v} ROWS UNBOUNDED PRECEDING) AS cum FROM (
     SELECT {by}, {v}, sum(y)::DOUBLE AS c1, sum(1 - y)::DOUBLE AS c0 FROM {src} WHERE {v} IS NOT NULL GROUP BY ALL)) GROUP BY {by}))"""


@query("mann_whitney", ctes=["obs"], rounded=["u", "auc", "z", "p"], digits=5, sql=_mw_sql("obs", "site", "score"))
def _(spark, sf):
    return T.mann_whitney(X.obs(spark, sf), "score", by=["site"])


def _kw_sql(src, by, v):
    return f"""SELECT {by}, n::BIGINT AS n, k, h, (h - k + 1) / (n - k) AS eta2,
  {ERFC.format(x='sqrt(h / 2)')} + sqrt(2 * h / pi()) * exp(-h / 2) AS p FROM (
  SELECT {by}, n, k, (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS h FROM (
   SELECT {by}, sum(ng) AS n, count(*) AS k, sum(rs * rs / ng) AS s FROM (
    SELECT {by}, site, count(*)::DOUBLE AS ng, sum(r)::DOUBLE AS rs FROM (SELECT {by}, site, {MID.format(by=by, v=v)} AS r FROM {src}) GROUP BY ALL) GROUP BY {by}) a
   JOIN (SELECT {by}, sum(c * c * c - c) AS t FROM (SELECT {by}, {v}, count(*)::DOUBLE AS c FROM {src} GROUP BY ALL) GROUP BY {by}) b USING ({by}))"""


@query("kruskal_wallis", ctes=["long_emb"], rounded=["h", "eta2", "p"], digits=4, sql=_kw_sql("long_emb", "feature", "value"))
def _(spark, sf):
    return T.kruskal_wallis(X.long_emb(spark, sf), by=["feature"])


@query("chi2_independence", rounded=["chi2"], sql="""
WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY ALL),
e AS (SELECT a.a, b.b, a.n::DOUBLE * b.n / (SELECT sum(o) FROM c) AS e FROM (SELECT a, sum(o) AS n FROM c GROUP BY a) a,
  (SELECT b, sum(o) AS n FROM c GROUP BY b) b)
SELECT sum(pow(coalesce(o, 0) - e, 2) / e) AS chi2,
 (((SELECT count(DISTINCT a) FROM c) - 1) * ((SELECT count(DISTINCT b) FROM c) - 1))::BIGINT AS df
FROM e LEFT JOIN c USING (a, b)""")
def _(spark, sf):
    li = X.table(spark, sf, "lineitem")
    return T.chi2_independence(li, "l_returnflag", "l_linestatus").select("chi2", F.col("df").cast("bigint").alias("df"))


@query("bh_fdr", ctes=["long_emb"], sql=f"""
WITH p AS ({_kw_sql('long_emb', 'feature', 'value')}),
r AS (SELECT feature, p, row_number() OVER (ORDER BY p, feature) AS i, count(*) OVER () AS m FROM p)
SELECT feature, coalesce(p <= (SELECT max(p) FROM r WHERE p <= i * 0.05 / m), false) AS reject FROM r""")
def _(spark, sf):
    p = T.kruskal_wallis(X.long_emb(spark, sf), by=["feature"])
    return T.bh_fdr(p).select("feature", "reject")


@query("cliffs_delta", ctes=["obs"], rounded=["delta"], sql=f"SELECT site, 2 * auc - 1 AS delta FROM ({_auc_sql('obs', 'site')})")
def _(spark, sf):
    return T.cliffs_delta(X.obs(spark, sf), "score", "y", by=["site"])


@query("spearman", ctes=["obs_pair"], rounded=["rho"], sql=f"""
SELECT site, corr(ra, rb) AS rho FROM (SELECT site, {MID.format(by='site', v='pa')} AS ra, {MID.format(by='site', v='pb')} AS rb FROM obs_pair) GROUP BY site""")
def _(spark, sf):
    return T.spearman(X.obs_pair(spark, sf), "pa", "pb", by=["site"])
