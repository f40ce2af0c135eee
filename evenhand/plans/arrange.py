"""Windows, picks, splits, weights and bag operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenhand.operators import setops as U
from evenhand.operators import splits as K
from evenhand.operators import windows as Wn
from evenhand.plans import frames as X
from evenhand.plans.registry import query


def tb(spark, sf, name):
    return X.table(spark, sf, name)


@query("first_per_key", sql="""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn
  FROM orders) WHERE rn = 1""")
def _(spark, sf):
    o = tb(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return Wn.first_per_key(o, "o_custkey", [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@query("earliest_group", ctes=["series"], sql="""
WITH e AS (SELECT patient, study FROM (SELECT patient, study, row_number() OVER (PARTITION BY patient ORDER BY study_date NULLS LAST, study) AS rn FROM series) WHERE rn = 1)
SELECT s.patient, s.study, s.line, s.part, s.study_date FROM series s JOIN e USING (patient, study)""")
def _(spark, sf):
    return Wn.earliest_group(X.series(spark, sf), "patient", "study", "study_date").select("patient", "study", "line", "part", "study_date")


@query("zscore_within", rounded=["z"], sql="""SELECT event_id, event_type, (value - avg(value) OVER w) / (stddev_samp(value) OVER w + 1e-8) AS z
  FROM events WINDOW w AS (PARTITION BY event_type)""")
def _(spark, sf):
    return Wn.zscore_within(tb(spark, sf, "events"), ["event_type"], "value", 1e-8).select("event_id", "event_type", "z")


@query("seed_average", rounded=["score"], sql="""SELECT user_id, avg(z) AS score FROM (SELECT user_id,
  (value - avg(value) OVER w) / (stddev_samp(value) OVER w + 1e-8) AS z FROM events WINDOW w AS (PARTITION BY event_type)) GROUP BY 1""")
def _(spark, sf):
    return Wn.seed_average(tb(spark, sf, "events"), ["user_id"], "event_type", "value")


@query("pick_probes", sql="""
WITH r AS (SELECT o_orderkey AS key, o_totalprice AS size, row_number() OVER (ORDER BY o_orderkey) AS i, count(*) OVER () AS n FROM orders),
p AS (SELECT *, CASE WHEN key = (SELECT key FROM r ORDER BY size, key LIMIT 1) THEN 1 WHEN key = (SELECT key FROM r ORDER BY size DESC, key LIMIT 1) THEN 2
 WHEN i = 1 THEN 3 WHEN i = n THEN 4 WHEN i = round_even((n - 1) / 3.0, 0) + 1 THEN 5 WHEN i = round_even((n - 1) * 2 / 3.0, 0) + 1 THEN 6 ELSE 7 END AS priority FROM r)
SELECT key, size, priority FROM p ORDER BY priority, key LIMIT 6""")
def _(spark, sf):
    o = tb(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("size"))
    return Wn.pick_probes(o, "key", "size", 6)


@query("argmax_tie", rounded=["mean_score", "sd_score"], sql="""
WITH m AS (SELECT l_returnflag AS fold, l_linenumber AS epoch, l_quantity::INT AS n_feat, avg(l_discount) AS mean_score, coalesce(stddev_samp(l_discount), 0) AS sd_score FROM lineitem GROUP BY ALL)
SELECT fold, epoch, n_feat, mean_score, sd_score FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(mean_score, 12) DESC, n_feat, epoch) AS rn FROM m) WHERE rn = 1""")
def _(spark, sf):
    s = tb(spark, sf, "lineitem").select(F.col("l_returnflag").alias("fold"), F.col("l_linenumber").alias("epoch"),
                                         F.col("l_quantity").cast("int").alias("n_feat"), F.col("l_discount").alias("score"))
    return Wn.argmax_tie(s, ["fold"], ["epoch", "n_feat"], "score", [F.col("n_feat"), F.col("epoch")])


@query("argmax_tolerance", rounded=["m"], sql="""
WITH m AS (SELECT l_returnflag AS fold, l_quantity::INT AS n_feat, l_linenumber AS c, round(avg(l_discount), 9) AS m FROM lineitem GROUP BY ALL),
g AS (SELECT * FROM (SELECT *, max(m) OVER (PARTITION BY fold) AS best FROM m) WHERE m >= best - 0.003)
SELECT fold, n_feat, c, m, tie_group FROM (SELECT *, count(*) OVER (PARTITION BY fold) AS tie_group, row_number() OVER (PARTITION BY fold ORDER BY n_feat, c) AS rn FROM g) WHERE rn = 1""")
def _(spark, sf):
    m = tb(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("fold"), F.col("l_quantity").cast("int").alias("n_feat"),
                                          F.col("l_linenumber").alias("c")).agg(F.round(F.avg("l_discount"), 9).alias("m"))
    return Wn.argmax_tolerance(m, ["fold"], "m", 0.003, [F.col("n_feat"), F.col("c")])


CONC = """SELECT bag, n, mx * n AS max_times_n, mx / nullif(mn, 0) AS max_over_min, CASE WHEN n > 1 THEN h / ln(n) ELSE 0 END AS entropy, top_mass FROM (
 SELECT bag, max(n) AS n, max(weight) AS mx, min(weight) AS mn, sum(CASE WHEN weight > 0 THEN -weight * ln(weight) ELSE 0 END) AS h,
  sum(weight) FILTER (r <= greatest(1, n // 10)) AS top_mass FROM (SELECT bag, weight, row_number() OVER (PARTITION BY bag ORDER BY weight DESC, inst) AS r,
   count(*) OVER (PARTITION BY bag) AS n FROM bags) GROUP BY bag)"""


@query("concentration", ctes=["bags"], rounded=["max_times_n", "max_over_min", "entropy", "top_mass"], digits=5, sql=CONC)
def _(spark, sf):
    return Wn.concentration(X.bags(spark, sf), "bag", "weight", "inst")


TOPB = """k AS (SELECT *, least(least(8, greatest(1, floor(n * 0.1))), floor(n / 2))::BIGINT AS k FROM (SELECT bag, inst, value, row_number() OVER (PARTITION BY bag ORDER BY value DESC, inst) AS r,
  count(*) OVER (PARTITION BY bag) AS n FROM bags)), f AS (SELECT *, r <= k AS is_top, r > n - k AS is_bottom FROM k)"""


@query("adaptive_top_bottom", ctes=["bags"], sql=f"WITH {TOPB} SELECT bag, inst, k, is_top, is_bottom FROM f")
def _(spark, sf):
    return Wn.adaptive_top_bottom(X.bags(spark, sf).select("bag", "inst", "value"), "bag", "value", "inst").select("bag", "inst", "k", "is_top", "is_bottom")


@query("top_bottom_separation", ctes=["bags"], rounded=["top_mean", "bottom_mean", "gap"], sql=f"""WITH {TOPB}
SELECT bag, max(k) AS k, avg(value) FILTER (is_top) AS top_mean, avg(value) FILTER (is_bottom) AS bottom_mean,
 avg(value) FILTER (is_top) - avg(value) FILTER (is_bottom) AS gap FROM f GROUP BY bag""")
def _(spark, sf):
    return Wn.separation(Wn.adaptive_top_bottom(X.bags(spark, sf).select("bag", "inst", "value"), "bag", "value", "inst"), "bag", "value")


@query("bag_softmax", ctes=["bags"], rounded=["alpha"], sql="""SELECT bag, inst, e / sum(e) OVER (PARTITION BY bag) AS alpha FROM (
  SELECT bag, inst, exp(value / 50 - max(value / 50) OVER (PARTITION BY bag)) AS e FROM bags)""")
def _(spark, sf):
    b = X.bags(spark, sf).withColumn("score", F.col("value") / 50)
    return Wn.bag_softmax(b, "bag", "score").select("bag", "inst", "alpha")


@query("bag_softmax_pool", ctes=["long_bag"], rounded=["pooled"], sql="""
WITH s AS (SELECT bag, inst, max(value) FILTER (feature = 0) * 5 AS score FROM long_bag GROUP BY ALL), e AS (SELECT bag, inst, exp(score - max(score) OVER (PARTITION BY bag)) AS e FROM s)
SELECT bag, feature, sum(e * value) / sum(e) AS pooled FROM long_bag JOIN e USING (bag, inst) GROUP BY ALL""")
def _(spark, sf):
    e = tb(spark, sf, "embeddings").select(F.col("label").alias("bag"), F.col("embedding").cast("array<double>").alias("v"))
    long = e.select("bag", (F.col("v").getItem(0) * 5).alias("score"), F.posexplode("v").alias("feature", "value"))
    return Wn.bag_softmax_pool(long, "bag", "score")


@query("gap_stats", rounded=["min_gap", "max_gap", "median_gap"], digits=4, sql="""
WITH d AS (SELECT user_id, min(t) AS v FROM (SELECT user_id, epoch(ts) / 3600 AS t FROM events) GROUP BY user_id, round(t, 3)),
g AS (SELECT user_id, v - lag(v) OVER (PARTITION BY user_id ORDER BY v) AS gap FROM d)
SELECT user_id, count(gap) AS n_gaps, min(gap) AS min_gap, max(gap) AS max_gap, median(gap) AS median_gap, max(gap) - min(gap) <= 1e-3 AS uniform FROM g WHERE gap IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    ev = tb(spark, sf, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600).alias("t"))
    return Wn.gap_stats(ev, "user_id", "t")


@query("farthest_points", sql="""
WITH RECURSIVE p AS (SELECT label AS bag, vec_id AS inst, list_transform(embedding, lambda x: x::DOUBLE) AS f FROM embeddings),
c AS (SELECT bag, list(m ORDER BY j) AS c FROM (SELECT label AS bag, t.j, avg(embedding[t.j + 1]::DOUBLE) AS m FROM embeddings, range(64) t(j) GROUP BY ALL) GROUP BY bag),
w AS (SELECT 0 AS step, bag, inst, f, list_distance(f, c) AS near, NULL::BIGINT AS pick FROM p JOIN c USING (bag)
 UNION ALL
 SELECT step + 1, bag, inst, f, least(near, list_distance(f, best.f)), best.inst FROM
  (SELECT *, first_value({'inst': inst, 'f': f}) OVER (PARTITION BY bag ORDER BY near DESC, inst) AS best FROM w WHERE step < 4))
SELECT DISTINCT bag, step AS pick, pick AS inst FROM w""")
def _(spark, sf):
    e = tb(spark, sf, "embeddings").select(F.col("label").alias("bag"), F.col("vec_id").alias("inst"), F.col("embedding").cast("array<double>").alias("f"))
    return Wn.farthest_points(e, "bag", "inst", "f", 5)


@query("top_n", sql="SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 5")
def _(spark, sf):
    c = tb(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return Wn.top_n(c, [F.col("n").desc(), F.col("user_id")], 5)


@query("top_n_per_key", sql="""SELECT event_type, user_id, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS rank FROM
  (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)) WHERE rank <= 12""")
def _(spark, sf):
    c = tb(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return Wn.top_n_per_key(c, ["event_type"], [F.col("n").desc(), F.col("user_id")], 12)


@query("decile_strips", sql="""SELECT l_returnflag, least(floor((l_extendedprice - 0.0) / ((hi - 0.0) / 10)), 9)::INT AS bin, count(*) AS n
  FROM lineitem, (SELECT max(l_extendedprice)::DOUBLE AS hi FROM lineitem) GROUP BY ALL""")
def _(spark, sf):
    return Wn.fixed_bins(tb(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.0, None, 10)


@query("outside_strips", sql="""SELECT l_linestatus, CASE WHEN l_quantity < 10 THEN -1 WHEN l_quantity > 40 THEN 6 ELSE least(floor((l_quantity - 10) / 5.0), 5) END::INT AS bin,
  count(*) AS n FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    return Wn.fixed_bins(tb(spark, sf, "lineitem"), ["l_linestatus"], "l_quantity", 10.0, 40.0, 6)


HASH = "('0x' || substr(md5({seed} || '|' || {key}), 1, 15))::BIGINT"


@query("stratified_sample", sql=f"""SELECT o_orderkey, o_orderstatus, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority
  ORDER BY {HASH.format(seed="'1'", key='o_orderkey')}, o_orderkey) AS rn FROM orders) WHERE rn <= 20""")
def _(spark, sf):
    o = tb(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return Wn.stratified_sample(o, ["o_orderstatus", "o_orderpriority"], "o_orderkey", 20)


@query("maximin_choice", rounded=["worst", "mean"], sql="""
WITH g AS (SELECT l_linenumber AS variant, l_returnflag, l_linestatus, avg(l_discount) AS m FROM lineitem GROUP BY ALL)
SELECT variant, worst, mean, row_number() OVER (ORDER BY worst DESC, variant) AS rank FROM (SELECT variant, min(m) AS worst, avg(m) AS mean FROM g GROUP BY variant)""")
def _(spark, sf):
    s = tb(spark, sf, "lineitem").withColumnRenamed("l_linenumber", "variant")
    return Wn.maximin_choice(s, "variant", ["l_returnflag", "l_linestatus"], "l_discount")


@query("bag_median", ctes=["long_bag"], rounded=["value"], sql="SELECT bag, feature, median(value) AS value FROM long_bag GROUP BY ALL")
def _(spark, sf):
    return Wn.bag_median(X.long_bag(spark, sf), "bag")


@query("bag_mean", ctes=["long_bag"], rounded=["value"], sql="SELECT bag, feature, avg(value) AS value FROM long_bag GROUP BY ALL")
def _(spark, sf):
    return Wn.bag_mean(X.long_bag(spark, sf), "bag")


@query("bag_expand_moments", ctes=["long_folds"], rounded=["mean", "sd"], sql="""SELECT fold, feature, avg(value) AS mean, stddev_pop(value) AS sd, count(*) AS n
  FROM long_folds WHERE role = 'train' GROUP BY ALL""")
def _(spark, sf):
    return Wn.bag_expand_moments(X.long_folds(spark, sf), ["fold"])


# ---- splits and weights -------------------------------------------------------------------------------------
@query("stratified_kfold", ctes=["obs"], sql=f"""
WITH r AS (SELECT key, (row_number() OVER (PARTITION BY site, y ORDER BY {HASH.format(seed="'1'", key='key')}, key) - 1) % 5 AS tf FROM obs)
SELECT t.fold::INT AS fold, key, CASE WHEN tf = t.fold THEN 'test' ELSE 'train' END AS role FROM r, range(5) t(fold)""")
def _(spark, sf):
    return K.stratified_kfold(X.obs(spark, sf), "key", ["site", "y"], 5, 1)


@query("repeated_kfold", ctes=["obs"], sql=f"""
WITH r AS (SELECT s.seed, key, (row_number() OVER (PARTITION BY s.seed, site, y ORDER BY {HASH.format(seed='s.seed', key='key')}, key) - 1) % 5 AS tf FROM obs, range(1, 6) s(seed))
SELECT seed::INT AS seed, t.fold::INT AS fold, key, CASE WHEN tf = t.fold THEN 'test' ELSE 'train' END AS role FROM r, range(5) t(fold)""")
def _(spark, sf):
    return K.repeated_kfold(X.obs(spark, sf), "key", ["site", "y"])


@query("inner_kfold", ctes=["emb_split"], sql=f"""
SELECT fold, key, role, ((row_number() OVER (PARTITION BY fold, site, y ORDER BY {HASH.format(seed='(fold + 100)', key='key')}, key) - 1) % 3)::INT AS inner_fold FROM emb_split WHERE role = 'train'
UNION ALL SELECT fold, key, role, -1 FROM emb_split WHERE role = 'test'""")
def _(spark, sf):
    return K.inner_kfold(X.emb_split(spark, sf), X.obs_emb(spark, sf), "key", ["site", "y"])


@query("holdout_split", ctes=["obs"], sql=f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {HASH.format(seed="'1'", key='key')}, key) AS rn, count(*) OVER (PARTITION BY y) AS n FROM obs)
SELECT key, y, CASE WHEN rn <= greatest(least(greatest(round_even(n * 0.2, 0), 1), n - 1), 0) THEN 'val' ELSE 'train' END AS role FROM r""")
def _(spark, sf):
    return K.holdout_split(X.obs(spark, sf), "key", "y").select("key", "y", "role")


@query("leave_one_site_out", ctes=["obs"], sql="""SELECT s.site AS held_out, o.key, CASE WHEN o.site = s.site THEN 'test' ELSE 'train' END AS role
  FROM obs o, (SELECT DISTINCT site FROM obs) s""")
def _(spark, sf):
    return K.leave_one_site_out(X.obs(spark, sf))


@query("transport_pairs", ctes=["obs"], sql="""
WITH p AS (SELECT a.site AS source, b.site AS target FROM (SELECT DISTINCT site FROM obs) a JOIN (SELECT DISTINCT site FROM obs) b ON a.site <> b.site)
SELECT source, target, key, CASE WHEN site = source THEN 'train' ELSE 'test' END AS role FROM p JOIN obs ON site IN (source, target)""")
def _(spark, sf):
    return K.transport_pairs(X.obs(spark, sf))


@query("strata_weights", ctes=["emb_split"], rounded=["weight"], sql="""
WITH t AS (SELECT * FROM emb_split WHERE role = 'train'), c AS (SELECT fold, site, y, count(*) AS n FROM t GROUP BY ALL),
f AS (SELECT fold, sum(n) AS n_all, count(*) AS s FROM c GROUP BY fold)
SELECT fold, key, n_all::DOUBLE / (s * n) AS weight FROM t JOIN c USING (fold, site, y) JOIN f USING (fold)""")
def _(spark, sf):
    t = X.emb_split(spark, sf).where("role = 'train'").join(X.obs_emb(spark, sf), "key")
    return K.strata_weights(t, ["site", "y"], ["fold"]).select("fold", "key", "weight")


@query("class_balance", ctes=["obs"], rounded=["pos_weight", "w_pos", "w_neg"], sql="""SELECT site, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg,
 count(*) FILTER (y = 0)::DOUBLE / nullif(count(*) FILTER (y = 1), 0) AS pos_weight, count(*)::DOUBLE / nullif(2 * count(*) FILTER (y = 1), 0) AS w_pos,
 count(*)::DOUBLE / nullif(2 * count(*) FILTER (y = 0), 0) AS w_neg FROM obs GROUP BY site""")
def _(spark, sf):
    return K.class_balance(X.obs(spark, sf), "y", ["site"])


@query("split_report", ctes=["emb_split"], rounded=["prevalence", "pos_weight"], sql="""
WITH c AS (SELECT fold, role, site, y, count(*) AS c FROM emb_split GROUP BY ALL)
SELECT fold, role, sum(c)::BIGINT AS n, coalesce(sum(c) FILTER (y = 1), 0)::BIGINT AS n_pos, coalesce(sum(c) FILTER (y = 0), 0)::BIGINT AS n_neg, min(c) AS smallest_stratum,
 coalesce(sum(c) FILTER (y = 1), 0)::DOUBLE / sum(c) AS prevalence, sum(c) FILTER (y = 0)::DOUBLE / nullif(sum(c) FILTER (y = 1), 0) AS pos_weight FROM c GROUP BY ALL""")
def _(spark, sf):
    return K.split_report(X.emb_split(spark, sf), X.obs_emb(spark, sf))


@query("strata_short_of_folds", ctes=["obs"], sql="SELECT site, y, count(*) AS n FROM obs GROUP BY ALL HAVING count(*) < 40")
def _(spark, sf):
    return K.strata_short_of(X.obs(spark, sf), ["site", "y"], 40)


@query("expect_partition", ctes=["emb_split"], sql="SELECT count(*) AS n_gaps, count(*) = 0 AS sound FROM (SELECT key FROM emb_split WHERE role = 'test' GROUP BY key HAVING count(*) <> 1)")
def _(spark, sf):
    gaps = U.covering_gaps(X.emb_split(spark, sf), X.obs_emb(spark, sf))
    return gaps.agg(F.count(F.lit(1)).alias("n_gaps"), (F.count(F.lit(1)) == 0).alias("sound"))
