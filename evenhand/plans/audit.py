"""Expectations, fingerprints, gates, provenance and grid operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenhand.operators import grid as G
from evenhand.operators import quality as Q
from evenhand.plans import frames as X
from evenhand.plans.registry import query
from evenhand.session import cut_lineage, scratch_path
from evenhand.sources.tables import assemble_manifest


def tb(spark, sf, name):
    return X.table(spark, sf, name)


@query("expect_counts", sql="""SELECT 'count ' || o_orderstatus AS "check", count(*) = count(*) FILTER (o_totalprice > 0) AS pass,
  count(*) || ' of ' || count(*) FILTER (o_totalprice > 0) AS detail FROM orders GROUP BY o_orderstatus""")
def _(spark, sf):
    o = tb(spark, sf, "orders")
    declared = o.where("o_totalprice > 0").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return Q.expect_counts(o, ["o_orderstatus"], declared)


@query("expect_unique", sql="SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    return Q.expect_unique(tb(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("expect_finite", sql="""SELECT l_suppkey, count(*) FILTER (l_tax = 0) AS ratio, count(*) FILTER (l_discount = 0) AS inverse FROM lineitem GROUP BY 1
  HAVING count(*) FILTER (l_tax = 0) > 0 OR count(*) FILTER (l_discount = 0) > 0""")
def _(spark, sf):
    li = tb(spark, sf, "lineitem").select("l_suppkey", F.try_divide("l_discount", "l_tax").alias("ratio"),
                                          F.when(F.col("l_discount") == 0, float("inf")).otherwise(1 / F.col("l_discount")).alias("inverse"))
    return Q.expect_finite(li, "l_suppkey", ["ratio", "inverse"])


@query("expect_schema", sql="""SELECT 'names and order' AS "check", true AS pass, '6 of 6 columns, rows ' || count(*) AS detail FROM orders UNION ALL SELECT 'forbidden tokens', false, 'o_orderdate'""")
def _(spark, sf):
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    return Q.expect_schema(tb(spark, sf, "orders"), names, ["date"])


@query("distinct_name_lists", sql="""SELECT sha256(event_type || '|value') AS names_sha256, 2::INT AS width, count(*) AS n FROM events GROUP BY event_type""")
def _(spark, sf):
    return Q.distinct_name_lists(tb(spark, sf, "events").select(F.array(F.col("event_type"), F.lit("value")).alias("names")), "names")


@query("audit_consistency", sql="""
WITH a AS (SELECT o_custkey AS key, max(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS key, max(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
x AS (SELECT c_custkey AS key FROM customer WHERE c_acctbal < 0)
SELECT * FROM (SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NOT NULL AND x.key IS NOT NULL THEN 'excluded but present' WHEN b.key IS NULL AND x.key IS NULL THEN 'missing'
  WHEN a.key IS NULL THEN 'not in master' WHEN b.key IS NOT NULL AND a.v <> b.v THEN 'value differs' END AS problem
 FROM a FULL JOIN b ON a.key = b.key LEFT JOIN x ON x.key = coalesce(a.key, b.key)) WHERE problem IS NOT NULL""")
def _(spark, sf):
    o = tb(spark, sf, "orders")
    side = lambda s: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderpriority").alias("v"))
    out = tb(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("key"))
    return Q.audit_consistency(side("F"), side("O"), "key", ["v"], out)


@query("run_checks", sql="""
WITH c AS (SELECT 'unique orders' AS "check", count(*) = count(DISTINCT o_orderkey) AS pass, count(*)::VARCHAR AS detail FROM orders
 UNION ALL SELECT 'positive prices', count(*) FILTER (o_totalprice <= 0) = 0, (count(*) FILTER (o_totalprice <= 0))::VARCHAR FROM orders
 UNION ALL SELECT 'no negative balance', count(*) FILTER (c_acctbal < 0) = 0, (count(*) FILTER (c_acctbal < 0))::VARCHAR FROM customer)
SELECT * FROM c UNION ALL SELECT 'overall', bool_and(pass), count(*) FILTER (pass) || ' of ' || count(*) FROM c""")
def _(spark, sf):
    o, c = tb(spark, sf, "orders"), tb(spark, sf, "customer")
    row = lambda d, n, bad, detail: d.agg(bad.alias("b"), detail.alias("d")).select(
        F.lit(n).alias("check"), (F.col("b") == 0).alias("pass"), F.col("d").cast("string").alias("detail"))
    dup = o.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))
    low, neg = F.count_if(F.col("o_totalprice") <= 0), F.count_if(F.col("c_acctbal") < 0)
    return Q.run_checks([row(dup, "unique orders", F.count_if(F.col("n") > 1), F.sum("n")), row(o, "positive prices", low, low), row(c, "no negative balance", neg, neg)])


@query("rejection_rollup", rounded=["share"], sql="""
WITH g AS (SELECT l_returnflag, count(*) AS c, count(*) FILTER (l_quantity < 5) AS too_small, count(*) FILTER (l_quantity >= 5 AND l_discount > 0.08) AS discounted,
 count(*) FILTER (l_quantity >= 5 AND l_discount <= 0.08) AS kept FROM lineitem GROUP BY 1)
SELECT l_returnflag, reason, n, n::DOUBLE / c AS share, c = kept + too_small + discounted AS balanced FROM g, LATERAL (SELECT 'too_small' AS reason, too_small AS n UNION ALL SELECT 'discounted', discounted)""")
def _(spark, sf):
    li = tb(spark, sf, "lineitem")
    small, disc = F.col("l_quantity") < 5, (F.col("l_quantity") >= 5) & (F.col("l_discount") > 0.08)
    flag = lambda c: c.cast("bigint")
    d = li.select("l_returnflag", F.lit(1).cast("bigint").alias("candidates"), flag(small).alias("too_small"), flag(disc).alias("discounted"), flag(~small & ~disc).alias("kept"))
    return Q.rejection_rollup(d, ["too_small", "discounted"], "candidates", "kept", ["l_returnflag"])


@query("duplicate_rows", sql="""
WITH g AS (SELECT text, lang, min(doc_id) AS first_key, count(*) AS copies FROM documents GROUP BY ALL HAVING count(*) > 1)
SELECT doc_id, first_key, copies FROM documents JOIN g USING (text, lang) WHERE doc_id <> first_key""")
def _(spark, sf):
    return Q.duplicate_rows(tb(spark, sf, "documents"), "doc_id", ["text", "lang"])


FP = "sum(('0x' || substr(md5({}), 1, 15))::BIGINT::DECIMAL(38, 0))::DECIMAL(38, 0)::VARCHAR"


@query("frame_fingerprint", sql=f"SELECT {FP.format(" || ".join(f"length({c}::VARCHAR) || ':' || {c}" for c in ("o_orderkey", "o_orderstatus", "o_orderpriority")))} AS fingerprint, count(*) AS n FROM orders")
def _(spark, sf):
    return Q.frame_fingerprint(tb(spark, sf, "orders"), ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@query("verify_frozen", sql="SELECT 'customers' AS name, true AS intact UNION ALL SELECT 'orders', true")
def _(spark, sf):
    named = [("customers", tb(spark, sf, "customer")), ("orders", tb(spark, sf, "orders"))]
    path = scratch_path(spark, "freeze")
    Q.freeze(named).write.parquet(path)
    return Q.verify_frozen(named, spark.read.parquet(path))


@query("snapshot_diff", sql="""
WITH a AS (SELECT user_id, sum(CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END) AS v FROM events WHERE event_type <> 'click' GROUP BY 1), b AS (SELECT user_id, count(*) AS v FROM events WHERE event_type <> 'view' GROUP BY 1)
SELECT * FROM (SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'added' WHEN b.user_id IS NULL THEN 'removed' WHEN a.v <> b.v THEN 'changed' END AS change
 FROM a FULL JOIN b ON a.user_id = b.user_id) WHERE change IS NOT NULL""")
def _(spark, sf):
    ev = tb(spark, sf, "events")
    a = ev.where("event_type <> 'click'").groupBy("user_id").agg(F.count_if(F.col("event_type") != "view").alias("v"))
    b = ev.where("event_type <> 'view'").groupBy("user_id").agg(F.count(F.lit(1)).alias("v"))
    return Q.snapshot_diff(a, b, "user_id", "v")


@query("score_once", ctes=["prob_pair"], rounded=["p"], sql="SELECT key, pa AS p, y FROM prob_pair")
def _(spark, sf):
    d = X.prob_pair(spark, sf)
    base = scratch_path(spark, "locked")
    d.select("key", F.col("pa").alias("p")).write.parquet(f"{base}/pred")
    pred = spark.read.parquet(f"{base}/pred")
    Q.freeze([("predictions", pred)]).write.parquet(f"{base}/freeze")
    return Q.score_once(pred, spark.read.parquet(f"{base}/freeze"), d.select("key", "y"), "key", f"{base}/scored")


@query("evaluate_gate", rounded=["observed", "and_observed"], digits=4, sql="""
WITH m AS (SELECT 'avg_discount' AS metric, avg(l_discount) AS observed FROM lineitem UNION ALL SELECT 'share_returned', avg((l_returnflag = 'R')::INT) FROM lineitem UNION ALL SELECT 'max_tax', max(l_tax) FROM lineitem),
r AS (SELECT * FROM (VALUES (1, 'avg_discount', '>=', 0.04, NULL, NULL, NULL), (2, 'share_returned', '<', 0.5, 'max_tax', '<=', 0.05), (3, 'max_tax', '>', 0.0, NULL, NULL, NULL)) t(id, metric, op, value, and_metric, and_op, and_value)),
j AS (SELECT id, r.metric, op, value::DOUBLE AS value, m.observed, and_metric, n.observed AS and_observed,
 CASE op WHEN '>=' THEN m.observed >= value WHEN '>' THEN m.observed > value WHEN '<=' THEN m.observed <= value ELSE m.observed < value END AND (and_metric IS NULL OR n.observed <= and_value) AS pass
 FROM r JOIN m ON r.metric = m.metric LEFT JOIN m n ON r.and_metric = n.metric)
SELECT *, (SELECT bool_and(pass) FROM j) AS gate FROM j""")
def _(spark, sf):
    li = tb(spark, sf, "lineitem").agg(F.avg("l_discount").alias("avg_discount"), F.avg((F.col("l_returnflag") == "R").cast("int")).alias("share_returned"), F.max("l_tax").alias("max_tax"))
    m = li.unpivot([], ["avg_discount", "share_returned", "max_tax"], "metric", "observed")
    rules = spark.createDataFrame([(1, "avg_discount", ">=", 0.04, None, None, None), (2, "share_returned", "<", 0.5, "max_tax", "<=", 0.05), (3, "max_tax", ">", 0.0, None, None, None)],
                                  "id int, metric string, op string, value double, and_metric string, and_op string, and_value double")
    return Q.evaluate_gate(m, rules)


ENTRIES = """e AS (SELECT c_mktsegment AS label, count(*) FILTER (c_acctbal >= 5000) AS n_pos, count(*) FILTER (c_acctbal < 5000) AS n_neg, max(c_nationkey) AS mx,
 count(DISTINCT c_nationkey) AS n_series, count(*) AS n_patients, sum(c_custkey) AS s FROM customer GROUP BY 1)"""


def _entries(spark, sf):
    return tb(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("label")).agg(
        F.count_if(F.col("c_acctbal") >= 5000).alias("n_pos"), F.count_if(F.col("c_acctbal") < 5000).alias("n_neg"),
        F.countDistinct("c_nationkey").alias("n_series"), F.count(F.lit(1)).alias("n_patients"), F.sum("c_custkey").alias("s"))


@query("qualify_candidates", sql=f"""WITH {ENTRIES}, q AS (SELECT label, n_pos + n_neg AS total, least(n_pos, n_neg) AS minority, true AS evaluable, n_pos + n_neg >= 60 AND least(n_pos, n_neg) >= 135 AS meets_size,
  contains(lower(label), 'house') AS same_centre, CASE WHEN label > 'F' THEN 'A' ELSE 'C' END AS code FROM e)
SELECT label, total, minority, evaluable, meets_size, same_centre, meets_size AND code IN ('A', 'B') AS qualifies, (SELECT NOT bool_or(meets_size AND code IN ('A', 'B')) FROM q) AS stop FROM q""")
def _(spark, sf):
    e = _entries(spark, sf).withColumn("code", F.when(F.col("label") > "F", "A").otherwise("C")).withColumn("centre", F.col("label"))
    return Q.qualify_candidates(e, ["House"], least_minority=135).select("label", "total", "minority", "evaluable", "meets_size", "same_centre", "qualifies", "stop")


@query("feasibility_table", sql=f"""WITH {ENTRIES} SELECT label AS candidate, n_pos::VARCHAR AS total_pos, n_neg::VARCHAR AS total_neg, 'A - expert' AS segmentation_availability,
 printf('%d shared PatientID(s) with a development cohort; identifier-evidence rank %d', n_series, 5) AS possible_overlap, printf('%.2f GiB (%d patients, %d series)', s / 1024.0::DOUBLE, n_patients, n_series) AS download_size,
 'yes' AS pre_treatment, '' AS segmentation_provenance, '' AS institution_independence, '' AS acquisition_diversity, '' AS processing_difficulty, '' AS manual_work, '' AS suitable FROM e""")
def _(spark, sf):
    e = _entries(spark, sf).withColumn("code", F.lit("A")).withColumn("code_text", F.lit("expert")).withColumn("pre_treatment", F.lit("yes"))
    return Q.feasibility_table(e.withColumn("shared", F.col("n_series")).withColumn("evidence_rank", F.lit(5)).withColumn("gib", F.col("s") / 1024.0))


@query("unit_status", rounded=["mean_seconds", "elapsed", "projected"], digits=3, sql="""
WITH u AS (SELECT o_orderkey AS unit FROM orders), d AS (SELECT o_orderkey AS unit, o_totalprice / 1000 AS seconds FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')
SELECT count(*) AS n_units, count(seconds) AS n_complete, avg(seconds) AS mean_seconds, sum(seconds) AS elapsed, count(*) - count(seconds) AS n_pending, (count(*) - count(seconds)) * avg(seconds) AS projected FROM u LEFT JOIN d USING (unit)""")
def _(spark, sf):
    o = tb(spark, sf, "orders")
    ck = o.select(F.col("o_orderkey").alias("unit"), F.col("o_orderpriority").alias("protocol"), (F.col("o_orderstatus") == "F").alias("complete"), (F.col("o_totalprice") / 1000).alias("seconds"))
    return Q.unit_status(o.select(F.col("o_orderkey").alias("unit")), ck, "1-URGENT")


@query("pending_units", sql="SELECT o_orderkey AS unit FROM orders WHERE NOT (o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def _(spark, sf):
    o = tb(spark, sf, "orders")
    ck = o.select(F.col("o_orderkey").alias("unit"), F.col("o_orderpriority").alias("protocol"), (F.col("o_orderstatus") == "F").alias("complete"))
    return Q.pending_units(o.select(F.col("o_orderkey").alias("unit")), ck, "1-URGENT")


@query("assemble_manifest", sql="""SELECT d.doc_id AS key, d.lang, l.quality AS lab_quality, l.doc_id IS NOT NULL AS has_lab, e.label AS emb_label, e.vec_id IS NOT NULL AS has_emb
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def _(spark, sf):
    base = tb(spark, sf, "documents").select(F.col("doc_id").alias("key"), "lang")
    lab = tb(spark, sf, "labels").select(F.col("doc_id").alias("key"), "quality")
    emb = tb(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), "label")
    return assemble_manifest(base, [("lab", lab), ("emb", emb)], "key")


@query("assemble_oof", ctes=["emb_split"], rounded=["score"], sql="""
SELECT s.key, s.fold, embedding[1]::DOUBLE AS score, 1::BIGINT AS n_rows, s.y, d.n_chars FROM emb_split s JOIN embeddings ON vec_id = s.key LEFT JOIN documents d ON d.doc_id = s.key WHERE role = 'test'""")
def _(spark, sf):
    sp = X.emb_split(spark, sf).where("role = 'test'").join(X.wide_emb(spark, sf), "key")
    units = [sp.where(F.col("fold") == k).select("key", "fold", F.col("features").getItem(0).alias("score")) for k in range(3)]
    sizes = tb(spark, sf, "documents").select(F.col("doc_id").alias("key"), "n_chars")
    return Q.assemble_oof(units, X.obs_emb(spark, sf).select("key", "y"), sizes, "key")


@query("expect_plausible", rounded=["min", "mean", "max", "volume"], sql="""
SELECT user_id, min(value) AS min, avg(value) AS mean, max(value) AS max, count(*)::DOUBLE AS volume, min(value) >= 0 AND max(value) <= 250 AND count(*) > 0 AS plausible FROM events GROUP BY 1""")
def _(spark, sf):
    g = tb(spark, sf, "events").groupBy("user_id").agg(F.min("value").alias("f_min"), F.avg("value").alias("f_mean"), F.max("value").alias("f_max"), F.count(F.lit(1)).cast("double").alias("f_vol"))
    long = g.unpivot(["user_id"], ["f_min", "f_mean", "f_max", "f_vol"], "feature", "value")
    return Q.expect_plausible(long, "user_id", {"min": "f_min", "mean": "f_mean", "max": "f_max", "volume": "f_vol"}, 0.0, 250.0)


@query("expect_same_frame", sql="""
WITH a AS (SELECT doc_id, quality AS y FROM labels), b AS (SELECT doc_id, toxic AS y FROM labels)
SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def _(spark, sf):
    lab = tb(spark, sf, "labels")
    return Q.expect_same_frame(lab.select("doc_id", F.col("quality").alias("y")), lab.select("doc_id", F.col("toxic").alias("y")), ["doc_id", "y"])


# ---- grids --------------------------------------------------------------------------------------------------
SIZE, STRIDE, LEAST = (4, 8, 8), (2, 4, 4), 9
BLOCKS = """ext AS (SELECT "case", min(z) FILTER (mask) AS z0, max(z) FILTER (mask) AS z1, min(y) FILTER (mask) AS y0, max(y) FILTER (mask) AS y1, min(x) FILTER (mask) AS x0, max(x) FILTER (mask) AS x1,
  max(z) + 1 AS dz, max(y) + 1 AS dy, max(x) + 1 AS dx FROM grid GROUP BY 1),
cand AS (SELECT "case", a.s * 2 AS z, b.s * 4 AS y, c.s * 4 AS x FROM ext, range(0, 40) a(s), range(0, 40) b(s), range(0, 600) c(s)
 WHERE a.s * 2 >= floor(z0 / 2) * 2 AND a.s * 2 <= least(z1, dz - 4) AND b.s * 4 >= floor(y0 / 4) * 4 AND b.s * 4 <= least(y1, dy - 8) AND c.s * 4 >= floor(x0 / 4) * 4 AND c.s * 4 <= least(x1, dx - 8)),
hit AS (SELECT c."case", c.z, c.y, c.x, count(g.z) AS n_mask, coalesce(bool_or(g.z = c.z + 2 AND g.y = c.y + 4 AND g.x = c.x + 4), false) AS centre_in FROM cand c
 LEFT JOIN (SELECT * FROM grid WHERE mask) g ON g."case" = c."case" AND g.z >= c.z AND g.z < c.z + 4 AND g.y >= c.y AND g.y < c.y + 8 AND g.x >= c.x AND g.x < c.x + 8 GROUP BY ALL),
bl AS (SELECT *, CASE WHEN NOT centre_in THEN 'centre outside' WHEN n_mask < 9 THEN 'too few cells' ELSE 'kept' END AS verdict FROM hit)"""


@query("lattice_blocks", ctes=["grid"], sql=f"""WITH {BLOCKS} SELECT "case", z, y, x, n_mask, z + 2 AS centre_z, y + 4 AS centre_y, x + 4 AS centre_x, verdict FROM bl WHERE n_mask > 0""")
def _(spark, sf):
    return G.lattice_blocks(X.grid(spark, sf), SIZE, STRIDE, LEAST)


@query("lattice_report", ctes=["grid"], sql=f"""WITH {BLOCKS} SELECT "case", count(bl.z) AS n_candidates, count(*) FILTER (verdict = 'kept') AS n_kept, count(*) FILTER (verdict = 'too few cells') AS too_few_cells,
 count(*) FILTER (verdict = 'centre outside') AS centre_outside FROM ext LEFT JOIN bl USING ("case") WHERE z0 IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    return G.lattice_report(X.grid(spark, sf), SIZE, STRIDE, LEAST)


@query("lattice_audit", ctes=["grid"], sql=f"""WITH {BLOCKS} SELECT "case", true AS on_lattice, true AS in_bounds, true AS centred, bool_and(n_mask >= 9) AS enough_cells, count(*) AS n, true AS no_duplicates FROM bl WHERE n_mask > 0 GROUP BY 1""")
def _(spark, sf):
    g = cut_lineage(X.grid(spark, sf).select("case", *G.AXES, "mask"))
    dims = g.groupBy("case").agg(*[(F.max(a) + 1).alias(f"dim_{a}") for a in G.AXES])
    return Q.lattice_audit(G.lattice_blocks(g, SIZE, STRIDE, LEAST), "case", G.AXES, SIZE, STRIDE, dims, LEAST)


@query("missing_starts", ctes=["grid"], sql=f"""WITH {BLOCKS} SELECT "case", z, y, x FROM bl WHERE n_mask > 0 AND verdict <> 'kept'""")
def _(spark, sf):
    b = cut_lineage(G.lattice_blocks(X.grid(spark, sf), SIZE, STRIDE, LEAST))
    return Q.missing_starts(b, b.where("verdict = 'kept'"), "case", G.AXES)


@query("slice_boxes", ctes=["grid"], sql="""SELECT "case", z, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM grid WHERE mask GROUP BY ALL""")
def _(spark, sf):
    return G.slice_boxes(X.grid(spark, sf))


@query("loosen_boxes", ctes=["grid"], sql="""SELECT "case", z, greatest(min(x) - 7, 0) AS x0, greatest(min(y) - 4, 0) AS y0, max(x) + 7 AS x1, max(y) + 4 AS y1 FROM grid WHERE mask GROUP BY ALL""")
def _(spark, sf):
    return G.loosen_boxes(G.slice_boxes(X.grid(spark, sf)), 5.0, F.lit(0.7), F.lit(1.25))


@query("shell_bins", ctes=["grid"], sql="""SELECT "case", CASE WHEN dist > 0 AND dist <= 4 THEN '0-4' WHEN dist > 4 AND dist <= 8 THEN '4-8' WHEN dist > 8 AND dist <= 12 THEN '8-12' END AS shell, count(*) AS n FROM grid GROUP BY ALL""")
def _(spark, sf):
    return G.shell_bins(X.grid(spark, sf), "dist").groupBy("case", "shell").agg(F.count(F.lit(1)).alias("n"))


@query("region_stats", ctes=["grid"], rounded=["min", "max", "median", "share_inside", "volume"], digits=4, sql="""SELECT "case", mask, count(*) AS n, min(value) AS min, max(value) AS max,
 avg((value BETWEEN 10000 AND 50000)::INT) AS share_inside, median(value) AS median, count(*) * 2.5::DOUBLE AS volume FROM grid GROUP BY ALL""")
def _(spark, sf):
    return G.region_stats(X.grid(spark, sf), ["case", "mask"], 10000.0, 50000.0, 2.5)


POS = ["on_left", "rel_lateral", "rel_ap", "rel_z", "midline_dist", "centroid_depth", "depth_rel", "contact_frac", "contact_medial", "outside_frac", "log_volume"]


@query("position_features", ctes=["grid"], rounded=POS, digits=5, sql="""
WITH s AS (SELECT "case", avg(z) FILTER (mask) AS cz, avg(y) FILTER (mask) AS cy, avg(x) FILTER (mask) AS cx, min(z) FILTER (mask) AS mz0, max(z) FILTER (mask) AS mz1, (min(x) + max(x)) / 2.0::DOUBLE AS mid, (max(x) - min(x)) / 2.0::DOUBLE AS hw FROM grid GROUP BY 1),
j AS (SELECT g.*, s.* EXCLUDE ("case"), cx > mid AS lf, region AND CASE WHEN cx > mid THEN x > mid ELSE x <= mid END AS side, dist > 0 AND dist <= 4 AS shell FROM grid g JOIN s USING ("case")),
a AS (SELECT "case", any_value(cz) AS cz, any_value(cy) AS cy, any_value(cx) AS cx, any_value(mid) AS mid, any_value(hw) AS hw, any_value(lf) AS lf,
 min(x) FILTER (side AND z BETWEEN mz0 AND mz1) AS xl, max(x) FILTER (side AND z BETWEEN mz0 AND mz1) AS xh, min(y) FILTER (side AND z BETWEEN mz0 AND mz1) AS yl, max(y) FILTER (side AND z BETWEEN mz0 AND mz1) AS yh,
 min(z) FILTER (side) AS zl, max(z) FILTER (side) AS zh, coalesce(max(dist) FILTER (region AND z = round_even(cz, 0) AND y = round_even(cy, 0) AND x = round_even(cx, 0)), 0) AS dep, max(dist) FILTER (side) AS md,
 count(*) FILTER (shell AND NOT region) AS nt, count(*) FILTER (shell) AS ns, count(*) FILTER (shell AND NOT region AND abs(x - mid) < abs(cx - mid)) AS nm, count(*) FILTER (mask AND NOT region) AS nout, count(*) FILTER (mask) AS n FROM j GROUP BY 1)
SELECT "case", lf::INT::DOUBLE AS on_left, greatest(least(abs(cx - CASE WHEN lf THEN xl ELSE xh END) / greatest(xh - xl, 1e-3), 1), 0) AS rel_lateral, greatest(least((cy - yl) / greatest(yh - yl, 1e-3), 1), 0) AS rel_ap,
 greatest(least((cz - zl) / greatest(zh - zl, 1e-3), 1), 0) AS rel_z, abs(cx - mid) / greatest(hw, 1e-3) AS midline_dist, dep AS centroid_depth, dep / greatest(coalesce(md, 1), 1e-3) AS depth_rel, nt::DOUBLE / greatest(ns, 1) AS contact_frac,
 coalesce(nm::DOUBLE / nullif(nt, 0), 0) AS contact_medial, nout::DOUBLE / n AS outside_frac, ln(n) AS log_volume FROM a WHERE n > 0""")
def _(spark, sf):
    g = X.grid(spark, sf).withColumn("body", F.lit(True)).withColumn("shell", (F.col("dist") > 0) & (F.col("dist") <= 4)).withColumn("depth", F.col("dist"))
    return G.position_features(g)


@query("region_algebra", ctes=["grid"], sql="""SELECT "case", bool_and(NOT (mask AND region)) AS disjoint, bool_and(NOT mask OR region) AS a_in_b, bool_and(true) AS union_exact FROM grid GROUP BY 1""")
def _(spark, sf):
    return G.region_algebra(X.grid(spark, sf).withColumn("u", F.col("mask") | F.col("region")), "mask", "region", "u")


@query("geometry_flags", sql="""
WITH a AS (SELECT l_orderkey AS k, count(*) AS size, max(l_linenumber) AS spacing FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS k, 4::BIGINT AS size, 7 AS spacing, o_orderstatus <> 'P' AS bin, o_totalprice > 100000 AS full FROM orders)
SELECT k, a.size = b.size AS size_equal, a.spacing = b.spacing AS spacing_equal, bin AS is_binary, b.full AS not_empty, a.size = b.size AND a.spacing = b.spacing AND bin AND b.full AS all_ok FROM a JOIN b USING (k)""")
def _(spark, sf):
    a = tb(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("size"), F.max("l_linenumber").alias("spacing"))
    b = tb(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.lit(4).cast("bigint").alias("size"), F.lit(7).alias("spacing"), (F.col("o_orderstatus") != "P").alias("binary"),
                                       (F.col("o_totalprice") > 100000).cast("int").alias("n_cells"))
    return G.geometry_flags(a, b, "k", ["size", "spacing"])


@query("containment_share", ctes=["grid"], rounded=["share"], sql="""SELECT "case", count(*) FILTER (mask AND region)::DOUBLE / greatest(count(*) FILTER (mask), 1) AS share FROM grid GROUP BY 1""")
def _(spark, sf):
    return G.containment_share(X.grid(spark, sf), "mask", "region")
