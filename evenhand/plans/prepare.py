"""Sources, cleaning, joins, set algebra and summaries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenhand.functions import expr as E
from evenhand.operators import aggregate as A
from evenhand.operators import clean as P
from evenhand.operators import joins as J
from evenhand.operators import neighbours as V
from evenhand.operators import setops as U
from evenhand.plans import frames as X
from evenhand.plans.registry import query
from evenhand.session import scratch_path
from evenhand.sources import tables as S
from evenhand.streaming.incremental import process_new_files


def tb(spark, sf, name):
    return X.table(spark, sf, name)


# ---- sources and sinks --------------------------------------------------------------------------------------
@query("csv_round_trip", sql="SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment, c_acctbal FROM customer")
def _(spark, sf):
    path = S.write_table(tb(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"),
                         scratch_path(spark, "customer-csv"), "csv")
    return S.read_table_csv(spark, path, ["c_custkey", "c_name", "c_mktsegment"], ["c_acctbal"])


@query("parquet_boxes", sql="""SELECT l_orderkey AS study, l_linenumber AS image, l_quantity AS x0, l_extendedprice AS y0,
  l_quantity + 1 AS x1 FROM lineitem""")
def _(spark, sf):
    return tb(spark, sf, "lineitem").select(F.col("l_orderkey").alias("study"), F.col("l_linenumber").alias("image"),
                                            F.col("l_quantity").alias("x0"), F.col("l_extendedprice").alias("y0"),
                                            (F.col("l_quantity") + 1).alias("x1"))


@query("json_listing", sql="""SELECT o_orderkey AS series, o_orderstatus AS modality, o_totalprice AS bytes FROM orders""")
def _(spark, sf):
    o = tb(spark, sf, "orders").select(F.col("o_orderkey").alias("series"), F.col("o_orderstatus").alias("modality"),
                                       F.col("o_totalprice").alias("bytes"))
    path = scratch_path(spark, "listing")
    o.write.json(path)
    return S.read_json_listing(spark, path, "series bigint, modality string, bytes double")


@query("entity_records", sql="""SELECT event_id AS entity, event_type AS kind, (props::JSON->>'k')::INT AS k, value, TRUE AS has_file FROM events""")
def _(spark, sf):
    ev = tb(spark, sf, "events").select(F.col("event_id").alias("entity"), F.struct(
        F.col("event_type").alias("kind"), F.from_json("props", "k int").alias("detail")).alias("meta"), "value")
    path = S.write_table(ev, scratch_path(spark, "records"), "json")
    rec = S.read_entity_records(spark, path, "entity bigint, meta struct<kind:string, detail:struct<k:int>>, value double",
                                {"entity": "entity", "kind": "meta.kind", "k": "meta.detail.k", "value": "value"})
    return rec.withColumn("has_file", F.col("source_file").contains("part-")).drop("source_file")


@query("records_to_long", sql="""SELECT key, feature, value FROM (SELECT o_orderkey AS key, 'total' AS feature, o_totalprice AS value FROM orders
  UNION ALL SELECT o_orderkey, 'year', year(o_orderdate)::DOUBLE FROM orders)""")
def _(spark, sf):
    o = tb(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.array(F.lit("total"), F.lit("year")).alias("names"),
                                       F.array("o_totalprice", F.year("o_orderdate").cast("double")).alias("vals"))
    return S.records_to_long(o, "key", "names", "vals")


@query("records_to_matrix", sql="SELECT o_orderkey AS key, o_totalprice AS total, year(o_orderdate)::DOUBLE AS year FROM orders")
def _(spark, sf):
    o = tb(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.array(F.lit("total"), F.lit("year")).alias("names"),
                                       F.array("o_totalprice", F.year("o_orderdate").cast("double")).alias("vals"))
    return S.records_to_matrix(o, "key", "names", "vals", ["total", "year"])


@query("bag_instances", sql="""SELECT label AS key, vec_id AS inst, CASE WHEN embedding IS NULL OR len(embedding) <> 64 THEN 'wrong_width'
  WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN 'nonfinite' ELSE 'ok' END AS verdict FROM embeddings""")
def _(spark, sf):
    e = tb(spark, sf, "embeddings").select(F.col("label").alias("key"), F.col("vec_id").alias("inst"), F.col("embedding").alias("features"))
    return S.read_bags(e, 64).drop("features")


@query("box_xml", sql="""SELECT s_name AS name, s_suppkey::DOUBLE AS x0, s_nationkey::DOUBLE AS y0, (s_suppkey + 10)::DOUBLE AS x1,
  (s_nationkey + 5)::DOUBLE AS y1 FROM supplier""")
def _(spark, sf):
    box = F.struct(F.col("s_suppkey").alias("xmin"), F.col("s_nationkey").alias("ymin"), (F.col("s_suppkey") + 10).alias("xmax"),
                   (F.col("s_nationkey") + 5).alias("ymax"))
    path = scratch_path(spark, "boxes")
    tb(spark, sf, "supplier").select(F.col("s_name").alias("name"), box.alias("bndbox")).write.format("xml").option(
        "rowTag", "object").option("rootTag", "annotation").save(path)
    return S.read_box_xml(spark, path)


@query("sql_select", sql="SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def _(spark, sf):
    return S.sql_select(tb(spark, sf, "orders"), "order_index", ["o_orderkey", "o_orderstatus"],
                        "o_orderstatus = 'F' AND o_totalprice > 100000")


@query("id_list", sql="SELECT c_mktsegment || '-' || c_custkey AS id FROM customer WHERE c_acctbal >= 0")
def _(spark, sf):
    path = scratch_path(spark, "ids")
    name = F.concat_ws("-", "c_mktsegment", "c_custkey")
    line = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("# "), name)).otherwise(F.concat(name, F.lit("  # kept")))
    tb(spark, sf, "customer").select(line.alias("value")).write.text(path)
    return S.read_id_list(spark, path)


@query("file_digests")
def _(spark, sf):
    return S.file_digests(spark, sf, "*.parquet")


@query("line_manifest", sql="SELECT format('fetch --entity {} --bytes {:08d}', o_orderkey, o_custkey) AS value FROM orders WHERE o_orderstatus = 'P'")
def _(spark, sf):
    o = tb(spark, sf, "orders").where("o_orderstatus = 'P'")
    path = scratch_path(spark, "manifest")
    S.line_manifest(o, "fetch --entity %d --bytes %08d", ["o_orderkey", "o_custkey"]).write.text(path)
    return spark.read.text(path)


@query("incremental_append", sql="""SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'F' THEN 'ok' ELSE 'redone' END AS status,
  o_totalprice AS value FROM orders""")
def _(spark, sf):
    o = tb(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("failed").alias("status"),
                                       F.col("o_totalprice").alias("value"))
    todo = S.pending(o.select("key", "value"), o, "key")
    return S.incremental_append(o, todo.select("key", F.lit("redone").alias("status"), "value"), "key")


@query("incremental_stream", sql="SELECT user_id, event_type, value * 2 AS doubled FROM events")
def _(spark, sf):
    ev = tb(spark, sf, "events").select("user_id", "event_type", "value")
    src, out, ck = (scratch_path(spark, n) for n in ("incoming", "processed", "progress"))
    twice = lambda d: d.select("user_id", "event_type", (F.col("value") * 2).alias("doubled"))
    ev.where("event_type IN ('view', 'click')").write.parquet(src)
    process_new_files(spark, src, ev.schema, out, ck, twice)
    ev.where("event_type NOT IN ('view', 'click')").write.mode("append").parquet(src)
    process_new_files(spark, src, ev.schema, out, ck, twice)
    return spark.read.parquet(out)


# ---- projections and rules ----------------------------------------------------------------------------------
@query("select_block", sql="SELECT l_orderkey, l_discount, l_tax FROM lineitem WHERE l_returnflag = 'A'")
def _(spark, sf):
    li = tb(spark, sf, "lineitem").withColumn("status", F.when(F.col("l_returnflag") == "A", "ok").otherwise("failed"))
    return P.select_block(li, ["l_orderkey"], ["l_disc", "l_tax", "l_ship"], exclude=["date"], status="status")


@query("drop_diagnostics", sql="SELECT * EXCLUDE (l_shipdate, l_comment_placeholder) FROM (SELECT *, 1 AS l_comment_placeholder FROM lineitem)")
def _(spark, sf):
    return P.drop_diagnostics(tb(spark, sf, "lineitem"), ["l_ship"])


@query("coerce_numeric", sql="""SELECT p_partkey, try_cast(trim(split_part(p_size || '\\' || p_type, '\\', 1)) AS DOUBLE) AS first_token,
  try_cast(p_brand AS DOUBLE) AS bad, p_retailprice FROM part""")
def _(spark, sf):
    p = tb(spark, sf, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit("\\"), "p_type").alias("first_token"),
                                     F.col("p_brand").alias("bad"), "p_retailprice")
    return P.coerce_numeric(P.coerce_numeric(p, ["first_token"], "\\"), ["bad", "p_retailprice"])


@query("prefix_columns", sql="SELECT p_partkey, p_size AS rad__p_size, p_type AS rad__p_type FROM part")
def _(spark, sf):
    return P.prefix_columns(tb(spark, sf, "part").select("p_partkey", "p_size", "p_type"), "rad", ["p_partkey"])


@query("entity_key", sql="SELECT c_mktsegment || '::' || c_custkey AS key, c_custkey FROM customer")
def _(spark, sf):
    return P.with_entity_key(tb(spark, sf, "customer"), "c_mktsegment", "c_custkey").select("key", "c_custkey")


@query("id_collisions", sql="""SELECT user_id, min(event_type) AS first_site, max(event_type) AS last_site FROM events GROUP BY user_id
  HAVING min(event_type) <> max(event_type)""")
def _(spark, sf):
    return P.id_collisions(tb(spark, sf, "events"), "event_type", "user_id")


@query("parse_bool", sql="SELECT c_custkey, lower(trim(flag)) IN ('true', '1', 'yes', 't') AS flag FROM (SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN ' Yes ' WHEN c_acctbal > 0 THEN 'T' ELSE 'no' END AS flag FROM customer)")
def _(spark, sf):
    c = tb(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 5000, " Yes ").when(F.col("c_acctbal") > 0, "T").otherwise("no").alias("flag"))
    return c.select("c_custkey", E.parse_bool("flag").alias("flag"))


@query("normalise_category", sql="""SELECT o_orderkey, CASE WHEN lower(trim(v)) IN ('', 'nan', 'none', 'na', 'unknown') THEN NULL ELSE trim(v) END AS category
  FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN ' Unknown' WHEN 'P' THEN '' ELSE ' ' || o_orderpriority || ' ' END AS v FROM orders)""")
def _(spark, sf):
    v = F.when(F.col("o_orderstatus") == "O", " Unknown").when(F.col("o_orderstatus") == "P", "").otherwise(
        F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")))
    return tb(spark, sf, "orders").select("o_orderkey", E.normalise_category(v).alias("category"))


@query("map_label", sql="SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 1 WHEN 'ECONOMY' THEN 0 END AS label FROM part")
def _(spark, sf):
    return tb(spark, sf, "part").select("p_partkey", E.map_label("p_type", {"PROMO": 1, "ECONOMY": 0}).alias("label"))


@query("map_label_codes", sql="SELECT s_suppkey, CASE WHEN s_nationkey IN (1, 3, 5, 7) THEN 1 WHEN s_nationkey IN (0, 2, 4) THEN 0 END AS label FROM supplier")
def _(spark, sf):
    return tb(spark, sf, "supplier").select("s_suppkey", E.map_label_codes("s_nationkey", [1, 3, 5, 7], [0, 2, 4]).alias("label"))


@query("map_label_rules", sql="""SELECT p_partkey, CASE WHEN starts_with(lower(p_name), 'red') THEN 0 WHEN lower(p_name) = 'blue bolt' THEN 0
  WHEN contains(lower(p_name), 'ring') AND NOT contains(lower(p_name), 'small') THEN 1 END AS label FROM part""")
def _(spark, sf):
    rules = [("contains", "ring", 1, "small"), ("equals", "blue bolt", 0), ("startswith", "red", 0)]
    return tb(spark, sf, "part").select("p_partkey", E.map_label_rules("p_name", rules).alias("label"))


@query("eligibility_filter", sql="""SELECT o_orderkey, label FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS label FROM orders)
  WHERE label IS NOT NULL AND o_totalprice <= 400000 AND o_custkey >= 10 AND NOT regexp_matches(lower(o_orderpriority), 'low|not spec')""")
def _(spark, sf):
    o = tb(spark, sf, "orders").withColumn("label", E.map_label("o_orderstatus", {"F": 1, "O": 0}))
    return P.eligibility_filter(o, "label", {"o_totalprice": 400000}, {"o_custkey": 10}, ("o_orderpriority", "low|not spec")).select("o_orderkey", "label")


@query("first_failing_rule", sql="""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_totalprice > 450000 THEN 'too large'
  WHEN o_orderpriority LIKE '%LOW%' THEN 'low priority' ELSE 'included' END AS reason FROM orders) GROUP BY reason""")
def _(spark, sf):
    rules = [("pending", F.col("o_orderstatus") == "P"), ("too large", F.col("o_totalprice") > 450000),
             ("low priority", F.col("o_orderpriority").contains("LOW"))]
    return A.count_by(P.first_failing_rule(tb(spark, sf, "orders"), rules), ["reason"])


@query("extract_token", sql="""SELECT c_custkey, split_part('A::' || c_name, '::', 1) AS site, split_part(c_mktsegment || '-' || c_nationkey, '-', 2) AS dash,
  regexp_extract(c_name, '(\\d+)', 1)::BIGINT AS digits, regexp_extract(c_name, '([A-Za-z])', 1) AS letter, substr(c_name, 3, 4) AS slice FROM customer""")
def _(spark, sf):
    c = tb(spark, sf, "customer")
    return c.select("c_custkey", E.extract_token(F.concat(F.lit("A::"), "c_name"), "site").alias("site"),
                    E.extract_token(F.concat_ws("-", "c_mktsegment", "c_nationkey"), "dash").alias("dash"),
                    E.extract_token("c_name", "digits").alias("digits"), E.extract_token("c_name", "letter").alias("letter"),
                    E.extract_token("c_name", "slice", (2, 6)).alias("slice"))


@query("parse_age", sql="SELECT p_partkey, CASE WHEN p_size < 40 THEN p_size::DOUBLE END AS age FROM part")
def _(spark, sf):
    text = F.when(F.col("p_size") < 40, F.concat(F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit("Y"))).otherwise("n/a")
    return tb(spark, sf, "part").select("p_partkey", E.parse_age(text).alias("age"))


@query("slugify", sql="""SELECT page_id, lower(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g'), '^_+|_+$', '', 'g')) AS slug FROM pages""")
def _(spark, sf):
    return tb(spark, sf, "pages").select("page_id", E.slugify("url").alias("slug"))


@query("derive_clinical", rounded=["clin__age"], sql="""SELECT c_custkey, c_nationkey + c_acctbal / 365.25 AS clin__age,
  CASE c_mktsegment WHEN 'BUILDING' THEN 1.0 WHEN 'MACHINERY' THEN 0.0 END::DOUBLE AS clin__male FROM customer""")
def _(spark, sf):
    c = tb(spark, sf, "customer").withColumn("sex", F.when(F.col("c_mktsegment") == "BUILDING", " Male").when(F.col("c_mktsegment") == "MACHINERY", "F").otherwise("?"))
    return P.derive_clinical(c, "c_nationkey", "c_acctbal", "sex").select("c_custkey", "clin__age", "clin__male")


@query("subset_view", sql="""SELECT o_custkey AS key, o_orderpriority AS site FROM orders WHERE o_orderpriority <> '5-LOW'
  AND o_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 12)""")
def _(spark, sf):
    o = tb(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("site"))
    return P.subset_view(o, o.groupBy("key").count().where("count > 12"), drop_site="5-LOW")


@query("name_family", sql="""SELECT event_type, image_type, family, count(*) AS n FROM (SELECT event_type,
  CASE WHEN event_type = 'view' THEN 'wavelet' ELSE 'original' END AS image_type, event_type AS family FROM events) GROUP BY ALL""")
def _(spark, sf):
    name = F.concat_ws("_", F.when(F.col("event_type") == "view", "wavelet-HHL").otherwise("original"), "event_type", F.lit("Mean"))
    return tb(spark, sf, "events").select("event_type", E.name_family(name).alias("f")).groupBy(
        "event_type", "f.image_type", "f.family").agg(F.count(F.lit(1)).alias("n"))


@query("clip_logit_sigmoid", ctes=["prob_pair"], rounded=["clipped", "lo", "back"], sql="""SELECT key, greatest(least(pa, 0.9), 0.1) AS clipped,
  ln(greatest(least(pb, 1 - 1e-6), 1e-6) / (1 - greatest(least(pb, 1 - 1e-6), 1e-6))) AS lo,
  greatest(least(pb, 1 - 1e-6), 1e-6) AS back FROM prob_pair""")
def _(spark, sf):
    return X.prob_pair(spark, sf).select("key", E.clip("pa", 0.1, 0.9).alias("clipped"), E.logit("pb").alias("lo"),
                                         E.sigmoid(E.logit("pb")).alias("back"))


# ---- joins --------------------------------------------------------------------------------------------------
@query("left_join", sql="SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def _(spark, sf):
    return J.left_join(tb(spark, sf, "customer").select("c_custkey"), tb(spark, sf, "orders"), "c_custkey", "o_custkey").select(
        "c_custkey", "o_orderkey", "o_totalprice")


@query("inner_chain", sql="""SELECT d.doc_id, d.lang, l.quality, e.label FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  JOIN embeddings e ON d.doc_id = e.vec_id""")
def _(spark, sf):
    return J.inner_chain(tb(spark, sf, "documents").select("doc_id", "lang"), [
        tb(spark, sf, "labels").select("doc_id", "quality"),
        tb(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")], "doc_id")


@query("align_to_cohort", sql="SELECT d.doc_id AS key, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, sf):
    return J.align_to(tb(spark, sf, "documents").select(F.col("doc_id").alias("key")), tb(spark, sf, "labels").withColumnRenamed("doc_id", "key"))


@query("semi_join", sql="SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return J.semi_join(tb(spark, sf, "documents").select("doc_id", "lang"), tb(spark, sf, "labels"), "doc_id")


@query("anti_join", sql="SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return J.anti_join(tb(spark, sf, "documents").select("doc_id", "lang"), tb(spark, sf, "labels"), "doc_id")


MEMBERS = """(SELECT o_custkey AS key, count(*) AS n, min(o_orderstatus) AS lab FROM orders WHERE {} GROUP BY o_custkey)"""


@query("membership_join", sql=f"""SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NOT NULL AND b.key IS NOT NULL THEN 'shared'
  WHEN a.key IS NOT NULL THEN 'a_only' ELSE 'b_only' END AS membership, a.lab AS lab_a, a.n AS n_a, b.lab AS lab_b, b.n AS n_b,
  CASE WHEN a.key IS NOT NULL AND b.key IS NOT NULL THEN a.lab = b.lab END AS lab_agrees,
  CASE WHEN a.key IS NOT NULL AND b.key IS NOT NULL THEN a.n = b.n END AS n_agrees
  FROM {MEMBERS.format("o_orderpriority = '1-URGENT'")} a FULL JOIN {MEMBERS.format("o_orderpriority = '5-LOW'")} b ON a.key = b.key""")
def _(spark, sf):
    o = tb(spark, sf, "orders")
    part = lambda p: o.where(F.col("o_orderpriority") == p).groupBy(F.col("o_custkey").alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderstatus").alias("lab"))
    return J.membership_join(part("1-URGENT"), part("5-LOW"), "key", ["lab", "n"])


@query("paired_predictions", ctes=["prob_pair"], rounded=["pa", "pb"], sql="SELECT key, y, pa, pb, TRUE AS sound FROM prob_pair")
def _(spark, sf):
    d = X.prob_pair(spark, sf)
    return J.paired_predictions(d.select("key", "y", F.col("pa").alias("p")), d.select("key", "y", F.col("pb").alias("p")), "key", "y", "p")


@query("pairwise_overlap", ctes=["series"], sql="""
WITH e AS (SELECT DISTINCT modality || maker AS entry FROM series),
p AS (SELECT a.entry AS a, b.entry AS b FROM e a JOIN e b ON a.entry < b.entry),
sp AS (SELECT a.e AS a, b.e AS b, count(*) AS n FROM (SELECT DISTINCT modality || maker AS e, patient FROM series) a
  JOIN (SELECT DISTINCT modality || maker AS e, patient FROM series) b ON a.patient = b.patient AND a.e < b.e GROUP BY ALL),
ss AS (SELECT a.e AS a, b.e AS b, count(*) AS n FROM (SELECT DISTINCT modality || maker AS e, study FROM series) a
  JOIN (SELECT DISTINCT modality || maker AS e, study FROM series) b ON a.study = b.study AND a.e < b.e GROUP BY ALL)
SELECT p.a, p.b, coalesce(sp.n, 0) AS shared_patients, coalesce(ss.n, 0) AS shared_studies,
 CASE WHEN ss.n > 0 THEN 1 WHEN sp.n > 0 THEN 2 ELSE 5 END AS evidence_rank,
 CASE WHEN ss.n > 0 THEN 'same studies' WHEN sp.n > 0 THEN 'same patients' ELSE 'no shared identifier' END AS verdict
FROM p LEFT JOIN sp ON p.a = sp.a AND p.b = sp.b LEFT JOIN ss ON p.a = ss.a AND p.b = ss.b""")
def _(spark, sf):
    s = X.series(spark, sf).select(F.concat("modality", "maker").alias("entry"), "patient", "study")
    return J.pairwise_overlap(s.select("entry").distinct(), s, "entry", "patient", "study")


NN = """z AS (SELECT e.vec_id AS key, 'S' || (label % 4) AS site, list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - m[i]) / s[i]) AS f
  FROM embeddings e, (SELECT list(m ORDER BY f) AS m, list(s ORDER BY f) AS s FROM (SELECT f, avg(value) AS m, stddev_pop(value) AS s FROM
   (SELECT t.f, embedding[t.f + 1]::DOUBLE AS value FROM embeddings, range(64) t(f)) GROUP BY f))),
d AS (SELECT a.key, a.site, b.key AS other, a.site = b.site AS same, list_distance(a.f, b.f) AS dist FROM z a JOIN z b ON a.key <> b.key),
nn AS (SELECT key, site, min(dist) FILTER (same) AS d_within, min(dist) FILTER (NOT same) AS d_across,
  arg_min(other, dist) FILTER (same) AS nn_within, arg_min(other, dist) FILTER (NOT same) AS nn_across FROM d GROUP BY ALL)"""


def _standardised(spark, sf):
    from evenhand.operators.harmonise import standardise_vectors

    return standardise_vectors(X.wide_emb(spark, sf), "features")


@query("nearest_neighbour_scan", rounded=["d_within", "d_across"], digits=5, sql=f"WITH {NN} SELECT key, site, nn_within, d_within, nn_across, d_across FROM nn")
def _(spark, sf):
    return J.nearest_neighbours(_standardised(spark, sf), "key", "site", "features")


@query("indexed_neighbours", rounded=["d_within", "d_across"], digits=5)
def _(spark, sf):
    return V.indexed_neighbours(_standardised(spark, sf), "key", "site", "features")


@query("neighbour_recall", rounded=["recall"])
def _(spark, sf):
    rows = _standardised(spark, sf)
    return V.recall(rows, V.indexed_neighbours(rows, "key", "site", "features"), "key", "site", "features")


@query("duplicate_candidates", rounded=["d_across", "threshold"], digits=5, sql=f"""WITH {NN}
SELECT key, site, nn_across, d_across, t AS threshold FROM nn, (SELECT quantile_cont(d_within, 0.5) AS t FROM nn) WHERE d_across < t""")
def _(spark, sf):
    nn = J.nearest_neighbours(_standardised(spark, sf), "key", "site", "features")
    return J.duplicate_candidates(nn, 0.5).select("key", "site", "nn_across", "d_across", "threshold")


@query("lookup_map", sql="SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(spark, sf):
    c = tb(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return J.lookup_map(c, tb(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey").select("c_custkey", "n_name")


@query("merge_suffix", rounded=["avg_a", "avg_b"], sql="""SELECT user_id, a.v AS avg_a, b.v AS avg_b FROM
 (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1) a JOIN
 (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1) b USING (user_id)""")
def _(spark, sf):
    run = lambda t: tb(spark, sf, "events").where(F.col("event_type") == t).groupBy("user_id").agg(F.avg("value").alias("avg"))
    return J.merge_suffix(run("click"), run("view"), ["user_id"])


@query("best_container", ctes=["series"], sql="""
WITH ann AS (SELECT DISTINCT patient, part FROM series WHERE modality = 'A'),
h AS (SELECT s.patient, s.study, count(DISTINCT s.part) AS n_hits, max(s.images) AS size FROM series s JOIN ann USING (patient, part) GROUP BY ALL)
SELECT patient, study, n_hits, size FROM (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY n_hits DESC, size DESC, study) AS rn FROM h) WHERE rn = 1""")
def _(spark, sf):
    s = X.series(spark, sf)
    return J.best_container(s, s.where("modality = 'A'"), "patient", "study", "part", "images")


@query("assign_rows_to_split", ctes=["emb_split", "long_emb"], rounded=["total"], sql="""
SELECT fold, role, site, count(*) AS n, sum(value) AS total FROM emb_split s JOIN long_emb l USING (key, site, y) GROUP BY ALL""")
def _(spark, sf):
    from evenhand.operators.splits import assign_rows_to_split

    return assign_rows_to_split(X.long_emb(spark, sf), X.emb_split(spark, sf)).groupBy("fold", "role", "site").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


# ---- aggregations -------------------------------------------------------------------------------------------
@query("count_by", sql="SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def _(spark, sf):
    return A.count_by(tb(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("crosstab", sql="""SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS "n_F", count(*) FILTER (l_linestatus = 'O') AS "n_O" FROM lineitem GROUP BY 1""")
def _(spark, sf):
    return A.crosstab(tb(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@query("count_and_distinct", sql="SELECT l_suppkey, l_returnflag, count(*) AS n, count(DISTINCT l_partkey) AS n_distinct FROM lineitem GROUP BY ALL")
def _(spark, sf):
    return A.count_and_distinct(tb(spark, sf, "lineitem"), ["l_suppkey", "l_returnflag"], "l_partkey")


@query("collection_summary", ctes=["series"], sql="""
WITH p AS (SELECT collection, patient, bool_or(modality = 'R') AS i, bool_or(modality = 'A') AS m FROM series GROUP BY ALL),
pc AS (SELECT collection, count(*) AS n_patients, count(*) FILTER (i) AS n_image_patients, count(*) FILTER (m) AS n_mask_patients, count(*) FILTER (i AND m) AS n_both FROM p GROUP BY 1)
SELECT s.collection, count(*) AS n_series, sum(bytes)::BIGINT AS bytes, coalesce(sum(bytes) FILTER (modality = 'R'), 0)::BIGINT AS image_bytes,
 array_to_string(list_sort(list(DISTINCT maker)), ',') AS makers, array_to_string(list_sort(list(DISTINCT licence)), ',') AS licences,
 count(DISTINCT study) AS n_studies, any_value(n_patients) AS n_patients, any_value(n_image_patients) AS n_image_patients, any_value(n_mask_patients) AS n_mask_patients,
 any_value(n_both) AS n_both, any_value(mo) AS modalities
FROM series s JOIN pc USING (collection) JOIN (SELECT collection, string_agg(modality || ':' || c, ',' ORDER BY modality) AS mo FROM
 (SELECT collection, modality, count(*) AS c FROM series GROUP BY ALL) GROUP BY 1) USING (collection) GROUP BY s.collection""")
def _(spark, sf):
    return A.collection_summary(X.series(spark, sf), "collection")


@query("entry_rollup", ctes=["series"], sql="""
WITH r AS (SELECT *, CASE WHEN collection IN ('BUILDING', 'MACHINERY') THEN 'heavy' ELSE 'light' END AS entry FROM series)
SELECT entry, count(*) AS n_series, sum(bytes)::BIGINT AS bytes, count(DISTINCT patient) AS n_patients, count(DISTINCT study) AS n_studies,
 (SELECT count(DISTINCT collection || patient) FROM r x WHERE x.entry = r.entry AND modality = 'R') AS n_image_patients FROM r GROUP BY entry""")
def _(spark, sf):
    s = X.series(spark, sf)
    entries = s.select("collection").distinct().withColumn("entry", F.when(F.col("collection").isin("BUILDING", "MACHINERY"), "heavy").otherwise("light"))
    return A.entry_rollup(s, entries, "collection", "entry")


@query("describe_by_class", rounded=["mean", "sd", "pct_true", "q1", "median", "q3"], digits=4, sql="""
SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS sd, count(*) - count(c_acctbal) AS n_missing,
 100 * avg((c_nationkey > 10)::INT) AS pct_true, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.5) AS median,
 quantile_cont(c_acctbal, 0.75) AS q3 FROM customer GROUP BY 1""")
def _(spark, sf):
    c = tb(spark, sf, "customer").withColumn("flag", F.col("c_nationkey") > 10)
    return A.describe_by_class(c, ["c_mktsegment"], "c_acctbal", "flag")


@query("numeric_summary", rounded=["min", "max", "mean", "sd", "p25", "median", "p75"], digits=4, sql="""
SELECT l_returnflag, "column", count(*) AS n, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_samp(value) AS sd,
 count(DISTINCT round(value, 6)) AS n_distinct, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS p75
FROM (UNPIVOT (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount FROM lineitem) ON l_quantity, l_extendedprice, l_discount INTO NAME "column" VALUE value) GROUP BY ALL""")
def _(spark, sf):
    return A.numeric_summary(tb(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag"])


@query("category_distribution", sql="""
WITH c AS (SELECT url_host AS v, count(*) AS c FROM (SELECT split_part(url, '/', 3) AS url_host FROM pages) GROUP BY 1)
SELECT (SELECT sum(c) FROM c WHERE v <> '')::BIGINT AS n_present, coalesce((SELECT sum(c) FROM c WHERE v = ''), 0)::BIGINT AS n_missing,
 (SELECT count(*) FROM c WHERE v <> '') AS n_distinct,
 (SELECT string_agg(v || ':' || c, ',' ORDER BY c DESC, v) FROM (SELECT * FROM c ORDER BY c DESC, v LIMIT 12)) AS top_values""")
def _(spark, sf):
    return A.category_distribution(tb(spark, sf, "pages").withColumn("host", F.split("url", "/").getItem(2)), "host")


@query("bag_size_stats", rounded=["mean", "sd", "q1", "median", "q3"], sql="""
WITH s AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n, user_id) AS i, count(*) OVER () AS m FROM s),
e AS (SELECT p, (m + 1) * p AS pos, greatest(1, least(floor((m + 1) * p), m - 1)) AS j FROM (SELECT DISTINCT m FROM r), (VALUES (0.25), (0.5), (0.75)) t(p)),
q AS (SELECT p, a.n + (pos - j) * (b.n - a.n) AS v FROM e JOIN r a ON a.i = j JOIN r b ON b.i = j + 1)
SELECT count(*) AS n_bags, sum(n)::BIGINT AS total, min(n) AS min, max(n) AS max, avg(n) AS mean, stddev_pop(n) AS sd, count(*) FILTER (n < 20) AS n_small,
 (SELECT v FROM q WHERE p = 0.25)::DOUBLE AS q1, (SELECT v FROM q WHERE p = 0.5)::DOUBLE AS median, (SELECT v FROM q WHERE p = 0.75)::DOUBLE AS q3 FROM s""")
def _(spark, sf):
    return A.bag_size_stats(tb(spark, sf, "events"), "user_id")


@query("mean_sd", rounded=["mean", "sd"], sql="""SELECT l_shipdate::DATE::VARCHAR AS day, avg(l_discount) AS mean,
  CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(l_discount) END AS sd, count(*) AS n FROM lineitem GROUP BY 1""")
def _(spark, sf):
    return A.mean_sd(tb(spark, sf, "lineitem").withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd")), ["day"], "l_discount")


@query("gain_concentration", rounded=["total", "largest", "share"], sql="""
WITH f AS (SELECT user_id AS fold, avg(value) FILTER (event_type = 'view') AS a, avg(value) FILTER (event_type = 'click') AS b FROM events GROUP BY 1), d AS (SELECT fold, b - a AS d FROM f)
SELECT sum(d) AS total, (SELECT fold FROM d WHERE d IS NOT NULL ORDER BY abs(d) DESC, fold LIMIT 1) AS largest_fold, (SELECT d FROM d WHERE d IS NOT NULL ORDER BY abs(d) DESC, fold LIMIT 1) AS largest,
 count(*) FILTER (d > 0) AS improved, count(*) FILTER (d < 0) AS worsened, (SELECT d FROM d WHERE d IS NOT NULL ORDER BY abs(d) DESC, fold LIMIT 1) / sum(d) AS share FROM d""")
def _(spark, sf):
    at = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    f = tb(spark, sf, "events").groupBy(F.col("user_id").alias("fold")).agg(at("view").alias("a"), at("click").alias("b"))
    return A.gain_concentration(f.where("a IS NOT NULL AND b IS NOT NULL"), "fold", "a", "b")


@query("paired_ratio", rounded=["min", "median", "max", "mean"], sql="""
WITH c AS (SELECT c_mktsegment AS seg, c_custkey, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'O') AS b FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL)
SELECT seg, min(b::DOUBLE / a) AS min, max(b::DOUBLE / a) AS max, avg(b::DOUBLE / a) AS mean, count(*) FILTER (b >= a) AS n_not_smaller, median(b::DOUBLE / a) AS median FROM c WHERE a <> 0 GROUP BY seg""")
def _(spark, sf):
    c = tb(spark, sf, "customer").join(tb(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy(
        F.col("c_mktsegment").alias("seg"), "c_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count_if(F.col("o_orderstatus") == "O").alias("b"))
    return A.paired_ratio(c, "a", "b", ["seg"])


@query("runtime_model", rounded=["slope", "intercept", "origin_slope", "max_residual"], digits=3, sql="""
WITH f AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept,
 sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity) AS origin_slope FROM lineitem GROUP BY 1)
SELECT l_returnflag, slope, intercept, origin_slope, max(abs(l_extendedprice - intercept - slope * l_quantity)) AS max_residual FROM lineitem JOIN f USING (l_returnflag) GROUP BY ALL""")
def _(spark, sf):
    return A.runtime_model(tb(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])


@query("selection_frequency", rounded=["mean_rank", "mean_coef", "frequency"], digits=10, sql="""
SELECT feature, count(DISTINCT fold) AS n_folds, avg(rk) AS mean_rank, avg(coef) AS mean_coef, count(*) FILTER (coef > 0) AS n_positive, count(*) FILTER (coef < 0) AS n_negative,
 array_to_string(list_sort(list(DISTINCT fold)), ',') AS folds, count(DISTINCT fold)::DOUBLE / (SELECT count(DISTINCT o_orderpriority) FROM orders) AS frequency
FROM (SELECT l_partkey AS feature, o_orderpriority AS fold, l_linenumber AS rk, l_discount - 0.05 AS coef FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY feature""")
def _(spark, sf):
    sel = tb(spark, sf, "lineitem").join(tb(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_partkey").alias("feature"), F.col("o_orderpriority").alias("fold"), F.col("l_linenumber").alias("rk"), (F.col("l_discount") - 0.05).alias("coef"))
    return A.selection_frequency(sel, "feature", "fold", "rk", "coef")


@query("shift_table", rounded=["before", "after", "shift"], digits=4, sql="""
WITH u AS (SELECT o_orderstatus AS st, "column", value FROM (UNPIVOT (SELECT o_orderstatus, o_totalprice, o_custkey::DOUBLE AS o_custkey FROM orders) ON o_totalprice, o_custkey INTO NAME "column" VALUE value))
SELECT "column", median(value) FILTER (st = 'F') AS before, median(value) FILTER (st = 'O') AS after, median(value) FILTER (st = 'O') - median(value) FILTER (st = 'F') AS shift FROM u GROUP BY 1""")
def _(spark, sf):
    o = tb(spark, sf, "orders")
    return A.shift_table(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), ["o_totalprice", "o_custkey"])


@query("name_family_counts", sql="""SELECT image_type, family, count(*) AS n FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS image_type,
  coalesce(nullif(split_part(p_name, ' ', 2), ''), '') AS family, p_brand FROM part) GROUP BY ALL""")
def _(spark, sf):
    names = tb(spark, sf, "part").select(F.concat_ws("_", F.split("p_name", " ").getItem(0), F.split("p_name", " ").getItem(1), "p_brand").alias("name"))
    return A.name_family_counts(names, "name")


# ---- set operations -----------------------------------------------------------------------------------------
@query("union_sites", sql="""SELECT key, src, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord, src, value) AS rn FROM (
  SELECT o_custkey AS key, 0 AS ord, 'F' AS src, o_totalprice AS value FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT o_custkey, 1, 'O', o_totalprice FROM orders WHERE o_orderstatus = 'O')) WHERE rn = 1""")
def _(spark, sf):
    o = tb(spark, sf, "orders")
    part = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("key"), F.lit(s).alias("src"), F.col("o_totalprice").alias("value"))
    return U.union_sites([part("F"), part("O")], "key")


@query("key_set_algebra", sql="""SELECT 'intersect' AS op, o_custkey FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')
  UNION ALL SELECT 'except', o_custkey FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')
  UNION ALL SELECT 'union', o_custkey FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')""")
def _(spark, sf):
    o = tb(spark, sf, "orders")
    a, b = o.where("o_orderstatus = 'F'"), o.where("o_orderpriority = '5-LOW'")
    tag = lambda d, n: d.select(F.lit(n).alias("op"), "o_custkey")
    return tag(U.intersect_keys(a, b, "o_custkey"), "intersect").unionByName(tag(U.except_keys(a, b, "o_custkey"), "except")).unionByName(
        tag(U.union_keys(a, b, "o_custkey"), "union"))


@query("pairwise_jaccard", rounded=["jaccard"], sql="""
WITH m AS (SELECT DISTINCT o_orderpriority AS g, o_custkey AS i FROM orders), s AS (SELECT g, count(*) AS n FROM m GROUP BY g),
x AS (SELECT a.g AS a, b.g AS b, count(*) AS shared FROM m a JOIN m b ON a.i = b.i AND a.g < b.g GROUP BY ALL)
SELECT p.g AS a, q.g AS b, coalesce(shared, 0) AS shared, p.n + q.n - coalesce(shared, 0) AS union_size, coalesce(shared, 0)::DOUBLE / (p.n + q.n - coalesce(shared, 0)) AS jaccard
FROM s p JOIN s q ON p.g < q.g LEFT JOIN x ON x.a = p.g AND x.b = q.g""")
def _(spark, sf):
    return U.pairwise_jaccard(tb(spark, sf, "orders"), "o_orderpriority", "o_custkey")


@query("in_all_in_any", sql="""SELECT count(*) FILTER (c = (SELECT count(DISTINCT l_returnflag) FROM lineitem)) AS in_all, count(*) AS in_any
  FROM (SELECT l_orderkey, count(DISTINCT l_returnflag) AS c FROM lineitem GROUP BY 1)""")
def _(spark, sf):
    return U.in_all_in_any(tb(spark, sf, "lineitem"), "l_returnflag", "l_orderkey")


@query("all_combinations", rounded=["total"], digits=2, sql="""
WITH i AS (SELECT event_type AS item, row_number() OVER (ORDER BY event_type) - 1 AS b, count(*) AS n, sum(value) AS v FROM events GROUP BY 1)
SELECT string_agg(item, '+' ORDER BY item) AS combo, count(*)::INT AS n_items, sum(n)::BIGINT AS n, sum(v) AS total
FROM range(1, (SELECT (1 << count(*)) FROM i)) m(mask), i WHERE (mask >> b) & 1 = 1 GROUP BY mask""")
def _(spark, sf):
    per = tb(spark, sf, "events").groupBy(F.col("event_type").alias("item")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    return U.all_combinations(per.select("item"), "item").join(per, "item").groupBy("combo", "n_items").agg(
        F.sum("n").alias("n"), F.sum("v").alias("total"))


@query("covering_gaps", ctes=["emb_split"], sql="""
SELECT d.doc_id AS key, coalesce(n, 0) AS n_test, TRUE AS in_cohort FROM documents d LEFT JOIN (SELECT key, count(*) AS n FROM emb_split WHERE role = 'test' GROUP BY 1) t
 ON d.doc_id = t.key WHERE coalesce(n, 0) <> 1""")
def _(spark, sf):
    return U.covering_gaps(X.emb_split(spark, sf), tb(spark, sf, "documents").select(F.col("doc_id").alias("key")))
