"""Single Spark ML estimators with the penalty scale of the usual C convention, ensembles, fusion and transport.

Searches over many splits and settings do not fit models one by one: see ``search``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.functions import expr as E
from evenhand.operators import harmonise as H
from evenhand.operators import selection as S
from evenhand.operators.core import attach_stats, quantiles, same_keys
from evenhand.operators.metrics import auc_by_group, fold_logits, line_logistic, site_balanced_auc, weighted_auc
from evenhand.operators.resample import percentiles
from evenhand.operators.splits import strata_weights
from evenhand.operators.weightings import replicate_counts, vector_areas
from evenhand.operators.windows import top_n, zscore_within
from evenhand.session import cut_lineage

# The search grids and the boosted-tree settings.
TOP_K = (10, 25, 50)
LOGREG_C = (0.01, 0.1, 1.0)
RIDGE_C = (0.0001, 0.0003, 0.001, 0.003, 0.01)
SVM_C = (0.1, 1.0, 10.0)
LEAVES = (4, 8)
BOOST = {"maxIter": 200, "stepSize": 0.03, "minInstancesPerNode": 10, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.5"}


def candidate_grid(top_k: Sequence[int] = TOP_K, logreg_c: Sequence[float] = LOGREG_C, ridge_c: Sequence[float] = RIDGE_C,
                   svm_c: Sequence[float] = SVM_C, leaves: Sequence[int] = LEAVES) -> list[dict]:
    """Every setting in a fixed order; k = 0 means all features."""
    out = [{"kind": "logreg", "k": k, "setting": c} for k, c in product(top_k, logreg_c)]
    out += [{"kind": "svm", "k": k, "setting": c} for k, c in product(top_k, svm_c)]
    out += [{"kind": "gbt", "k": k, "setting": float(n)} for k, n in product(top_k, leaves)]
    out += [{"kind": "ridge_all", "k": 0, "setting": c} for c in ridge_c]
    return [{"candidate": i, **c} for i, c in enumerate(out)]


def fits_of(splits: DataFrame, grid: Sequence[dict] | None = None) -> DataFrame:
    """The settings to be fitted on every split: its row once per setting, in the order of the grid."""
    grid = candidate_grid() if grid is None else grid
    made = [F.struct(F.lit(g["candidate"]).alias("candidate"), F.lit(g["kind"]).alias("kind"), F.lit(g["k"]).alias("k"), F.lit(float(g["setting"])).alias("setting")) for g in grid]
    return splits.withColumn("_g", F.explode(F.array(*made))).select(*splits.columns, "_g.*")


def _total(df: DataFrame, weight: str | None) -> float:
    return float(df.agg(F.sum(weight) if weight else F.count(F.lit(1))).first()[0] or 0.0)


def fit_logistic(df: DataFrame, c: float = 1.0, l1_ratio: float = 0.0, label: str = "y", weight: str | None = None,
                 features: str = "features", max_iter: int = 200):
    """Penalised logistic regression; ``C`` maps to 1 / (C * total weight), the intercept is free."""
    est = LogisticRegression(featuresCol=features, labelCol=label, regParam=1.0 / (c * _total(df, weight)), elasticNetParam=l1_ratio,
                             standardization=False, maxIter=max_iter, tol=1e-10, family="binomial")
    return (est.setWeightCol(weight) if weight else est).fit(df)


def fit_gbt(df: DataFrame, leaves: int = 4, label: str = "y", weight: str | None = None, features: str = "features", seed: int = 1, **over):
    """Boosted trees; a tree of ``leaves`` leaves becomes a tree of depth log2(leaves)."""
    est = GBTClassifier(featuresCol=features, labelCol=label, maxDepth=max(1, round(math.log2(leaves))), seed=seed, **{**BOOST, **over})
    return (est.setWeightCol(weight) if weight else est).fit(df)


def fourier_map(df: DataFrame, features: str, width: int, gamma: float, parts: int = 128, seed: int = 1, out: str = "features") -> DataFrame:
    """Random Fourier features of the RBF kernel exp(-gamma |x - x'|^2); inner products approximate the kernel."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0.0, math.sqrt(2.0 * gamma), (width, parts)), rng.uniform(0.0, 2.0 * math.pi, parts)

    @F.pandas_udf("array<double>")
    def lift(x: pd.Series) -> pd.Series:
        return pd.Series(list(math.sqrt(2.0 / parts) * np.cos(np.stack(x.to_numpy()) @ w + b)))

    return df.withColumn(out, array_to_vector(lift(features)))


def rbf_svm(train: DataFrame, rows: DataFrame, features: str, c: float = 1.0, label: str = "y", weight: str | None = None,
            parts: int = 128, seed: int = 1) -> DataFrame:
    """``rows`` scored by a linear SVM on Fourier features, gamma = 1 / (width * variance of all training values).

    An approximation of the kernel machine; it improves with ``parts``.
    """
    st = train.select(F.size(features).alias("w"), F.explode(features).alias("v")).agg(F.max("w"), F.var_pop("v")).first()
    width, gamma = int(st[0]), 1.0 / (st[0] * max(st[1], 1e-12))
    lift = lambda d: fourier_map(d, features, width, gamma, parts, seed, "_lift")
    est = LinearSVC(featuresCol="_lift", labelCol=label, regParam=1.0 / (c * _total(train, weight)), maxIter=100, standardization=False)
    model = (est.setWeightCol(weight) if weight else est).fit(lift(train))
    return model.transform(lift(rows)).withColumn("score", vector_to_array("rawPrediction")[1]).drop("_lift", "rawPrediction", "prediction")


def margin(model, rows: DataFrame, features: str = "features") -> DataFrame:
    """Decision value (log odds) as ``score``."""
    out = model.transform(rows).withColumn("score", vector_to_array("rawPrediction")[1])
    return out.drop(*[c for c in ("rawPrediction", "probability", "prediction") if c in out.columns])


def lasso_select(df: DataFrame, c: float, label: str = "y", weight: str | None = None, features: str = "values") -> DataFrame:
    """Support of an L1 logistic fit: (feature position, coef) with |coef| > 1e-8. No row means the candidate is invalid."""
    vec = df.withColumn("_x", array_to_vector(features))
    return coefficient_table(fit_logistic(vec, c, 1.0, label, weight, "_x"), df).where(F.abs("coef") > 1e-8)


def coefficient_table(model, df: DataFrame) -> DataFrame:
    """(feature position, coef) of a fitted linear model: one row per column of the data, none of its rows read."""
    values = F.array(*[F.lit(float(v)) for v in model.coefficients.toArray()])
    return df.sparkSession.range(1).select(F.posexplode(values).alias("feature", "coef"))


def capped_elastic_net(train: DataFrame, rows: DataFrame, c: float, l1_ratio: float, cap: int = 8, label: str = "y",
                       weight: str | None = None, features: str = "values") -> DataFrame:
    """Elastic net, keep the ``cap`` largest non-zero coefficients (ties to the lower index), refit on them, score ``rows``.

    With nothing kept the score is the log odds of the weighted training prior.
    """
    vec = train.withColumn("_x", array_to_vector(features))
    table = coefficient_table(fit_logistic(vec, c, l1_ratio, label, weight, "_x"), train).where("coef <> 0")
    strongest = top_n(table, [F.abs("coef").desc(), F.col("feature")], cap)
    keep = [r["feature"] for r in strongest.orderBy("feature").collect()]
    if not keep:
        w = F.col(weight) if weight else F.lit(1.0)
        prior = float(train.agg(F.sum(w * F.col(label)) / F.sum(w)).first()[0])
        return rows.withColumn("score", E.logit(F.lit(prior))).withColumn("n_selected", F.lit(0))
    pick = lambda d: d.withColumn("_x", array_to_vector(F.array(*[F.col(features)[j] for j in keep])))
    model = fit_logistic(pick(train), c, l1_ratio, label, weight, "_x")
    return margin(model, pick(rows)).drop("_x").withColumn("n_selected", F.lit(len(keep)))


def mrmr_ridge(train_long: DataFrame, train: DataFrame, rows: DataFrame, k: int, c: float = 1.0, weight: str | None = None,
               features: str = "values") -> DataFrame:
    """Top k by relevance minus redundancy on the training rows, then L2 logistic on them."""
    order = S.mrmr_rank(S.anova_f(train_long), S.abs_corr_matrix(train, features), [], k)
    keep = sorted(r["feature"] for r in order.select("feature").collect())
    pick = lambda d: d.withColumn("_x", array_to_vector(F.array(*[F.col(features)[j] for j in keep])))
    return margin(fit_logistic(pick(train), c, weight=weight, features="_x"), pick(rows)).drop("_x")


# ---- ensembles ----------------------------------------------------------------------------------------------
def ensemble_z(scores: DataFrame, by: Sequence[str] = ("fold",), model: str = "kind", key: str = "key") -> DataFrame:
    """Mean over models of (score - training mean) / (training sd + 1e-8), on the test rows."""
    tr = F.col("role") == "train"
    st = scores.groupBy(*by, model).agg(F.avg(F.when(tr, F.col("score"))).alias("_m"), F.stddev_pop(F.when(tr, F.col("score"))).alias("_s"))
    d = same_keys(scores.where("role = 'test'"), st, [*by, model])
    return d.withColumn("z", (F.col("score") - F.col("_m")) / (F.col("_s") + 1e-8)).groupBy(*by, key, "site", "y").agg(F.avg("z").alias("score"))


# ---- fusion and calibration ---------------------------------------------------------------------------------
def fuse(oof: DataFrame, combos: DataFrame, within: Sequence[str], block: str = "block") -> DataFrame:
    """Equal-weight mean of within-group z-scores for every combination of blocks.

    ``combos`` lists (combo, n_items, block): 2^n - 1 subsets of the declared blocks.
    """
    z = zscore_within(oof, [block, *within], "score")
    return z.join(combos, block).groupBy("combo", "n_items", *within, "key", "site", "y").agg(F.avg("z").alias("score"))


def late_fusion(oof: DataFrame, loso: DataFrame, combos: DataFrame, b: int = 2000, seed: int = 1) -> DataFrame:
    """Per combination: site-balanced AUC and mean site AUC (mean over seeds), its interval, mean leave-site-out AUC."""
    f = cut_lineage(fuse(oof, combos, ["seed"]))
    sb = site_balanced_auc(f, by=["combo", "n_items", "seed"]).groupBy("combo", "n_items").agg(F.avg("sb_auc").alias("sb_auc"))
    site = auc_by_group(f, "site", by=["combo", "seed"]).groupBy("combo", "seed").agg(F.avg("auc").alias("a")).groupBy(
        "combo").agg(F.avg("a").alias("site_auc"))
    lo = weighted_auc(fuse(loso, combos, ["held_out", "seed"]), by=["combo", "held_out", "seed"]).groupBy("combo", "held_out").agg(
        F.avg("auc").alias("a")).groupBy("combo").agg(F.avg("a").alias("loso_mean"))
    avg = cut_lineage(f.groupBy("combo", "key", "site", "y").agg(F.avg("score").alias("score")))
    # the same counts of draws serve every combination
    base = attach_stats(avg.select("key", "site", "y").distinct(), ["site", "y"], (1 / F.count(F.lit(1))).alias("w"))
    counts = replicate_counts(base, ["site", "y"], "key", b, seed).select("key", "w", "chunk", "counts")
    reps = vector_areas(avg.join(counts, "key"), ["combo"], b)
    ci = percentiles(reps, ["combo"], "auc", {"ci_lo": 0.025, "ci_hi": 0.975})
    out = same_keys(sb, site, ["combo"])
    return same_keys(same_keys(out, lo, ["combo"]), ci, ["combo"])


def stacked_fusion(pairs: DataFrame, a: str, b: str, c: float = 1.0, by: str = "fold") -> DataFrame:
    """Two-input ridge fitted per fold on the inner-OOF rows (role train), scoring the outer test rows."""
    d = pairs.withColumn("_x", array_to_vector(F.array(a, b)))
    out = []
    for r in d.select(by).distinct().orderBy(by).collect():
        part = d.where(F.col(by) == r[by])
        out.append(margin(fit_logistic(part.where("role = 'train'"), c, features="_x"), part.where("role = 'test'")).drop("_x"))
    return reduce(DataFrame.unionByName, out)


def platt_fit(oof: DataFrame, p: str, y: str = "y", c: float = 1e6, eps: float = 1e-6) -> tuple[float, float, bool]:
    """(a, b, valid) of sigmoid(a logit(p) + b); the identity and False when a fit is impossible or not increasing."""
    folded = fold_logits(oof, p, y, eps)
    r = folded.agg(F.sum("w1"), F.sum("n"), F.count(F.lit(1))).first()
    if not r[1] or r[0] in (0.0, r[1]) or r[2] < 2:
        return 1.0, 0.0, False
    a, b = line_logistic(folded, c=c)
    return (a, b, True) if math.isfinite(a) and math.isfinite(b) and a > 0 else (1.0, 0.0, False)


def platt_apply(p, a: float, b: float, eps: float = 1e-6):
    return E.sigmoid(F.lit(a) * E.logit(p, eps) + F.lit(b))


def transport_scores(long: DataFrame, source: str, target: str, cand: dict, em_steps: int = 10, em_tol: float = 1e-4,
                     shift: float = 0.15, kmax: int = 50) -> DataFrame:
    """Train on one site, score another under every mapping of its features: (mapping, key, y, score, p).

    none, combat (own moments), balanced_em (soft class weights from the source model, re-estimated until the
    posteriors settle), prior_known / prior_minus / prior_plus (one prevalence number), oracle (true labels).
    The destination's labels are used only by prior_known, its misspecified forms and the oracle.
    """
    cols = ["key", "site", "y", "feature", "value"]
    src = long.where(F.col("site") == source).select(*cols)
    state = cut_lineage(H.fit_state(src.withColumn("role", F.lit("train")), [], "none"))
    fills = state.select("feature", "fill")
    clean = lambda d: H.impute(d, fills).select(*cols)
    src, dst = clean(src), cut_lineage(clean(long.where(F.col("site") == target)))
    ref = cut_lineage(H.source_reference(src))
    scale = state.select("feature", "mul", "add")
    to_z = lambda d: same_keys(d, scale, ["feature"]).withColumn("value", F.col("value") * F.col("mul") + F.col("add"))
    train = to_z(src).select(*cols)
    order = S.corr_prune_topk(S.within_site_auc_rank(train), S.abs_corr_matrix(H.to_vectors(train, ["key"]), "values"), [], 0.9, kmax) \
        if cand["k"] else train.select("feature").distinct().withColumn("position", F.col("feature"))
    keep = cut_lineage(order.where(F.col("position") <= cand["k"]) if cand["k"] else order)

    def vectors(d):
        picked = to_z(d).join(keep.select("feature"), "feature", "left_semi")
        return H.to_vectors(picked, ["key", "site", "y"]).withColumn("_x", array_to_vector("values"))

    model = fit_logistic(strata_weights(vectors(src), ["site", "y"], [], "w"), cand["setting"], weight="w", features="_x")

    def score(d):
        return margin(model, vectors(d)).select("key", "y", "score", E.sigmoid("score").alias("p"))

    out = {"none": score(dst), "combat": score(H.map_destination(dst, ref)), "oracle": score(H.map_destination(dst, ref, mode="oracle"))}
    out["prior_known"] = score(H.map_destination_prior(dst, ref))
    out["prior_minus"] = score(H.map_destination_prior(dst, ref, shift=-shift))
    out["prior_plus"] = score(H.map_destination_prior(dst, ref, shift=shift))
    now = cut_lineage(out["combat"])
    for _ in range(em_steps):
        pi = H.prior_shift_em(now.select(F.lit(target).alias("site"), "p"), "site").first()["pi"]
        soft = dst.join(now.select("key", H.adjust_posterior("p", F.lit(pi)).alias("q")), "key")
        new = cut_lineage(score(H.map_destination(soft, ref, mode="balanced", soft="q")))
        moved = new.join(now.select("key", F.col("p").alias("_p")), "key").agg(F.max(F.abs(F.col("p") - F.col("_p")))).first()[0]
        now = new
        if moved is None or moved < em_tol:
            break
    out["balanced_em"] = now
    return reduce(DataFrame.unionByName, [d.withColumn("mapping", F.lit(m)) for m, d in out.items()])


# ---- inspection ---------------------------------------------------------------------------------------------
def pca_project(df: DataFrame, features: str, k: int = 2) -> DataFrame:
    """First ``k`` principal components as columns pc1..pck."""
    vec = df.withColumn("_x", array_to_vector(features))
    out = PCA(k=k, inputCol="_x", outputCol="_p").fit(vec).transform(vec).withColumn("_p", vector_to_array("_p"))
    return out.select(*df.columns, *[F.col("_p")[i].alias(f"pc{i + 1}") for i in range(k)])


def kde_curve(df: DataFrame, value: str, by: str, points: int = 300, lo: float = 0.005, hi: float = 0.995) -> DataFrame:
    """Gaussian density per group on a shared grid between two pooled quantiles; bandwidth n^(-1/5) sd.

    Every row adds to each grid point inside its task, so ``points`` sums per group leave it.
    """
    edge = quantiles(df, [], value, {"lo": lo, "hi": hi}).select(F.struct("lo", "hi")).scalar()
    st = attach_stats(df.where(F.col(value).isNotNull()), [by], (F.stddev_samp(value) * F.pow(F.count(value), F.lit(-0.2))).alias("_h"),
                      F.count(value).alias("_n"))
    g = st.withColumn("_e", edge).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("_e.lo") + (F.col("_e.hi") - F.col("_e.lo")) * F.col("i") / (points - 1)
    t = (x - F.col(value)) / F.col("_h")
    dens = F.sum(F.exp(-t * t / 2) / (F.col("_h") * F.col("_n") * math.sqrt(2 * math.pi)))
    return g.groupBy(by, "i", x.alias("x")).agg(dens.alias("density"))
