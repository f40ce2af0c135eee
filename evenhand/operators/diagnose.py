"""Confounding, shift and stability diagnostics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.functions import expr as E
from evenhand.operators.core import attach_stats, quantiles, same_keys
from evenhand.operators.joins import merge_suffix
from evenhand.operators.metrics import auc_by_group, confusion, mean_group_auc, rates, site_balanced_auc, weighted_auc
from evenhand.operators.splits import strata_weights
from evenhand.operators.stattests import attach_one, bh_fdr, chi2_independence, cliffs_delta, kruskal_wallis, mann_whitney
from evenhand.operators.windows import concentration, zscore_within


def site_only_baseline(labels: DataFrame, split: DataFrame) -> DataFrame:
    """Score every test row by the training prevalence of its site: pooled against site-balanced AUC."""
    rows = split.join(labels, "key")
    prev = rows.where("role = 'train'").groupBy("fold", "site").agg(F.avg("y").alias("score"))
    oof = same_keys(rows.where("role = 'test'").select("fold", "key", "site", "y"), prev, ["fold", "site"])
    return attach_one(weighted_auc(oof).withColumnRenamed("auc", "pooled_auc"), site_balanced_auc(oof))


def baseline_metrics(oof: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pooled, site-balanced and mean site AUC of out-of-fold scores."""
    parts = [weighted_auc(oof, by=by).withColumnRenamed("auc", "pooled_auc"), site_balanced_auc(oof, by=by),
             mean_group_auc(oof, "site", by=by).select(*by, F.col("mean_auc").alias("site_auc"))]
    return reduce(lambda a, b: same_keys(a, b, by) if by else attach_one(a, b), parts)


def prediction_shift(oof: DataFrame, site_a: str, site_b: str, by: Sequence[str] = (), s: str = "score") -> DataFrame:
    """Within each true class: median and quartiles of the score per site, the median difference, Cliff's delta."""
    d = oof.where(F.col("site").isin(site_a, site_b))
    q = quantiles(d, [*by, "y", "site"], s, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    side = lambda v, n: q.where(F.col("site") == v).select(*by, "y", *[F.col(c).alias(f"{c}_{n}") for c in ("q1", "median", "q3")])
    j = same_keys(side(site_a, "a"), side(site_b, "b"), [*by, "y"])
    delta = cliffs_delta(d.withColumn("_is", (F.col("site") == site_a).cast("int")), s, "_is", [*by, "y"])
    return same_keys(j.withColumn("median_diff", F.col("median_a") - F.col("median_b")), delta, [*by, "y"])


def prediction_shifts(oof: DataFrame, by: Sequence[str] = (), s: str = "score") -> DataFrame:
    """``prediction_shift`` of every pair of sites (site_a before site_b). A row takes part once for each other site."""
    keys = [*by, "y"]
    q = quantiles(oof, [*keys, "site"], s, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    side = lambda n: q.select(*keys, F.col("site").alias(f"site_{n}"), *[F.col(c).alias(f"{c}_{n}") for c in ("q1", "median", "q3")])
    pairs = same_keys(side("a"), side("b"), keys).where("site_a < site_b").withColumn("median_diff", F.col("median_a") - F.col("median_b"))
    sites = oof.agg(F.sort_array(F.collect_set("site")).alias("s")).select("s").scalar()
    met = oof.withColumn("_all", sites).select(*keys, "site", s, F.explode(F.filter("_all", lambda x: x != F.col("site"))).alias("_o"))
    met = met.select(*keys, s, F.least("site", "_o").alias("site_a"), F.greatest("site", "_o").alias("site_b"), (F.col("site") < F.col("_o")).cast("int").alias("_is"))
    return same_keys(pairs, cliffs_delta(met, s, "_is", [*keys, "site_a", "site_b"]), [*keys, "site_a", "site_b"])


def subgroup_metrics(df: DataFrame, groups: dict, y: str = "y", s: str = "score") -> DataFrame:
    """n and AUC in named, possibly overlapping strata; NULL AUC where one class is missing."""
    marks = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in groups.items()]))
    return auc_by_group(df.withColumn("subgroup", F.explode(marks)), "subgroup", y, s)


def univariate_leak_check(df: DataFrame, variables: Sequence[str], y: str = "y", site: str = "site") -> DataFrame:
    """Within one site, how well does each acquisition variable alone predict the label."""
    long = df.select(y, site, *[E.finite(v).alias(v) for v in variables]).unpivot([y, site], list(variables), "variable", "value")
    return weighted_auc(long, y, "value", by=[site, "variable"])


def block_summary(metrics: DataFrame, block: str, harm: str, harms: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per block; each metric once per harmonisation."""
    return metrics.groupBy(block).agg(*[F.max(F.when(F.col(harm) == h, F.col(v))).alias(f"{v}_{h}") for h in harms for v in values])


def hyperparam_counts(chosen: DataFrame, by: Sequence[str]) -> DataFrame:
    n = chosen.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return attach_stats(n, by[:-1], F.sum("n").alias("_t")).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def small_bag_report(oof: DataFrame, bags: DataFrame, shared: DataFrame, key: str, limit: int = 20, thr: float = 0.5) -> DataFrame:
    """Predictions of small bags: size, correctness, whether the key is in the shared subset."""
    size = bags.groupBy(key).agg(F.count(F.lit(1)).alias("n_inst")).where(F.col("n_inst") < limit)
    d = oof.join(size, key).join(shared.select(key, F.lit(True).alias("shared")), key, "left")
    return d.withColumn("correct", (F.col("score") >= thr) == (F.col("y") == 1)).withColumn("shared", F.coalesce("shared", F.lit(False)))


def attention_compare(a: DataFrame, b: DataFrame, bag: str, fold: str, weight: str, inst: str) -> DataFrame:
    """Weight concentration of two runs per bag, as per-fold medians side by side."""
    names = ["max_times_n", "max_over_min", "entropy", "top_mass"]

    def run(d):
        c = concentration(d, bag, weight, inst).join(d.select(bag, fold).distinct(), bag)
        long = c.unpivot([fold], names, "measure", "value")
        return quantiles(long, [fold, "measure"], "value", {"median": 0.5})

    return merge_suffix(run(a), run(b), [fold, "measure"])


def transport_summary(scores: DataFrame, mappings: Sequence[str]) -> DataFrame:
    """z within (direction, seed, mapping, block), blocks fused by mean, AUC per cell, mean over seeds, one column per mapping."""
    z = zscore_within(scores, ["direction", "seed", "mapping", "block"], "score")
    f = z.groupBy("direction", "seed", "mapping", "key", "y").agg(F.avg("z").alias("score"))
    a = weighted_auc(f, by=["direction", "seed", "mapping"]).groupBy("direction", "mapping").agg(F.avg("auc").alias("auc"))
    return a.groupBy("direction").agg(*[F.max(F.when(F.col("mapping") == m, F.col("auc"))).alias(f"auc_{m}") for m in mappings])


def site_threshold_metrics(df: DataFrame, s: str = "score", threshold: float = 0.0) -> DataFrame:
    """Sensitivity, specificity and balanced accuracy, pooled (site NULL) and per site: grouping sets over the counts."""
    conf = confusion(df, s, threshold, by=["site"], strict=True)
    both = conf.rollup("site").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")])
    return rates(both, ["site"]).select("site", "sensitivity", "specificity", "balanced_accuracy")


def fusion_summary(fusions: DataFrame, sensitivity: str) -> DataFrame:
    """Best combination, count, median, range, leave-site-out median, and one named combination beside it."""
    m = fusions.agg(F.max_by("combo", F.struct("sb_auc", "combo")).alias("best_combo"), F.max("sb_auc").alias("best"), F.min("sb_auc").alias("worst"),
                    F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("combo") == sensitivity, F.col("sb_auc"))).alias("named"))
    out = attach_one(m, quantiles(fusions, [], "sb_auc", {"median": 0.5}))
    return attach_one(out, quantiles(fusions, [], "loso_mean", {"loso_median": 0.5}))


def feature_test_report(long: DataFrame, q: float = 0.05) -> DataFrame:
    """Per stage and feature: site effect (H, eta squared, reject) and in how many sites the label effect is significant.

    ``long`` has stage, feature, site, y, value. All tests of all features run as grouped aggregations.
    """
    site = bh_fdr(kruskal_wallis(long, by=["stage", "feature"]), by=["stage"], q=q).withColumnRenamed("reject", "site_effect")
    lab = bh_fdr(mann_whitney(long, by=["stage", "feature", "site"]), by=["stage", "site"], q=q)
    lab = lab.groupBy("stage", "feature").agg(F.count_if("reject").alias("n_sites_label_effect"), F.avg(F.abs(F.col("auc") - 0.5)).alias("mean_auc_gap"))
    return same_keys(site, lab, ["stage", "feature"])


def feature_test_summary(report: DataFrame, corr: DataFrame, n_sites: int) -> DataFrame:
    """Per stage: features with a site effect, with a label effect in >= 1, >= 2 and all sites, median eta squared; shares of correlated pairs."""
    n = F.col("n_sites_label_effect")
    g = report.groupBy("stage").agg(F.count(F.lit(1)).alias("n_features"), F.count_if("site_effect").alias("site_effect"), F.count_if(n >= 1).alias("label_ge1"),
                                    F.count_if(n >= 2).alias("label_ge2"), F.count_if(n == n_sites).alias("label_all"))
    g = same_keys(g, quantiles(report, ["stage"], "eta2", {"eta2_median": 0.5}), ["stage"])
    share = lambda t: F.avg((F.col("r") > t).cast("int"))
    return same_keys(g, corr.groupBy("stage").agg(share(0.7).alias("pairs_gt_07"), share(0.9).alias("pairs_gt_09")), ["stage"])


def clinical_test_report(df: DataFrame, numeric: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Per covariate: p by class (rank or contingency test), p between sites, mean within-site AUC."""
    num = df.select("site", "y", *[E.finite(c).alias(c) for c in numeric]).unpivot(["site", "y"], list(numeric), "covariate", "value").where("value IS NOT NULL")
    a = mann_whitney(num, by=["covariate"]).select("covariate", F.col("p").alias("p_class"))
    b = kruskal_wallis(num, by=["covariate"]).select("covariate", F.col("p").alias("p_site"))
    out = same_keys(a, b, ["covariate"])
    if flags:
        fl = df.select("site", "y", *[F.col(c).cast("double").alias(c) for c in flags]).unpivot(["site", "y"], list(flags), "covariate", "value")
        fa = chi2_independence(fl, "value", "y", ["covariate"]).select("covariate", F.col("p").alias("p_class"))
        fb = chi2_independence(fl, "value", "site", ["covariate"]).select("covariate", F.col("p").alias("p_site"))
        out = out.unionByName(same_keys(fa, fb, ["covariate"]))
        num = num.unionByName(fl.where("value IS NOT NULL"))
    w = mean_group_auc(num, "site", "y", "value", by=["covariate"]).select("covariate", F.col("mean_auc").alias("within_site_auc"))
    return same_keys(out, w, ["covariate"])


