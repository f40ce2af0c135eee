"""Ranking, standardising within groups, picking, gaps, bag pooling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenhand.functions import expr as E
from evenhand.operators.core import attach_stats, quantiles, row_numbers, same_keys


def first_per_key(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """First row per key. The rank filter is applied per task before the shuffle, so a hot key stays small."""
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_n_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def earliest_group(df: DataFrame, key: str, group: str, date: str) -> DataFrame:
    """Rows of the earliest group per key; NULL dates come last, ties go to the smaller group id."""
    order = F.struct(F.col(date).isNull(), F.col(date), F.col(group))
    first = df.groupBy(key).agg(F.min_by(group, order).alias("_g"))
    return same_keys(df, first, [key]).where(F.col(group) == F.col("_g")).drop("_g")


def zscore_within(df: DataFrame, by: Sequence[str], value: str, eps: float = 0.0, ddof: int = 1, out: str = "z") -> DataFrame:
    """(x - mean) / (sd + eps) inside each group."""
    sd = F.stddev_samp(value) if ddof == 1 else F.stddev_pop(value)
    d = attach_stats(df, by, F.avg(value).alias("_m"), sd.alias("_s"))
    return d.withColumn(out, E.ratio(F.col(value) - F.col("_m"), F.col("_s") + eps)).drop("_m", "_s")


def seed_average(oof: DataFrame, key: Sequence[str], seed: str, value: str, eps: float = 1e-8) -> DataFrame:
    """z-score inside each seed, then the mean per row key."""
    return zscore_within(oof, [seed], value, eps).groupBy(*key).agg(F.avg("z").alias("score"))


def pick_probes(df: DataFrame, key: str, size: str, n: int = 6) -> DataFrame:
    """Smallest, largest, first, last and the rows at 1/3 and 2/3 by key, then fill by key; at most ``n`` distinct rows."""
    num = row_numbers(df.select(key, size), [], key, out="_i", total="_n")
    lo = num.agg(F.min_by(key, F.struct(size, key)).alias("a"), F.min_by(key, F.struct(-F.col(size), F.col(key))).alias("b"))
    num = num.withColumn("_e", lo.select(F.struct("a", "b")).scalar())
    at = lambda f: F.bround((F.col("_n") - 1) * f) + 1
    why = F.coalesce(F.when(F.col(key) == F.col("_e.a"), 1), F.when(F.col(key) == F.col("_e.b"), 2),
                     F.when(F.col("_i") == 1, 3), F.when(F.col("_i") == F.col("_n"), 4), F.when(F.col("_i") == at(1 / 3), 5),
                     F.when(F.col("_i") == at(2 / 3), 6), F.lit(7))
    return num.withColumn("priority", why).orderBy("priority", key).limit(n).select(key, size, "priority")


def argmax_tie(surface: DataFrame, by: Sequence[str], candidate: Sequence[str], score: str, ties: Sequence[Column]) -> DataFrame:
    """Best mean score per group; equal means (to 12 places) fall through the ordered tie-breaks."""
    mean = surface.groupBy(*by, *candidate).agg(F.avg(score).alias("mean_score"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("sd_score"))
    w = W.partitionBy(*by).orderBy(F.round("mean_score", 12).desc(), *ties)
    return mean.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def argmax_tolerance(cands: DataFrame, by: Sequence[str], score: str, tol: float, ties: Sequence[Column]) -> DataFrame:
    """All within ``tol`` of the best form a group; the tie-breaks choose in it. Reports the group's size."""
    d = attach_stats(cands, by, F.max(score).alias("_best")).where(F.col(score) >= F.col("_best") - tol)
    d = attach_stats(d, by, F.count(F.lit(1)).alias("tie_group")).drop("_best")
    w = W.partitionBy(*by).orderBy(*ties)
    return d.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def concentration(df: DataFrame, bag: str, weight: str, inst: str) -> DataFrame:
    """Per bag of weights: max * n, max / min, entropy / ln n, mass of the top max(1, n // 10)."""
    num = row_numbers(df.select(bag, weight, inst), [bag], weight, [inst], descending=True, out="_r", total="_n")
    w = F.col(weight)
    g = num.groupBy(bag).agg(F.max("_n").alias("n"), F.max(w).alias("_mx"), F.min(w).alias("_mn"),
                             F.sum(F.when(w > 0, -w * F.log(w)).otherwise(0.0)).alias("_h"),
                             F.sum(F.when(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 10)), w)).alias("top_mass"))
    n = F.col("n")
    return g.select(bag, n, (F.col("_mx") * n).alias("max_times_n"), E.ratio("_mx", "_mn").alias("max_over_min"),
                    F.when(n > 1, F.col("_h") / F.log(n)).otherwise(0.0).alias("entropy"), "top_mass")


def adaptive_top_bottom(df: DataFrame, bag: str, score: str, inst: str, frac: float = 0.1, max_k: int = 8) -> DataFrame:
    """k = min(max_k, max(1, floor(frac n))), lowered so that 2k <= n; flags for the k highest and k lowest."""
    num = row_numbers(df, [bag], score, [inst], descending=True, out="_r", total="_n")
    k = F.least(F.least(F.lit(max_k), F.greatest(F.lit(1), F.floor(F.col("_n") * frac))), F.floor(F.col("_n") / 2))
    return num.withColumn("k", k.cast("bigint")).withColumn("is_top", F.col("_r") <= F.col("k")).withColumn(
        "is_bottom", F.col("_r") > F.col("_n") - F.col("k")).drop("_r", "_n")


def separation(flags: DataFrame, bag: str, score: str) -> DataFrame:
    """Mean score of the flagged top and bottom rows and their gap."""
    g = flags.groupBy(bag).agg(F.max("k").alias("k"), F.avg(F.when(F.col("is_top"), F.col(score))).alias("top_mean"),
                               F.avg(F.when(F.col("is_bottom"), F.col(score))).alias("bottom_mean"))
    return g.withColumn("gap", F.col("top_mean") - F.col("bottom_mean"))


def bag_softmax(df: DataFrame, bag: str, score: str, out: str = "alpha") -> DataFrame:
    """softmax of the score inside each bag, shifted by the bag's maximum."""
    d = attach_stats(df, [bag], F.max(score).alias("_mx")).withColumn("_e", F.exp(F.col(score) - F.col("_mx")))
    return attach_stats(d, [bag], F.sum("_e").alias("_t")).withColumn(out, F.col("_e") / F.col("_t")).drop("_mx", "_e", "_t")


def bag_softmax_pool(long: DataFrame, bag: str, score: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """Weighted pooled vector per bag, in long form: sum of softmax(score) * value per feature.

    ``long`` carries the instance's score on every feature row, so each (bag, feature) normalises itself and
    the pool needs one pass after the maximum.
    """
    d = attach_stats(long, [bag], F.max(score).alias("_mx"))
    e = F.exp(F.col(score) - F.col("_mx"))
    return d.groupBy(bag, feature).agg((F.sum(e * F.col(value)) / F.sum(e)).alias("pooled"))


def gap_stats(df: DataFrame, by: str, value: str, tol: float = 1e-3, digits: int = 3) -> DataFrame:
    """One position per rounded value and group (the first), then median, min and max consecutive gap and whether all are equal."""
    near = df.where(F.col(value).isNotNull()).groupBy(by, F.round(value, digits).alias("_k"))
    d = near.agg(F.min(value).cast("double").alias("_v")).drop("_k")
    num = row_numbers(d, [by], "_v", out="_r")
    nxt = num.select(by, (F.col("_r") + 1).alias("_r"), F.col("_v").alias("_p"))
    gaps = num.join(nxt, [by, "_r"]).withColumn("gap", F.col("_v") - F.col("_p"))
    m = gaps.groupBy(by).agg(F.count(F.lit(1)).alias("n_gaps"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"))
    q = quantiles(gaps, [by], "gap", {"median_gap": 0.5})
    return same_keys(m, q, [by]).withColumn("uniform", F.col("max_gap") - F.col("min_gap") <= tol)


def farthest_points(df: DataFrame, bag: str, inst: str, features: str, k: int = 8) -> DataFrame:
    """Greedy farthest-point picks per bag, started from the centroid.

    Pick 0 is the centroid itself (inst NULL); each next pick is the instance farthest from all picks so far,
    ties to the smaller inst. A bag is spread over tasks: every round keeps each instance's distance to its
    nearest pick and finds the farthest by a map-side combined aggregate, so no bag is gathered.
    """
    from evenhand.session import cut_lineage

    d = df.select(F.col(bag).alias("bag"), F.col(inst).alias("inst"), F.col(features).alias("f"))
    sums = d.select("bag", F.posexplode("f").alias("p", "v")).groupBy("bag", "p").agg(F.avg("v").alias("m"))
    centre = sums.groupBy("bag").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "m"))), lambda x: x["m"]).alias("c"))
    dist = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    near = same_keys(d, centre, ["bag"]).withColumn("near", dist("f", "c")).drop("c")
    picks = []
    for step in range(1, k):
        best = near.groupBy("bag").agg(F.max(F.struct("near", -F.col("inst"), F.col("f"))).alias("b")).select(
            "bag", F.lit(step).alias("pick"), (-F.col("b.col2")).alias("inst"), F.col("b.f").alias("pf"), F.col("b.near").alias("far"))
        best = cut_lineage(best)
        picks.append(best)
        near = same_keys(near, best.select("bag", "pf"), ["bag"]).withColumn("near", F.least("near", dist("f", "pf"))).drop("pf")
        if step % 4 == 0:
            near = cut_lineage(near)
    start = centre.select("bag", F.lit(0).alias("pick"), F.lit(None).cast("bigint").alias("inst"))
    return reduce(DataFrame.unionByName, [start, *[p.select("bag", "pick", "inst") for p in picks]])


def fixed_bins(df: DataFrame, by: Sequence[str], value: str, lo: float | None, hi: float | None, bins: int) -> DataFrame:
    """Histogram on equal bins from ``lo`` to ``hi``; an edge not given is the extreme of the data.

    The last bin includes its upper edge. Values below the edges count in bin -1, values above in bin ``bins``; NULL values have a NULL bin.
    """
    v = F.col(value)
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first() if lo is None or hi is None else None
    lo, hi = (ends["lo"] if lo is None else lo), (ends["hi"] if hi is None else hi)
    if lo is None or hi is None:
        return df.groupBy(*by, F.lit(None).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    lo, hi = float(lo), float(hi)
    width = (hi - lo) / bins or 1.0
    b = F.when(v.isNull(), None).when(v < lo, -1).when(v > hi, bins).otherwise(F.least(F.floor((v - lo) / width), F.lit(bins - 1))).cast("int")
    return df.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def stratified_sample(df: DataFrame, strata: Sequence[str], key: str, n: int, seed: int = 1) -> DataFrame:
    """n rows per stratum in hash order; the rank filter runs before the shuffle."""
    w = W.partitionBy(*strata).orderBy(F.col("_h"), F.col(key))
    d = df.withColumn("_h", E.hash_order(seed, key)).withColumn("_rn", F.row_number().over(w))
    return d.where(F.col("_rn") <= n).drop("_h", "_rn")


def maximin_choice(scores: DataFrame, variant: str, group: Sequence[str], score: str) -> DataFrame:
    """Variants by their worst group mean, best first."""
    g = scores.groupBy(variant, *group).agg(F.avg(score).alias("m")).groupBy(variant).agg(F.min("m").alias("worst"), F.avg("m").alias("mean"))
    w = W.orderBy(F.col("worst").desc(), F.col(variant))
    return g.withColumn("rank", F.row_number().over(w))


def bag_median(long: DataFrame, bag: str) -> DataFrame:
    return quantiles(long, [bag, "feature"], "value", {"value": 0.5})


def bag_mean(long: DataFrame, bag: str) -> DataFrame:
    return long.groupBy(bag, "feature").agg(F.avg("value").alias("value"))


def bag_expand_moments(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and population sd over all instances of the training bags, so each instance counts once."""
    return long.where(F.col("role") == "train").groupBy(*by, "feature").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count("value").alias("n"))
