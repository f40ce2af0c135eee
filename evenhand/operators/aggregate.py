"""Summaries: counts, moments, quantiles, rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.functions import expr as E
from evenhand.operators.core import quantiles, same_keys


def count_by(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, row: str, col: str, levels: Sequence) -> DataFrame:
    """Counts with the declared levels as columns."""
    return df.groupBy(row).agg(*[F.count_if(F.col(col) == v).alias(f"n_{v}") for v in levels])


def count_and_distinct(df: DataFrame, by: Sequence[str], item: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(item).alias("n_distinct"))


def collection_summary(series: DataFrame, by: str, image: str = "R", mask: str = "A") -> DataFrame:
    """Per collection: distinct series, patients, studies, patients with images, masks, both; bytes; makers.

    Each distinct count is its own two-step aggregation on a hashed id, so one large collection is spread
    over the cluster; patients are folded to one row with their flags before they are counted.
    """
    base = series.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_series"), F.sum("bytes").alias("bytes"),
        F.sum(F.when(F.col("modality") == image, F.col("bytes")).otherwise(0)).alias("image_bytes"),
        F.array_join(F.sort_array(F.collect_set("maker")), ",").alias("makers"),
        F.array_join(F.sort_array(F.collect_set("licence")), ",").alias("licences"))
    pat = series.groupBy(by, "patient").agg(F.max(F.col("modality") == image).alias("i"), F.max(F.col("modality") == mask).alias("m"))
    pat = pat.groupBy(by).agg(F.count(F.lit(1)).alias("n_patients"), F.count_if("i").alias("n_image_patients"),
                              F.count_if("m").alias("n_mask_patients"), F.count_if(F.col("i") & F.col("m")).alias("n_both"))
    stu = series.groupBy(by, "study").agg(F.lit(1)).groupBy(by).agg(F.count(F.lit(1)).alias("n_studies"))
    mod = series.groupBy(by, "modality").agg(F.count(F.lit(1)).alias("c")).groupBy(by).agg(F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("modality", "c"))), lambda x: F.concat(x["modality"], F.lit(":"), x["c"])),
        ",").alias("modalities"))
    return same_keys(same_keys(same_keys(base, pat, [by]), stu, [by]), mod, [by])


def entry_rollup(series: DataFrame, entries: DataFrame, collection: str, entry: str, image: str = "R") -> DataFrame:
    """Collections rolled up to entries: distinct patients and studies over the union, additive per-collection image patients."""
    rows = series.join(entries, collection)
    pat = rows.groupBy(entry, "patient").agg(F.lit(1)).groupBy(entry).agg(F.count(F.lit(1)).alias("n_patients"))
    stu = rows.groupBy(entry, "study").agg(F.lit(1)).groupBy(entry).agg(F.count(F.lit(1)).alias("n_studies"))
    per = rows.groupBy(entry, collection, "patient").agg(F.max((F.col("modality") == image).cast("int")).alias("i"))
    per = per.groupBy(entry).agg(F.sum("i").alias("n_image_patients"))
    add = rows.groupBy(entry).agg(F.count(F.lit(1)).alias("n_series"), F.sum("bytes").alias("bytes"))
    return same_keys(same_keys(same_keys(add, pat, [entry]), stu, [entry]), per, [entry])


def describe_by_class(df: DataFrame, by: Sequence[str], value: str, flag: str) -> DataFrame:
    """n, mean, sd, missing, percent flagged, quartiles."""
    v = E.finite(value)
    d = df.withColumn("_v", v)
    m = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("sd"),
                           F.count_if(F.col("_v").isNull()).alias("n_missing"), (100 * F.avg(F.col(flag).cast("int"))).alias("pct_true"))
    return same_keys(m, quantiles(d, by, "_v", {"q1": 0.25, "median": 0.5, "q3": 0.75}), by, "left")


def numeric_summary(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per column: finite n, min, quartiles, max, mean, sd (0 for one value), distinct values after rounding to 6."""
    long = df.select(*by, *[E.finite(c).alias(c) for c in cols]).unpivot(list(by), list(cols), "column", "value").where("value IS NOT NULL")
    keys = [*by, "column"]
    m = long.groupBy(*keys).agg(F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"),
                                F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"))
    d = long.select(*keys, F.round("value", 6).alias("v")).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_distinct"))
    q = quantiles(long, keys, "value", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return same_keys(same_keys(m, d, keys), q, keys)


def category_distribution(df: DataFrame, c: str, top: int = 12, by: Sequence[str] = ()) -> DataFrame:
    """Present, missing and distinct values, with the most frequent ones as text."""
    v = E.normalise_category(c)
    cnt = df.select(*by, v.alias("v")).groupBy(*by, "v").agg(F.count(F.lit(1)).alias("c"))
    present = F.col("v").isNotNull()
    g = cnt.groupBy(*by).agg(F.coalesce(F.sum(F.when(present, F.col("c"))), F.lit(0)).alias("n_present"),
                             F.coalesce(F.sum(F.when(~present, F.col("c"))), F.lit(0)).alias("n_missing"), F.count("v").alias("n_distinct"))
    lead = top_of(cnt.where(present), by, "c", "v", top)
    return same_keys(g, lead, by, "left") if by else g.withColumn("top_values", lead.scalar())


def top_of(cnt: DataFrame, by: Sequence[str], n: str, label: str, top: int) -> DataFrame:
    """``label:n`` of the ``top`` largest as one text; rank filters run before the shuffle."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*by).orderBy(F.col(n).desc(), F.col(label))
    kept = cnt.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
    return kept.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", label, n))),
                                                          lambda x: F.concat_ws(":", x[label], x[n])), ",").alias("top_values"))


def bag_size_stats(bags: DataFrame, bag: str, label: str | None = None, small: int = 20) -> DataFrame:
    """Over bag sizes: n, total, min, median, mean, max, population sd, exclusive quartiles, small bags."""
    size = bags.groupBy(bag, *([label] if label else [])).agg(F.count(F.lit(1)).alias("n"))
    by = [label] if label else []
    m = size.groupBy(*by).agg(F.count(F.lit(1)).alias("n_bags"), F.sum("n").alias("total"), F.min("n").alias("min"), F.max("n").alias("max"),
                              F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"), F.count_if(F.col("n") < small).alias("n_small"))
    q = quantiles(size, by, "n", {"q1": 0.25, "median": 0.5, "q3": 0.75}, "exclusive")
    if by:
        return same_keys(m, q, by)
    return m.withColumn("_q", q.select(F.struct("q1", "median", "q3")).scalar()).select(*m.columns, "_q.*")


def mean_sd(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Finite values only: mean, sample sd (0 for one value, NULL for none), n."""
    v = E.finite(value)
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.when(F.count(v) == 1, 0.0).otherwise(F.stddev_samp(v)).alias("sd"),
                               F.count(v).alias("n"))


def state_summary(state: DataFrame, by: Sequence[str], kept: str, mean: str, sd: str) -> DataFrame:
    """Over a fitted-state table: offered, kept, dropped and the spread of fitted means and sds."""
    k = F.col(kept)
    m = state.groupBy(*by).agg(F.count(F.lit(1)).alias("offered"), F.count_if(k).alias("kept"), F.count_if(~k).alias("dropped"),
                               *[f(F.when(k, F.col(c))).alias(f"{n}_{c}") for c in (mean, sd) for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))])
    q = quantiles(state.where(k), by, sd, {f"median_{sd}": 0.5})
    return same_keys(m, q, by, "left")


def gain_concentration(df: DataFrame, fold: str, a: str, b: str) -> DataFrame:
    """Fold differences b - a: sum, the largest in size and its share, folds improved and worsened."""
    d = df.withColumn("_d", F.col(b) - F.col(a))
    g = d.agg(F.sum("_d").alias("total"), F.max_by(fold, F.struct(F.abs("_d"), -F.col(fold))).alias("largest_fold"),
              F.max_by("_d", F.struct(F.abs("_d"), -F.col(fold))).alias("largest"), F.count_if(F.col("_d") > 0).alias("improved"),
              F.count_if(F.col("_d") < 0).alias("worsened"))
    return g.withColumn("share", E.ratio("largest", "total"))


def paired_ratio(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """b / a: min, median, max, mean; how often b >= a."""
    d = df.withColumn("_ratio", E.ratio(b, a)).where("_ratio IS NOT NULL")
    m = d.groupBy(*by).agg(F.min("_ratio").alias("min"), F.max("_ratio").alias("max"), F.avg("_ratio").alias("mean"),
                           F.count_if(F.col(b) >= F.col(a)).alias("n_not_smaller"))
    q = quantiles(d, by, "_ratio", {"median": 0.5})
    return same_keys(m, q, by) if by else m.withColumn("median", q.scalar())


def runtime_model(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least squares y = a + b x, largest absolute residual, slope through the origin."""
    fit = df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                              (F.sum(F.col(x) * F.col(y)) / F.sum(F.col(x) * F.col(x))).alias("origin_slope"))
    if by:
        rows = same_keys(df, fit, by)
    else:
        rows = df.withColumn("_f", fit.select(F.struct(*fit.columns)).scalar()).select(*df.columns, "_f.*")
    res = F.abs(F.col(y) - F.col("intercept") - F.col("slope") * F.col(x))
    return rows.groupBy(*by, "slope", "intercept", "origin_slope").agg(F.max(res).alias("max_residual"))


def selection_frequency(sel: DataFrame, feature: str, fold: str, rank: str, coef: str) -> DataFrame:
    """Folds a feature was selected in, frequency, mean rank and coefficient, its signs."""
    total = sel.agg(F.countDistinct(fold)).scalar()
    g = sel.groupBy(feature).agg(F.countDistinct(fold).alias("n_folds"), F.avg(rank).alias("mean_rank"), F.avg(coef).alias("mean_coef"),
                                 F.count_if(F.col(coef) > 0).alias("n_positive"), F.count_if(F.col(coef) < 0).alias("n_negative"),
                                 F.array_join(F.sort_array(F.collect_set(fold)), ",").alias("folds"))
    return g.withColumn("frequency", F.col("n_folds") / total)


def shift_table(before: DataFrame, after: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Medians of two cohorts side by side."""
    med = lambda d, n: quantiles(d.select(*[E.finite(c).alias(c) for c in cols]).unpivot([], list(cols), "column", "value"),
                                 ["column"], "value", {n: 0.5})
    j = med(before, "before").join(med(after, "after"), "column", "full")
    return j.withColumn("shift", F.col("after") - F.col("before"))


def name_family_counts(names: DataFrame, name: str) -> DataFrame:
    f = E.name_family(name)
    return names.select(name).distinct().select(f.alias("_f")).groupBy("_f.image_type", "_f.family").agg(F.count(F.lit(1)).alias("n"))
