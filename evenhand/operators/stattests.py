"""Rank tests, contingency tests and multiplicity control, all grouped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.functions import expr as E
from evenhand.functions.special import chi2_tail, normal_two_sided
from evenhand.operators.core import collapse, row_numbers, running_totals, same_keys
from evenhand.operators.metrics import weighted_auc
from evenhand.session import cut_lineage


def mid_ranks(df: DataFrame, by: Sequence[str], value: str, out: str = "mid_rank") -> DataFrame:
    """Average rank with ties, joined back to the rows."""
    t = running_totals(collapse(df, by, value), by, value, ["n"])
    t = t.select(*by, value, (F.col("cum_n") - (F.col("n") - 1) / 2).alias(out))
    return same_keys(df, t, [*by, value], "left")


def mann_whitney(df: DataFrame, value: str = "value", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """U of class 1, AUC = U / (n1 n0) and the two-sided p (normal, tie-corrected, continuity 0.5)."""
    one = lambda v: F.when(F.col(y) == v, 1).otherwise(0).cast("bigint")
    t = collapse(df.where(F.col(y).isin(0, 1)), by, value, c1=one(1), c0=one(0))
    t = running_totals(t, by, value, ["c0"])
    tie = (F.col("c1") + F.col("c0")).cast("double")
    g = t.groupBy(*by).agg(F.sum("c1").alias("n1"), F.sum("c0").alias("n0"),
                           F.sum(F.col("c1") * (F.col("cum_c0") - 0.5 * F.col("c0"))).alias("u"),
                           F.sum(tie * tie * tie - tie).alias("_t"))
    n = (F.col("n1") + F.col("n0")).cast("double")
    pairs = F.col("n1").cast("double") * F.col("n0")
    sd = F.sqrt(pairs / 12 * (n + 1 - F.col("_t") / (n * (n - 1))))
    z = E.ratio(F.greatest(F.abs(F.col("u") - pairs / 2) - 0.5, F.lit(0.0)), sd)
    return g.select(*by, "n1", "n0", "u", E.ratio("u", pairs).alias("auc"), z.alias("z")).withColumn("p", normal_two_sided("z"))


def kruskal_wallis(df: DataFrame, value: str = "value", group: str = "site", by: Sequence[str] = ()) -> DataFrame:
    """Tie-corrected H, its p, and eta squared = (H - k + 1) / (n - k)."""
    # written once: the ranks are joined back by value, and a fitted value computed twice may differ in its last bit
    cells = cut_lineage(collapse(df, [*by, group], value))
    pooled = cells.groupBy(*by, value).agg(F.sum("n").alias("n"))
    ranks = running_totals(pooled, by, value, ["n"]).select(
        *by, value, (F.col("cum_n") - (F.col("n") - 1) / 2).alias("_r"), F.col("n").cast("double").alias("_tie"))
    per_group = same_keys(cells, ranks, [*by, value]).groupBy(*by, group).agg(
        F.sum("n").cast("double").alias("ng"), F.sum(F.col("n") * F.col("_r")).alias("rs"))
    g = per_group.groupBy(*by).agg(F.sum("ng").alias("n"), F.count(F.lit(1)).alias("k"),
                                   F.sum(F.col("rs") * F.col("rs") / F.col("ng")).alias("_s"))
    ties = ranks.groupBy(*by).agg(F.sum(F.pow("_tie", F.lit(3)) - F.col("_tie")).alias("_t"))
    g = same_keys(g, ties, by) if by else attach_one(g, ties)
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("_s") - 3 * (n + 1)) / (1 - F.col("_t") / (n * n * n - n))
    g = g.select(*by, F.col("n").cast("bigint").alias("n"), "k", h.alias("h"))
    return g.withColumn("eta2", (F.col("h") - F.col("k") + 1) / (F.col("n") - F.col("k"))).withColumn(
        "p", chi2_tail("h", (F.col("k") - 1).cast("double")))


def attach_one(df: DataFrame, one: DataFrame) -> DataFrame:
    """Columns of a one-row frame added to every row."""
    packed = one.select(F.struct(*one.columns)).scalar()
    return df.withColumn("_one", packed).select(*df.columns, "_one.*")


def chi2_independence(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Contingency chi-squared with p; a 2 x 2 table gets the Yates correction.

    Only observed cells are formed: the plain statistic is n (sum o^2 / (row * column) - 1), and in a 2 x 2
    table every cell misses its expectation by the same amount, so the margins give the corrected sum.
    """
    keys = list(by)
    cell = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, a, b).agg(F.count(F.lit(1)).cast("double").alias("o"))
    margin = lambda c: cell.groupBy(*keys, c).agg(F.sum("o").alias("m"))
    inverse = lambda c, n: margin(c).groupBy(*keys).agg(F.count(F.lit(1)).alias(f"k{n}"), F.sum(1 / F.col("m")).alias(f"i{n}"), F.sum("m").alias(f"n{n}"))
    size = same_keys(inverse(a, "a"), inverse(b, "b"), keys) if keys else attach_one(inverse(a, "a"), inverse(b, "b"))
    full = same_keys(cell, margin(a).withColumnRenamed("m", "ra"), [*keys, a])
    full = same_keys(full, margin(b).withColumnRenamed("m", "rb"), [*keys, b])
    g = full.groupBy(*keys).agg(F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("rb"))).alias("s"),
                                F.max(F.struct("o", "ra", "rb")).alias("one"))
    g = same_keys(g, size, keys) if keys else attach_one(g, size)
    n = F.col("na")
    gap = F.abs(F.col("one.o") - F.col("one.ra") * F.col("one.rb") / n)
    yates = F.pow(gap - F.least(F.lit(0.5), gap), 2) * n * F.col("ia") * F.col("ib")
    chi2 = F.when((F.col("ka") == 2) & (F.col("kb") == 2), yates).otherwise(F.greatest(n * (F.col("s") - 1), F.lit(0.0)))
    out = g.select(*keys, chi2.alias("chi2"), ((F.col("ka") - 1) * (F.col("kb") - 1)).alias("df"))
    return out.withColumn("p", chi2_tail("chi2", F.col("df").cast("double")))


def bh_fdr(df: DataFrame, p: str = "p", by: Sequence[str] = (), q: float = 0.05, key: str = "feature") -> DataFrame:
    """Benjamini-Hochberg: reject every p up to the largest p(i) <= i q / m."""
    df = cut_lineage(df)  # the cut is one of these p-values, to the last bit
    ranked = row_numbers(df.where(F.col(p).isNotNull()), by, p, [key], out="_i", total="_m")
    cut = ranked.groupBy(*by).agg(F.max(F.when(F.col(p) <= F.col("_i") * q / F.col("_m"), F.col(p))).alias("_cut"))
    out = same_keys(df, cut, by, "left") if by else attach_one(df, cut)
    return out.withColumn("reject", F.coalesce(F.col(p) <= F.col("_cut"), F.lit(False))).drop("_cut")


def cliffs_delta(df: DataFrame, value: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(#a > b - #a < b) / (n_a n_b), which is 2 AUC - 1: no pairs are formed."""
    return weighted_auc(df, y, value, by=by).select(*by, (2 * F.col("auc") - 1).alias("delta"))


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    ok = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    r = mid_ranks(mid_ranks(ok, by, a, "_ra"), by, b, "_rb")
    return r.groupBy(*by).agg(F.corr("_ra", "_rb").alias("rho"))
