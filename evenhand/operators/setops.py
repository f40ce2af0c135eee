"""Unions, key-set algebra, Jaccard, combinations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.functions import expr as E
from evenhand.operators.joins import shared_members


def union_sites(dfs: Sequence[DataFrame], key: str | None = None) -> DataFrame:
    """Append by name; with ``key`` the first source holding a key wins."""
    tagged = [d.withColumn("_src", F.lit(i)) for i, d in enumerate(dfs)]
    allrows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    if key is None:
        return allrows.drop("_src")
    cols = [c for c in allrows.columns if c not in (key, "_src")]
    one = allrows.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct("_src", *cols)).alias("_r"))
    return one.select(key, "_r.*")


def intersect_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def except_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).subtract(b.select(key))


def union_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def pairwise_jaccard(members: DataFrame, group: str, item: str, empty: float | None = None) -> DataFrame:
    """|A n B| / |A u B| for every pair of groups; two empty sets give ``empty`` (1.0 or NULL).

    A group with no item is present as a row whose item is NULL.
    """
    sizes = members.groupBy(group).agg(F.countDistinct(item).alias("size"))
    names = sizes.agg(F.sort_array(F.collect_list(F.struct(F.col(group).alias("g"), F.col("size").alias("s")))).alias("_e"))
    pairs = names.select("_e", F.posexplode("_e").alias("_i", "_a")).select(
        "_a", F.explode(F.slice("_e", F.col("_i") + 2, F.size("_e"))).alias("_b")).select(
        F.col("_a.g").alias("a"), F.col("_b.g").alias("b"), F.col("_a.s").alias("sa"), F.col("_b.s").alias("sb"))
    j = pairs.join(shared_members(members, group, item), ["a", "b"], "left").fillna(0, ["shared"])
    union = F.col("sa") + F.col("sb") - F.col("shared")
    return j.select("a", "b", "shared", union.alias("union_size"),
                    F.coalesce(E.ratio("shared", union), F.lit(empty).cast("double")).alias("jaccard"))


def in_all_in_any(members: DataFrame, group: str, item: str) -> DataFrame:
    per = members.where(F.col(item).isNotNull()).groupBy(item).agg(F.countDistinct(group).alias("c"))
    total = members.agg(F.countDistinct(group)).scalar()
    return per.agg(F.count_if(F.col("c") == total).alias("in_all"), F.count(F.lit(1)).alias("in_any"))


def all_combinations(items: DataFrame, item: str) -> DataFrame:
    """Every non-empty subset of a short item list: (combo, item). Grows as 2^n, so n is a handful by nature."""
    arr = items.agg(F.sort_array(F.collect_set(item)).alias("_it"))
    masks = arr.select("_it", F.expr("explode(sequence(1, shiftleft(1, size(_it)) - 1))").alias("mask"))
    members = F.expr("filter(_it, (x, i) -> (shiftright(mask, i) & 1) = 1)")
    return masks.withColumn("_m", members).select(F.array_join("_m", "+").alias("combo"), F.size("_m").alias("n_items"),
                                                  F.explode("_m").alias(item))


def covering_gaps(split: DataFrame, cohort: DataFrame, key: str = "key") -> DataFrame:
    """Keys a split loses, invents or tests more than once; empty when the test folds partition the cohort."""
    tested = split.where(F.col("role") == "test").groupBy(key).agg(F.count(F.lit(1)).alias("n_test"))
    j = cohort.select(key, F.lit(1).alias("_in")).join(tested, key, "full")
    return j.select(key, F.coalesce("n_test", F.lit(0)).alias("n_test"), F.col("_in").isNotNull().alias("in_cohort")).where(
        (F.col("n_test") != 1) | ~F.col("in_cohort"))
