"""Deterministic splits and weights. Order inside a stratum is an md5 hash of seed and key, never ``rand``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenhand.functions import expr as E
from evenhand.operators.core import row_numbers, same_keys


def _folds(df: DataFrame, key: str, strata: Sequence[str], k: int, seed, out: str) -> DataFrame:
    ordered = df.withColumn("_h", E.hash_order(seed, key))
    return row_numbers(ordered, strata, "_h", [key], out="_rn").withColumn(
        out, ((F.col("_rn") - 1) % k).cast("int")).drop("_h", "_rn")


def test_folds(df: DataFrame, key: str, strata: Sequence[str], k: int, seed) -> DataFrame:
    """``df`` with ``test_fold`` in 0..k-1, every stratum spread evenly."""
    return _folds(df, key, strata, k, seed, "test_fold")


def _long(assigned: DataFrame, k: int) -> DataFrame:
    return assigned.withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(k)]))).withColumn(
        "role", F.when(F.col("test_fold") == F.col("fold"), "test").otherwise("train")).drop("test_fold")


def stratified_kfold(df: DataFrame, key: str, strata: Sequence[str], k: int = 5, seed=1) -> DataFrame:
    """Long split: fold, key, role; each row is tested once."""
    return _long(test_folds(df.select(key, *strata), key, strata, k, seed), k).select("fold", key, "role")


def strata_short_of(df: DataFrame, strata: Sequence[str], k: int) -> DataFrame:
    """Strata too small to appear in every fold; empty when the split is sound."""
    return df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < k)


def repeated_kfold(df: DataFrame, key: str, strata: Sequence[str], k: int = 5,
                   seeds: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    """seed, fold, key, role for every seed."""
    per_seed = df.select(key, *strata).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    return _long(test_folds(per_seed, key, ["seed", *strata], k, F.col("seed")), k).select("seed", "fold", key, "role")


def inner_kfold(split: DataFrame, labels: DataFrame, key: str, strata: Sequence[str], k: int = 3,
                base_seed: int = 100) -> DataFrame:
    """Inner folds inside each outer training part; ``inner_fold`` is -1 on test rows."""
    rows = split.join(labels.select(key, *strata), key)
    train = rows.where(F.col("role") == "train")
    inner = _folds(train, key, ["fold", *strata], k, F.col("fold") + base_seed, "inner_fold")
    test = rows.where(F.col("role") == "test").withColumn("inner_fold", F.lit(-1))
    return inner.unionByName(test).select("fold", key, "role", "inner_fold")


def holdout_split(df: DataFrame, key: str, label: str, frac: float = 0.2, min_val: int = 1, min_train: int = 1,
                  seed=1) -> DataFrame:
    """Validation rows per class: round(frac * n), at least ``min_val``, leaving ``min_train``."""
    ordered = df.withColumn("_h", E.hash_order(seed, key))
    num = row_numbers(ordered, [label], "_h", [key], out="_rn", total="_n")
    take = F.greatest(F.least(F.greatest(F.bround(F.col("_n") * frac), F.lit(min_val)), F.col("_n") - min_train), F.lit(0))
    return num.withColumn("role", F.when(F.col("_rn") <= take, "val").otherwise("train")).drop("_h", "_rn", "_n")


def leave_one_site_out(df: DataFrame, key: str = "key", site: str = "site") -> DataFrame:
    """held_out, key, role: every site in turn is the test set. Sites are few and named by the data."""
    sites = df.agg(F.sort_array(F.collect_set(site)).alias("s")).select("s").scalar()
    return df.select(key, site, F.explode(sites).alias("held_out")).withColumn(
        "role", F.when(F.col(site) == F.col("held_out"), "test").otherwise("train")).select("held_out", key, "role")


def transport_pairs(df: DataFrame, key: str = "key", site: str = "site") -> DataFrame:
    """source, target, key, role for every ordered pair of sites."""
    sites = df.agg(F.sort_array(F.collect_set(site)).alias("s")).select("s").scalar()
    both = df.select(key, site).withColumn("_all", sites)
    other = F.filter("_all", lambda s: s != F.col(site))
    as_source = both.select(F.col(site).alias("source"), F.explode(other).alias("target"), key, F.lit("train").alias("role"))
    as_target = both.select(F.explode(other).alias("source"), F.col(site).alias("target"), key, F.lit("test").alias("role"))
    return as_source.unionByName(as_target)


def strata_weights(df: DataFrame, strata: Sequence[str], by: Sequence[str] = (), out: str = "weight") -> DataFrame:
    """w = N / (S * n_s) within ``by``: equal total per stratum, mean one."""
    counts = df.groupBy(*by, *strata).agg(F.count(F.lit(1)).alias("_ns"))
    w = W.partitionBy(*by)  # one row per stratum
    counts = counts.select(*by, *strata, (F.sum("_ns").over(w) / (F.count(F.lit(1)).over(w) * F.col("_ns"))).alias(out))
    return same_keys(df, counts, [*by, *strata])


def class_balance(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Entity counts, pos_weight = n_neg / n_pos and the balanced class weights n / (2 n_c)."""
    c = df.groupBy(*by).agg(F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"))
    n = F.col("n_pos") + F.col("n_neg")
    return c.select(*by, "n_pos", "n_neg", E.ratio("n_neg", "n_pos").alias("pos_weight"),
                    E.ratio(n, 2 * F.col("n_pos")).alias("w_pos"), E.ratio(n, 2 * F.col("n_neg")).alias("w_neg"))


def split_report(split: DataFrame, labels: DataFrame, key: str = "key", label: str = "y", site: str = "site") -> DataFrame:
    """Per fold and role: size, class counts, smallest stratum, prevalence, pos_weight."""
    cells = split.join(labels.select(key, label, site), key).groupBy("fold", "role", site, label).agg(
        F.count(F.lit(1)).alias("c"))
    g = cells.groupBy("fold", "role").agg(
        F.sum("c").alias("n"), F.sum(F.when(F.col(label) == 1, F.col("c")).otherwise(0)).alias("n_pos"),
        F.sum(F.when(F.col(label) == 0, F.col("c")).otherwise(0)).alias("n_neg"), F.min("c").alias("smallest_stratum"))
    return g.withColumn("prevalence", F.col("n_pos") / F.col("n")).withColumn("pos_weight", E.ratio("n_neg", "n_pos"))


def assign_rows_to_split(df: DataFrame, split: DataFrame, key: str = "key") -> DataFrame:
    """Rows joined to the frozen long split: one copy per fold with its role."""
    return df.join(split, key)
