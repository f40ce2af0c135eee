"""Bootstrap intervals.

Replicates are vectors of counts: a task draws for a block of a stratum and every row carries how often each replicate holds
it (``weightings``). The rows are then sorted once, whatever the number of replicates. Stratum sizes are exact and draws deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.functions import expr as E
from evenhand.operators.core import attach_stats, row_numbers, same_keys
from evenhand.operators.metrics import rank_areas
from evenhand.operators.weightings import replicate_counts, vector_areas
from evenhand.session import cut_lineage


def draws(df: DataFrame, strata: Sequence[str], key: str, b: int, seed: int) -> DataFrame:
    """``df`` once per draw with its replicate ``b``: for use where a replicate's rows themselves are wanted.

    The one wide step is the join of draws to positions; it is a plain equi-join on the strata columns (NULL equal to NULL) and
    the position, so a base small enough is broadcast and a large one is hashed evenly, positions being unique.
    Rows are spread before they multiply, or a small base would draw all replicates in one task.
    """
    spark = df.sparkSession
    named = F.to_json(F.struct(*strata), {"ignoreNullFields": "false"}) if strata else F.lit("all")
    pos = row_numbers(df.withColumn("_k", E.hash_order("order", key)), strata, "_k", [key], out="_j", total="_n").drop("_k")
    pos = cut_lineage(pos)
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = pos.select(*strata, "_n", "_j").withColumn("_s", named).repartition(spread, "_j").withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(b))))
    drawn = drawn.select(*strata, "b", (E.hash_order(seed, "b", "_s", "_j") % F.col("_n") + 1).alias("_j"))
    return same_keys(drawn, pos.drop("_n"), [*strata, "_j"]).drop("_j")


def _both(a: str, c: str) -> Column:
    return F.array(F.struct(F.lit("a").alias("model"), F.col(a).alias("score")), F.struct(F.lit("c").alias("model"), F.col(c).alias("score")))


def percentiles(values: DataFrame, by: Sequence[str], value: str, names: dict[str, float]) -> DataFrame:
    """Exact percentiles of replicate values, of which a group has one per replicate."""
    return values.groupBy(*by).agg(*[F.percentile(value, p).alias(name) for name, p in names.items()])


INTERVAL = {"lo": 0.025, "median": 0.5, "hi": 0.975}


def stratified_bootstrap(df: DataFrame, b: int = 2000, seed: int = 1, key: str = "key", y: str = "y", s: str = "score",
                         site: str = "site") -> DataFrame:
    """(b, auc): replicate values of the site-balanced AUC, resampling within site x label."""
    # stratum sizes are unchanged by the draw, so a drawn row weighs one over its stratum's size
    base = attach_stats(df.select(key, F.col(site).alias("site"), F.col(y).alias("y"), F.col(s).alias("score")), ["site", "y"], (1 / F.count(F.lit(1))).alias("w"))
    return vector_areas(replicate_counts(base, ["site", "y"], key, b, seed), [], b).select("b", "auc")


def stratified_bootstrap_ci(df: DataFrame, **kw) -> DataFrame:
    return percentiles(stratified_bootstrap(df, **kw), [], "auc", INTERVAL)


def class_bootstrap_ci(df: DataFrame, b: int = 2000, seed: int = 1, key: str = "key", y: str = "y", s: str = "score") -> DataFrame:
    """Percentile interval of the plain AUC, resampling within each class."""
    base = df.select(key, F.col(y).alias("y"), F.col(s).alias("score"), F.lit(1.0).alias("w"))
    return percentiles(vector_areas(replicate_counts(base, ["y"], key, b, seed), [], b), [], "auc", INTERVAL)


def paired_bootstrap(df: DataFrame, a: str, c: str, strata: Sequence[str] = (), b: int = 2000, seed: int = 1,
                     key: str = "key", y: str = "y", site: str = "site") -> DataFrame:
    """Per replicate: difference a - c in ROC and PR area, both scores on the same drawn rows.

    With ``strata`` the draw keeps the size of each stratum (the per-cohort form).
    """
    counts = replicate_counts(df.select(*dict.fromkeys([key, y, a, c, *strata])), strata, key, b, seed)
    long = counts.select("chunk", "counts", F.col(y).alias("y"), F.lit(1.0).alias("w"), F.explode(_both(a, c)).alias("x")).select("chunk", "counts", "y", "w", "x.*")
    both = vector_areas(long, ["model"], b, pr=True)
    pick = lambda m, v: F.max(F.when(F.col("model") == m, F.col(v)))
    return both.groupBy("b").agg((pick("a", "auc") - pick("c", "auc")).alias("d_roc"),
                                 F.when(pick("a", "auc").isNotNull(), pick("a", "pr_auc") - pick("c", "pr_auc")).alias("d_pr"))


def paired_bootstrap_summary(df: DataFrame, a: str, c: str, **kw) -> DataFrame:
    """Observed difference beside the replicates' mean, median, sd, interval, share above zero; skipped counted."""
    y = kw.get("y", "y")
    reps = paired_bootstrap(df, a, c, **kw).unpivot(["b"], ["d_roc", "d_pr"], "metric", "value")
    ok = F.col("value").isNotNull()
    mom = reps.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count_if(~ok).alias("n_skipped"),
                                     F.avg(F.when(ok, (F.col("value") > 0).cast("int"))).alias("share_above"),
                                     *[F.percentile("value", p).alias(name) for name, p in INTERVAL.items()])
    m = rank_areas(df.select(y, F.explode(_both(a, c)).alias("x")).select(y, "x.*"), y, "score", by=["model"])
    sign = F.when(F.col("model") == "a", 1.0).otherwise(-1.0)
    obs = m.agg(F.sum(sign * F.col("auc")).alias("d_roc"), F.sum(sign * F.col("pr_auc")).alias("d_pr"))
    obs = obs.unpivot([], ["d_roc", "d_pr"], "metric", "observed")
    return same_keys(obs, mom, ["metric"]).withColumn("includes_zero", (F.col("lo") <= 0) & (F.col("hi") >= 0))
