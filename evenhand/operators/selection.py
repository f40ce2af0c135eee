"""Feature ranking, redundancy and pruning."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenhand.operators.core import same_keys
from evenhand.operators.metrics import weighted_auc


def within_site_auc_rank(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean over sites of |AUC - 1/2| per feature, ranked from the best; ties to the smaller feature."""
    a = weighted_auc(long, "y", "value", by=[*by, "site", "feature"])
    g = a.groupBy(*by, "feature").agg(F.avg(F.abs(F.col("auc") - 0.5)).alias("score"))
    w = W.partitionBy(*by).orderBy(F.round("score", 12).desc(), "feature")
    return g.withColumn("rank", F.row_number().over(w))


def anova_f(long: DataFrame, by: Sequence[str] = (), label: str = "y") -> DataFrame:
    """One-way F per feature: between-class mean square over pooled variance; 0 where the pooled variance is 0."""
    keys = [*by, "feature"]
    c = long.where("value IS NOT NULL").groupBy(*keys, label).agg(F.count("value").alias("n"), F.avg("value").alias("m"),
                                                                F.var_pop("value").alias("v"))
    w = W.partitionBy(*keys)  # one row per class
    c = c.withColumn("_g", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    g = c.groupBy(*keys).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("_g"), 2)).alias("_b"), F.sum(F.col("n") * F.col("v")).alias("_w"),
                             F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    pooled = F.col("_w") / (F.col("n") - F.col("k"))
    return g.select(*keys, F.when(pooled > 0, F.col("_b") / (F.col("k") - 1) / pooled).otherwise(0.0).alias("f"))


def abs_corr_matrix(vectors: DataFrame, features: str, by: Sequence[str] = ()) -> DataFrame:
    """|Pearson r| of every feature pair i < j, per group.

    Tasks stream their rows through a small matrix product and emit one partial cross-product row per feature;
    partial rows are summed by key. Neither rows nor the matrix pass through the driver. Values are centred
    first (by the group's means) so the sums are stable; zero variance gives 0.
    """
    pos = vectors.select(*by, F.posexplode(features).alias("p", "v")).groupBy(*by, "p").agg(F.avg("v").alias("m"))
    centre = pos.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "m"))), lambda x: x["m"]).alias("_c"))
    if by:
        d = same_keys(vectors.select(*by, F.col(features).alias("_f")), centre, by)
    else:
        d = vectors.select(F.col(features).alias("_f")).withColumn("_c", centre.scalar())
    group = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    d = d.select(group.alias("g"), F.zip_with("_f", "_c", lambda x, c: x - c).alias("x"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows arrive sorted by group, so one matrix is held at a time
        now, m = None, None
        for pdf in batches:
            for g, part in pdf.groupby("g", sort=True):
                if now is not None and g != now:
                    yield pd.DataFrame({"g": now, "i": np.arange(len(m)), "row": list(m)})
                    m = None
                x = np.stack(part["x"].to_numpy())
                now, m = g, x.T @ x if m is None else m + x.T @ x
        if m is not None:
            yield pd.DataFrame({"g": now, "i": np.arange(len(m)), "row": list(m)})

    rows = d.sortWithinPartitions("g").mapInPandas(partial, "g string, i int, row array<double>")
    cell = rows.select("g", "i", F.posexplode("row").alias("j", "v")).where("j >= i").groupBy("g", "i", "j").agg(F.sum("v").alias("v"))
    diag = cell.where("i = j").select("g", F.col("i").alias("k"), F.col("v").alias("s"))
    c = cell.where("i < j").join(diag.select("g", F.col("k").alias("i"), F.col("s").alias("si")), ["g", "i"]).join(
        diag.select("g", F.col("k").alias("j"), F.col("s").alias("sj")), ["g", "j"])
    r = F.when((F.col("si") > 0) & (F.col("sj") > 0), F.least(F.lit(1.0), F.abs(F.col("v")) / F.sqrt(F.col("si") * F.col("sj")))).otherwise(0.0)
    out = c.select("g", "i", "j", r.alias("r"))
    if not by:
        return out.drop("g")
    names = vectors.select(*by).distinct().withColumn("g", group)
    return out.join(names, "g").select(*by, "i", "j", "r")


def corr_prune_topk(ranked: DataFrame, corr: DataFrame, by: Sequence[str] = (), limit: float = 0.9, kmax: int = 25) -> DataFrame:
    """Walk the ranking and skip a feature correlated above ``limit`` with a kept one; stop at ``kmax`` (0 keeps all).

    ``ranked`` has feature and rank, ``corr`` the pairs i < j. Only pairs above the limit travel, one group per
    fold, sized by the number of features. Any k is the prefix of ``position``.
    """
    if kmax == 0:
        return ranked.select(*by, "feature", F.col("rank").alias("position"))
    hot = corr.where(F.col("r") > limit)
    both = hot.select(*by, F.col("i").alias("feature"), F.col("j").alias("other")).unionByName(
        hot.select(*by, F.col("j").alias("feature"), F.col("i").alias("other")))
    clash = both.groupBy(*by, "feature").agg(F.collect_list("other").alias("clash"))
    rows = same_keys(ranked.select(*by, "feature", "rank"), clash, [*by, "feature"], "left")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        taken: set = set()
        for f, bad in pdf.sort_values("rank")[["feature", "clash"]].itertuples(index=False):
            if len(kept) >= kmax:
                break
            if bad is not None and not taken.isdisjoint(bad):
                continue
            kept.append(f)
            taken.add(f)
        head = {c: pdf[c].iloc[0] for c in by}
        return pd.DataFrame({**head, "feature": kept, "position": range(1, len(kept) + 1)})

    schema = ", ".join([*[f"{c} {ranked.schema[c].dataType.simpleString()}" for c in by], f"feature {ranked.schema['feature'].dataType.simpleString()}", "position int"])
    return rows.groupBy(*by).applyInPandas(walk, schema)


def mrmr_rank(f: DataFrame, corr: DataFrame, by: Sequence[str] = (), k: int = 10) -> DataFrame:
    """Greedy relevance minus mean redundancy; ties to the lowest feature. Audit columns per step.

    Works on fitted summaries: one row per feature and one per pair, a group per fold.
    """
    both = corr.select(*by, F.col("i").alias("feature"), F.struct(F.col("j").alias("o"), "r").alias("p")).unionByName(
        corr.select(*by, F.col("j").alias("feature"), F.struct(F.col("i").alias("o"), "r").alias("p")))
    near = both.groupBy(*by, "feature").agg(F.collect_list("p").alias("p")).select(
        *by, "feature", F.transform("p", lambda x: x["o"]).alias("others"), F.transform("p", lambda x: x["r"]).alias("rs"))
    rows = same_keys(f.select(*by, "feature", "f"), near, [*by, "feature"], "left")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("feature").reset_index(drop=True)
        feats = pdf["feature"].to_numpy()
        where = {v: i for i, v in enumerate(feats)}
        rel = pdf["f"].to_numpy(float)
        red = np.zeros(len(feats))
        free = np.ones(len(feats), bool)
        out = []
        for step in range(1, min(k, len(feats)) + 1):
            score = np.where(free, rel - (red / (step - 1) if step > 1 else 0.0), -np.inf)
            best = int(score.argmax())
            out.append((feats[best], step, rel[best], red[best] / (step - 1) if step > 1 else None, score[best]))
            free[best] = False
            if pdf["others"][best] is not None:
                np.add.at(red, [where[o] for o in pdf["others"][best]], pdf["rs"][best])
        head = {c: pdf[c].iloc[0] for c in by}
        return pd.DataFrame(out, columns=["feature", "position", "relevance", "redundancy", "score"]).assign(**head)

    schema = ", ".join([*[f"{c} {f.schema[c].dataType.simpleString()}" for c in by],
                        f"feature {f.schema['feature'].dataType.simpleString()}, position int, relevance double, redundancy double, score double"])
    return rows.groupBy(*by).applyInPandas(lambda pdf: greedy(pdf)[[*by, "feature", "position", "relevance", "redundancy", "score"]], schema)
