"""Curves and metrics. Every curve starts from a collapse to distinct scores, then running totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.functions import expr as E
from evenhand.operators.core import collapse, running_totals, same_keys
from evenhand.session import cut_lineage


def _class_mass(df: DataFrame, by, y, s, w) -> DataFrame:
    weight = E.col(w).cast("double") if w else F.lit(1.0)
    return collapse(df.where(F.col(y).isNotNull()), by, s,
                    w1=F.when(F.col(y) == 1, weight).otherwise(0.0), w0=F.when(F.col(y) == 0, weight).otherwise(0.0))


def _areas_from_mass(mass: DataFrame, by, s) -> DataFrame:
    """ROC and PR areas from one ascending pass: the counts above a score are totals less what lies below it."""
    run = running_totals(mass, by, s, ["w0", "w1"])
    wins = F.sum(F.col("w1") * (F.col("cum_w0") - 0.5 * F.col("w0")))
    tp, fp = F.col("tot_w1") - F.col("cum_w1") + F.col("w1"), F.col("tot_w0") - F.col("cum_w0") + F.col("w0")
    ap = F.sum(F.when(F.col("w1") > 0, F.col("w1") / F.col("tot_w1") * tp / (tp + fp)).otherwise(F.when(F.col("tot_w1") > 0, 0.0)))
    return run.groupBy(*by).agg(E.ratio(wins, F.sum("w1") * F.sum("w0")).alias("auc"), ap.alias("pr_auc"))


def _auc_from_mass(mass: DataFrame, by, s) -> DataFrame:
    run = running_totals(mass, by, s, ["w0"])
    wins = F.sum(F.col("w1") * (F.col("cum_w0") - 0.5 * F.col("w0")))
    return run.groupBy(*by).agg(E.ratio(wins, F.sum("w1") * F.sum("w0")).alias("auc"))


def weighted_auc(df: DataFrame, y: str = "y", s: str = "score", w: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Weighted Mann-Whitney AUC with half-ties; NULL when a group holds one class."""
    return _auc_from_mass(_class_mass(df, by, y, s, w), by, s)


def rank_areas(df: DataFrame, y: str = "y", s: str = "score", w: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``auc`` and ``pr_auc`` (average precision) together, from one sort of the distinct scores."""
    return _areas_from_mass(_class_mass(df, by, y, s, w), by, s)


def site_balanced_auc(df: DataFrame, y: str = "y", s: str = "score", site: str = "site", by: Sequence[str] = ()) -> DataFrame:
    """AUC in which every site x label stratum carries the same total weight.

    Rows are folded to (by, site, y, score) counts first, so the weights are attached to distinct scores.
    """
    folded = collapse(df.where(F.col(y).isNotNull()), [*by, site, y], s)
    strata = folded.groupBy(*by, site, y).agg(F.sum("n").alias("_ns"))
    unit = same_keys(folded, strata, [*by, site, y]).withColumn("_w", F.col("n") / F.col("_ns"))
    out = _auc_from_mass(_class_mass(unit, by, y, s, "_w"), by, s)
    return out.withColumnRenamed("auc", "sb_auc")


def auc_by_group(df: DataFrame, group: str, y: str = "y", s: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Per group: n, positives and AUC (NULL where a group has one class)."""
    keys = [*by, group]
    run = running_totals(_class_mass(df, keys, y, s, None), keys, s, ["w0"])
    wins = F.sum(F.col("w1") * (F.col("cum_w0") - 0.5 * F.col("w0")))
    return run.groupBy(*keys).agg(F.sum(F.col("w0") + F.col("w1")).cast("bigint").alias("n"), F.sum("w1").cast("bigint").alias("n_pos"),
                                  E.ratio(wins, F.sum("w1") * F.sum("w0")).alias("auc"))


def mean_group_auc(df: DataFrame, group: str, y: str = "y", s: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Mean of the group AUCs over groups that hold both classes."""
    g = auc_by_group(df, group, y, s, by)
    return g.groupBy(*by).agg(F.avg("auc").alias("mean_auc"), F.count("auc").alias("n_groups"))


def cumulative_counts(df: DataFrame, y: str = "y", s: str = "score", w: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp and the class totals at each distinct threshold, highest first."""
    run = running_totals(_class_mass(df, by, y, s, w), by, s, ["w1", "w0"], descending=True)
    return run.select(*by, F.col(s).alias("threshold"), F.col("cum_w1").alias("tp"), F.col("cum_w0").alias("fp"),
                      F.col("tot_w1").alias("pos"), F.col("tot_w0").alias("neg"), F.col("w1").alias("d_tp"))


def pr_auc(df: DataFrame, y: str = "y", s: str = "score", w: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Average precision: precision at each distinct threshold times the recall it adds."""
    return rank_areas(df, y, s, w, by).drop("auc")


def roc_points(df: DataFrame, y: str = "y", s: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """threshold, fpr, tpr, from (0, 0) at a NULL threshold upwards."""
    c = cumulative_counts(df, y, s, by=by)
    pts = c.select(*by, "threshold", E.ratio("fp", "neg").alias("fpr"), E.ratio("tp", "pos").alias("tpr"))
    start = c.select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"),
                     F.lit(0.0).alias("tpr")).distinct()
    return pts.unionByName(start)


def pr_points(df: DataFrame, y: str = "y", s: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """threshold, recall, precision, closed by (0, 1) at a NULL threshold."""
    c = cumulative_counts(df, y, s, by=by)
    pts = c.select(*by, "threshold", E.ratio("tp", "pos").alias("recall"),
                   (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))
    end = c.select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("recall"),
                   F.lit(1.0).alias("precision")).distinct()
    return pts.unionByName(end)


def confusion(df: DataFrame, score: str, threshold, y: str = "y", by: Sequence[str] = (), w: str | None = None,
              strict: bool = False) -> DataFrame:
    """tp, fp, tn, fn (weighted when ``w``) at a fixed threshold or a per-row threshold column."""
    thr = F.col(threshold) if isinstance(threshold, str) else E.col(threshold) if isinstance(threshold, Column) else F.lit(threshold)
    hit = F.col(score) > thr if strict else F.col(score) >= thr
    unit = F.col(w) if w else F.lit(1).cast("bigint")
    zero = F.lit(0.0) if w else F.lit(0).cast("bigint")
    count = lambda cond, name: F.sum(F.when(cond, unit).otherwise(zero)).alias(name)
    pos, neg = F.col(y) == 1, F.col(y) == 0
    return df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(*by).agg(
        count(hit & pos, "tp"), count(hit & neg, "fp"), count(~hit & neg, "tn"), count(~hit & pos, "fn"))


def rates(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rates from tp, fp, tn, fn. Undefined sensitivity or specificity is NULL, undefined precision 0, MCC NULL."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    sens, spec = E.ratio(tp, tp + fn), E.ratio(tn, tn + fp)
    prec = F.coalesce(E.ratio(tp, tp + fp), F.lit(0.0))
    out = conf.select(
        *by, "tp", "fp", "tn", "fn", sens.alias("sensitivity"), spec.alias("specificity"), prec.alias("precision"),
        E.ratio(tn, tn + fn).alias("npv"),
        F.coalesce(E.ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
        E.ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        E.ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"))
    bal = F.when(F.col("sensitivity").isNull(), F.col("specificity")).when(
        F.col("specificity").isNull(), F.col("sensitivity")).otherwise((F.col("sensitivity") + F.col("specificity")) / 2)
    return out.withColumn("balanced_accuracy", bal)


def threshold_metrics(df: DataFrame, score: str = "score", threshold=0.5, y: str = "y", by: Sequence[str] = (),
                      w: str | None = None, strict: bool = False) -> DataFrame:
    return rates(confusion(df, score, threshold, y, by, w, strict), by)


def brier(df: DataFrame, p: str = "p", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))


def calibration(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Slope of y on logit(p) (barely regularised logistic) and the intercept with the slope held at one."""
    folded = fold_logits(df, p, y)
    slope, _ = line_logistic(folded, c=1e6)
    _, intercept = line_logistic(folded, slope=1.0)
    # one row of fitted state, attached to the row count of the frame it was fitted on
    return folded.agg(F.sum("n").cast("bigint").alias("n")).select("n", F.lit(slope).alias("slope"), F.lit(intercept).alias("intercept"))


def fold_logits(df: DataFrame, p: str, y: str, eps: float = 1e-6) -> DataFrame:
    """Distinct logits with their row and positive counts, materialised for the iterations that follow."""
    g = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(E.logit(p, eps).alias("z"))
    return cut_lineage(g.agg(F.sum(y).cast("double").alias("w1"), F.count(F.lit(1)).cast("double").alias("n")))


def line_logistic(folded: DataFrame, c: float | None = None, slope: float | None = None, steps: int = 60) -> tuple[float, float]:
    """(slope, intercept) of a one-feature logistic by Newton steps, each trial one aggregate over the folded rows.

    ``c`` penalises the slope by slope^2 / (2 c); a given ``slope`` is held fixed and only the intercept moves,
    within [-20, 20]. A step that does not lower the loss is halved: whole ones may swing or run off. Six sums come back per trial.
    """
    pen = 0.0 if c is None or slope is not None else 1.0 / c

    def sums(a, b):
        t = F.lit(a) * F.col("z") + F.lit(b)
        m = E.sigmoid(t)
        g, h = F.col("w1") - F.col("n") * m, F.col("n") * m * (1 - m)
        loss = F.col("n") * (F.greatest(t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(t)))) - F.col("w1") * t
        r = folded.agg(F.sum(loss), F.sum(g), F.sum(g * F.col("z")), F.sum(h), F.sum(h * F.col("z")), F.sum(h * F.col("z") * F.col("z"))).first()
        return (float(r[0]) + pen * a * a / 2, *(float(v) for v in r[1:]))

    a, b = (1.0 if slope is None else slope), 0.0
    now = sums(a, b)
    for _ in range(steps):
        loss, gb, ga, hbb, hab, haa = now
        if slope is not None:
            da, db = 0.0, gb / max(hbb, 1e-12)
        else:
            ga, haa = ga - pen * a, haa + pen
            det = max(haa * hbb - hab * hab, 1e-300)
            da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size, share = max(abs(da), abs(db)), 1.0
        if size < 1e-10:
            break
        while share * size >= 1e-10:
            to = a + share * da, max(-20.0, min(20.0, b + share * db))
            now = sums(*to)
            if now[0] <= loss + 1e-13 * abs(loss):
                break
            share /= 2
        else:
            break
        if to == (a, b):
            break
        a, b = to
    return a, b


def fold_metrics(oof: DataFrame, by: Sequence[str], y: str = "y", s: str = "score", threshold=0.5) -> DataFrame:
    """AUC, PR-AUC, Brier and threshold metrics for every group of ``by`` at once."""
    out = same_keys(rank_areas(oof, y, s, by=by), brier(oof, s, y, by), by)
    return same_keys(out, threshold_metrics(oof, s, threshold, y, by), by)


def model_differences(metrics: DataFrame, a: str, b: str, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per metric: mean of a - b over groups, and in how many groups a is better."""
    long = metrics.unpivot(["model", *by], list(names), "metric", "value")
    side = lambda m, c: long.where(F.col("model") == m).select(*by, "metric", F.col("value").alias(c))
    pair = same_keys(side(a, "va"), side(b, "vb"), [*by, "metric"])
    diff = F.col("va") - F.col("vb")
    return pair.groupBy("metric").agg(F.avg(diff).alias("mean_diff"), F.min(diff).alias("min_diff"),
                                      F.max(diff).alias("max_diff"), F.count_if(diff > 0).alias("n_better"))


def dice(df: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """2|A and B| / (|A| + |B|) of two boolean marks; both empty counts as 1. Also hit flags."""
    one = lambda c: F.count_if(c)
    both, na, nb = one(F.col(a) & F.col(b)), one(F.col(a)), one(F.col(b))
    g = df.groupBy(*by).agg(both.alias("n_both"), na.alias("n_a"), nb.alias("n_b"))
    return g.withColumn("dice", F.coalesce(E.ratio(2 * F.col("n_both"), F.col("n_a") + F.col("n_b")), F.lit(1.0))) \
        .withColumn("hit", F.col("n_both") > 0)


def label_agreement(df: DataFrame, a: str, b: str, thr: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows two models put on the same side of the threshold."""
    return df.groupBy(*by).agg(F.avg(((F.col(a) >= thr) == (F.col(b) >= thr)).cast("int")).alias("agreement"))


def select_threshold(df: DataFrame, y: str = "y", s: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """The observed score maximising balanced accuracy; ties go to the one nearest 0.5."""
    c = cumulative_counts(df, y, s, by=by)
    rate = lambda a: F.coalesce(a, F.lit(0.0))
    c = c.withColumn("balanced_accuracy", (rate(E.ratio("tp", "pos")) + rate(1 - E.ratio("fp", "neg"))) / 2)
    best = F.max_by(F.struct("threshold", "balanced_accuracy"),
                    F.struct(F.round("balanced_accuracy", 12), -F.abs(F.col("threshold") - 0.5), -F.col("threshold")))
    return c.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")
