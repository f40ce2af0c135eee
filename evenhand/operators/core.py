"""Grouped ranking without a hot task.

A window over ``partitionBy(site)`` puts a whole site in one task. The operators here fold equal values
together where they can, cut the rows into ranges of (group, value, ties) with Spark's range partitioning, run the window
inside each range, and take the offsets from a second, small window over the range totals. One plan serves
every size, type and tie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenhand.session import cut_lineage


def same_keys(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, NULL keys included, keeping one copy of the keys (those of ``a``)."""
    renamed = b.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in b.columns])
    cond = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return a.join(renamed, cond, how).drop(*[f"_r_{c}" for c in on])


def attach_stats(df: DataFrame, by: Sequence[str], *aggs: Column) -> DataFrame:
    """Group aggregates joined back to every row.

    The aggregate is combined map-side, so a hot group costs one row per task; the join back is broadcast
    by AQE when the measured size allows and otherwise split by its skew handling. A window over the group
    would instead sort the whole group in one task.
    """
    if not by:
        one = df.agg(*aggs)
        packed = one.select(F.struct(*one.columns)).scalar()
        return df.withColumn("_stats", packed).select(*df.columns, "_stats.*")
    return same_keys(df, df.groupBy(*by).agg(*aggs), by)


def running_totals(df: DataFrame, by: Sequence[str], order: str, sums: Sequence[str],
                   descending: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """Inclusive running sums ``cum_<c>`` and group totals ``tot_<c>`` along ``order`` within ``by``.

    Rows must be unique in (by, order, ties), as after a collapse to distinct values. ``order`` and ``ties`` may be of any
    type that sorts; NULL counts as the smallest.
    """
    asc = lambda c: F.col(c).asc_nulls_first()
    key = F.col(order).desc_nulls_last() if descending else asc(order)
    names = df.columns
    # Cells are ranges of (by, order, ties), written once so that totals and rows see the same cuts.
    celled = df.repartitionByRange(*[asc(c) for c in by], key, *[asc(c) for c in ties]).withColumn("_cell", F.spark_partition_id())
    celled = cut_lineage(celled)
    totals = celled.groupBy(*by, "_cell").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    whole = W.partitionBy(*by)
    before = whole.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*by, "_cell",
                           *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums],
                           *[F.sum(f"_t_{c}").over(whole).alias(f"tot_{c}") for c in sums])
    run = W.partitionBy(*by, "_cell").orderBy(key, *[asc(c) for c in ties]).rowsBetween(W.unboundedPreceding, 0)
    out = same_keys(celled, totals, [*by, "_cell"])
    return out.select(*names, *[(F.col(f"_o_{c}") + F.sum(c).over(run)).alias(f"cum_{c}") for c in sums],
                      *[f"tot_{c}" for c in sums])


def row_numbers(df: DataFrame, by: Sequence[str], order: str, ties: Sequence[str] = (),
                descending: bool = False, out: str = "rn", total: str | None = None) -> DataFrame:
    """1-based position within ``by``; ``ties`` must make the order total."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    num = running_totals(one, by, order, ["_one"], descending, ties)
    keep = [F.col("cum__one").alias(out)] + ([F.col("tot__one").alias(total)] if total else [])
    return num.select(*df.columns, *keep)


def collapse(df: DataFrame, by: Sequence[str], value: str, **sums: Column) -> DataFrame:
    """One row per distinct value with its sums (a row count ``n`` by default), combined map-side."""
    aggs = [F.sum(c).alias(k) for k, c in sums.items()] or [F.count(F.lit(1)).alias("n")]
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(*aggs)


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float],
              method: str = "linear", counts: str | None = None) -> DataFrame:
    """Exact quantiles per group, one column per entry of ``probs``.

    ``linear`` puts p at position (n-1)p, ``exclusive`` at (n+1)p - 1 (clamped to the ends). NULLs are
    skipped. Positions come from running counts of the distinct values, so no group is held in one
    buffer. ``counts`` names a multiplicity column.
    """
    t = collapse(df, by, value, _q=F.col(counts) if counts else F.lit(1).cast("bigint"))
    t = running_totals(t, by, value, ["_q"])
    aggs, outs = [], []
    for k, p in probs.items():
        pos = (F.col("tot__q") - 1) * p if method == "linear" else (F.col("tot__q") + 1) * p - 1
        if method == "exclusive":
            # the two neighbours are chosen first, so short groups extrapolate as the textbook rule does
            lo = F.greatest(F.lit(0), F.least(F.floor(pos), F.col("tot__q") - 2))
            hi = F.least(lo + 1, F.col("tot__q") - 1)
        else:
            lo, hi = F.floor(pos), F.ceil(pos)
        start = F.col("cum__q") - F.col("_q")
        at = lambda i: F.max(F.when((start <= i) & (i < F.col("cum__q")), F.col(value)))
        aggs += [at(lo).alias(f"_lo_{k}"), at(hi).alias(f"_hi_{k}"), F.max(pos - lo).alias(f"_f_{k}")]
        outs.append((F.col(f"_lo_{k}") + F.col(f"_f_{k}") * (F.col(f"_hi_{k}") - F.col(f"_lo_{k}"))).alias(k))
    return t.groupBy(*by).agg(*aggs).select(*by, *outs)


def median(df: DataFrame, by: Sequence[str], value: str, out: str = "median") -> DataFrame:
    return quantiles(df, by, value, {out: 0.5})
