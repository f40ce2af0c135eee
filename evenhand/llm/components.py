"""Connected components of an edge table by alternating star contractions, without any table of all nodes in one place."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.session import cut_lineage


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its part) of the graph of the given edges."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def contract(edges: DataFrame) -> DataFrame:
    """Every task's edges replaced by the forest of bounded pieces of them; components stay."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                u, v = forest(batch.column("u").to_numpy(), batch.column("v").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, a: str = "a", b: str = "b", node: str = "node", component: str = "component") -> DataFrame:
    """(node, component) of every node of the edges that is not the smallest of its component.

    ``a`` and ``b`` are longs; loops, repeated edges and null ends have no effect. The number of rounds grows with the
    logarithm of the longest chain; each round is written to the checkpoint folder.
    """
    src = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where((F.col(a) != F.col(b)))
    now = cut_lineage(contract(src).distinct())
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(now)
    while seen[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        large = cut_lineage(large)
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), "m")
        small = large.join(low, F.col("u") == F.col("_u")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = cut_lineage(small.select("e.u", "e.v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        before, seen = seen, mark(after)
        now = after
        if seen == before:
            break
    return now.select(F.col("u").alias(node), F.col("v").alias(component))
