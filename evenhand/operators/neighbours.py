"""Nearest neighbours by a random-projection index: work and rows grow with the data, not with its square.

Rows meet in buckets of equal signs under random projections, in several tables. A bucket of more than ``bucket_rows`` rows, however it came
about, is put in order along one more projection and cut into blocks; a block meets itself and the next one. Distances of what meets
are exact, so a neighbour found is reported with its true distance; what the index misses is measured by ``recall``.
``joins.nearest_neighbours`` is the exact mode: it compares blocks until none can hold a nearer row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.functions import expr as E
from evenhand.operators.core import row_numbers, same_keys
from evenhand.session import cut_lineage


def vectors(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _codes(centre: np.ndarray, tables: int, bits: int, seed: int):
    """(table, code, place, row) of every row: the signs of ``bits`` projections and the value of one more."""

    def run(batches):
        rng = np.random.default_rng(seed)
        planes = rng.normal(size=(tables, len(centre), bits + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = vectors(batch.column("f"), batch.num_rows) - centre
            for t in range(tables):
                p = x @ planes[t]
                code = (p[:, :bits] > 0) @ (np.int64(1) << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(code), pa.array(p[:, bits]), batch.column("_row")],
                                                 names=["table", "code", "place", "_row"])

    return run


def _meet(group: pa.Table) -> pa.Table:
    """Each row's nearest partner of its own site and of another one, among the rows of a block and those of the next."""
    n = group.num_rows
    x, guest = vectors(group.column("f").combine_chunks(), n), group.column("guest").to_numpy()
    key, site = (np.asarray(group.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices) for c in ("key", "site"))
    square = (x * x).sum(1)
    d = square[:, None] + square - 2.0 * (x @ x.T)
    d[(key[:, None] == key) | (guest[:, None] & guest)] = np.inf
    same, out = site[:, None] == site, {}
    for name, mask in (("within", same), ("across", ~same)):
        e = np.where(mask, d, np.inf)
        j = e.argmin(1)
        dist = np.sqrt(((x - x[j]) ** 2).sum(1))
        none = ~np.isfinite(e[np.arange(n), j])
        other = group.column("key").take(pa.array(j, mask=none)).combine_chunks()
        out |= {f"nn_{name}": other, f"d_{name}": pa.array(dist, mask=none)}
    return pa.table({"_row": group.column("_row").combine_chunks(), **out})


def indexed_neighbours(df: DataFrame, key: str, site: str, features: str, tables: int = 12, bucket_rows: int = 1000, seed: int = 1) -> DataFrame:
    """(key, site, nn_within, d_within, nn_across, d_across): nearest row of the same site and of another one that the index finds.

    Keys may be of any type that sorts; rows of one key do not count as neighbours. Rows without a complete vector have no neighbours.
    Nothing found is NULL, as for the only row of a site.
    """
    rows = df.select(F.col(key).alias("key"), F.col(site).alias("site"), F.col(features).cast("array<double>").alias("f"))
    rows = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    whole = rows.where(F.col("f").isNotNull() & ~F.exists("f", lambda v: v.isNull() | F.isnan(v)))
    centre = whole.select(F.posexplode("f").alias("p", "v")).groupBy("p").agg(F.avg("v").alias("m")).toPandas().sort_values("p")["m"].to_numpy()
    bits = max(0, math.ceil(math.log2(max(whole.count(), 1) / bucket_rows)))
    codes = whole.select("f", "_row").mapInArrow(_codes(centre, tables, bits, seed), "table int, code long, place double, _row long")
    placed = row_numbers(codes, ["table", "code"], "place", ["_row"], out="_at", total="_n")
    placed = placed.withColumn("block", F.floor((F.col("_at") - 1) / bucket_rows))
    # a block is its own host, and the guest of the one before it
    visits = F.explode(F.when(F.col("block") > 0, F.array(F.struct(F.col("block").alias("host"), F.lit(False).alias("guest")), F.struct((F.col("block") - 1).alias("host"), F.lit(True).alias("guest"))))
                       .otherwise(F.array(F.struct(F.col("block").alias("host"), F.lit(False).alias("guest")))))
    placed = placed.select("table", "code", "_row", visits.alias("v")).select("table", "code", "_row", "v.host", "v.guest")
    kind = rows.schema["key"].dataType.simpleString()
    met = placed.join(whole, "_row").groupBy("table", "code", "host").applyInArrow(
        _meet, f"_row long, nn_within {kind}, d_within double, nn_across {kind}, d_across double")
    best = lambda c: F.min(F.when(F.col(f"d_{c}").isNotNull(), F.struct(F.col(f"d_{c}").alias("d"), F.col(f"nn_{c}").alias("o")))).alias(c)
    found = met.groupBy("_row").agg(best("within"), best("across"))
    return rows.drop("f").join(found, "_row", "left").select("key", "site", F.col("within.o").alias("nn_within"), F.col("within.d").alias("d_within"),
                                                             F.col("across.o").alias("nn_across"), F.col("across.d").alias("d_across"))


def recall(df: DataFrame, found: DataFrame, key: str, site: str, features: str, sample: int = 500, seed: int = 1) -> DataFrame:
    """(side, n, n_found, recall): how many of ``sample`` rows, chosen by the hash of their key, have their true nearest neighbour in ``found``.

    The sample is of bounded size and goes to every task, which compares it with its own rows: one scan of the data.
    """
    rows = df.select(F.col(key).alias("key"), F.col(site).alias("site"), F.col(features).cast("array<double>").alias("f")).where(
        F.col("f").isNotNull() & ~F.exists("f", lambda v: v.isNull() | F.isnan(v)))
    asked = rows.orderBy(E.hash_order(seed, F.col("key").cast("string")), "key").limit(sample).toArrow()
    if not asked.num_rows:
        return found.sparkSession.createDataFrame([], "side string, n long, n_found long, recall double")
    table = found.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        mine = table.value
        x = vectors(mine.column("f").combine_chunks(), mine.num_rows)
        keys, sites = mine.column("key").to_pylist(), mine.column("site").to_pylist()
        best = np.full((2, len(x)), np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            y = vectors(batch.column("f"), batch.num_rows)
            other, place = batch.column("key").to_pylist(), batch.column("site").to_pylist()
            for i in range(len(x)):
                d = ((y - x[i]) ** 2).sum(1)
                d[np.fromiter((k == keys[i] for k in other), bool, len(other))] = np.inf
                near = np.fromiter((s == sites[i] for s in place), bool, len(place))
                best[0, i] = min(best[0, i], np.where(near, d, np.inf).min())
                best[1, i] = min(best[1, i], np.where(near, np.inf, d).min())
        for side, b in zip(("within", "across"), np.sqrt(best)):
            yield pa.RecordBatch.from_arrays([pa.array([side] * len(x)), mine.column("key").combine_chunks(), pa.array(b)], names=["side", "key", "d"])

    kind = rows.schema["key"].dataType.simpleString()
    truth = rows.mapInArrow(run, f"side string, key {kind}, d double").groupBy("side", "key").agg(F.min("d").alias("d")).where(F.col("d") < float("inf"))
    seen = found.select("key", F.expr("stack(2, 'within', d_within, 'across', d_across) AS (side, _d)"))
    both = same_keys(truth, seen.groupBy("side", "key").agg(F.min("_d").alias("_d")), ["side", "key"], "left")
    hit = F.coalesce(F.col("_d") <= F.col("d") * (1 + 1e-9) + 1e-9, F.lit(False)).cast("int")
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("n_found"), F.avg(hit).alias("recall"))
