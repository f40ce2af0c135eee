"""Operator 2: near-duplicate vectors by Euclidean p-stable hashing.

Unit vectors are projected on random Gaussian directions, shifted, and quantised; HASHES numbers make a bucket key, in
TABLES tables. Vectors that share a bucket are compared exactly (cosine in double precision). Equal vectors are
one class with a count from the start. A bucket of more than BLOCK classes is cut into blocks, and every pair of blocks is
a group of its own, so no task holds a hot bucket; links are counted and contracted where they are found, never listed.
A pair that shares several buckets counts in the first table only.

At the limit of cosine 0.98 a table finds a pair with probability 0.51, twelve tables all but 2 in 10,000 of them.

Vectors that are null, empty, zero or hold null or non-finite numbers, and rows without a label, have no link and are
their own component. Vectors of different lengths are never compared. Rows that repeat an id count as separate vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.components import components
from evenhand.session import cut_lineage

COSINE = 0.98
TABLES, HASHES, WIDTH, SEED = 12, 8, 2.0, 11
BLOCK = 1024


def units(rows: list) -> list[np.ndarray | None]:
    """Vectors scaled to length one in double precision; None where there is no direction."""
    out = []
    for x in rows:
        v = None
        if x is not None and len(x) and None not in x:
            v = np.asarray(x, np.float64)
            top = np.abs(v).max()
            v = v / top if np.isfinite(top) and top > 0 else None
            v = None if v is None else v / np.sqrt(v @ v)
        out.append(v)
    return out


def bucket_keys(x: np.ndarray) -> np.ndarray:
    """A 64-bit key of every row in every table."""
    rng = np.random.default_rng([SEED, x.shape[1]])
    a = rng.standard_normal((x.shape[1], TABLES * HASHES))
    b = rng.uniform(0, WIDTH, TABLES * HASHES)
    cell = np.floor((x @ a + b) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(x), TABLES, HASHES)
    odd = rng.integers(1 << 62, size=HASHES).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    key = (cell * odd).sum(axis=2, dtype=np.uint64)
    return (key ^ key >> np.uint64(29)).astype(np.int64)


def found_links(x, y, kx, ky, table: int, same: bool, least: float) -> np.ndarray:
    """Matrix of the pairs at or above the limit that share no bucket of an earlier table."""
    hit = x @ y.T >= least
    if same:
        hit = np.triu(hit, 1)
    i, j = np.nonzero(hit)
    for t in range(table):
        if not len(i):
            break
        new = kx[i, t] != ky[j, t]
        i, j = i[new], j[new]
    out = np.zeros(hit.shape, bool)
    out[i, j] = True
    return out


def link_groups(rows: DataFrame, least: float) -> DataFrame:
    """Per group of a bucket: (cls, links, parent), links weighted by class size, parent the smallest class linked in the group."""

    def one(table, part):
        side, cls, size, unit, keys = part
        x = np.frombuffer(b"".join(unit)).reshape(len(unit), -1)
        k = np.frombuffer(b"".join(keys), np.int64).reshape(len(keys), -1)
        side, cls, size = np.array(side), np.array(cls), np.array(size)
        if (side == 2).all():
            hit = found_links(x, x, k, k, table, True, least)
            left = right = np.arange(len(x))
        else:
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            hit = found_links(x[left], x[right], k[left], k[right], table, False, least)
        links = np.zeros(len(x), np.int64)
        links[left] += hit @ size[right]
        links[right] += size[left] @ hit
        label = np.arange(len(x))
        while True:  # smallest row of each part of the group
            new = label.copy()
            new[left] = np.minimum(new[left], np.where(hit, label[right][None, :], len(x)).min(axis=1, initial=len(x)))
            new[right] = np.minimum(new[right], np.where(hit, label[left][:, None], len(x)).min(axis=0, initial=len(x)))
            new = new[new]
            if (new == label).all():
                break
            label = new
        some = links > 0
        return pa.RecordBatch.from_arrays([pa.array(cls[some]), pa.array(links[some]), pa.array(cls[label[some]])], names=["cls", "links", "parent"])

    def run(batches):
        name, part = None, ([], [], [], [], [])
        for batch in batches:
            groups = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j"))))
            columns = [batch.column(c).to_pylist() for c in ("side", "cls", "size", "unit", "keys")]
            table = batch.column("tab").to_pylist()
            for n, g in enumerate(groups):
                if g != name:
                    if len(part[0]) > 1:
                        yield one(at, part)
                    name, part = g, ([], [], [], [], [])
                at = table[n]
                for own, c in zip(part, columns):
                    own.append(c[n])
        if len(part[0]) > 1:
            yield one(at, part)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side", "cls")
    return dealt.mapInArrow(run, "cls long, links long, parent long")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = COSINE) -> DataFrame:
    """(key, n_links, component_id, kept), one row per input row."""

    def prepare(batches):
        for batch in batches:
            made = units(batch.column("_v").to_pylist())
            ok = [v is not None for v in made]
            by_size: dict[int, list[int]] = {}
            for n, v in enumerate(made):
                if v is not None:
                    by_size.setdefault(len(v), []).append(n)
            keys: list[bytes | None] = [None] * len(made)
            for own in by_size.values():
                for n, k in zip(own, bucket_keys(np.stack([made[n] for n in own]))):
                    keys[n] = k.tobytes()
            unit = [v.tobytes() if o else None for v, o in zip(made, ok)]
            yield pa.RecordBatch.from_arrays([batch.column("_k"), batch.column("_l"), pa.array(unit, pa.binary()), pa.array(keys, pa.binary())],
                                             names=["_k", "_l", "unit", "keys"])

    src = df.select(F.col(key).cast("long").alias("_k"), F.col(label).cast("string").alias("_l"), F.col(vector).alias("_v"))
    rows = cut_lineage(src.mapInArrow(prepare, "_k long, _l string, unit binary, keys binary")
                       .withColumn("cls", F.when(F.col("_l").isNotNull() & F.col("unit").isNotNull(), F.xxhash64("_l", "unit"))))
    classes = cut_lineage(rows.where("cls is not null").groupBy("cls").agg(
        F.count(F.lit(1)).alias("size"), F.min("_k").alias("first"), F.first("_l").alias("_l"), F.first("unit").alias("unit"), F.first("keys").alias("keys")))
    tables = F.sequence(F.lit(0), F.lit(TABLES - 1))
    key_of = lambda t: F.substring("keys", F.lit(1) + 8 * t, F.lit(8))
    each = classes.select("cls", F.explode(F.transform(tables, lambda t: F.struct(t.cast("int").alias("tab"), F.xxhash64("_l", F.length("unit"), t, key_of(t)).alias("bucket")))).alias("_b")).select("cls", "_b.*")
    sizes = each.groupBy("bucket", "tab").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("bucket").alias("_bucket"), "n")
    full = cut_lineage(each.join(sizes, F.col("bucket") == F.col("_bucket")).drop("_bucket"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls", F.lit(5)), F.col("blocks")).cast("int")
    cut = full.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("cls", "tab", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"))
    rich = cut.join(classes.select(F.col("cls").alias("_cls"), "size", "unit", "keys"), F.col("cls") == F.col("_cls")).drop("_cls")
    linked = cut_lineage(link_groups(rich, least))
    names = classes.select(F.col("cls").alias("_cls"), "first")
    edges = linked.where("cls <> parent").select("cls", "parent").distinct()
    edges = edges.join(names, F.col("cls") == F.col("_cls")).select(F.col("first").alias("a"), "parent").join(names, F.col("parent") == F.col("_cls")).select("a", F.col("first").alias("b"))
    parts = components(edges)
    totals = linked.groupBy("cls").agg(F.sum("links").alias("links")).select(F.col("cls").alias("_cls"), "links")
    result = classes.select("cls", "size", "first").join(totals, F.col("cls") == F.col("_cls"), "left").drop("_cls")
    result = result.join(parts, F.col("first") == F.col("node"), "left").select(
        F.col("cls").alias("_cls"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).cast("long").alias("_n"), F.coalesce("component", "first").alias("_c"))
    out = rows.select("_k", "cls").join(result, F.col("cls") == F.col("_cls"), "left")
    return out.select(F.col("_k").alias(key), F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_c", "_k").alias("component_id")).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
