"""Nested model search over many splits at once.

A slot is one outer split (a fold of a seed, or a site held out), a context one training part of it: all of it, or what an inner fold leaves.
The rows are written once, each with its inner fold in every slot; no context has rows of its own. Every step is one scan for
all contexts and candidates:

- moments and cross-products per (slot, inner fold, site, class), of which the parts of all contexts are sums;
- within-site AUCs of all features, each column sorted once, with the contexts as weightings (``weightings``);
- a Newton step of every fit: tasks add up normal equations per (context, candidate), groups of them are solved in tasks,
  and only coefficients reach the driver;
- all scores.

Boosted trees grow one after the other, so each of their fits has a task of its own, which takes its binned rows block by block.

State is bounded by contexts, sites and features, not by rows; its size is checked before it is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenhand.functions import expr as E
from evenhand.operators import harmonise as H
from evenhand.operators import trees as T
from evenhand.operators.core import attach_stats, same_keys
from evenhand.operators.metrics import auc_by_group, confusion, site_balanced_auc, weighted_auc
from evenhand.operators.resample import percentiles
from evenhand.operators.splits import inner_kfold, leave_one_site_out, repeated_kfold, strata_weights
from evenhand.operators.weightings import WIDTH, pack, replicate_counts, vector_areas
from evenhand.operators.windows import argmax_tie, zscore_within
from evenhand.session import cut_lineage

LIMIT = 1 << 28  # bytes of state that may be broadcast
LANDMARKS = 64  # of a kernel machine
STRIP = 1_024  # rows whose designs are held at a time
SPAN = 1 << 18  # test rows of a context beyond which its scores are ranked in ranges
SMALL = 1e-3  # slack below which the hinge is taken as quadratic
# Most Newton steps of a fit, and the gain, as a share of the objective, at which it ends.
STEPS = {"svm": 40, "logistic": 30}
TOLERANCE = {"svm": 1e-5, "logistic": 1e-9}
# Fits of many rows set out from those of a share of them, if that has so many rows; where they end is decided on all rows alone.
FEW = 15_000
SHARES = (512, 64, 8)


# ---- slots --------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Plan:
    """Rows (key, site, y, x, v) with the inner fold in every slot (-1: tested there, -2: no part in it), and the names of the slots."""

    rows: DataFrame
    slots: list[dict]
    inner: int

    def contexts(self) -> int:
        return len(self.slots) * (self.inner + 1)


def parts(v: np.ndarray, slot: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Training and test rows of a context; i = -1 is the whole outer training part."""
    own = v[:, slot]
    return (own >= 0, own == -1) if i < 0 else ((own >= 0) & (own != i), own == i)


def _plan(wide: DataFrame, split: DataFrame, slots: list[dict], inner: int, base_seed: int, features: str) -> Plan:
    labels = wide.select("key", "site", "y")
    low = inner_kfold(split, labels, "key", ["site", "y"], inner, base_seed)
    own = F.map_from_entries(F.collect_list(F.struct(F.col("fold").cast("int"), F.col("inner_fold").cast("int"))))
    v = low.groupBy("key").agg(own.alias("_m")).select("key", F.transform(F.sequence(F.lit(0), F.lit(len(slots) - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(-2))).alias("v"))
    rows = wide.select("key", "site", F.col("y").cast("int").alias("y"), F.col(features).alias("x")).join(v, "key")
    return Plan(cut_lineage(rows.repartition(int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions")))), slots, inner)


def pooled_plan(wide: DataFrame, seeds: Sequence[int] = (1, 2, 3, 4, 5), k: int = 5, inner: int = 3, base_seed: int = 100, features: str = "features") -> Plan:
    """Repeated stratified folds on site x label; inner folds inside every training part."""
    split = repeated_kfold(wide.select("key", "site", "y"), "key", ["site", "y"], k, seeds)
    at = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(seeds) for x in (s, i * k)]), F.col("seed"))
    split = split.select((at + F.col("fold")).alias("fold"), "key", "role")
    return _plan(wide, split, [{"seed": s, "fold": f} for s in seeds for f in range(k)], inner, base_seed, features)


def held_out_plan(wide: DataFrame, seeds: Sequence[int] = (1, 2, 3, 4, 5), inner: int = 3, base_seed: int = 100, features: str = "features") -> Plan:
    """Every site held out in turn; seeds draw the inner folds. The list of sites is the one thing that passes the driver."""
    split = leave_one_site_out(wide.select("key", "site"))
    sites = [r[0] for r in wide.select("site").distinct().orderBy("site").collect()]
    at = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(sites) for x in (s, i * len(seeds))]), F.col("held_out"))
    split = split.withColumn("_d", F.explode(F.array(*[F.lit(i) for i in range(len(seeds))]))).select((at + F.col("_d")).alias("fold"), "key", "role")
    return _plan(wide, split, [{"held_out": s, "seed": d} for s in sites for d in seeds], inner, base_seed, features)


def transport_plan(wide: DataFrame, pairs: Sequence[tuple] | None = None, seeds: Sequence[int] = (1,), inner: int = 3, base_seed: int = 100, features: str = "features") -> Plan:
    """Slots that train on one site and are scored on another: the given (source, target) pairs, or all ordered ones."""
    if pairs is None:
        sites = [r[0] for r in wide.select("site").distinct().orderBy("site").collect()]
        pairs = [(a, b) for a in sites for b in sites if a != b]
    slots = [{"source": a, "target": b, "seed": d} for a, b in pairs for d in seeds]
    roles = F.array(*[F.struct(F.lit(i).alias("fold"), F.lit(s["source"]).alias("a"), F.lit(s["target"]).alias("b")) for i, s in enumerate(slots)])
    split = wide.select("key", "site", F.explode(roles).alias("r")).where((F.col("site") == F.col("r.a")) | (F.col("site") == F.col("r.b")))
    split = split.select("r.fold", "key", F.when(F.col("site") == F.col("r.a"), "train").otherwise("test").alias("role"))
    return _plan(wide, split, slots, inner, base_seed, features)


def locked_plan(dev: DataFrame, new: DataFrame, inner: int = 3, base_seed: int = 100, features: str = "features") -> Plan:
    """One slot: all of ``dev`` trains, the unlabelled rows of ``new`` are scored once and take part through their own moments only."""
    rows = dev.select("key", "site", "y", features, F.lit("train").alias("_role")).unionByName(new.select("key", "site", F.lit(0).alias("y"), features, F.lit("test").alias("_role")))
    split = rows.select(F.lit(0).alias("fold"), "key", F.col("_role").alias("role"))
    return _plan(rows.drop("_role"), split, [{"fold": 0}], inner, base_seed, features)


# ---- what the training parts need ---------------------------------------------------------------------------
@dataclass
class Prepared:
    """Fitted state of every context as arrays: value -> (value or fill) * mul + add, the order of the features kept, the weights."""

    inner: int
    sites: dict
    fill: np.ndarray
    mul: np.ndarray
    add: np.ndarray
    full: list
    order: list
    weight: np.ndarray
    lifts: dict = field(default_factory=dict)
    bins: dict = field(default_factory=dict)  # per context the columns boosted trees may take, and the bins of their cells

    def size(self) -> int:
        own = sum(a.nbytes for a in (self.fill, self.mul, self.add, self.weight)) + sum(t.points.nbytes + t.map.nbytes for t in self.lifts.values())
        return own + sum(table.nbytes for _, table in self.bins.values())

    def z(self, ctx: int, x: np.ndarray, site: np.ndarray) -> np.ndarray:
        gone = np.isnan(x)
        z = np.take(self.mul[ctx], site, axis=0)
        z *= np.where(gone, self.fill[ctx], x) if gone.any() else x
        z += np.take(self.add[ctx], site, axis=0)
        return z

    def columns(self, ctx: int, k: int) -> np.ndarray:
        return self.full[ctx] if k == 0 else self.order[ctx][:k]


def read(batch: pa.RecordBatch, sites: dict | None = None):
    """(x, site, y, v) of a batch of rows as arrays; a missing value is NaN."""
    n = batch.num_rows
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    v = batch.column("v").flatten().to_numpy().reshape(n, -1)
    site = batch.column("site").to_pylist()
    y = batch.column("y").to_numpy(zero_copy_only=False)
    return x, (np.array([sites[s] for s in site], np.int64) if sites is not None else site), y, v


def strips(batch: pa.RecordBatch, sites: dict):
    """``read`` of a batch in strips of at most STRIP rows, whose matrices stay in the cache of a core."""
    if batch.num_rows:
        x, site, y, v = read(batch, sites)
        for at in range(0, len(x), STRIP):
            yield x[at: at + STRIP], site[at: at + STRIP], y[at: at + STRIP], v[at: at + STRIP]


def _cells(inner: int, shift: np.ndarray, holes: np.ndarray):
    """Per (slot, inner fold, site, class): rows, sums and cross-products of values (missing as 0) and of marks of missing ones."""

    def run(batches):
        sums: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, site, y, v = read(batch)
            gone = np.isnan(x)
            a = np.concatenate([np.ones((len(x), 1)), np.where(gone, 0.0, x - shift), gone[:, holes]], axis=1)
            strata: dict = {}
            for i, k in enumerate(zip(site, y.tolist())):
                strata.setdefault(k, []).append(i)
            for (s, c), rows in strata.items():
                part, own = a[rows], v[rows]
                for slot in range(v.shape[1]):
                    for i in range(-1, inner):
                        pick = part[own[:, slot] == i]
                        if len(pick):
                            key = (slot, i, s, c)
                            g = pick.T @ pick
                            sums[key] = sums[key] + g if key in sums else g
        keys = list(sums)
        yield pa.RecordBatch.from_pydict({"slot": pa.array([k[0] for k in keys], pa.int32()), "i": pa.array([k[1] for k in keys], pa.int32()),
                                          "site": pa.array([k[2] for k in keys], pa.string()), "y": pa.array([k[3] for k in keys], pa.int32()),
                                          "gram": pa.array([sums[k].tobytes() for k in keys], pa.binary())})

    return run


def _add(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b) for b in group.column("gram").to_pylist())
    return group.slice(0, 1).select(["slot", "i", "site", "y"]).append_column("gram", pa.array([total.tobytes()], pa.binary()))


def _moments(inner: int, shift: np.ndarray, holes: np.ndarray):
    """Cells of ``harmonise.fit_state`` of the contexts of a slot."""
    p = len(shift)

    def run(group: pa.Table) -> pa.Table:
        out: dict = {c: [] for c in ("ctx", "role", "site", "y", "feature", "n", "m", "v", "nm")}
        cells: dict = {}
        for r in group.to_pylist():
            d = 1 + p + len(holes)
            cells[r["i"], r["site"], r["y"]] = np.frombuffer(r["gram"]).reshape(d, d)
        slot = group.column("slot")[0].as_py()
        for i in range(-1, inner):
            for role, folds in (("train", [j for j in range(inner) if j != i]), ("test", [i])):
                for s, c in sorted({k[1:] for k in cells}, key=str):
                    have = [cells[j, s, c] for j in folds if (j, s, c) in cells]
                    if not have:
                        continue
                    g = sum(have)
                    nm = np.zeros(p)
                    nm[holes] = g[0, 1 + p:]
                    n = g[0, 0] - nm
                    with np.errstate(all="ignore"):
                        m = g[0, 1: 1 + p] / n
                        v = np.maximum(np.diag(g)[1: 1 + p] / n - m * m, 0.0)
                    rows = {"ctx": [slot * (inner + 1) + i + 1] * p, "role": [role] * p, "site": [s] * p, "y": [c] * p, "feature": list(range(p)),
                            "n": n.astype(np.int64).tolist(), "m": [None if k == 0 else float(x) for k, x in zip(n, m + shift)],
                            "v": [None if k == 0 else float(x) for k, x in zip(n, v)], "nm": nm.astype(np.int64).tolist()}
                    for k in out:
                        out[k] += rows[k]
        kinds = {"ctx": pa.int32(), "role": pa.string(), "site": pa.string(), "y": pa.int32(), "feature": pa.int32(), "n": pa.int64(), "m": pa.float64(), "v": pa.float64(), "nm": pa.int64()}
        return pa.table({k: pa.array(x, kinds[k]) for k, x in out.items()})

    return run


def _members(inner: int, size: int):
    """The row once per chunk of ``size`` contexts with 1 where the context trains on it."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            m = np.stack([parts(v, s, i)[0] for s in range(v.shape[1]) for i in range(-1, inner)], axis=1)
            for c in range(0, m.shape[1], size):
                part = np.zeros((len(m), size), np.uint8)
                part[:, : m.shape[1] - c] = m[:, c: c + size]
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in ("site", "y", "x")] + [pa.array(np.full(len(m), c // size, np.int32)), pack(part)],
                                                 names=["site", "y", "x", "chunk", "counts"])

    return run


def _one(size: int):
    """A cell that counts in one context only."""

    def run(batches):
        for batch in batches:
            m = np.zeros((batch.num_rows, size), np.uint8)
            m[np.arange(len(m)), batch.column("ctx").to_numpy() % size] = 1
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in ("site", "feature", "chunk", "score", "y", "w")] + [pack(m)],
                                             names=["site", "feature", "chunk", "score", "y", "w", "counts"])

    return run


def _walk_order(inner: int, shift: np.ndarray, holes: np.ndarray, limit: float, kmax: int):
    """Per context the features in rank order, without those correlated above ``limit`` with one kept before."""
    p = len(shift)

    def run(cells: pa.Table, fitted: pa.Table) -> pa.Table:
        grams: dict = {}
        d = 1 + p + len(holes)
        for r in cells.to_pylist():
            key = r["i"], r["site"]
            grams[key] = grams.get(key, 0) + np.frombuffer(r["gram"]).reshape(d, d)
        state = fitted.to_pandas()
        out = []
        for ctx, part in state.groupby("ctx"):
            i = ctx % (inner + 1) - 1
            total = np.zeros((p, p))
            for s, rows in part.groupby("site", dropna=False):
                s = None if s is None or s != s else s
                have = [grams[j, s] for j in range(inner) if j != i and (j, s) in grams]
                if not have:
                    continue
                mul, add, fill, f = np.zeros(p), np.zeros(p), np.zeros(p), rows["feature"].to_numpy()
                mul[f], add[f], fill[f] = rows["mul"], rows["add"], rows["fill"]
                # z = mul * (value - shift) + mul * (fill - shift) * missing + (add + mul * shift)
                lift = np.zeros((p, d))
                lift[:, 0] = add + mul * shift
                lift[:, 1: 1 + p] = np.diag(mul)
                lift[holes, 1 + p + np.arange(len(holes))] = (mul * (fill - shift))[holes]
                total += lift @ sum(have) @ lift.T
            sd = np.sqrt(np.maximum(np.diag(total), 1e-300))
            ranked = part.drop_duplicates("feature").sort_values("rank")["feature"].to_numpy()
            kept: list = []
            for f in ranked:
                if len(kept) >= kmax:
                    break
                if kept and np.max(np.abs(total[f, kept]) / (sd[f] * sd[kept])) > limit:
                    continue
                kept.append(int(f))
            out.append((int(ctx), kept))
        return pa.table({"ctx": pa.array([c for c, _ in out], pa.int32()), "kept": pa.array([k for _, k in out], pa.list_(pa.int32()))})

    return run


def prepare(plan: Plan, harm: str = "combat", limit: float = 0.9, kmax: int = 50, missing: float = 0.2, ranked: bool = True) -> Prepared:
    """Fitted preprocessing, weights and, where ``ranked``, the feature order of every context."""
    rows, inner = plan.rows, plan.inner
    st = rows.select(F.posexplode("x").alias("p", "value")).groupBy("p").agg(F.avg("value").alias("m"), F.count_if(F.col("value").isNull()).alias("gone")).toPandas().sort_values("p")
    shift, holes = st["m"].fillna(0.0).to_numpy(), np.flatnonzero(st["gone"].to_numpy() > 0)
    cells = rows.mapInArrow(_cells(inner, shift, holes), "slot int, i int, site string, y int, gram binary")
    cells = cut_lineage(cells.groupBy("slot", "i", "site", "y").applyInArrow(_add, "slot int, i int, site string, y int, gram binary"))
    kinds = "ctx int, role string, site string, y int, feature int, n long, m double, v double, nm long"
    moments = cut_lineage(cells.groupBy("slot").applyInArrow(_moments(inner, shift, holes), kinds))
    medians = moments.select("ctx", "feature").distinct().withColumn("fill", F.lit(0.0))
    if len(holes):
        medians = same_keys(medians.drop("fill"), H.median_fit(_missing_long(plan, holes), ["ctx"]), ["ctx", "feature"], "left").fillna(0.0, ["fill"])
    state = H.state_from_cells(moments, cut_lineage(medians), ["ctx"], harm, missing=missing)
    state = cut_lineage(state.select("ctx", "site", "feature", "fill", "mul", "add"))
    order = None
    if ranked:
        rank = _ranks(plan, moments, state, bool(len(holes)))
        fitted = same_keys(state, rank, ["ctx", "feature"]).withColumn("slot", F.floor(F.col("ctx") / (inner + 1)).cast("int"))
        order = cells.groupBy("slot").cogroup(fitted.groupBy("slot")).applyInArrow(_walk_order(inner, shift, holes, limit, kmax), "ctx int, kept array<int>").toPandas()
    counts = moments.where("role = 'train' AND feature = 0").select("ctx", "site", "y", (F.col("n") + F.col("nm")).alias("n")).toPandas()
    return _arrays(plan, len(shift), state.toPandas(), order, counts)


def _missing_long(plan: Plan, holes: np.ndarray) -> DataFrame:
    """Training values of the features that miss some, per context."""
    pairs = F.explode(F.sequence(F.lit(0), F.lit(plan.contexts() - 1)))
    d = plan.rows.select("v", F.explode(F.array(*[F.struct(F.lit(int(h)).alias("feature"), F.col("x")[int(h)].alias("value")) for h in holes])).alias("c"))
    d = d.select("v", "c.*").withColumn("ctx", pairs)
    own, i = F.element_at("v", (F.floor(F.col("ctx") / (plan.inner + 1)) + 1).cast("int")), F.col("ctx") % (plan.inner + 1) - 1
    return d.where((own >= 0) & (own != i)).select("ctx", "feature", "value")


def _ranks(plan: Plan, moments: DataFrame, state: DataFrame, some_missing: bool) -> DataFrame:
    """(ctx, feature, rank): mean over sites of |AUC - 1/2| on the training rows, ties to the smaller feature.

    Within a site all steps after the median are one rising line, so the raw values rank as the prepared ones do.
    """
    size = min(WIDTH, plan.contexts())
    cells = plan.rows.mapInArrow(_members(plan.inner, size), "site string, y int, x array<double>, chunk int, counts binary")
    cells = cells.select("site", F.posexplode("x").alias("feature", "score"), "chunk", "y", F.lit(1.0).alias("w"), "counts")
    if some_missing:
        filled = same_keys(moments.where("role = 'train' AND nm > 0"), state.groupBy("ctx", "feature").agg(F.first("fill").alias("fill")), ["ctx", "feature"])
        filled = filled.select("site", "feature", F.floor(F.col("ctx") / size).cast("int").alias("chunk"), F.col("fill").alias("score"), "y", F.col("nm").cast("double").alias("w"), "ctx")
        cells = cells.unionByName(filled.mapInArrow(_one(size), "site string, feature int, chunk int, score double, y int, w double, counts binary"))
    auc = vector_areas(cells, ["site", "feature"], plan.contexts(), size=size)
    score = auc.groupBy((F.col("b") - 1).alias("ctx"), "feature").agg(F.avg(F.abs(F.col("auc") - 0.5)).alias("score"))
    kept = score.join(state.select("ctx", "feature").distinct(), ["ctx", "feature"], "left_semi")
    return kept.select("ctx", "feature", F.row_number().over(W.partitionBy("ctx").orderBy(F.round("score", 12).desc(), "feature")).alias("rank"))


def _arrays(plan: Plan, p: int, state, order, counts) -> Prepared:
    names = sorted({s for s in state["site"].tolist() + counts["site"].tolist()}, key=lambda s: (s is not None, s or ""))
    sites, c = {s: i for i, s in enumerate(names)}, plan.contexts()
    if c * len(sites) * p * 24 > LIMIT:
        raise ValueError(f"{c} contexts, {len(sites)} sites and {p} features are too many for one state")
    fill, mul, add = np.zeros((c, p)), np.zeros((c, len(sites), p)), np.zeros((c, len(sites), p))
    ctx, s, f = state["ctx"].to_numpy(), state["site"].map(sites).to_numpy() if None not in sites else np.array([sites[x] for x in state["site"]]), state["feature"].to_numpy()
    fill[ctx, f], mul[ctx, s, f], add[ctx, s, f] = state["fill"], state["mul"], state["add"]
    full: list = [np.zeros(0, np.int64)] * c
    for k, part in state.groupby("ctx"):
        full[k] = np.array(sorted(set(part["feature"])), np.int64)
    kept: list = [np.zeros(0, np.int64)] * c
    if order is not None:
        for k, row in zip(order["ctx"], order["kept"]):
            kept[k] = np.array(row, np.int64)
    weight = np.zeros((c, len(sites), 2))
    for k, part in counts.groupby("ctx"):
        n = part["n"].to_numpy(float)
        weight[k, [sites[x] for x in part["site"]], part["y"].to_numpy()] = n.sum() / (len(n) * n)
    return Prepared(plan.inner, sites, fill, mul, add, full, kept, weight)


# ---- kernel features ----------------------------------------------------------------------------------------
def _nearest_hashes(inner: int, m: int):
    """The m training rows of every context with the smallest hashes, of a batch."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            at = np.argsort(batch.column("h").to_numpy(), kind="stable")
            ctx, row = [], []
            for s in range(v.shape[1]):
                for i in range(-1, inner):
                    pick = at[parts(v, s, i)[0][at]][:m]
                    ctx.append(np.full(len(pick), s * (inner + 1) + i + 1, np.int32))
                    row.append(pick)
            take = batch.select(["site", "x", "h"]).take(pa.array(np.concatenate(row)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ctx)), *take.columns], names=["ctx", "site", "x", "h"])

    return run


def add_lifts(plan: Plan, made: Prepared, ks: Sequence[int], m: int = LANDMARKS, seed: int = 1) -> None:
    """Kernel features of the k best columns of every context through ``m`` of its training rows, those with the smallest hashes of their keys.

    The prepared values have variance 1, so the width of the kernel is 1 over their number.
    """
    if plan.contexts() * m * (sum(ks) + len(ks) * m) * 8 > LIMIT:
        raise ValueError("too many landmarks for one state")
    rows = plan.rows.select("site", "x", "v", E.hash_order(seed, "key").alias("h"))
    few = rows.mapInArrow(_nearest_hashes(plan.inner, m), "ctx int, site string, x array<double>, h long")
    best = few.withColumn("_n", F.row_number().over(W.partitionBy("ctx").orderBy("h"))).where(F.col("_n") <= m)
    for ctx, part in best.toPandas().groupby("ctx"):
        part = part.sort_values("h")
        x = np.array([[np.nan if e is None else e for e in r] for r in part["x"]], np.float64)
        z = made.z(ctx, x, np.array([made.sites[s] for s in part["site"]]))
        for k in ks:
            cols = made.columns(ctx, k)
            made.lifts[ctx, k] = Lift(z[:, cols], 1.0 / max(len(cols), 1))


def kernel(x: np.ndarray, points: np.ndarray, gamma: float) -> np.ndarray:
    d = (2 * x) @ points.T
    d -= np.einsum("ij,ij->i", x, x)[:, None]
    d -= (points * points).sum(1)
    np.minimum(d, 0.0, out=d)
    d *= gamma
    return np.exp(d, out=d)


class Lift:
    """Nystroem features: inner products equal the kernel between rows and landmarks, and its best fit through them elsewhere."""

    def __init__(self, points: np.ndarray, gamma: float):
        self.points, self.gamma = points, gamma
        values, vectors = np.linalg.eigh(kernel(points, points, gamma))
        keep = values > 1e-10 * max(values.max(initial=0.0), 1e-300)
        self.map = vectors[:, keep] / np.sqrt(values[keep])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return kernel(x, self.points, self.gamma) @ self.map


# ---- bins ---------------------------------------------------------------------------------------------------
def _cell_counts(shared, columns: dict):
    """Training rows of a task per (context, column, cell)."""

    def run(batches):
        made, sums = shared.value, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, site, _, v = read(batch, made.sites)
            for ctx, cols in columns.items():
                slot, i = divmod(ctx, made.inner + 1)
                rows = np.flatnonzero(parts(v, slot, i - 1)[0])
                if len(rows):
                    sums[ctx] = sums.get(ctx, 0) + T.count_cells(made.z(ctx, x[rows], site[rows])[:, cols])
        yield pa.RecordBatch.from_pydict({"ctx": pa.array(list(sums), pa.int32()), "counts": pa.array([c.tobytes() for c in sums.values()], pa.binary())})

    return run


def _tables(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, np.int64) for b in group.column("counts").to_pylist())
    return pa.table({"ctx": group.column("ctx")[:1], "bins": pa.array([T.bins_of_cells(total.reshape(-1, T.CELLS)).tobytes()], pa.binary())})


def add_bins(plan: Plan, made: Prepared, ks: Sequence[int]) -> None:
    """Bins of the k best columns of every context, quantiles of all its training rows."""
    if not ks:
        return
    columns = {c: np.unique(np.concatenate([made.columns(c, k) for k in ks])) for c in range(plan.contexts())}
    columns = {c: cols for c, cols in columns.items() if len(cols)}
    if made.size() + sum(map(len, columns.values())) * T.CELLS > LIMIT:
        raise ValueError("too many columns to be binned for one state")
    shared = plan.rows.sparkSession.sparkContext.broadcast(made)
    counts = plan.rows.select("x", "site", "y", "v").mapInArrow(_cell_counts(shared, columns), "ctx int, counts binary")
    for ctx, table in counts.groupBy("ctx").applyInArrow(_tables, "ctx int, bins binary").toPandas().itertuples(index=False):
        made.bins[int(ctx)] = columns[ctx], np.frombuffer(table, np.uint8).reshape(-1, T.CELLS)
    shared.unpersist()


# ---- fits ---------------------------------------------------------------------------------------------------
class Designs:
    """Design matrices of a context, each built once: the k best columns, all columns, or kernel features of the k best; bins for boosted trees."""

    def __init__(self, made: Prepared, ctx: int, z: np.ndarray):
        self.made, self.ctx, self.z, self.known = made, ctx, z, {}

    def of(self, kind: str, k: int) -> np.ndarray:
        key = (kind == "svm", k)
        if key not in self.known:
            x = self.z[:, self.made.columns(self.ctx, k)]
            if kind == "svm":
                x = self.made.lifts[self.ctx, k](x)
            a = np.empty((len(x), x.shape[1] + 1))
            a[:, :-1], a[:, -1] = x, 1.0
            self.known[key] = a
        return self.known[key]

    def bins(self, k: int) -> np.ndarray:
        cols = self.made.columns(self.ctx, k)
        if not len(cols) or self.ctx not in self.made.bins:
            return np.zeros((0, len(self.z)), np.uint8)
        own, table = self.made.bins[self.ctx]
        return T.to_bins(self.z[:, cols], table[np.searchsorted(own, cols)])

    def score(self, g: dict, model) -> np.ndarray:
        return model(self.bins(g["k"])) if g["kind"] == "gbt" else self.of(g["kind"], g["k"]) @ model


def _terms(kind: str, f: np.ndarray, y: np.ndarray, w: np.ndarray, band: float = 0.0):
    """Loss, gradient and curvature of each row at score f. The hinge is majorised by the parabola that touches it where it is.

    With a ``band`` its curvature is that of a loss over many rows, the density of rows at its edge, and its gradient the exact one.
    """
    if kind == "svm":
        t = 2.0 * y - 1.0
        slack = 1.0 - t * f
        if band:
            return w * np.maximum(slack, 0.0), -w * t * (slack > 0), w * np.maximum(1.0 - np.abs(slack) / band, 0.0) / band
        near = np.maximum(np.abs(slack), SMALL)
        return w * np.maximum(slack, 0.0), -w * t * (slack / (2 * near) + 0.5), w / (2 * near)
    prob = 1.0 / (1.0 + np.exp(-np.clip(f, -500, 500)))
    return w * (np.logaddexp(0.0, f) - y * f), w * (prob - y), np.maximum(w * prob * (1 - prob), 1e-12 * w)


def _normal(shared, betas, grid: list[dict], bands: dict):
    """One scan: loss, gradient and curvature of every open fit, summed in the task. ``bands``: of the fits that have one."""

    def run(batches):
        made, open_fits, sums = shared.value, betas.value, {}
        by_ctx: dict = {}
        for ctx, c in open_fits:
            by_ctx.setdefault(ctx, []).append(c)
        upper = {d: np.triu_indices(d) for d in {len(b) for b in open_fits.values()}}
        room = np.empty(STRIP * max(upper, default=0))
        for x, site, y, v in (strip for batch in batches for strip in strips(batch, made.sites)):
            for ctx, cands in by_ctx.items():
                slot, i = divmod(ctx, made.inner + 1)
                rows = np.flatnonzero(parts(v, slot, i - 1)[0])
                if not len(rows):
                    continue
                designs = Designs(made, ctx, made.z(ctx, x[rows], site[rows]))
                w = made.weight[ctx, site[rows], y[rows]]
                for c in cands:
                    g = grid[c]
                    a = designs.of(g["kind"], g["k"])
                    own = y[rows] if g.get("target") is None else (site[rows] == made.sites[g["target"]]).astype(np.int64)
                    loss, grad, curve = _terms(g["kind"], a @ open_fits[ctx, c], own, np.ones(len(rows)) if g.get("plain") else w, bands.get((ctx, c), 0.0))
                    d = a.shape[1]
                    # a product of a matrix with itself costs half of one with another
                    half = np.multiply(a, np.sqrt(curve)[:, None], out=room[: a.size].reshape(a.shape))
                    made_row = np.concatenate([[loss.sum()], grad @ a, (half.T @ half)[upper[d]]])
                    if (ctx, c) in sums:
                        sums[ctx, c] += made_row
                    else:
                        sums[ctx, c] = made_row
        keys = list(sums)
        yield pa.RecordBatch.from_pydict({"ctx": pa.array([k[0] for k in keys], pa.int32()), "candidate": pa.array([k[1] for k in keys], pa.int32()),
                                          "sums": pa.array([sums[k].tobytes() for k in keys], pa.binary())})

    return run


def descend(h: np.ndarray, g: np.ndarray, beta: np.ndarray, penalty: np.ndarray, sweeps: int = 1000) -> np.ndarray:
    """The step d that lowers g d + d h d / 2 + sum penalty |beta + d| most, by coordinate descent on the Gram matrix h."""
    x, slope, diagonal = beta.copy(), g.copy(), np.diag(h)
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(x)):
            z = x[j] - slope[j] / diagonal[j]
            new = np.sign(z) * max(abs(z) - penalty[j] / diagonal[j], 0.0)
            move = new - x[j]
            if move:
                slope += h[:, j] * move
                x[j] = new
                most = max(most, abs(move))
        if most < 1e-11:
            break
    return x - beta


def _step(betas, grid: list[dict]):
    """Sums of all tasks to the Newton step of each fit; the intercept is free of the penalty."""

    def run(group: pa.Table) -> pa.Table:
        ctx, c = group.column("ctx")[0].as_py(), group.column("candidate")[0].as_py()
        beta, cost = betas.value[ctx, c], grid[c]["setting"]
        s = sum(np.frombuffer(b) for b in group.column("sums").to_pylist()) * cost
        d = len(beta)
        l1 = grid[c].get("l1", 0.0)
        held = np.r_[np.ones(d - 1), 0.0]
        h = np.zeros((d, d))
        h[np.triu_indices(d)] = s[1 + d:]
        h = h + np.triu(h, 1).T + np.diag((1 - l1) * held + 1e-10)
        g = s[1: 1 + d] + (1 - l1) * held * beta
        step = descend(h, g, beta, l1 * held) if l1 else np.linalg.solve(h, -g)
        size = lambda b: l1 * float(np.abs(b[:-1]).sum())
        value = s[0] + 0.5 * (1 - l1) * float(beta[:-1] @ beta[:-1]) + size(beta)
        gain = -float(g @ step) - size(beta + step) + size(beta)
        return pa.table({"ctx": pa.array([ctx], pa.int32()), "candidate": pa.array([c], pa.int32()), "value": [value], "gain": [gain], "step": [step.tobytes()]})

    return run


def fit_all(plan: Plan, made: Prepared, grid: Sequence[dict], shared=None, contexts: Sequence[int] | None = None, steps: dict = STEPS, tolerance: dict = TOLERANCE,
            start: dict | None = None) -> dict:
    """Coefficients of every (context, candidate), intercept last: min (1 - l1) / 2 |b|^2 + l1 |b|_1 + C sum w loss; ``l1`` is 0 unless given.

    One job per Newton step for all fits that are still open; a step that does not lower the objective is halved. They set out from ``start``, by
    default from fits of some rows with the loss scaled up to all, where there are many; the steps on all rows end by the same rule from anywhere. A candidate may
    have a ``target`` (a site told from the others in place of the label) and be ``plain`` (all weights one). Boosted trees are left to ``grow_all``.
    """
    sc, grid = plan.rows.sparkSession.sparkContext, list(grid)
    shared = shared or sc.broadcast(made)
    bands: dict = {}
    if start is None:
        start, n = {}, plan.rows.count()
        for share in (s for s in SHARES if n >= s * FEW):
            few = replace(plan, rows=cut_lineage(plan.rows.where(F.pmod(F.xxhash64("key"), F.lit(share)) == 0)))
            start = fit_all(few, made, [{**g, "setting": g["setting"] * share} for g in grid], shared, contexts, steps, {"svm": 1e-4, "logistic": 1e-4}, start)
        bands = {k: n**-0.2 for k in start if grid[k[1]]["kind"] == "svm"}
    beta = {}
    for ctx in range(plan.contexts()) if contexts is None else contexts:
        designs = Designs(made, ctx, np.zeros((1, made.fill.shape[1])))
        for c, g in enumerate(grid):
            if g["kind"] != "gbt":
                beta[ctx, c] = start[ctx, c] if (ctx, c) in start else np.zeros(designs.of(g["kind"], g["k"]).shape[1])
    memory: dict = {}  # of an open fit: where it stood, its objective there, the step taken and its length
    family = lambda k: "svm" if grid[k[1]]["kind"] == "svm" else "logistic"
    left = {k: steps[family(k)] for k in beta}
    while left:
        now = sc.broadcast({k: beta[k] for k in left})
        sums = plan.rows.select("x", "site", "y", "v").mapInArrow(_normal(shared, now, grid, bands), "ctx int, candidate int, sums binary")
        made_steps = sums.groupBy("ctx", "candidate").applyInArrow(_step(now, grid), "ctx int, candidate int, value double, gain double, step binary").toPandas()
        seen = set()
        for ctx, c, value, gain, raw in made_steps.itertuples(index=False):
            k, step = (int(ctx), int(c)), np.frombuffer(raw)
            seen.add(k)
            left[k] -= 1
            before = memory.get(k)
            near = tolerance[family(k)] * abs(before[1]) if before is not None and k in bands else 0.0
            if near and (before[1] - near < value <= before[1] + 100 * near or value > before[1] and before[3] < 0.1):
                del bands[k], memory[k]  # its rows tell no more: parabolas go on from the better of the two places, and decide the end
                beta[k] = before[0] if value > before[1] else beta[k]
                continue
            if before is not None and value > before[1] + 1e-12 * abs(before[1]) and before[3] > 1e-4:
                memory[k] = (*before[:3], before[3] / 2)
                beta[k] = before[0] + memory[k][3] * before[2]
                continue
            if gain <= tolerance[family(k)] * (1e-6 + abs(value)) or left[k] <= 0:
                left.pop(k)
                beta[k] = beta[k] + step  # so close to the end it can be taken unseen
                continue
            memory[k] = (beta[k], value, step, 1.0)
            beta[k] = beta[k] + step
        left = {k: n for k, n in left.items() if k in seen and n > 0}
        now.unpersist()
    return beta


# ---- boosted trees ------------------------------------------------------------------------------------------
def _pack(shared, units: list):
    """Training rows of a batch as one packed block per unit (context, k)."""

    def run(batches):
        made = shared.value
        by_ctx: dict = {}
        for u, (ctx, k) in enumerate(units):
            by_ctx.setdefault(ctx, []).append((u, k))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, site, y, v = read(batch, made.sites)
            h = batch.column("h").to_numpy().astype(np.uint64).astype(np.uint32)
            for ctx, wanted in by_ctx.items():
                slot, i = divmod(ctx, made.inner + 1)
                rows = np.flatnonzero(parts(v, slot, i - 1)[0])
                if not len(rows):
                    continue
                designs = Designs(made, ctx, made.z(ctx, x[rows], site[rows]))
                signed = (made.weight[ctx, site[rows], y[rows]] * (2 * y[rows] - 1)).astype(np.float32).tobytes()
                n = len(wanted)
                yield pa.RecordBatch.from_pydict({"unit": pa.array([u for u, _ in wanted], pa.int32()), "bins": pa.array([designs.bins(k).tobytes() for _, k in wanted], pa.binary()),
                                                  "signed": pa.array([signed] * n, pa.binary()), "hashes": pa.array([h[rows].tobytes()] * n, pa.binary())})

    return run


def _grow(grid: list[dict], units: list, wanted: dict, options: dict):
    """The models of a unit, one for each of its candidates."""

    def run(batches):
        rows: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                u = batch.column("unit")[i].as_py()
                bins, signed, hashes = (np.frombuffer(batch.column(n)[i].as_buffer(), t) for n, t in (("bins", np.uint8), ("signed", np.float32), ("hashes", np.uint32)))
                rows.setdefault(u, T.Rows()).add(bins.reshape(-1, len(signed)).copy(), signed.copy(), hashes.copy())
        for u, own in rows.items():
            ctx, k = units[u]
            for c in wanted[ctx]:
                if grid[c]["k"] == k:
                    m = T.grow(own, int(grid[c]["setting"]), **options)
                    yield pa.RecordBatch.from_pydict({"ctx": pa.array([ctx], pa.int32()), "candidate": pa.array([c], pa.int32()), "base": [m.base],
                                                      "splits": pa.array([m.splits.tobytes()], pa.binary()), "leaf_values": pa.array([m.values.tobytes()], pa.binary())})

    return run


def grow_all(plan: Plan, made: Prepared, grid: Sequence[dict], shared, wanted: dict, **options) -> dict:
    """Boosted trees of the wanted (context: candidates); the ``setting`` of a candidate is its number of leaves.

    A tree needs the one before, so a task does the fits of one context and k on all its training rows: as bytes, one per column, beyond
    ``trees.ROOM`` in a file of the task. Only the trees reach the driver.
    """
    grid = list(grid)
    wanted = {ctx: [c for c in cands if grid[c]["kind"] == "gbt"] for ctx, cands in wanted.items()}
    # the longest fits first
    units = sorted({(ctx, grid[c]["k"]) for ctx, cands in wanted.items() for c in cands}, key=lambda u: (-len(made.columns(*u)), u))
    if not units:
        return {}
    rows = plan.rows.select("x", "site", "y", "v", E.hash_order(1, "key").alias("h"))
    packed = rows.mapInArrow(_pack(shared, units), "unit int, bins binary, signed binary, hashes binary").repartitionById(len(units), F.col("unit"))
    grown = packed.mapInArrow(_grow(grid, units, wanted, options), "ctx int, candidate int, base double, splits binary, leaf_values binary").toPandas()
    out = {}
    for ctx, c, base, splits, values in grown.itertuples(index=False):
        leaves = int(grid[c]["setting"])
        out[int(ctx), int(c)] = T.Trees(base, np.frombuffer(splits, np.int16).reshape(-1, leaves - 1, 3), np.frombuffer(values).reshape(-1, leaves))
    return out


# ---- scores -------------------------------------------------------------------------------------------------
def _score(shared, betas, grid: list[dict], wanted):
    """Scores of the rows of the wanted (context, roles, candidates)."""

    def run(batches):
        made, coef = shared.value, betas.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, site, y, v = read(batch, made.sites)
            for ctx, roles, cands in wanted:
                slot, i = divmod(ctx, made.inner + 1)
                for role, mask in zip(("train", "test"), parts(v, slot, i - 1)):
                    rows = np.flatnonzero(mask)
                    if role not in roles or not len(rows):
                        continue
                    designs = Designs(made, ctx, made.z(ctx, x[rows], site[rows]))
                    m = np.stack([designs.score(grid[c], coef[ctx, c]) for c in cands], axis=1)
                    own = batch.select(["key", "site", "y"]).take(pa.array(rows))
                    n, k = m.shape
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(m.ravel()))
                    which = pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(np.tile(np.array(cands, np.int32), n)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, ctx, np.int32)), pa.array([role] * n), *own.columns, which, lists],
                                                     names=["ctx", "role", "key", "site", "y", "candidates", "scores"])

    return run


def scores(plan: Plan, shared, beta: dict, grid: Sequence[dict], wanted) -> DataFrame:
    """(ctx, role, key, site, y, candidate, score), one scan for all."""
    coef = plan.rows.sparkSession.sparkContext.broadcast(beta)
    kind = plan.rows.schema["key"].dataType.simpleString()
    out = plan.rows.mapInArrow(_score(shared, coef, list(grid), list(wanted)), f"ctx int, role string, key {kind}, site string, y int, candidates array<int>, scores array<double>")
    out = out.select("ctx", "role", "key", "site", "y", F.explode(F.arrays_zip("candidates", "scores")).alias("s"))
    return out.select("ctx", "role", "key", "site", "y", F.col("s.candidates").alias("candidate"), F.col("s.scores").alias("score"))


def _strips_of_scores(shared, betas, grid: list[dict], contexts, cuts: dict):
    """Scores of the test rows per (context, candidate, range): of a batch the sorted values, the stratum (2 * site + class) of each and how often they stand there."""

    def run(batches):
        made, coef = shared.value, betas.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, site, y, v = read(batch, made.sites)
            code = (2 * site + y).astype(np.int32)
            for ctx in contexts:
                slot, i = divmod(ctx, made.inner + 1)
                rows = np.flatnonzero(parts(v, slot, i - 1)[1])
                if not len(rows):
                    continue
                designs = Designs(made, ctx, made.z(ctx, x[rows], site[rows]))
                out: dict = {n: [] for n in ("candidate", "range", "scores", "strata", "counts")}
                for c, g in enumerate(grid):
                    f = designs.score(g, coef[ctx, c])
                    order = np.argsort(f)
                    value, own, n = f[order], code[rows[order]], None
                    if (value[1:] == value[:-1]).any():  # equal ones move once
                        order = np.lexsort((code[rows], f))
                        value, own = f[order], code[rows[order]]
                        at = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (own[1:] != own[:-1])])
                        value, own, n = value[at], own[at], np.diff(np.r_[at, len(order)]).astype(np.int32)
                    edges = [0, *np.searchsorted(value, cuts.get((ctx, c), ())).tolist(), len(value)]
                    for r, (a, b) in enumerate(zip(edges, edges[1:])):
                        if b > a:
                            for name, held in zip(out, (c, r, value[a:b].tobytes(), own[a:b].tobytes(), None if n is None else n[a:b].tobytes())):
                                out[name].append(held)
                kinds = {"candidate": pa.int32(), "range": pa.int32(), "scores": pa.binary(), "strata": pa.binary(), "counts": pa.binary()}
                yield pa.RecordBatch.from_pydict({"ctx": pa.array([ctx] * len(out["range"]), pa.int32())} | {n: pa.array(a, kinds[n]) for n, a in out.items()})

    return run


def _range_area(weights, grid: list[dict]):
    """Class sums of a range of a (context, candidate) and its area within."""

    def run(group: pa.Table) -> pa.Table:
        made_weight, sites = weights.value
        ctx, c, r = (group.column(n)[0].as_py() for n in ("ctx", "candidate", "range"))
        strips_in = list(zip(*[group.column(n).to_pylist() for n in ("scores", "strata", "counts")]))
        value, own = np.frombuffer(b"".join(a for a, _, _ in strips_in)), np.frombuffer(b"".join(b for _, b, _ in strips_in), np.int32)
        n = np.concatenate([np.ones(len(a) // 8) if k is None else np.frombuffer(k, np.int32) for a, _, k in strips_in])
        target = grid[c].get("target")
        if target is None:
            one, w = (own & 1).astype(bool), made_weight[ctx][own] * n
        else:  # a site told from the others; rows without one take no part
            one, w = own >> 1 == sites[target], np.where(own >> 1 == sites.get(None, -1), 0.0, n)
        order = np.argsort(value, kind="stable")
        value, w1, w0 = value[order], np.where(one, w, 0.0)[order], np.where(one, 0.0, w)[order]
        at = np.flatnonzero(np.r_[True, ~((value[1:] == value[:-1]) | np.isnan(value[1:]) & np.isnan(value[:-1]))])
        w1, w0 = np.add.reduceat(w1, at), np.add.reduceat(w0, at)
        area = float((w1 * (np.cumsum(w0) - 0.5 * w0)).sum())
        return pa.table({"ctx": pa.array([ctx], pa.int32()), "candidate": pa.array([c], pa.int32()), "range": pa.array([r], pa.int32()),
                         "one": [float(w1.sum())], "zero": [float(w0.sum())], "area": [area]})

    return run


def areas_of_tests(plan: Plan, made: Prepared, shared, beta: dict, grid: Sequence[dict], contexts: Sequence[int], span: int = SPAN) -> DataFrame:
    """(ctx, candidate, auc) on the test rows: every site x label stratum of the same weight, or for a candidate with a ``target`` that site from the others.

    Scores move as packed strips, not as rows. A context with more than ``span`` test rows is cut into ranges of scores at the quantiles of
    some rows, which decide the size of the ranges only.
    """
    grid, spark = list(grid), plan.rows.sparkSession
    n = plan.rows.select("site", "y", F.posexplode("v").alias("slot", "i")).where("i >= -1").groupBy("slot", "i", "site", "y").count().collect()
    sizes = np.zeros((plan.contexts(), 2 * len(made.sites)))
    for r in n:
        sizes[r["slot"] * (plan.inner + 1) + r["i"] + 1, 2 * made.sites[r["site"]] + r["y"]] += r["count"]
    cuts: dict = {}
    ranges = -(-int(max(sizes[c].sum() for c in contexts)) // span)
    if ranges > 1:
        few = plan.rows.select("x", "site", "y", "v").sample(min(1.0, 4000 / (plan.rows.count() + 1)), seed=1).limit(4000).toArrow().combine_chunks().to_batches()
        for x, site, _, _ in (strip for batch in few for strip in strips(batch.slice(0, STRIP), made.sites)):
            for ctx in contexts:
                designs = Designs(made, ctx, made.z(ctx, x, site))
                for c, g in enumerate(grid):
                    cuts[ctx, c] = np.unique(np.quantile(designs.score(g, beta[ctx, c]), np.arange(1, ranges) / ranges))
    coef = spark.sparkContext.broadcast({k: b for k, b in beta.items() if k[0] in set(contexts)})
    with np.errstate(divide="ignore"):
        weights = spark.sparkContext.broadcast((np.where(sizes > 0, 1 / sizes, 0.0), made.sites))
    kinds = "ctx int, candidate int, range int, scores binary, strata binary, counts binary"
    packed = plan.rows.select("x", "site", "y", "v").mapInArrow(_strips_of_scores(shared, coef, grid, list(contexts), cuts), kinds)
    each = packed.groupBy("ctx", "candidate", "range").applyInArrow(_range_area(weights, grid), "ctx int, candidate int, range int, one double, zero double, area double")
    below = F.coalesce(F.sum("zero").over(W.partitionBy("ctx", "candidate").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    each = each.withColumn("_wins", F.col("area") + F.col("one") * below)
    return each.groupBy("ctx", "candidate").agg(E.ratio(F.sum("_wins"), F.sum("one") * F.sum("zero")).alias("auc"))


@dataclass
class Search:
    """A finished search: the inner surface, the choice per slot and kind, and the scores of the chosen models."""

    surface: DataFrame
    chosen: DataFrame
    outer: DataFrame
    made: Prepared
    beta: dict  # coefficients of the chosen models, by (context, place in the grid)
    wanted: list  # what ``scores`` takes to score them


def _named(plan: Plan, d: DataFrame) -> DataFrame:
    """``d`` with the names of its slots in place of their numbers."""
    table = plan.rows.sparkSession.createDataFrame([(i, *s.values()) for i, s in enumerate(plan.slots)], ["_slot", *plan.slots[0]])
    return d.join(table, F.col("slot") == F.col("_slot")).select(*plan.slots[0], *[c for c in d.columns if c not in ("slot", "_i")])


def _slot(plan: Plan):
    return F.floor(F.col("ctx") / (plan.inner + 1)).cast("int").alias("slot")


def share(plan: Plan, grid: Sequence[dict], harm: str, limit: float = 0.9, kmax: int = 50, landmarks: int = LANDMARKS):
    """Prepared state, with the order of features and kernel features where the grid wants them, and its broadcast."""
    made = prepare(plan, harm, limit, kmax, ranked=any(g["k"] for g in grid))
    add_lifts(plan, made, sorted({g["k"] for g in grid if g["kind"] == "svm"}), landmarks)
    add_bins(plan, made, sorted({g["k"] for g in grid if g["kind"] == "gbt"}))
    if made.size() > LIMIT:
        raise ValueError("the state is too large to be broadcast")
    return made, plan.rows.sparkSession.sparkContext.broadcast(made)


def inner_contexts(plan: Plan) -> list[int]:
    return [c for c in range(plan.contexts()) if c % (plan.inner + 1)]


def outer_contexts(plan: Plan) -> list[int]:
    return list(range(0, plan.contexts(), plan.inner + 1))


def search(plan: Plan, grid: Sequence[dict], harm: str = "combat", limit: float = 0.9, kmax: int = 50, landmarks: int = LANDMARKS) -> Search:
    """Inner scores of every candidate, the best of each kind by mean site-balanced AUC (ties to the first), its outer scores.

    ``surface``: slot names, inner_fold, kind, candidate, sb_auc. ``chosen``: slot names, kind, candidate, its k and setting, the mean and sd of its
    inner scores. ``outer``: slot names, role, key, site, y, kind, candidate, score.
    """
    grid = list(grid)
    spark = plan.rows.sparkSession
    made, shared = share(plan, grid, harm, limit, kmax, landmarks)
    beta = fit_all(plan, made, grid, shared) | grow_all(plan, made, grid, shared, {c: range(len(grid)) for c in inner_contexts(plan)})
    kinds = spark.createDataFrame([(g["candidate"], i, g["kind"], g["k"], float(g["setting"])) for i, g in enumerate(grid)], "candidate int, _i int, kind string, k int, setting double")
    areas = areas_of_tests(plan, made, shared, beta, grid, inner_contexts(plan))
    areas = areas.select(_slot(plan), (F.col("ctx") % (plan.inner + 1) - 1).alias("inner_fold"), F.col("candidate").alias("_i"), F.col("auc").alias("sb_auc"))
    surface = cut_lineage(areas.join(kinds, "_i"))
    best = argmax_tie(surface, ["slot", "kind"], ["candidate"], "sb_auc", [F.col("candidate")])
    around = surface.groupBy("slot", "candidate").agg(F.avg("sb_auc").alias("inner_mean"), F.stddev_samp("sb_auc").alias("inner_sd"))
    chosen = cut_lineage(best.select("slot", "kind", "candidate").join(around, ["slot", "candidate"]).join(kinds.select("candidate", "_i", "k", "setting"), "candidate"))
    picks: dict = {}
    for r in chosen.select("slot", "_i").collect():
        picks.setdefault(r["slot"], []).append(r["_i"])
    wanted = [(s * (plan.inner + 1), ("train", "test"), sorted(c)) for s, c in sorted(picks.items())]
    beta |= grow_all(plan, made, grid, shared, {ctx: cs for ctx, _, cs in wanted})
    need = {(ctx, c): beta[ctx, c] for ctx, _, cs in wanted for c in cs}
    outer = scores(plan, shared, need, grid, wanted).select(_slot(plan), "role", "key", "site", "y", F.col("candidate").alias("_i"), "score")
    outer = cut_lineage(outer.join(kinds.select("_i", "candidate", "kind"), "_i"))
    return Search(_named(plan, surface.drop("k", "setting")), _named(plan, chosen), _named(plan, outer), made, need, wanted)


def fixed(plan: Plan, grid: Sequence[dict], harm: str = "none", roles: Sequence[str] = ("test",), shared=None) -> DataFrame:
    """Settings without a search: fitted on every outer training part, scored there. (slot names, role, key, site, y, candidate, score)"""
    grid = list(grid)
    made, shared = shared or share(plan, grid, harm)
    beta = fit_all(plan, made, grid, shared, outer_contexts(plan))
    out = scores(plan, shared, beta, grid, [(c, tuple(roles), list(range(len(grid)))) for c in outer_contexts(plan)])
    return _named(plan, out.select(_slot(plan), "role", "key", "site", "y", "candidate", "score"))


def fixed_on(plan: Plan, kept: DataFrame, grid: Sequence[dict], harm: str = "none") -> DataFrame:
    """As ``fixed``, each slot on the features listed for it: ``kept`` (slot, feature), as many rows as slots have features."""
    made, _ = share(plan, [g for g in grid if g["kind"] != "svm"], harm)
    table = kept.select("slot", "feature").toPandas()
    lists = {int(slot) * (plan.inner + 1): set(part["feature"]) for slot, part in table.groupby("slot")}
    few = replace(made, full=[np.array([j for j in f if j in lists.get(ctx, ())], np.int64) for ctx, f in enumerate(made.full)])
    return fixed(plan, grid, harm, ("test",), (few, plan.rows.sparkSession.sparkContext.broadcast(few)))


def lasso_select(plan: Plan, c: float, l1: float = 1.0, harm: str = "none") -> DataFrame:
    """(slot names, feature, coef): what a sparse fit on each outer training part keeps, |coef| above 1e-8. A slot without a row keeps nothing."""
    made, shared = share(plan, [], harm)
    grid = [{"candidate": 0, "kind": "logreg", "k": 0, "setting": c, "l1": l1}]
    beta = fit_all(plan, made, grid, shared, outer_contexts(plan))
    rows = [(i, int(f), float(v)) for i, ctx in enumerate(outer_contexts(plan)) for f, v in zip(made.full[ctx], beta[ctx, 0]) if abs(v) > 1e-8]
    return _named(plan, plan.rows.sparkSession.createDataFrame(rows, "slot int, feature int, coef double"))


def capped_elastic_net(plan: Plan, c: float, l1: float, cap: int = 8, harm: str = "none") -> DataFrame:
    """(slot names, key, site, y, score, n_selected) of the test rows: an elastic net, its ``cap`` largest non-zero coefficients (ties to the
    lower feature), and a second fit on those alone. With nothing kept the score is the intercept, the log odds of the weighted training rows."""
    made, shared = share(plan, [], harm)
    grid = [{"candidate": 0, "kind": "logreg", "k": 0, "setting": c, "l1": l1}]
    beta = fit_all(plan, made, grid, shared, outer_contexts(plan))
    kept = {}
    for ctx in outer_contexts(plan):
        size = np.abs(beta[ctx, 0][:-1])
        best = np.lexsort((np.arange(len(size)), -size))[:cap]
        kept[ctx] = np.sort(made.full[ctx][best[size[best] > 0]])
    few = replace(made, full=[kept.get(ctx, f) for ctx, f in enumerate(made.full)])
    scored = fixed(plan, grid, harm, ("test",), (few, plan.rows.sparkSession.sparkContext.broadcast(few)))
    n = plan.rows.sparkSession.createDataFrame([(i, len(kept[ctx])) for i, ctx in enumerate(outer_contexts(plan))], "slot int, n_selected int")
    return same_keys(scored.drop("role", "candidate"), _named(plan, n), list(plan.slots[0]))


# ---- transport ----------------------------------------------------------------------------------------------
def _class_sums(shared, contexts: Sequence[int], soft=None):
    """Per context: weights, sums and squares of the imputed values, by class, of the training and of the test rows.

    The classes of the test rows are their labels, or with ``soft`` (mapped state, coefficients, place in the grid, priors) the posteriors under the prior.
    """

    def run(batches):
        made, sums = shared.value, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, site, y, v = read(batch, made.sites)
            for ctx in contexts:
                for role, mask in enumerate(parts(v, ctx // (made.inner + 1), -1)):
                    rows = np.flatnonzero(mask)
                    if not len(rows) or soft is not None and not role:
                        continue
                    raw, one = np.where(np.isnan(x[rows]), made.fill[ctx], x[rows]), y[rows].astype(np.float64)
                    if soft is not None:
                        mapped, beta, grid, prior = soft.value
                        k, b = beta[ctx]
                        f = Designs(mapped, ctx, mapped.z(ctx, x[rows], site[rows])).score(grid[k], b)
                        prob = np.clip(1 / (1 + np.exp(-f)), 1e-6, 1 - 1e-6)
                        up = prior[ctx] / 0.5 * prob
                        one = up / (up + (1 - prior[ctx]) / 0.5 * (1 - prob))
                    got = np.stack([np.concatenate([[w.sum()], w @ raw, w @ (raw * raw)]) for w in (1 - one, one)])
                    sums[ctx, role] = sums.get((ctx, role), 0) + got
        keys = list(sums)
        yield pa.RecordBatch.from_pydict({"ctx": pa.array([k[0] for k in keys], pa.int32()), "role": pa.array([k[1] for k in keys], pa.int32()),
                                          "sums": pa.array([sums[k].tobytes() for k in keys], pa.binary())})

    return run


def _sum_by_role(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b) for b in group.column("sums").to_pylist())
    return group.slice(0, 1).select(["ctx", "role"]).append_column("sums", pa.array([total.tobytes()], pa.binary()))


def _classes(plan: Plan, shared, contexts, soft=None) -> dict:
    """(context, role) -> weights, means and variances around them by class; role 1 is the test side."""
    kinds = "ctx int, role int, sums binary"
    rows = plan.rows.select("x", "site", "y", "v").mapInArrow(_class_sums(shared, contexts, soft), kinds).groupBy("ctx", "role").applyInArrow(_sum_by_role, kinds).toPandas()
    out = {}
    for ctx, role, raw in rows.itertuples(index=False):
        m = np.frombuffer(raw).reshape(2, -1)
        p = (m.shape[1] - 1) // 2
        n = np.maximum(m[:, :1], 1e-8)
        mean = m[:, 1: 1 + p] / n
        out[int(ctx), int(role)] = (m[:, 0], mean, np.maximum(m[:, 1 + p:] / n - mean * mean, 0.0))
    return out


def _moments_of(cell, balanced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Location and variance: of all rows, or the mean of the class means and the variance around them."""
    n, mean, var = cell
    share = (n / n.sum())[:, None]
    if balanced:
        return mean.mean(axis=0), (share * var).sum(axis=0)
    loc = (share * mean).sum(axis=0)
    return loc, (share * (var + (mean - loc) ** 2)).sum(axis=0)


def transport(plan: Plan, grid: Sequence[dict], em_steps: int = 10, em_tol: float = 1e-4, shift: float = 0.15, threshold: float = 0.5) -> DataFrame:
    """(source, target, seed, mapping, auc, bacc, sens, spec, prior): models searched on one site, scored on another under each mapping of its values.

    none; combat (the target's own moments); balanced_em (soft class moments from the source model's posteriors under a prior that is re-estimated until
    they settle); prior_known, prior_minus, prior_plus (the target's prevalence, and off by ``shift``); oracle (its labels). ``auc`` is of the ensemble
    of the chosen models, the rates are of the logistic model's probability at ``threshold``. Every mapping is a line per feature, so it is a state like
    any other: a round of the estimation is one scan for the posteriors, one for the moments of all slots.
    """
    grid, spark = list(grid), plan.rows.sparkSession
    found = search(plan, grid, "none")
    made, ctxs = found.made, outer_contexts(plan)
    shared = spark.sparkContext.broadcast(made)
    lead = {ctx: next((c, found.beta[ctx, c]) for c in cands if grid[c]["kind"] == "logreg") for ctx, _, cands in found.wanted}
    cells = _classes(plan, shared, ctxs)
    source = {ctx: _moments_of(cells[ctx, 0], True) for ctx in ctxs}
    effect = {ctx: cells[ctx, 0][1][1] - cells[ctx, 0][1][0] for ctx in ctxs}
    target = {ctx: made.sites[plan.slots[i]["target"]] for i, ctx in enumerate(ctxs)}
    truth = {ctx: float(cells[ctx, 1][0][1] / cells[ctx, 1][0].sum()) for ctx in ctxs}
    floor = lambda v: np.maximum(v, 1e-12)

    def state(scale_and_centre) -> Prepared:
        """The state with the target's values drawn to (x - centre) * scale + the source's location first."""
        mul, add = made.mul.copy(), made.add.copy()
        for ctx in ctxs:
            scale, centre = scale_and_centre(ctx)
            s = target[ctx]
            add[ctx, s] = (source[ctx][0] - centre * scale) * made.mul[ctx, s] + made.add[ctx, s]
            mul[ctx, s] = scale * made.mul[ctx, s]
        return replace(made, mul=mul, add=add)

    def by_moments(cells_of, balanced):
        def at(ctx):
            loc, var = _moments_of(cells_of[ctx, 1], balanced)
            return np.sqrt(floor(source[ctx][1]) / floor(var)), loc
        return state(at)

    def by_prior(off):
        def at(ctx):
            pi = truth[ctx] if not off else min(max(truth[ctx] + off, 0.02), 0.98)
            loc, var = _moments_of(cells[ctx, 1], False)
            r = np.sqrt(floor(var) / floor(source[ctx][1] + pi * (1 - pi) * effect[ctx] ** 2))
            return 1 / r, loc - (pi - 0.5) * r * effect[ctx]
        return state(at)

    states = {"none": made, "combat": by_moments(cells, False), "oracle": by_moments(cells, True), "prior_known": by_prior(0.0), "prior_minus": by_prior(-shift), "prior_plus": by_prior(shift)}
    one = [(ctx, ("test",), [lead[ctx][0]]) for ctx in ctxs]
    coef = {(ctx, c): b for ctx, (c, b) in lead.items()}

    def posteriors(prepared):
        d = scores(plan, spark.sparkContext.broadcast(prepared), coef, grid, one)
        return cut_lineage(d.select("ctx", "key", (1 / (1 + F.exp(-F.col("score")))).alias("p")))

    now, mapped, prior = posteriors(states["combat"]), states["combat"], {}
    for _ in range(em_steps):
        prior = {r["ctx"]: r["pi"] for r in H.prior_shift_em(now, "ctx").collect()}
        mapped = by_moments(_classes(plan, shared, ctxs, spark.sparkContext.broadcast((mapped, lead, grid, prior))), True)
        new = posteriors(mapped)
        moved = new.join(now.withColumnRenamed("p", "_p"), ["ctx", "key"]).agg(F.max(F.abs(F.col("p") - F.col("_p")))).first()[0]
        now = new
        if moved is None or moved < em_tol:
            break
    states["balanced_em"] = mapped
    kinds = spark.createDataFrame([(i, g["kind"]) for i, g in enumerate(grid)], "candidate int, kind string")
    names = list(plan.slots[0])
    train = found.outer.where("role = 'train'").groupBy(*names, "kind").agg(F.avg("score").alias("_m"), F.stddev_pop("score").alias("_s"))
    test = [(ctx, ("test",), cands) for ctx, _, cands in found.wanted]
    each = [scores(plan, spark.sparkContext.broadcast(m), found.beta, grid, test).withColumn("mapping", F.lit(name)) for name, m in states.items()]
    d = reduce(DataFrame.unionByName, each).join(kinds, "candidate")
    d = cut_lineage(same_keys(_named(plan, d.withColumn("slot", _slot(plan))), train, [*names, "kind"]))
    by = [*names, "mapping"]
    ens = d.groupBy(*by, "key", "y").agg(F.avg((F.col("score") - F.col("_m")) / (F.col("_s") + 1e-8)).alias("score"))
    prob = d.where("kind = 'logreg'").withColumn("p", 1 / (1 + F.exp(-F.col("score"))))
    rates = confusion(prob, "p", threshold, by=by)
    rates = rates.select(*by, E.ratio("tp", F.col("tp") + F.col("fn")).alias("sens"), E.ratio("tn", F.col("tn") + F.col("fp")).alias("spec"))
    out = same_keys(weighted_auc(ens, by=by), rates, by).withColumn("bacc", (F.col("sens") + F.col("spec")) / 2)
    known = spark.createDataFrame([(*s.values(), m, v) for s, ctx in zip(plan.slots, ctxs) for m, v in (("balanced_em", prior.get(ctx)), ("prior_known", truth[ctx]))],
                                  [*names, "mapping", "prior"])
    return same_keys(out, known, by, "left")


# ---- what is read off a search ------------------------------------------------------------------------------
def ensemble(outer: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, key, site, y, score): mean over the chosen models of their scores, standardised by those of the training rows; test rows only."""
    tr = F.col("role") == "train"
    st = outer.groupBy(*by, "kind").agg(F.avg(F.when(tr, F.col("score"))).alias("_m"), F.stddev_pop(F.when(tr, F.col("score"))).alias("_s"))
    d = same_keys(outer.where("role = 'test'"), st, [*by, "kind"])
    return d.groupBy(*by, "key", "site", "y").agg(F.avg((F.col("score") - F.col("_m")) / (F.col("_s") + 1e-8)).alias("score"))


def with_ensemble(outer: DataFrame, by: Sequence[str]) -> DataFrame:
    """(model, by, key, site, y, score) of the test rows: each kind, and the ensemble of all."""
    cols = ["model", *by, "key", "site", "y", "score"]
    alone = outer.where("role = 'test'").withColumn("model", F.col("kind"))
    return alone.select(*cols).unionByName(ensemble(outer, by).withColumn("model", F.lit("ensemble")).select(*cols))


def _figures(d: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, metric, value): site-balanced, plain and per-site AUC."""
    sb = site_balanced_auc(d, by=by).select(*by, F.lit("sb_auc").alias("metric"), F.col("sb_auc").alias("value"))
    raw = weighted_auc(d, by=by).select(*by, F.lit("raw_auc").alias("metric"), F.col("auc").alias("value"))
    site = auc_by_group(d, "site", by=by).select(*by, F.concat(F.lit("auc_"), "site").alias("metric"), F.col("auc").alias("value"))
    return sb.unionByName(raw).unionByName(site)


def seed_summary(oof: DataFrame, b: int = 2000, seed: int = 1) -> DataFrame:
    """Per model and metric: mean and sd over seeds, the figure of the seed-averaged score, and its interval for the site-balanced AUC.

    ``oof``: model, seed, key, site, y, score. A seed's scores are standardised (sample sd) before they are averaged.
    """
    oof = cut_lineage(oof.select("model", "seed", "key", "site", "y", "score"))
    per = _figures(oof, ["model", "seed"]).groupBy("model", "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    avg = cut_lineage(zscore_within(oof, ["model", "seed"], "score", eps=1e-8).groupBy("model", "key", "site", "y").agg(F.avg("z").alias("score")))
    whole = _figures(avg, ["model"]).withColumnRenamed("value", "seed_avg")
    base = attach_stats(avg.select("key", "site", "y").distinct(), ["site", "y"], (1 / F.count(F.lit(1))).alias("w"))
    counts = replicate_counts(base, ["site", "y"], "key", b, seed).select("key", "w", "chunk", "counts")
    ci = percentiles(vector_areas(avg.join(counts, "key"), ["model"], b), ["model"], "auc", {"lo": 0.025, "hi": 0.975}).withColumn("metric", F.lit("sb_auc"))
    return per.join(whole, ["model", "metric"]).join(ci, ["model", "metric"], "left")


def locked_scores(dev: DataFrame, new: DataFrame, blocks: dict[str, str], grid: Sequence[dict], harm: str = "combat", inner: int = 3) -> DataFrame:
    """(key, site, score): a search on all of ``dev`` per block of features, its ensemble on ``new`` standardised over it (population sd), the mean over blocks.

    ``blocks`` names an array column for each block; blocks are few and declared.
    """
    each = []
    for name, column in blocks.items():
        e = ensemble(search(locked_plan(dev, new, inner, features=column), grid, harm).outer, ["fold"])
        each.append(zscore_within(e.select("key", "site", "score"), [], "score", ddof=0).withColumn("block", F.lit(name)))
    return reduce(DataFrame.unionByName, each).groupBy("key", "site").agg(F.avg("z").alias("score"))


def held_out_auc(outer: DataFrame) -> DataFrame:
    """(held_out, seed, n, auc): the ensemble of each search on the site it never saw."""
    return auc_by_group(ensemble(outer, ["held_out", "seed"]).withColumn("_all", F.lit(1)), "_all", by=["held_out", "seed"]).select("held_out", "seed", "n", "auc")


def site_leak(plan: Plan, harm: str = "combat", c: float = 0.1) -> DataFrame:
    """(slot names, site_leak_auc, n_sites): sites told from the rest on the prepared features; mean test AUC.

    Weights balance site x label on either side. A site that is missing or alone on a side is skipped.
    """
    made, shared = share(plan, [], harm)
    names = [s for s in made.sites if s is not None]
    grid = [{"candidate": i, "kind": "logreg", "k": 0, "setting": c, "target": s} for i, s in enumerate(names)]
    targets = F.element_at(F.array(*[F.lit(s) for s in names]), F.col("candidate") + 1)
    d = fixed(plan, grid, harm, ("test",), (made, shared)).withColumn("target", targets).withColumn("is_site", (F.col("site") == F.col("target")).cast("int"))
    by = list(plan.slots[0])
    train = np.array([[made.weight[ctx, made.sites[s]].sum() > 0 for s in names] for ctx in outer_contexts(plan)])
    seen = [(*slot.values(), s) for slot, row in zip(plan.slots, train) for s, has in zip(names, row) if has and row.sum() > 1]
    d = strata_weights(d, ["site", "y"], [*by, "target"], "w")
    auc = weighted_auc(d, "is_site", "score", "w", by=[*by, "target"])
    kept = plan.rows.sparkSession.createDataFrame(seen, [*by, "target"])
    return auc.join(kept, [*by, "target"], "left_semi").groupBy(*by).agg(F.avg("auc").alias("site_leak_auc"), F.count("auc").alias("n_sites"))


def domain_classifier(plan: Plan, grid: Sequence[float] = (0.01, 0.1, 1.0), site: str | None = None) -> DataFrame:
    """Every site (or one) told from the rest, labels never used, C chosen by the inner folds: (target, slot names, chosen_c, n_test, pooled_auc)."""
    made, shared = share(plan, [], "none")
    names = [s for s in made.sites if s is not None] if site is None else [site]
    cands = [{"candidate": i, "kind": "logreg", "k": 0, "setting": c, "target": s, "plain": True} for i, (s, c) in enumerate((s, c) for s in names for c in grid)]
    beta = fit_all(plan, made, cands, shared)
    every = list(range(len(cands)))
    table = plan.rows.sparkSession.createDataFrame([(g["candidate"], g["target"], float(g["setting"])) for g in cands], "candidate int, target string, chosen_c double")

    surface = areas_of_tests(plan, made, shared, beta, cands, inner_contexts(plan)).join(table, "candidate").withColumn("slot", _slot(plan))
    best = cut_lineage(argmax_tie(surface, ["slot", "target"], ["chosen_c"], "auc", [F.col("chosen_c")]).select("slot", "target", "chosen_c"))
    oof = scores(plan, shared, beta, cands, [(c, ("test",), every) for c in outer_contexts(plan)]).join(table, "candidate")
    oof = oof.select(_slot(plan), "target", "chosen_c", (F.col("site") == F.col("target")).cast("int").alias("is_site"), "score").join(best, ["slot", "target", "chosen_c"])
    n = oof.groupBy("slot", "target", "chosen_c").agg(F.count(F.lit(1)).alias("n_test"))
    pooled = weighted_auc(oof, "is_site", "score", by=["target"]).withColumnRenamed("auc", "pooled_auc")
    return _named(plan, n.join(pooled, "target"))


def naive_scores(plan: Plan, k: int = 25, c: float = 1.0) -> DataFrame:
    """Test scores of the unharmonised, unweighted logistic fit on the k best features."""
    return fixed(plan, [{"candidate": 0, "kind": "logreg", "k": k, "setting": c, "plain": True}]).drop("role", "candidate")
