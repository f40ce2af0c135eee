"""Region operators on a cell table (case, z, y, x, value, mask, ...). No images are decoded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.functions import expr as E
from evenhand.operators.core import attach_stats, quantiles, same_keys
from evenhand.session import cut_lineage

AXES = ("z", "y", "x")


def _extents(cells: DataFrame, size: Sequence[int], stride: Sequence[int]) -> DataFrame:
    """Per case and axis: first and last lattice start, the grid's size."""
    in_mask = lambda c: F.when(F.col("mask"), F.col(c))
    g = cells.groupBy("case").agg(*[f(in_mask(a)).alias(f"{n}_{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))],
                                  *[(F.max(a) + 1).alias(f"dim_{a}") for a in AXES])
    for a, n, s in zip(AXES, size, stride):
        g = g.withColumn(f"first_{a}", F.floor(F.col(f"lo_{a}") / s) * s).withColumn(f"last_{a}", F.least(F.col(f"hi_{a}"), F.col(f"dim_{a}") - n))
        g = g.withColumn(f"n_{a}", F.greatest(F.floor((F.col(f"last_{a}") - F.col(f"first_{a}")) / s) + 1, F.lit(0)))
    return g.where(F.col("lo_z").isNotNull())


CHUNK, LOAD = 64, 1 << 19  # lattice starts along the last axis that one task takes together, mask cells of a task


def lattice_blocks(cells: DataFrame, size: Sequence[int], stride: Sequence[int], least: int = 27) -> DataFrame:
    """Blocks of the lattice anchored at 0 that hold a mask cell: cell count, centre, kept or the first failed rule.

    A mask cell names the blocks that cover it, so blocks are counted by one aggregation; empty blocks need
    no row (see ``lattice_report``).
    """
    cells = cut_lineage(cells.select("case", *AXES, "mask"))
    return _blocks(cells, _extents(cells, size, stride), size, stride, least)


def _blocks(cells: DataFrame, ext: DataFrame, size: Sequence[int], stride: Sequence[int], least: int) -> DataFrame:
    """Cells move once, to the tasks of the stretches of the last axis they touch, and name their blocks only there."""
    d = cells.where("mask").select("case", *AXES)
    tasks = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-d.count() // LOAD))
    starts = {a: (F.greatest(F.ceil((F.col(a) - (n - 1)) / s) * s, F.lit(0)), F.floor(F.col(a) / s) * s) for a, n, s in zip(AXES, size, stride)}
    lo, hi = starts[AXES[-1]]
    width = CHUNK * stride[-1]
    d = d.withColumn("_chunk", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))).repartition(tasks, "case", "_chunk")
    starts[AXES[-1]] = (F.greatest(lo, F.col("_chunk") * width), F.least(hi, F.col("_chunk") * width + (width - stride[-1])))
    for a, s in zip(AXES, stride):
        d = d.withColumn(f"s_{a}", F.explode(F.sequence(*starts[a], F.lit(s).cast("bigint"))))
    centre = E.all_of([F.col(a) == F.col(f"s_{a}") + n // 2 for a, n in zip(AXES, size)])
    b = d.groupBy("case", "_chunk", *[f"s_{a}" for a in AXES]).agg(F.count(F.lit(1)).alias("n_mask"), F.max(centre).alias("centre_in"))
    b = same_keys(b, ext, ["case"])
    ok = E.all_of([(F.col(f"s_{a}") >= F.col(f"first_{a}")) & (F.col(f"s_{a}") <= F.col(f"last_{a}")) for a in AXES])
    return b.where(ok).select("case", *[F.col(f"s_{a}").alias(a) for a in AXES], "n_mask",
                              *[(F.col(f"s_{a}") + n // 2).alias(f"centre_{a}") for a, n in zip(AXES, size)],
                              E.first_rule([("centre outside", ~F.col("centre_in")), ("too few cells", F.col("n_mask") < least)], "kept").alias("verdict"))


def lattice_report(cells: DataFrame, size: Sequence[int], stride: Sequence[int], least: int = 27) -> DataFrame:
    """Per case: candidate blocks, kept ones and rejections by reason; a block without mask cells has its centre outside."""
    cells = cut_lineage(cells.select("case", *AXES, "mask"))
    ext = _extents(cells, size, stride)
    b = _blocks(cells, ext, size, stride, least).groupBy("case").agg(
        F.count_if(F.col("verdict") == "kept").alias("n_kept"), F.count_if(F.col("verdict") == "too few cells").alias("too_few_cells"))
    j = same_keys(ext.select("case", (F.col("n_z") * F.col("n_y") * F.col("n_x")).alias("n_candidates")), b, ["case"], "left").fillna(0, ["n_kept", "too_few_cells"])
    return j.withColumn("centre_outside", F.col("n_candidates") - F.col("n_kept") - F.col("too_few_cells"))


def slice_boxes(cells: DataFrame) -> DataFrame:
    return cells.where("mask").groupBy("case", "z").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def loosen_boxes(boxes: DataFrame, mm: float, spacing_x, spacing_y) -> DataFrame:
    """Grow in-plane by round(mm / spacing) cells; the lower corner stops at 0."""
    gx, gy = (F.bround(F.lit(float(mm)) / E.col(s)).cast("int") for s in (spacing_x, spacing_y))
    return boxes.withColumn("x0", F.greatest(F.col("x0") - gx, F.lit(0))).withColumn("y0", F.greatest(F.col("y0") - gy, F.lit(0))) \
        .withColumn("x1", F.col("x1") + gx).withColumn("y1", F.col("y1") + gy)


def shell_bins(cells: DataFrame, distance: str, edges: Sequence[float] = (0, 4, 8, 12)) -> DataFrame:
    """Half-open shells (lo, hi] by a given distance; NULL outside."""
    shell = F.coalesce(*[F.when((F.col(distance) > a) & (F.col(distance) <= b), F.lit(f"{a:g}-{b:g}")) for a, b in zip(edges, edges[1:])])
    return cells.withColumn("shell", shell)


def region_stats(cells: DataFrame, by: Sequence[str], lo: float, hi: float, cell_volume: float = 1.0) -> DataFrame:
    """Per region: cells, min, median, max, share inside [lo, hi], volume."""
    m = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("min"), F.max("value").alias("max"),
                               F.avg(F.col("value").between(lo, hi).cast("int")).alias("share_inside"))
    return same_keys(m, quantiles(cells, by, "value", {"median": 0.5}), by, "left").withColumn("volume", F.col("n") * cell_volume)


def position_features(cells: DataFrame, spacing: float = 1.0) -> DataFrame:
    """Position of the mask in its region per case, from given columns mask, region, body, shell, depth.

    The centroid and midline are one aggregate per case; region cells then join them and are summarised once.
    """
    m = F.col("mask")
    at = lambda c: F.avg(F.when(m, F.col(c)))
    body = F.when(F.col("body"), F.col("x") * spacing)
    s = attach_stats(cells, ["case"], *[at(a).alias(f"c_{a}") for a in AXES], F.min(F.when(m, F.col("z"))).alias("m_z0"), F.max(F.when(m, F.col("z"))).alias("m_z1"),
                     ((F.min(body) + F.max(body)) / 2).alias("midline"), ((F.max(body) - F.min(body)) / 2).alias("half_w"))
    cx, x = F.col("c_x") * spacing, F.col("x") * spacing
    left = cx > F.col("midline")
    side = F.col("region") & (F.when(left, x > F.col("midline")).otherwise(x <= F.col("midline")))
    band = side & F.col("z").between(F.col("m_z0"), F.col("m_z1"))
    here = E.all_of([F.col(a) == F.bround(f"c_{a}") for a in AXES])
    sel = lambda cond, v: F.when(cond, v)
    g = s.groupBy("case", "c_z", "c_y", "c_x", "midline", "half_w").agg(
        F.min(sel(band, x)).alias("x_lo"), F.max(sel(band, x)).alias("x_hi"), F.min(sel(band, F.col("y"))).alias("y_lo"), F.max(sel(band, F.col("y"))).alias("y_hi"),
        F.min(sel(side, F.col("z"))).alias("z_lo"), F.max(sel(side, F.col("z"))).alias("z_hi"),
        F.coalesce(F.max(sel(here & F.col("region"), F.col("depth"))), F.lit(0.0)).alias("depth"), F.max(sel(side, F.col("depth"))).alias("max_depth"),
        F.count_if(F.col("shell") & ~F.col("region")).alias("n_touch"), F.count_if(F.col("shell")).alias("n_shell"),
        F.count_if(F.col("shell") & ~F.col("region") & (F.abs(x - F.col("midline")) < F.abs(cx - F.col("midline")))).alias("n_medial"),
        F.count_if(m & ~F.col("region")).alias("n_out"), F.count_if(m).alias("n_mask"))
    unit = lambda v: E.clip(v, 0.0, 1.0)
    span = lambda a, b: F.greatest(F.col(b) - F.col(a), F.lit(1e-3 / spacing))
    inner = F.when(left, F.col("x_lo")).otherwise(F.col("x_hi"))
    return g.where("n_mask > 0").select(
        "case", left.cast("double").alias("on_left"), unit(F.abs(cx - inner) / F.greatest(F.col("x_hi") - F.col("x_lo"), F.lit(1e-3))).alias("rel_lateral"),
        unit((F.col("c_y") - F.col("y_lo")) / span("y_lo", "y_hi")).alias("rel_ap"), unit((F.col("c_z") - F.col("z_lo")) / span("z_lo", "z_hi")).alias("rel_z"),
        (F.abs(cx - F.col("midline")) / F.greatest("half_w", F.lit(1e-3))).alias("midline_dist"), F.col("depth").alias("centroid_depth"),
        (F.col("depth") / F.greatest(F.coalesce("max_depth", F.lit(1.0)), F.lit(1e-3))).alias("depth_rel"),
        (F.col("n_touch") / F.greatest("n_shell", F.lit(1))).alias("contact_frac"), F.coalesce(E.ratio("n_medial", "n_touch"), F.lit(0.0)).alias("contact_medial"),
        (F.col("n_out") / F.col("n_mask")).alias("outside_frac"), F.log(F.col("n_mask") * spacing**3).alias("log_volume"))


def region_algebra(cells: DataFrame, a: str, b: str, union: str | None = None) -> DataFrame:
    """Per case: are two masks disjoint, is a inside b, is ``union`` exactly a or b."""
    x, y = F.col(a), F.col(b)
    aggs = [F.bool_and(~(x & y)).alias("disjoint"), F.bool_and(~x | y).alias("a_in_b")]
    if union:
        aggs.append(F.bool_and(F.col(union) == (x | y)).alias("union_exact"))
    return cells.groupBy("case").agg(*aggs)


def geometry_flags(image: DataFrame, mask: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Header records compared field by field; a mask must also be binary and not empty."""
    j = image.join(mask.select(key, "binary", "n_cells", *[F.col(f).alias(f"m_{f}") for f in fields]), key)
    same = [F.col(f).eqNullSafe(F.col(f"m_{f}")) for f in fields]
    flags = [*same, F.col("binary"), F.col("n_cells") > 0]
    return j.select(key, *[s.alias(f"{f}_equal") for f, s in zip(fields, same)], F.col("binary").alias("is_binary"), (F.col("n_cells") > 0).alias("not_empty"),
                    E.all_of(flags).alias("all_ok"))


def containment_share(cells: DataFrame, a: str, b: str) -> DataFrame:
    """Share of mask a lying inside b, 0 for an empty a."""
    return cells.groupBy("case").agg((F.count_if(F.col(a) & F.col(b)) / F.greatest(F.count_if(F.col(a)), F.lit(1))).alias("share"))
