"""Expectations, fingerprints, freezing, gates and provenance. Checks return rows, they never collect data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.functions import expr as E
from evenhand.operators.core import attach_stats, same_keys
from evenhand.operators.joins import membership_join


def _check(df: DataFrame, name: str, ok, detail) -> DataFrame:
    return df.select(F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("pass"), detail.cast("string").alias("detail"))


def expect_counts(df: DataFrame, by: Sequence[str], declared: DataFrame, n: str = "n") -> DataFrame:
    """Group sizes against declared ones; a group missing on either side fails."""
    seen = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_seen"))
    j = declared.select(*by, F.col(n).alias("_want")).join(seen, list(by), "full")
    name = F.concat(F.lit("count "), F.concat_ws("/", *by))
    return j.select(name.alias("check"), F.coalesce(F.col("_seen") == F.col("_want"), F.lit(False)).alias("pass"),
                    F.concat_ws(" of ", F.coalesce("_seen", F.lit(0)).cast("string"), F.coalesce("_want", F.lit(0)).cast("string")).alias("detail"))


def expect_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Offending keys with their counts; empty when unique."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def expect_finite(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Non-finite values per entity and column, rows with any."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    g = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).groupBy(key).agg(*[F.count_if(bad(c)).alias(c) for c in cols])
    return g.where(reduce(lambda a, b: a | b, [F.col(c) > 0 for c in cols]))


def expect_schema(df: DataFrame, names: Sequence[str], forbidden: Sequence[str] = ()) -> DataFrame:
    """Same names in the same order, and no column holding a forbidden token; the detail carries the row count."""
    same = list(df.columns) == list(names)
    tokens = sorted({c for c in df.columns for t in forbidden if t in c})
    one = df.agg(F.count(F.lit(1)).alias("n"))
    return _check(one, "names and order", F.lit(same), F.concat(F.lit(f"{len(df.columns)} of {len(names)} columns, rows "), "n")).unionByName(
        _check(one, "forbidden tokens", F.lit(not tokens), F.lit(",".join(tokens))))


def distinct_name_lists(df: DataFrame, names: str) -> DataFrame:
    """How many entities carry each list of feature names; one row when all agree."""
    return df.groupBy(F.sha2(F.concat_ws("|", names), 256).alias("names_sha256"), F.size(names).alias("width")).agg(F.count(F.lit(1)).alias("n"))


def audit_consistency(master: DataFrame, other: DataFrame, key: str, compare: Sequence[str], excluded: DataFrame) -> DataFrame:
    """Problem per key: missing on a side, a differing value, or present although excluded."""
    j = membership_join(master, other, key, compare).join(excluded.select(key, F.lit(True).alias("_x")), key, "left")
    differs = reduce(lambda a, b: a | b, [F.col(f"{c}_agrees") == F.lit(False) for c in compare], F.lit(False))
    x = F.coalesce("_x", F.lit(False))
    problem = F.coalesce(F.when((F.col("membership") == "b_only") & x, "excluded but present"), F.when((F.col("membership") == "shared") & x, "excluded but present"),
                         F.when((F.col("membership") == "a_only") & ~x, "missing"), F.when(F.col("membership") == "b_only", "not in master"),
                         F.when(differs, "value differs"))
    return j.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def run_checks(checks: Sequence[DataFrame]) -> DataFrame:
    """All checks in one table plus an ``overall`` row."""
    rows = reduce(DataFrame.unionByName, checks)
    total = rows.agg(F.bool_and("pass").alias("ok"), F.count_if("pass").alias("p"), F.count(F.lit(1)).alias("n"))
    return rows.unionByName(_check(total, "overall", F.col("ok"), F.concat_ws(" of ", F.col("p").cast("string"), F.col("n").cast("string"))))


def rejection_rollup(df: DataFrame, reasons: Sequence[str], candidates: str, retained: str, by: Sequence[str] = ()) -> DataFrame:
    """Rejections by reason with their share of all candidates, and whether candidates = retained + rejections."""
    g = df.groupBy(*by).agg(F.sum(candidates).alias("_c"), F.sum(retained).alias("_k"), *[F.sum(r).alias(r) for r in reasons])
    lost = reduce(lambda a, b: a + b, [F.col(r) for r in reasons])
    g = g.withColumn("balanced", F.col("_c") == F.col("_k") + lost)
    return g.unpivot([*by, "_c", "balanced"], list(reasons), "reason", "n").select(*by, "reason", "n", F.round(E.ratio("n", "_c"), 6).alias("share"), "balanced")


def duplicate_rows(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Keys whose rows are identical in ``cols``: every copy with the first key of its group."""
    h = df.select(key, F.sha2(F.to_json(F.struct(*cols)), 256).alias("_h"))
    g = h.groupBy("_h").agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_key")).where("copies > 1")
    return h.join(g, "_h").where(F.col(key) != F.col("first_key")).select(key, "first_key", "copies")


def frame_fingerprint(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Row-order-free content hash: sum of 64-bit md5 prefixes as a decimal, and the row count.

    Every field goes in with its length, so no text can pass for two fields or for NULL.
    """
    cols = list(cols or df.columns)
    field = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    text = F.concat(*[field(c) for c in cols])
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("fingerprint"), F.count(F.lit(1)).alias("n"))


def freeze(named: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """One row per named table: its fingerprint and size."""
    return reduce(DataFrame.unionByName, [frame_fingerprint(d).select(F.lit(n).alias("name"), "fingerprint", "n") for n, d in named])


def verify_frozen(named: Sequence[tuple[str, DataFrame]], frozen: DataFrame, fail: bool = True) -> DataFrame:
    """Current state against the frozen one; with ``fail`` a moved table raises when the result is read."""
    now = freeze(named).withColumnsRenamed({"fingerprint": "now", "n": "n_now"})
    j = frozen.join(now, "name", "full").withColumn("intact", F.col("fingerprint").eqNullSafe(F.col("now")))
    if fail:
        moved = F.concat(F.lit("frozen table moved: "), F.col("name"))
        j = j.withColumn("intact", F.when(F.col("intact"), True).otherwise(F.raise_error(moved).cast("boolean")))
    return j.select("name", "intact")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys added, removed or changed."""
    j = before.select(key, F.col(value).alias("_b"), F.lit(1).alias("_ib")).join(after.select(key, F.col(value).alias("_a"), F.lit(1).alias("_ia")), key, "full")
    kind = F.coalesce(F.when(F.col("_ib").isNull(), "added"), F.when(F.col("_ia").isNull(), "removed"), F.when(~F.col("_b").eqNullSafe(F.col("_a")), "changed"))
    return j.select(key, kind.alias("change")).where("change IS NOT NULL")


def score_once(pred: DataFrame, frozen: DataFrame, labels: DataFrame, key: str, out: str, name: str = "predictions") -> DataFrame:
    """Check the predictions against their frozen hash, read the locked labels, write the result once.

    Writing to a path that exists fails, so a second scoring run is refused.
    """
    verify_frozen([(name, pred)], frozen.where(F.col("name") == name)).collect()
    scored = pred.join(labels, key)
    scored.write.mode("errorifexists").parquet(out)
    return pred.sparkSession.read.parquet(out)


def _holds(op, value, limit):
    return F.when(op == ">=", value >= limit).when(op == ">", value > limit).when(op == "<=", value <= limit).when(op == "<", value < limit)


def evaluate_gate(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (id, metric, op, value, and_metric, and_op, and_value) against metrics (metric, observed).

    A rule with a second condition needs both; ``gate`` is true when every rule passes. A missing metric fails.
    """
    j = rules.join(metrics, "metric", "left").join(metrics.select(F.col("metric").alias("and_metric"), F.col("observed").alias("and_observed")), "and_metric", "left")
    first = F.coalesce(_holds(F.col("op"), F.col("observed"), F.col("value")), F.lit(False))
    second = F.when(F.col("and_metric").isNull(), True).otherwise(F.coalesce(_holds(F.col("and_op"), F.col("and_observed"), F.col("and_value")), F.lit(False)))
    j = j.select("id", "metric", "op", "value", "observed", "and_metric", "and_observed", (first & second).alias("pass"))
    return attach_stats(j, [], F.bool_and("pass").alias("gate"))


def qualify_candidates(entries: DataFrame, flags: Sequence[str], n_pos: str = "n_pos", n_neg: str = "n_neg", code: str = "code", centre: str = "centre",
                       least_total: int = 60, least_minority: int = 20, codes: Sequence[str] = ("A", "B")) -> DataFrame:
    """Size rule, usable code, same-centre flag, and a stop flag when nothing qualifies."""
    total, minority = F.col(n_pos) + F.col(n_neg), F.least(n_pos, n_neg)
    near = reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(centre), F.lit(""))).contains(f.lower()) for f in flags], F.lit(False))
    d = entries.withColumn("total", total).withColumn("minority", minority).withColumn("evaluable", total.isNotNull())
    d = d.withColumn("meets_size", F.coalesce((total >= least_total) & (minority >= least_minority), F.lit(False)))
    d = d.withColumn("same_centre", near).withColumn("qualifies", F.col("meets_size") & F.col(code).isin(*codes))
    return attach_stats(d, [], (~F.bool_or("qualifies")).alias("stop"))


def feasibility_table(entries: DataFrame) -> DataFrame:
    """The fixed report row per candidate; missing text is empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    # Report columns and text formats.
    fixed = ["pre_treatment", "segmentation_provenance", "institution_independence", "acquisition_diversity", "processing_difficulty", "manual_work", "suitable"]
    return entries.select(
        F.col("label").alias("candidate"), text("n_pos").alias("total_pos"), text("n_neg").alias("total_neg"),
        F.concat_ws(" - ", text("code"), text("code_text")).alias("segmentation_availability"),
        F.format_string("%d shared PatientID(s) with a development cohort; identifier-evidence rank %d", F.col("shared"), F.col("evidence_rank")).alias("possible_overlap"),
        F.format_string("%.2f GiB (%d patients, %d series)", F.col("gib"), F.col("n_patients"), F.col("n_series")).alias("download_size"),
        *[(text(c) if c in entries.columns else F.lit("")).alias(c) for c in fixed])


def unit_status(units: DataFrame, checkpoints: DataFrame, protocol: str) -> DataFrame:
    """Units complete under the current protocol, pending ones, mean seconds and the projected remaining time."""
    done = checkpoints.where((F.col("protocol") == protocol) & F.col("complete")).select("unit", "seconds")
    j = units.select("unit").join(done, "unit", "left")
    g = j.agg(F.count(F.lit(1)).alias("n_units"), F.count("seconds").alias("n_complete"), F.avg("seconds").alias("mean_seconds"), F.sum("seconds").alias("elapsed"))
    left = F.col("n_units") - F.col("n_complete")
    return g.withColumn("n_pending", left).withColumn("projected", left * F.col("mean_seconds"))


def pending_units(units: DataFrame, checkpoints: DataFrame, protocol: str) -> DataFrame:
    return units.join(checkpoints.where((F.col("protocol") == protocol) & F.col("complete")).select("unit"), "unit", "left_anti")


def assemble_oof(units: Sequence[DataFrame], labels: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Per-unit predictions together, with label and size; ``n_rows`` must be 1 everywhere."""
    rows = reduce(DataFrame.unionByName, units)
    rows = attach_stats(rows, [key], F.count(F.lit(1)).alias("n_rows"))
    return rows.join(labels, key).join(sizes, key, "left")


def lattice_audit(blocks: DataFrame, case: str, axes: Sequence[str], size: Sequence[int], stride: Sequence[int], dims: DataFrame, least: int) -> DataFrame:
    """Per case: starts on the lattice, no duplicate start, inside the grid, enough cells, centre = start + half."""
    j = same_keys(blocks, dims, [case])
    on = E.all_of([F.col(a) % s == 0 for a, s in zip(axes, stride)])
    inside = E.all_of([(F.col(a) >= 0) & (F.col(a) + n <= F.col(f"dim_{a}")) for a, n in zip(axes, size)])
    centre = E.all_of([F.col(f"centre_{a}") == F.col(a) + n // 2 for a, n in zip(axes, size)])
    flags = {"on_lattice": on, "in_bounds": inside, "centred": centre, "enough_cells": F.col("n_mask") >= least}
    # one pass: rows of one start first, then the starts of a case
    g = j.groupBy(case, *axes).agg(F.count(F.lit(1)).alias("n"), *[F.bool_and(c).alias(k) for k, c in flags.items()])
    return g.groupBy(case).agg(*[F.bool_and(k).alias(k) for k in flags], F.sum("n").alias("n"), (F.max("n") == 1).alias("no_duplicates"))


def missing_starts(reference: DataFrame, blocks: DataFrame, case: str, axes: Sequence[str]) -> DataFrame:
    """Reference starts absent from the new blocks; empty when they are a subset."""
    return reference.select(case, *axes).join(blocks.select(case, *axes), [case, *axes], "left_anti")


def expect_plausible(long: DataFrame, key: str, names: dict[str, str], lo: float, hi: float) -> DataFrame:
    """Per entity lo <= min <= mean <= max <= hi, entropy in [0, 12], positive volume; ``names`` maps roles to feature names."""
    at = lambda r: F.max(F.when(F.col("feature") == names[r], F.col("value"))).alias(r)
    g = long.where(F.col("feature").isin(*names.values())).groupBy(key).agg(*[at(r) for r in names])
    ok = (F.col("min") >= lo) & (F.col("min") <= F.col("mean")) & (F.col("mean") <= F.col("max")) & (F.col("max") <= hi)
    if "entropy" in names:
        ok = ok & F.col("entropy").between(0, 12)
    if "volume" in names:
        ok = ok & (F.col("volume") > 0)
    return g.withColumn("plausible", F.coalesce(ok, F.lit(False)))


def expect_same_frame(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows of (key, fold, label) on one side only, with the side; empty when the tables share one frame."""
    return a.select(*cols).exceptAll(b.select(*cols)).withColumn("side", F.lit("a")).unionByName(
        b.select(*cols).exceptAll(a.select(*cols)).withColumn("side", F.lit("b")))
