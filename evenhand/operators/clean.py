"""Column selection, renaming and rule filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.functions import expr as E
from evenhand.operators.core import same_keys


def select_block(df: DataFrame, keys: Sequence[str], prefixes: Sequence[str], exclude: Sequence[str] = (),
                 status: str | None = None) -> DataFrame:
    """Keys plus columns by prefix without the excluded tokens; only rows whose status is ok."""
    cols = [c for c in df.columns if c.startswith(tuple(prefixes)) and not any(t in c for t in exclude) and c not in keys]
    if status is not None:
        df = df.where(F.col(status) == "ok")
    return df.select(*keys, *cols)


def drop_diagnostics(df: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(tuple(prefixes))])


def coerce_numeric(df: DataFrame, cols: Sequence[str], first_of: str | None = None) -> DataFrame:
    return df.withColumns({c: E.finite(E.to_number(c, first_of)) for c in cols})


def prefix_columns(df: DataFrame, block: str, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"{block}__{c}" for c in df.columns if c not in keys})


def with_entity_key(df: DataFrame, site: str, local_id: str, fail: bool = False) -> DataFrame:
    """``df`` with the key of site and local id; with ``fail`` a local id that two sites use, or a NULL site, fails the query."""
    if not fail:
        return df.withColumn("key", E.entity_key(site, local_id))
    seen = df.groupBy(local_id).agg(F.min(site).alias("_first"), F.max(site).alias("_last"))
    both = same_keys(df, seen, [local_id], "left")
    clash = F.raise_error(F.concat(F.lit("local id of several sites: "), F.coalesce(F.col(local_id).cast("string"), F.lit("NULL")))).cast("string")
    key = F.when(F.col(site).isNotNull() & F.col("_first").eqNullSafe(F.col("_last")), E.entity_key(site, local_id)).otherwise(clash)
    return both.withColumn("key", key).drop("_first", "_last")


def id_collisions(df: DataFrame, site: str, local_id: str) -> DataFrame:
    """Local ids used by more than one site."""
    return df.groupBy(local_id).agg(F.min(site).alias("first_site"), F.max(site).alias("last_site")).where(
        F.col("first_site") != F.col("last_site"))


def eligibility_filter(df: DataFrame, label: str | None = None, max_of: dict | None = None, min_of: dict | None = None,
                       exclude: tuple[str, str] | None = None) -> DataFrame:
    """Non-null label, upper and lower bounds, and an exclusion pattern on a lower-cased text (NULL text passes)."""
    conds: list[Column] = []
    if label:
        conds.append(F.col(label).isNotNull())
    conds += [F.col(c) <= v for c, v in (max_of or {}).items()]
    conds += [F.col(c) >= v for c, v in (min_of or {}).items()]
    if exclude:
        conds.append(~F.lower(F.coalesce(F.col(exclude[0]), F.lit(""))).rlike(exclude[1]))
    return df.where(E.all_of(conds)) if conds else df


def first_failing_rule(df: DataFrame, rules: Sequence[tuple[str, Column]], out: str = "reason") -> DataFrame:
    return df.withColumn(out, E.first_rule(rules))


def derive_clinical(df: DataFrame, age: str, offset_days: str, gender: str) -> DataFrame:
    """Age at the event and a 0/1 male flag from text or code."""
    g = F.lower(F.trim(F.col(gender).cast("string")))
    return df.withColumn("clin__age", E.finite(age) + E.finite(offset_days) / 365.25).withColumn(
        "clin__male", F.when(g.isin("m", "male", "1"), 1.0).when(g.isin("f", "female", "2", "0"), 0.0))


def subset_view(df: DataFrame, multi: DataFrame | None = None, key: str = "key", drop_site: str | None = None,
                site: str = "site") -> DataFrame:
    """Ablation subset: without the keys of ``multi``, without one site."""
    out = df.join(multi.select(key), key, "left_anti") if multi is not None else df
    return out.where(F.col(site) != drop_site) if drop_site is not None else out
