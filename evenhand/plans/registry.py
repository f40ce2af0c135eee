"""Query registry: a Spark builder, the SQL that must agree with it, and the shared rounding."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.plans.frames import CTE, CTE_NEEDS


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def _with_ctes(body: str, names: Sequence[str]) -> str:
    ordered: list[str] = []

    def add(n):
        for need in CTE_NEEDS.get(n, ()):
            add(need)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    if not ordered:
        return body
    word = "WITH "
    if body.startswith("WITH RECURSIVE "):
        word, body = "WITH RECURSIVE ", "WITH " + body[15:]
    head = word + ",\n".join(f"{n} AS ({CTE[n]})" for n in ordered)
    return f"{head},\n{body[5:]}" if body.startswith("WITH ") else f"{head}\n{body}"


def query(name: str, sql: str | None = None, ctes: Sequence[str] = (), rounded: Sequence[str] = (), digits: int = 6):
    """Register ``fn(spark, sf_dir)``; ``rounded`` columns are rounded alike on both sides."""

    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.select(*[F.round(c, digits).alias(c) if c in rounded else F.col(c) for c in df.columns])

        text = None
        if sql is not None:
            text = _with_ctes(sql.strip(), ctes)
            if rounded:
                swaps = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in rounded)
                text = f"SELECT * REPLACE ({swaps}) FROM ({text})"
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(build, text)
        return fn

    return deco
