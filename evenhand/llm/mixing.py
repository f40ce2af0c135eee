"""Operator 12: mixing sources to target weights by capped water-filling.

Sources share a budget of words by weight. A source whose share is above its cap (``epochs`` times its words) is clamped there,
and what it leaves is dealt again among the others by weight, until no share is above its cap. A source is then taken
as often as its target holds it whole, and a seeded draw of its documents makes up the fraction: its documents in hashed order, up to
the one that comes nearest to the target.

Null and empty texts have no words and are taken as often as their source as a whole. A null source is a source like any other
and comes last. Repeated rows are drawn one by one. Without words every target is 0. Documents are taken whole, so a source's taken words
are within half of its longest document of the target, and no document is taken more often than the cap rounded up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.llm.hot import attach, numbered
from evenhand.operators.core import row_numbers, running_totals
from evenhand.session import cut_lineage

# Fixed values of the mix: weights by place of the source, repeated; words of the mix over words of all; most epochs of a source.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2.0
SEED = 1
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """``sizes`` (source_size, weight and what else names a source) with ``target``.

    A round is one aggregate over the table of sources: what the clamped ones take and the weight of the free ones. A source once
    clamped stays so, as the others' shares only grow, and the rounds end with the first that clamps no more.
    """
    cap = F.lit(float(epochs)) * F.col("source_size")
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    taken, free, clamped = 0.0, None, -1
    while True:
        level = F.lit(0.0) if free is None else F.col("weight") * (float(share) * total - taken) / F.lit(float(free))
        above = F.lit(False) if free is None else level > cap
        row = sizes.agg(F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)).first()
        if row[2] == clamped or row[1] is None:
            return sizes.withColumn("target", F.when(F.lit(row[1] is None) | above, cap).otherwise(level))
        taken, free, clamped = row


def source_sizes(rows: DataFrame, source: str, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """(source, source_size, weight), weights dealt in order of the sources by code point, null last, and repeated."""
    sums = rows.groupBy(source).agg(F.sum("size").alias("source_size"))
    placed = row_numbers(sums.withColumn("_at", F.struct(F.col(source).isNull().alias("last"), F.col(source).alias("name"))), [], "_at", out="_place")
    dealt = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_place") - 1, F.lit(len(weights))) + 1).cast("int"))
    return cut_lineage(placed.select(source, "source_size", dealt.alias("weight")))


def draw(rows: DataFrame, source: str, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: int = SEED,
         key: str = "_key") -> DataFrame:
    """``numbered`` rows (key, source, size) with source_size, target, copies and taken (words)."""
    mix = targets(source_sizes(rows, source, weights), share, epochs)
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    line = running_totals(rows.withColumn("_place", F.struct(order, "size")), [source], "_place", ["size"], ties=["_row"])
    line = attach(line.drop("_place", "tot_size"), mix.drop("weight"), [source])
    # a source is taken whole as often as it fits; the rest of the target is a stretch of its documents in hashed order
    whole = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    rest = F.col("target") - whole * F.col("source_size")
    extra = (rest > 0) & (F.col("cum_size") - F.col("size") / 2 <= rest)
    out = line.withColumn("copies", (whole + extra.cast("int")).cast("bigint")).drop("cum_size")
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def mixture_report(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **settings) -> DataFrame:
    """(key, size, source_size, target, taken), one row per row of ``docs``."""
    rows = numbered(docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), word_count(text).alias("size")))
    return draw(rows, "_source", **settings).select(F.col("_key").alias(key), "size", "source_size", "target", "taken")


def mixture(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **settings) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its own columns."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, names))
    rows = numbered(docs.toDF(*names))
    narrow = rows.select("_row", F.col(own[key]).alias("_key"), F.col(own[source]).alias("_source"), word_count(own[text]).alias("size"))
    copies = draw(narrow, "_source", **settings).where("copies > 0").select("_row", "copies")
    return rows.join(copies, "_row").select(*names, F.explode(F.sequence(F.lit(1), "copies")).alias("_copy")).select(*names).toDF(*docs.columns)
