"""A join for keys of which one may hold a large part of all rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.operators.core import same_keys
from evenhand.session import cut_lineage


def numbered(df: DataFrame) -> DataFrame:
    """The rows with a number of their own (``_row``), written once so that it stays."""
    return cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))


def attach(rows: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """Columns of ``table``, one row per key at most, joined to every one of the ``numbered`` rows; null keys meet null keys.

    Rows of one key are dealt to about sqrt(rows) salts. The table meets the distinct (key, salt) pairs first, which tasks
    fold before they move them, and the rows meet those. No key gives a task more than about sqrt(rows) rows of its own.
    """
    salts = math.isqrt(rows.count()) + 1
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int"))
    pairs = same_keys(salted.groupBy(*on, "_salt").agg(F.lit(0).alias("_any")).drop("_any"), table, on)
    return same_keys(salted, pairs, [*on, "_salt"], "left").drop("_salt")
