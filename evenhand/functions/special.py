"""Tail probabilities for test results. Used on result rows only, one per test."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|Z| >= |z|)."""
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2.0)))


def _chi2_tail(x: float, df: float) -> float | None:
    if pd.isna(x) or pd.isna(df) or df < 1:
        return None
    if x <= 0:
        return 1.0
    half = x / 2.0
    if int(df) % 2:
        total, term, k = math.erfc(math.sqrt(half)), math.exp(-half) * math.sqrt(half) / math.gamma(1.5), 1.5
        steps = (int(df) - 1) // 2
    else:
        total, term, k, steps = 0.0, math.exp(-half), 1.0, int(df) // 2
    for _ in range(steps):
        total += term
        term *= half / k
        k += 1.0
    return total


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    """P(chi-squared with ``df`` degrees >= x), by the finite series for whole degrees."""
    return pd.Series([_chi2_tail(a, b) for a, b in zip(x, df)], dtype="float64")
