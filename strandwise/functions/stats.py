"""Aggregate expressions and small numeric helpers shared by the operators."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLOATS = (T.DoubleType, T.FloatType)
_NUMBERS = (T.NumericType,)


def is_float(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, _FLOATS)


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, _NUMBERS)


def present(df: DataFrame, name: str) -> Column:
    """Condition: the value is there. NaN counts as missing."""
    c = F.col(f"`{name}`")
    return c.isNotNull() & ~F.isnan(c) if is_float(df, name) else c.isNotNull()


def cleaned(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into null."""
    c = F.col(f"`{name}`")
    return F.nanvl(c, F.lit(None).cast("double")) if is_float(df, name) else c


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """Wide to long over numeric columns: (ids, name, value double), NaN as null."""
    wide = df.select(*ids, *[cleaned(df, c).cast("double").alias(c) for c in columns])
    return wide.unpivot(ids, columns, name, value)


def ratio_or_zero_rule(error: Column, spread: Column) -> Column:
    """``1 - error / spread``; when the spread is 0: 1.0 without error, else 0.0."""
    return F.when(spread == 0, F.when(error == 0, 1.0).otherwise(0.0)).otherwise(
        1 - F.try_divide(error, spread)
    )


def _log_beta_half(a: float) -> float:
    """log B(a, 1/2); the series is used where the difference of lgammas cancels."""
    if a > 1e6:
        # log(Gamma(a + 1/2) / Gamma(a)) = log(a)/2 - 1/(8a) + O(a^-3)
        return 0.5 * math.log(math.pi) - (0.5 * math.log(a) - 1 / (8 * a))
    return math.lgamma(a) + math.lgamma(0.5) - math.lgamma(a + 0.5)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (DLMF 8.17.22)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    result = d
    for m in range(1, 10_000):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            c = 1.0 + numerator / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            step = c * d
            result *= step
        if abs(step - 1.0) < 1e-14:
            break
    return result


def correlation_p_value(r: float | None, n: float | None) -> float | None:
    """Two-sided p-value of a correlation: t with n - 2 degrees of freedom.

    Equal to the regularised incomplete beta function I_{1-r^2}((n-2)/2, 1/2).
    """
    if r is None or n is None or math.isnan(r) or math.isnan(n) or n < 2:
        return None
    if n == 2:
        return 1.0
    square = min(r * r, 1.0)
    if square == 1.0:
        return 0.0
    if square == 0.0:
        return 1.0
    a, b, x = (n - 2) / 2, 0.5, 1.0 - square
    front = math.exp(a * math.log1p(-square) + b * math.log(square) - _log_beta_half(a))
    if x < (a + 1) / (a + b + 2):
        return min(front * _beta_fraction(a, b, x) / a, 1.0)
    return max(1.0 - front * _beta_fraction(b, a, square) / b, 0.0)


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Arrow-batched; only ever applied to one row per target."""
    return pd.Series([correlation_p_value(x, k) for x, k in zip(r, n)], dtype="float64")
