"""Numeric column expressions: missing-value rules and sample statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_REAL = (T.FloatType, T.DoubleType)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (*_REAL, *_WHOLE, T.DecimalType))


def is_whole(dtype: T.DataType) -> bool:
    return isinstance(dtype, _WHOLE)


def numeric_columns(df: DataFrame, skip: tuple[str, ...] | list[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in skip]


def quoted(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_number(df: DataFrame, name: str) -> Column:
    """The column as DOUBLE with NaN turned into NULL (a missing value either way)."""
    c = quoted(name)
    if isinstance(df.schema[name].dataType, _REAL):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    return c.cast("double")


def present(df: DataFrame, name: str) -> Column:
    """True where the column holds a value; NaN counts as missing."""
    c = quoted(name)
    if isinstance(df.schema[name].dataType, _REAL):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()


def finite_or_null(c: Column) -> Column:
    """NaN and both infinities become NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def adjusted_skewness(n: int, g1: float | None) -> float | None:
    """Bias-corrected skewness from the population value; None below three values, 0 for a constant."""
    return (g1 or 0.0) * math.sqrt(n * (n - 1)) / (n - 2) if n > 2 else None


def adjusted_kurtosis(n: int, g2: float | None) -> float | None:
    """Bias-corrected excess kurtosis; None below four values, 0 for a constant."""
    if n <= 3:
        return None
    return 0.0 if g2 is None else (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)


def normality_p(n: int, g1: float | None, g2: float | None) -> float | None:
    """p-value of the D'Agostino-Pearson K2 test from n, population skewness and excess kurtosis."""
    if n < 20 or g1 is None or g2 is None:
        return None
    y = g1 * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (beta - 1)) - 1
    z1 = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
    mean = 3 * (n - 1) / (n + 1)
    variance = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (g2 + 3 - mean) / math.sqrt(variance)
    skew_b2 = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / skew_b2 * (2 / skew_b2 + math.sqrt(1 + 4 / skew_b2**2))
    d = 1 + x * math.sqrt(2 / (a - 4))
    if d == 0:
        return None
    z2 = (1 - 2 / (9 * a) - math.copysign(math.cbrt((1 - 2 / a) / abs(d)), d)) / math.sqrt(2 / (9 * a))
    return math.exp(-(z1 * z1 + z2 * z2) / 2)


def plain_round(c: Column, digits: int) -> Column:
    """Rounding that never leaves a negative zero behind."""
    return F.round(c, digits) + F.lit(0.0)
