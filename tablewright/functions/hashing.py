"""Deterministic row digests and hash-based uniform numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.numeric import quoted

TWO_60 = 1152921504606846976.0
SHORT_TEXT = 64


def _stable(df: DataFrame, name: str) -> Column:
    c = quoted(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.nanvl(c + F.lit(0.0), F.lit(None).cast("double"))
    return c


def row_digest(df: DataFrame, columns: list[str], salt: int = 0) -> Column:
    """60-bit digest of a row from the MD5 of its values as text, each behind its length, which any SQL engine can recompute.

    NULLs keep their place and differ from every value.
    """
    parts: list[Column] = [F.lit(str(salt))]
    for name in columns:
        value = _stable(df, name)
        value = (F.to_json(value) if isinstance(df.schema[name].dataType, (T.ArrayType, T.MapType, T.StructType)) else value.cast("string"))
        parts.append(F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("bigint")


def text_key(c: Column) -> Column:
    """A grouping key for strings: short ones as they are, long ones by their SHA-256, so texts are not shuffled."""
    return F.when(F.length(c) > SHORT_TEXT, F.concat(F.lit("sha256:"), F.sha2(c, 256))).otherwise(c)


def uniform(digest: Column) -> Column:
    """Uniform number in [0, 1] from a row digest."""
    return digest.cast("double") / F.lit(TWO_60)


def uniform_from_key(*parts: Column) -> Column:
    """Uniform number in [0, 1) from any values, without a shuffle or a random state."""
    return (F.xxhash64(*parts).bitwiseAND(F.lit((1 << 52) - 1))).cast("double") / F.lit(float(1 << 52))
