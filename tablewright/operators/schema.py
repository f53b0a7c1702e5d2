"""Schema report: null and distinct counts, samples, and a semantic type per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.hashing import text_key
from tablewright.functions.numeric import is_numeric, is_whole, present, quoted
from tablewright.functions.text import (
    LATITUDE_NAMES,
    LONGITUDE_NAMES,
    has_date_hint,
    is_id_name,
    matches,
    word_count,
)
from tablewright.runtime import bounded_parts

# Samples shown, and limits of the type decision, which looks at all values.
SHOWN_SAMPLES = 3
#: Cells whose values a task counts, and classes of keys that each name a smallest one.
COUNTED_CELLS, KEY_CLASSES = 1_000_000, 16
PHONE_MIN_SAMPLE = 3
HIGH_CARDINALITY_RATIO = 0.80
TEXT_WORDS = 5
PATTERN_TYPES = ("email", "ip_address", "url", "uuid", "phone_number")


def _as_text(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    c = quoted(name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        c = c + F.lit(0.0)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        c = F.to_json(c)
    return F.when(present(df, name), c.cast("string"))


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_name, value, n)`` over all columns: one shuffle of values already counted per task.

    Long strings stand as their digest. A task counts a bounded number of cells, so that mostly different values do not fill its memory.
    """
    columns = columns or df.columns
    keyed = bounded_parts(df.select(*[text_key(_as_text(df, c)).alias(f"c{i}") for i, c in enumerate(columns)]), df.count(), COUNTED_CELLS)
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("value")) for i, c in enumerate(columns)])
    return keyed.select(F.inline(cells)).groupBy("column_name", "value").agg(F.count("*").alias("n"))


def column_counts(df: DataFrame) -> DataFrame:
    """Null and distinct counts per column, in two aggregation steps instead of many distinct counts."""
    return value_counts(df).groupBy("column_name").agg(
        F.sum("n").alias("num_rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("null_count"),
        F.count("value").alias("unique_count"),
    )


def first_values(df: DataFrame, key: str, size: int = SHOWN_SAMPLES) -> DataFrame:
    """``(column_name, values)``: the first non-null values of each column in key order.

    Two scans. The first takes, per column, the smallest key of every class of keys: ``size`` of these bound the keys of the rows wanted, so the second orders
    only a few rows. A column with fewer classes has no bound.
    """
    k = quoted(key)
    least = df.groupBy(F.pmod(F.xxhash64(k), F.lit(KEY_CLASSES)).alias("__class")).agg(*[F.min(F.when(present(df, c), k)).alias(f"__k{i}") for i, c in enumerate(df.columns)])
    bounds = least.agg(F.struct(*[F.get(F.sort_array(F.collect_list(f"__k{i}")), F.lit(size - 1)).alias(f"__b{i}") for i in range(len(df.columns))])).scalar()
    early = lambda i: F.coalesce(k <= F.col("__bounds")[f"__b{i}"], F.lit(True))
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.when(early(i), _as_text(df, c)).alias("value")) for i, c in enumerate(df.columns)])
    rows = df.withColumn("__bounds", bounds).select(k.alias("__key"), F.inline(cells)).where(F.col("value").isNotNull())
    place = F.row_number().over(Window.partitionBy("column_name").orderBy("__key", "value"))
    kept = rows.withColumn("place", place).where(F.col("place") <= size)
    ordered = F.sort_array(F.collect_list(F.struct("place", "value")))
    return kept.groupBy("column_name").agg(F.transform(ordered, lambda s: s["value"]).alias("values"))


def text_facts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, seen, all_dates, email, ..., middle)``: what holds for all values of each text column, in one scan.

    ``middle`` is the median count of words.
    """
    spark = df.sparkSession
    kinds = ", ".join(f"{k} boolean" for k in PATTERN_TYPES)
    if not columns:
        return spark.createDataFrame([], f"column_name string, seen bigint, all_dates boolean, {kinds}, middle double")
    sure = lambda c: F.coalesce(c, F.lit(False))

    def facts(name: str) -> Column:
        v = _as_text(df, name)
        every = lambda c: F.coalesce(F.every(F.when(v.isNotNull(), sure(c))), F.lit(True))
        return F.struct(
            F.lit(name).alias("column_name"), F.count(v).alias("seen"), every(F.try_to_timestamp(v).isNotNull()).alias("all_dates"),
            *[every(matches(v, k)).alias(k) for k in PATTERN_TYPES],
            F.coalesce(F.percentile(F.when(v.isNotNull(), word_count(v)), 0.5), F.lit(0.0)).alias("middle"))

    return df.agg(*[facts(c).alias(f"f{i}") for i, c in enumerate(columns)]).select(F.inline(F.array(*[F.col(f"f{i}") for i in range(len(columns))])))


def infer_schema(df: DataFrame, key: str) -> DataFrame:
    """The schema report. Types are decided on all values; the samples shown are the first in ``key`` order."""
    spark = df.sparkSession
    facts, texts, coordinates = [], [], []
    for position, field in enumerate(df.schema.fields):
        dtype, lower = field.dataType, field.name.lower()
        is_text = isinstance(dtype, T.StringType)
        texts += [field.name] if is_text else []
        kind = (
            "datetime" if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))
            else "boolean" if isinstance(dtype, T.BooleanType)
            else "whole" if is_whole(dtype)
            else "real" if is_numeric(dtype)
            else "text" if is_text
            else "other"
        )
        limit = 90.0 if lower in LATITUDE_NAMES else 180.0 if lower in LONGITUDE_NAMES else None
        if limit and is_numeric(dtype):
            coordinates.append((field.name, limit))
        facts.append((field.name, position, dtype.simpleString(), kind, has_date_hint(field.name)))
    facts_table = spark.createDataFrame(
        facts, "column_name string, position int, dtype string, kind string, date_hint boolean"
    )
    if coordinates:
        cells = F.array(
            *[F.struct(F.lit(c).alias("column_name"), F.col(f"in{i}").alias("spatial"))
              for i, (c, _) in enumerate(coordinates)]
        )
        spatial = df.agg(
            *[
                F.every(F.when(present(df, c), quoted(c).cast("double").between(-limit, limit))).alias(f"in{i}")
                for i, (c, limit) in enumerate(coordinates)
            ]
        ).select(F.inline(cells))
    else:
        spatial = spark.createDataFrame([], "column_name string, spatial boolean")

    some = F.col("seen") > 0
    ratio = F.col("unique_count") / F.greatest(F.col("num_rows"), F.lit(1))
    text_type = (
        F.when(F.col("date_hint") & F.col("all_dates"), "datetime")
        .when(some & F.col("email"), "email")
        .when(some & F.col("ip_address"), "ip_address")
        .when(some & F.col("url"), "url")
        .when(some & F.col("uuid"), "uuid")
        .when((F.col("seen") >= PHONE_MIN_SAMPLE) & F.col("phone_number"), "phone_number")
        .when(F.col("middle") >= TEXT_WORDS, "text")
        .when(ratio >= HIGH_CARDINALITY_RATIO, "high_cardinality")
        .otherwise("categorical")
    )
    inferred = (
        F.when(F.coalesce(F.col("num_rows"), F.lit(0)) == 0, "unknown")
        .when(F.col("kind") == "datetime", "datetime")
        .when(F.col("kind") == "boolean", "boolean")
        .when((F.col("kind") == "whole") & (F.col("unique_count") <= 2), "boolean")
        .when(F.col("kind").isin("whole", "real"), F.when(F.col("spatial"), "spatial_coords").otherwise("numeric"))
        .when(F.col("kind") == "text", text_type)
        .otherwise("unknown")
    )
    percent = lambda c: F.coalesce(F.try_divide(F.col(c) * F.lit(100.0), F.col("num_rows")), F.lit(0.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (
        facts_table.join(column_counts(df), "column_name", "left")
        .join(first_values(df, key), "column_name", "left")
        .join(text_facts(df, texts), "column_name", "left")
        .join(spatial, "column_name", "left")
        .select(
            "column_name", "position", "dtype", inferred.alias("inferred_type"),
            zero("null_count"), percent("null_count").alias("null_pct"),
            zero("unique_count"), percent("unique_count").alias("unique_pct"),
            F.coalesce("values", F.array().cast("array<string>")).alias("sample_values"),
        )
    )


def identifier_columns(columns: list[str], target: str | None = None) -> list[str]:
    return [c for c in columns if is_id_name(c, target)]


def drop_identifiers(df: DataFrame, target: str | None = None) -> DataFrame:
    return df.drop(*identifier_columns(df.columns, target))


def tag_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """The same table with each semantic type kept in its column metadata."""
    for name, semantic in types.items():
        df = df.withMetadata(name, {**df.schema[name].metadata, "semantic_type": semantic})
    return df
