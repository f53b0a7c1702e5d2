"""Small helpers on tables: scratch copies, checked broadcasts, and cuts of an ordering at a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.runtime import BROADCAST_ROWS, scratch_path

#: Characters between words, and words, as regular expressions of Java and of RE2.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: ``ORDER_BITS`` of an ordering are narrowed ``STEP_BITS`` at a time.
ORDER_BITS, STEP_BITS = 60, 15


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read from there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``table`` marked for broadcast if it has been counted to hold at most ``rows`` rows, else as it is."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def key_of(column: str | Column) -> Column:
    """A string key that keeps NULL apart from every value."""
    value = F.col(column) if isinstance(column, str) else column
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value.cast("string")))


def order_hash(*columns: Column) -> Column:
    """60 bits of MD5, which other engines can compute as well."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("bigint")


def cuts(rows: DataFrame, budgets: DataFrame, close: float = 0.0) -> DataFrame:
    """Where the ordered rows of each group reach a budget of their sizes.

    ``rows`` has ``group`` (string), ``place`` (0 to 2**60 - 1) and ``size``; ``budgets`` has ``group`` and ``budget``,
    one row per group. Returns ``group, last``: the rows with ``place <= last`` are those before the budget; the
    places at the boundary are taken if that comes at least as near to the budget as leaving them out. Groups
    whose sizes never pass their budget get the largest place. Rows with equal places stay together, and so do
    those of a bucket that holds at most the part ``close`` of its budget.

    No row is sorted: sizes are summed by group and by the leading bits of the place, and only the bucket in which
    a budget falls is read again with more bits, until it holds one place.
    """
    found = stored(budgets.select(
        "group", F.col("budget").cast("double").alias("budget"), F.lit(0).cast("bigint").alias("bucket"), F.lit(0.0).alias("below"),
        F.lit(0.0).alias("inside"), F.lit((1 << ORDER_BITS) - 1).cast("bigint").alias("low"), F.lit(0).cast("bigint").alias("high"), F.lit(True).alias("more")), "cuts")
    few = checked_broadcast(found) is not found
    beside = F.broadcast if few else (lambda table: table)
    over, under = F.col("below") + F.col("inside") - F.col("budget"), F.col("budget") - F.col("below")
    # A group that never passes its budget ends there, with every place before the cut.
    top = {"bucket": 0, "below": 0.0, "inside": 0.0, "low": (1 << ORDER_BITS) - 1, "high": (1 << ORDER_BITS) - 1, "more": False}
    for shift in range(ORDER_BITS - STEP_BITS, -1, -STEP_BITS):
        # The groups are looked up once a round; their budgets travel with the sums, since a broadcast stays with the driver for long.
        open_groups = found.where("more").select("group", "budget", F.col("bucket").alias("prefix"), F.col("below").alias("had"))
        near = rows.select("group", "size", "place", F.shiftright("place", shift).alias("bucket")).join(beside(open_groups), "group")
        sums = near.where(F.shiftright("bucket", STEP_BITS) == F.col("prefix")).groupBy("group", "bucket").agg(
            F.sum("size").cast("double").alias("inside"), F.min("place").alias("low"), F.max("place").alias("high"),
            F.min("budget").alias("budget"), F.min("had").alias("had"))
        run = Window.partitionBy("group").orderBy("bucket")
        total = sums.withColumn("below", F.col("had") + F.sum("inside").over(run) - F.col("inside"))
        more = (F.col("low") < F.col("high")) & (F.col("inside") > F.lit(close) * F.col("budget"))
        passed = total.withColumn("more", more).where(F.col("below") + F.col("inside") > F.col("budget"))
        first = passed.select("group", "budget", F.struct("bucket", "below", "inside", "low", "high", "more").alias("at"))
        # Every open group has a row of its own, so that none is lost.
        left = first.unionByName(open_groups.select("group", "budget"), allowMissingColumns=True).groupBy("group").agg(
            F.min("budget").alias("budget"), F.min("at").alias("at"))
        left = left.select("group", "budget", *[F.coalesce(F.col("at")[c], F.lit(v).cast(found.schema[c].dataType)).alias(c) for c, v in top.items()])
        found = stored(found.where("not more").unionByName(left), "cuts")
        if found.where("more").isEmpty():
            break
    return found.select("group", F.when(over <= under, F.col("high")).otherwise(F.col("low") - 1).alias("last"))
