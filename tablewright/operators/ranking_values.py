"""Running totals and tie-averaged ranks over distinct values, without a single global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.runtime import cut_lineage

#: Slices in which values of a group are ordered on their own.
SLICES = 64


def running_totals(counts: DataFrame, value: str, sums: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """For one row per distinct ``value`` of each group, add ``<sum>_before``: the total over all smaller values of the group.

    Values are cut in slices by sketched quantiles of the distinct values, so that a heavy value cannot fill a slice; each slice is ordered on its own and
    shifted by the totals of the slices before it. The sketch decides how even the slices are, never what comes out. Groups are few (columns, classes).
    """
    counts = cut_lineage(counts)
    points = F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)])
    # One row of cuts per group, and later one row per group and slice.
    cuts = counts.groupBy(*by).agg(F.percentile_approx(value, points, F.lit(8 * SLICES)).alias("__cuts"))
    placed = counts.join(F.broadcast(cuts), list(by)) if by else counts.withColumn("__cuts", F.lit(cuts.first()[0]).cast("array<double>"))
    # The place of the value among the sorted cuts is how many of them are smaller.
    place = F.array_position(F.sort_array(F.array_append("__cuts", F.col(value).cast("double"))), F.col(value).cast("double")) - 1
    sliced = placed.withColumn("__slice", F.coalesce(place, F.lit(0)).cast("int")).drop("__cuts")
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*by, "__slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        sliced.groupBy(*by, "__slice")
        .agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
        .select(*by, "__slice", *[F.coalesce(F.sum(f"__t_{s}").over(before), F.lit(0)).alias(f"__s_{s}") for s in sums])
    )
    joined = sliced.join(F.broadcast(shifts), [*by, "__slice"])
    return joined.select(
        *counts.columns,
        *[(F.coalesce(F.sum(s).over(inside), F.lit(0)) + F.col(f"__s_{s}")).alias(f"{s}_before") for s in sums],
    )


def tie_ranks(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, value, n, rank)``: the average rank shared by all rows of a group that carry the value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    totals = running_totals(counts, value, ["n"], by)
    return totals.select(*by, value, "n", (F.col("n_before") + (F.col("n") + 1) / 2).cast("double").alias("rank"))
