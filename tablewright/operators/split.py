"""Leakage-safe splits and folds: rows with equal features always stay together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.hashing import row_digest, uniform
from tablewright.functions.numeric import as_number, numeric_columns, quoted
from tablewright.operators.order_stats import order_values
from tablewright.runtime import attach_lookup, cut_lineage

# Fixed value: share of the rows left after the test part.
VALIDATION_SHARE = 0.2
SLICES = 4096
#: Rows of a table of classes or slices that may be broadcast.
SMALL_ROWS = 1_000_000
GROUP = "__group"


def with_groups(df: DataFrame, features: list[str], name: str = GROUP) -> DataFrame:
    """Adds the id of the group of identical feature rows."""
    return df.withColumn(name, row_digest(df, features))


def split_by_draw(u: Column, test_size: float = 0.2) -> Column:
    """Split name from a uniform number per group: no shuffle, groups whole by construction."""
    validation = (1.0 - test_size) * VALIDATION_SHARE
    return F.when(u < test_size, "test").when(u < test_size + validation, "val").otherwise("train")


def hash_split(df: DataFrame, features: list[str], test_size: float = 0.2, seed: int = 42) -> DataFrame:
    return df.withColumn("split", split_by_draw(uniform(row_digest(df, features, salt=seed)), test_size))


def _group_table(grouped: DataFrame, label: str | None) -> DataFrame:
    """One row per group: its size and majority class (the smallest class wins a tie)."""
    if label is None:
        return grouped.groupBy(GROUP).agg(F.count("*").alias("n")).withColumn("class", F.lit("all"))
    per_class = grouped.groupBy(GROUP, quoted(label).alias("class")).agg(F.count("*").alias("c"))
    return per_class.groupBy(GROUP).agg(
        F.sum("c").alias("n"), F.min_by("class", F.struct(-F.col("c"), F.col("class"))).alias("class")
    )


def _draw(seed: int) -> Column:
    """Uniform number of a group, from the MD5 of seed and id, which any SQL engine can compute."""
    return uniform(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(GROUP).cast("string"))), 1, 15), 16, 10).cast("bigint"))


def _beside(table: DataFrame) -> DataFrame:
    """A table of classes or of their slices for a broadcast, if a count finds it small; else it is shuffled."""
    table = cut_lineage(table)
    return F.broadcast(table) if table.count() <= SMALL_ROWS else table


def quota_split(
    df: DataFrame, features: list[str], label: str | None = None, test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Split with row quotas per class: groups whole, test and validation filled in hash order.

    Groups of a class are counted in 4096 slices of their hash; only a slice that straddles a quota is ordered group by group, so no class is sorted as a
    whole. Quotas, and running sums over slices, are small tables that go to the groups, which do not move for them. A group larger than the
    validation quota trains, unless its class has no smaller one.
    """
    grouped = with_groups(df, features)
    total = df.count()
    groups = _group_table(grouped, label).withColumn("u", _draw(seed))
    groups = cut_lineage(groups).withColumn("slice", F.floor(F.col("u") * SLICES).cast("int"))
    validation = (1.0 - test_size) * VALIDATION_SHARE
    quota = lambda share: F.greatest(F.lit(1), F.round(F.sum("n") * F.lit(share)).cast("bigint"))
    quotas = groups.groupBy("class").agg(
        quota(test_size).alias("for_test"), quota(validation).alias("for_val"), F.min("n").alias("least")
    )
    quotas = _beside(quotas.withColumnRenamed("class", "q_class"))
    sized = groups.join(quotas, F.col("class").eqNullSafe(F.col("q_class"))).drop("q_class")
    fits = F.col("n") <= F.greatest("for_val", "least")
    before = Window.partitionBy("class").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        sized.where(fits)
        .groupBy("class", "slice")
        .agg(F.sum("n").alias("slice_rows"))
        .select(
            F.col("class").alias("s_class"), F.col("slice").alias("s_slice"), "slice_rows",
            F.coalesce(F.sum("slice_rows").over(before), F.lit(0)).alias("slice_start"),
        )
    )
    placed = sized.where(fits).join(
        _beside(slices), F.col("class").eqNullSafe(F.col("s_class")) & (F.col("slice") == F.col("s_slice"))
    )
    inside = Window.partitionBy("class", "slice").orderBy("u", GROUP).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("slice_start") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    slice_end = F.col("slice_start") + F.col("slice_rows")
    straddles = lambda end: (F.col("slice_start") < end) & (slice_end > end)

    # The last test group may reach past its quota; validation starts where it ends.
    whole = placed.where(slice_end <= F.col("for_test")).select("class", slice_end.alias("end"))
    partly = placed.where(straddles(F.col("for_test"))).withColumn("start", start).where("start < for_test").select(
        "class", (F.col("start") + F.col("n")).alias("end")
    )
    ends = whole.unionByName(partly).groupBy(F.col("class").alias("e_class")).agg(F.max("end").alias("test_end"))
    placed = placed.join(_beside(ends), F.col("class").eqNullSafe(F.col("e_class")))
    val_end = F.col("test_end") + F.col("for_val")
    name = lambda at: F.when(at < F.col("for_test"), "test").when(at < val_end, "val").otherwise("train")
    edge = straddles(F.col("for_test")) | straddles(val_end)
    assigned = (
        placed.where(~edge).select(GROUP, "n", name(F.col("slice_start")).alias("split"))
        .unionByName(placed.where(edge).withColumn("start", start).select(GROUP, "n", name(F.col("start")).alias("split")))
        .unionByName(sized.where(~fits).select(GROUP, "n", F.lit("train").alias("split")))
    )
    return attach_lookup(grouped, assigned, [GROUP], total, "n").drop(GROUP)


def order_of(df: DataFrame, order_col: str) -> Column:
    """A time or number as a DOUBLE that sorts alike."""
    if df.schema[order_col].dataType.simpleString().startswith(("timestamp", "date")):
        return F.unix_micros(quoted(order_col).cast("timestamp")).cast("double")
    return as_number(df, order_col)


def sequential_split(df: DataFrame, order_col: str, test_size: float = 0.2) -> DataFrame:
    """Split by time: the oldest rows train, the newest test. Rows with equal times stay on one side."""
    order = order_of(df, order_col)

    # A cut is the largest value of the part that ends there, so ties never cross it.
    def ends(rows: int) -> list[int]:
        n_test = int(rows * test_size)
        n_train = rows - n_test - int((rows - n_test) * VALIDATION_SHARE)
        return [max(n_train - 1, 0), max(rows - n_test - 1, 0)] if rows > 1 else []

    cuts = order_values(df, order, ends)
    if not cuts:
        return df.withColumn("split", F.lit("train"))
    train_end, val_end = cuts
    return df.withColumn(
        "split", F.when(order <= train_end, "train").when(order <= val_end, "val").otherwise("test")
    )


def assign_folds(
    df: DataFrame, features: list[str], folds: int = 5, label: str | None = None, seed: int = 42
) -> DataFrame:
    """Adds ``fold``. Without a label the fold comes from the group hash alone (no shuffle).

    With a label each class deals its groups to the folds in turn, in hash order within 4096 slices;
    the position inside a class is the count of groups in earlier slices plus the place in the slice.
    """
    if label is None:
        digest = row_digest(df, features, salt=seed)
        return df.withColumn("fold", F.pmod(digest, F.lit(folds)).cast("int"))
    grouped = with_groups(df, features)
    groups = _group_table(grouped, label).withColumn("u", _draw(seed + 1))
    groups = cut_lineage(groups).withColumn("slice", F.floor(F.col("u") * SLICES).cast("int"))
    slices = groups.groupBy("class", "slice").agg(F.count("*").alias("size"))
    before = Window.partitionBy("class").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(
        F.col("class").alias("s_class"), F.col("slice").alias("s_slice"),
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"),
    )
    placed = groups.join(_beside(slices), F.col("class").eqNullSafe(F.col("s_class")) & (F.col("slice") == F.col("s_slice")))
    place = F.col("start") + F.row_number().over(Window.partitionBy("class", "slice").orderBy("u", GROUP)) - 1
    dealt = placed.select(GROUP, "n", F.pmod(place, F.lit(folds)).cast("int").alias("fold"))
    return attach_lookup(grouped, dealt, [GROUP], df.count(), "n").drop(GROUP)


def forward_folds(df: DataFrame, order_col: str, folds: int = 5, among: Column | None = None) -> DataFrame:
    """Adds ``fold`` for forward chaining: the newest ``folds`` parts of equal size are folds 0 and up, all older rows are -1.

    Fold i is judged by a model of the rows with a smaller fold number, so nothing of its future is in the fit. The cuts are exact order values of the rows
    ``among`` (all by default); equal times stay in one fold, the older one. Rows without a time, or not ``among``, have no fold.
    """
    order = order_of(df, order_col)
    kept = order if among is None else F.when(among, order)

    def ends(rows: int) -> list[int]:
        size = rows // (folds + 1)
        return [rows - (folds - i) * size - 1 for i in range(folds)] if size else []

    cuts = order_values(df, kept, ends)
    if not cuts:
        raise ValueError(f"{folds} forward folds need at least {folds + 1} rows with a time")
    fold = sum(((kept > F.lit(cut)).cast("int") for cut in cuts), F.lit(-1))
    return df.withColumn("fold", F.when(kept.isNotNull(), fold).cast("int"))


def fold_strategy(df: DataFrame, features: list[str], is_classification: bool) -> str:
    """Name of the fold rule: by groups when rows repeat, stratified for classes."""
    counts = with_groups(df, features).groupBy(GROUP).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    grouped = "Group" if (counts or 0) > 1 else ""
    return f"{'Stratified' if is_classification else ''}{grouped}KFold"


def split_overlap(splits: DataFrame, features: list[str], split: str = "split", digits: int = 8) -> DataFrame:
    """Distinct rounded feature rows shared by each pair of splits; all zero for disjoint splits."""
    numeric = set(numeric_columns(splits))
    cells = [
        F.round(as_number(splits, c), digits).alias(c) if c in numeric else quoted(c) for c in features
    ]
    seen = splits.select(*cells, F.col(split).alias("__s")).groupBy(*[quoted(c) for c in features]).agg(
        *[F.max((F.col("__s") == s).cast("int")).alias(s) for s in ("train", "val", "test")]
    )
    both = lambda a, b: F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0))
    return seen.agg(
        both("train", "val").alias("train_val"), both("train", "test").alias("train_test"),
        both("val", "test").alias("val_test"),
    )
