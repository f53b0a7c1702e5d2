"""Association between columns: correlations, collinearity, mutual information, leakage."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.numeric import as_number, is_numeric, numeric_columns, present, quoted
from tablewright.operators.gram import BLOCK_COLUMNS, pair_correlations
from tablewright.operators.order_stats import exact_quantiles
from tablewright.operators.ranking_values import running_totals
from tablewright.runtime import attach_lookup, cut_lineage, spread

# Fixed values.
HIGH_CORRELATION = 0.95
VIF_MIN_SHOWN = 2.0
VIF_MAX_R2 = 0.99999
VIF_MIN_ROWS = 5
MI_MIN_ROWS = 10
MI_BINS = 10
CLASS_LIMIT = 10
LEAKAGE_CORRELATION = 0.97

_PAIRS = "col_a string, col_b string, correlation double"


def _pairwise_corr(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson r of every pair over the rows where both sides are present, in one scan however many pairs there are."""
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], _PAIRS)
    return pair_correlations(df, columns).drop("rows")


def pearson_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(col_a, col_b, correlation)`` for all pairs of numeric columns."""
    columns = columns or numeric_columns(df)
    return _pairwise_corr(df.select(*[as_number(df, c).alias(c) for c in columns]), columns)


def _ranked(df: DataFrame, groups: list[list[str]], rows: int) -> tuple[DataFrame, dict[str, tuple[int, str]]]:
    """Rows of tie-averaged ranks, and the group and column of each of its columns: ranks over the rows where all of a group are present, else NULL.

    A column's values are counted once, for each of the groups it is in, by one scan for all columns, and its ranks in all of them are looked up by one join.
    ``rows`` is the number of rows of ``df``.
    """
    df = spread(df, rows)
    whole = [reduce(lambda a, b: a & b, [quoted(c).isNotNull() for c in columns]) for columns in groups]
    within: dict[str, list[int]] = {}
    for g, columns in enumerate(groups):
        for c in columns:
            within.setdefault(c, []).append(g)
    slots = [f"__n{j}" for j in range(max(map(len, within.values())))]
    inside = lambda c, j: whole[within[c][j]].cast("int") if j < len(within[c]) else F.lit(0)
    cells = F.array(*[
        F.struct(F.lit(i).alias("__c"), quoted(c).cast("double").alias("__v"), *[inside(c, j).alias(n) for j, n in enumerate(slots)]) for i, c in enumerate(within)])
    counts = df.select(F.inline(cells)).where(F.col("__v").isNotNull()).groupBy("__c", "__v").agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in slots])
    ranks = cut_lineage(running_totals(counts, "__v", slots, ("__c",)))
    out, names = df, {}
    # Rows without a value are dealt out by the others of their values, as they find nothing.
    gap = F.pmod(F.xxhash64(*[quoted(c) for c in within]), F.lit(4096)).cast("int") + 1
    for i, (c, own) in enumerate(within.items()):
        found = [((F.col(f"{n}_before") + (F.col(n) + 1) / 2).cast("double")).alias(f"__r{g}_{i}") for n, g in zip(slots, own)]
        one = ranks.where(F.col("__c") == i).select(F.col("__v").alias(f"__v{i}"), F.lit(0).alias("__gap"), "n", *found)
        keyed = out.withColumns({f"__v{i}": quoted(c).cast("double"), "__gap": F.when(quoted(c).isNull(), gap).otherwise(0)})
        out = attach_lookup(keyed, one, [f"__v{i}", "__gap"], rows, "n").drop(f"__v{i}", "__gap")
        names |= {f"__r{g}_{i}": (g, c) for g in own}
    return out.select(*[F.when(whole[g], F.col(r)).alias(r) for r, (g, _) in names.items()]), names


def spearman_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rank correlation of all pairs: Pearson r of tie-averaged ranks.

    Columns without gaps are ranked once. A pair with gaps is ranked again on the rows where both
    sides are present, as each pair has its own set of rows.
    """
    columns = columns or numeric_columns(df)
    numbers = df.select(*[as_number(df, c).alias(c) for c in columns])
    counts = numbers.agg(F.count("*").alias("rows"), *[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(columns)])
    counts = counts.first()
    rows = counts["rows"]
    full = [c for i, c in enumerate(columns) if counts[f"n{i}"] == rows]
    groups = [full] if len(full) > 1 else []
    groups += [[a, b] for a, b in combinations(columns, 2) if a not in full or b not in full]
    if not groups:
        return df.sparkSession.createDataFrame([], _PAIRS)
    ranked, names = _ranked(numbers, groups, rows)
    # Columns without gaps in one scan, the pairs with gaps by as many as share a block of columns.
    at = {place: r for r, place in names.items()}
    scans = [[at[g, c] for g in part for c in groups[g]] for part in _scans(groups)]
    ranked = cut_lineage(ranked) if len(scans) > 1 else ranked
    place = df.sparkSession.createDataFrame([(r, g, c) for r, (g, c) in names.items()], "r string, g int, c string")
    side = lambda s: F.broadcast(place.select(F.col("r").alias(f"col_{s}"), F.col("g").alias(f"g_{s}"), F.col("c").alias(f"c_{s}")))
    pairs = reduce(DataFrame.unionAll, [_pairwise_corr(ranked, scan) for scan in scans]).join(side("a"), "col_a").join(side("b"), "col_b").where("g_a = g_b")
    return pairs.select(F.col("c_a").alias("col_a"), F.col("c_b").alias("col_b"), "correlation")


def _scans(groups: list[list[str]]) -> list[list[int]]:
    """Groups whose pairs are taken from one scan: together at most a block of columns, or a single group."""
    out, held = [], 0
    for g, columns in enumerate(groups):
        if not out or held + len(columns) > BLOCK_COLUMNS:
            out, held = [*out, []], 0
        out[-1].append(g)
        held += len(columns)
    return out


def high_pairs(matrix: DataFrame, limit: float = HIGH_CORRELATION) -> DataFrame:
    """Pairs whose absolute correlation reaches the limit, strongest first."""
    strength = F.abs("correlation")
    return (
        matrix.where(F.nanvl(strength, F.lit(None).cast("double")) >= limit)
        .withColumn("correlation", strength)
        .orderBy(F.desc("correlation"), "col_a", "col_b")
    )


def variance_inflation(df: DataFrame, columns: list[str] | None = None, shown_from: float = VIF_MIN_SHOWN) -> DataFrame:
    """VIF of each numeric column: the diagonal of the inverse correlation matrix over complete rows.

    The cluster computes the k x k matrix in one pass; only that matrix is inverted on the driver.
    """
    spark = df.sparkSession
    columns = columns or numeric_columns(df)
    schema = "column_name string, vif double"
    if len(columns) < 2:
        return spark.createDataFrame([], schema)
    complete = df.select(*[as_number(df, c).alias(c) for c in columns]).dropna()
    # Columns x columns numbers; the columns of a constant one are NaN.
    pairs = pair_correlations(complete, columns).collect()
    if (pairs[0]["rows"] if pairs else 0) < VIF_MIN_ROWS:
        return spark.createDataFrame([], schema)
    place = {c: i for i, c in enumerate(columns)}
    r = np.eye(len(columns))
    for x in pairs:
        a, b = place[x["col_a"]], place[x["col_b"]]
        r[a, b] = r[b, a] = x["correlation"]
    flat = np.isnan(r).sum(axis=1) == len(columns) - 1
    valid = [c for c, constant in zip(columns, flat) if not constant]
    if len(valid) < 2:
        return spark.createDataFrame([], schema)
    r = r[np.ix_(~flat, ~flat)]
    cap = 1.0 / (1.0 - VIF_MAX_R2)
    # A regression on perfectly collinear inputs keeps working, so each column is solved by least squares.
    items = []
    for i, c in enumerate(valid):
        others = [j for j in range(len(valid)) if j != i]
        beta = np.linalg.lstsq(r[np.ix_(others, others)], r[others, i], rcond=1e-10)[0]
        r2 = min(float(r[others, i] @ beta), VIF_MAX_R2)
        vif = min(1.0 / (1.0 - r2), cap)
        if vif >= shown_from:
            items.append((c, float(vif)))
    return spark.createDataFrame(sorted(items, key=lambda t: (-t[1], t[0])), schema)


def is_classification_target(df: DataFrame, target: str) -> bool:
    """Non-numeric or boolean targets, and numeric ones with at most ten values, are classes."""
    if not is_numeric(df.schema[target].dataType):
        return True
    distinct = df.where(present(df, target)).select(quoted(target)).distinct()
    return distinct.limit(CLASS_LIMIT + 1).count() <= CLASS_LIMIT


def _entropy_terms(counts: Column) -> Column:
    return F.sum(counts * F.log(counts.cast("double")))


def discrete_mutual_information(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Mutual information (nats) between each feature and the target, both taken as classes.

    ``n*MI = S(xy) - S(x) - S(y) + n ln n`` with ``S = sum c ln c``: three nested counts, no join.
    A missing feature value is a class of its own.
    """
    known = df.where(present(df, target))
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.when(present(df, c), quoted(c).cast("string")).alias("x"))
            for c in features
        ]
    )
    joint = known.select(quoted(target).cast("string").alias("y"), F.inline(cells)).groupBy(
        "column_name", "x", "y"
    ).agg(F.count("*").alias("c"))
    s_xy = joint.groupBy("column_name").agg(_entropy_terms(F.col("c")).alias("s_xy"), F.sum("c").alias("n"))
    per_x = joint.groupBy("column_name", "x").agg(F.sum("c").alias("c"))
    per_y = joint.groupBy("column_name", "y").agg(F.sum("c").alias("c"))
    s_x = per_x.groupBy("column_name").agg(_entropy_terms(F.col("c")).alias("s_x"))
    s_y = per_y.groupBy("column_name").agg(_entropy_terms(F.col("c")).alias("s_y"))
    n = F.col("n").cast("double")
    score = (F.col("s_xy") - F.col("s_x") - F.col("s_y")) / n + F.log(n)
    return s_xy.join(s_x, "column_name").join(s_y, "column_name").select(
        "column_name", F.greatest(score, F.lit(0.0)).alias("mi_score")
    )


def bin_column(x: Column, cuts: list[float]) -> Column:
    """Number of cut points at or below the value."""
    total = F.lit(0)
    for cut in cuts:
        total = total + (x >= F.lit(cut)).cast("int")
    return total


def with_bins(df: DataFrame, columns: list[str], bins: int = MI_BINS) -> DataFrame:
    """Numeric columns replaced by equal-frequency bin numbers; a missing value takes the median's bin."""
    exprs = {c: as_number(df, c) for c in columns}
    cuts = exact_quantiles(df, exprs, [i / bins for i in range(1, bins)] + [0.5])
    out = {}
    for c in columns:
        points = [v for v in cuts[c][:-1] if v is not None]
        filled = F.coalesce(exprs[c], F.lit(cuts[c][-1]).cast("double"))
        out[c] = bin_column(filled, sorted(set(points)))
    return df.withColumns(out)


def mutual_information(df: DataFrame, target: str, bins: int = MI_BINS) -> DataFrame:
    """``(column_name, mi_score, spearman_corr)`` of every column with the target, strongest first."""
    known = df.where(present(df, target))
    if known.limit(MI_MIN_ROWS).count() < MI_MIN_ROWS:
        return df.sparkSession.createDataFrame([], "column_name string, mi_score double, spearman_corr double")
    features = [c for c in df.columns if c != target]
    numeric = [c for c in features if is_numeric(df.schema[c].dataType)]
    to_bin = list(numeric)
    if not is_classification_target(known, target):
        to_bin.append(target)
    binned = with_bins(known, to_bin, bins) if to_bin else known
    scores = discrete_mutual_information(binned, features, target)
    ranks = target_rank_correlation(known, target, numeric)
    return scores.join(ranks, "column_name", "left").orderBy(F.desc("mi_score"), "column_name")


def coerced_target(df: DataFrame, target: str) -> Column:
    """The target read as a number; values that are not numbers become NULL."""
    if is_numeric(df.schema[target].dataType):
        return as_number(df, target)
    if isinstance(df.schema[target].dataType, T.BooleanType):
        return quoted(target).cast("double")
    return F.nanvl(quoted(target).cast("string").try_cast("double"), F.lit(None).cast("double"))


def target_rank_correlation(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """Absolute Spearman correlation of numeric features with the target read as a number."""
    schema = "column_name string, spearman_corr double"
    y = coerced_target(df, target)
    if not features or df.where(y.isNotNull()).limit(6).count() <= 5:
        return df.sparkSession.createDataFrame([], schema)
    numbers = df.select(y.alias("__y"), *[as_number(df, c).alias(c) for c in features])
    full = numbers.agg(
        F.count("*").alias("rows"), F.count("__y").alias("y"), *[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(features)]
    ).first()
    whole = [c for i, c in enumerate(features) if full[f"n{i}"] == full["rows"] == full["y"]]
    groups = ([["__y", *whole]] if whole else []) + [["__y", c] for c in features if c not in whole]
    ranked, names = _ranked(numbers, groups, full["rows"])
    at = {place: r for r, place in names.items()}
    # A pair's ranks are NULL on the rows that are not its own.
    found = [(c, F.abs(F.corr(at[g, "__y"], at[g, c]))) for g, (_, *named) in enumerate(groups) for c in named]
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"r{i}").alias("spearman_corr")) for i, (c, _) in enumerate(found)])
    out = ranked.agg(*[r.alias(f"r{i}") for i, (_, r) in enumerate(found)]).select(F.inline(cells))
    return out.withColumn("spearman_corr", F.nanvl("spearman_corr", F.lit(None).cast("double")))


def target_correlation(df: DataFrame, target: str) -> DataFrame:
    """Signed Pearson r of every numeric column with the target read as a number, in one aggregate."""
    features = numeric_columns(df, (target,))
    if not features:
        return df.sparkSession.createDataFrame([], "column_name string, correlation double")
    y = coerced_target(df, target)
    cells = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"r{i}").alias("correlation")) for i, c in enumerate(features)]
    )
    return df.agg(*[F.corr(as_number(df, c), y).alias(f"r{i}") for i, c in enumerate(features)]).select(F.inline(cells))


def leakage_correlation(df: DataFrame, target: str, limit: float = LEAKAGE_CORRELATION) -> DataFrame:
    return target_correlation(df, target).where(F.abs(F.nanvl("correlation", F.lit(None).cast("double"))) >= limit)
