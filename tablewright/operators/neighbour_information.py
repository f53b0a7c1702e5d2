"""Mutual information with continuous columns from neighbour counts, on all rows, in blocks of bounded size."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.hashing import row_digest, uniform
from tablewright.functions.numeric import as_number, finite_or_null, is_numeric, present, quoted
from tablewright.operators.association import discrete_mutual_information, is_classification_target
from tablewright.operators.order_stats import exact_quantiles

NEIGHBOURS = 3
#: Rows of a block; the work grows with rows x BLOCK_ROWS.
BLOCK_ROWS = 2048
#: Width of the noise that parts equal values, relative to the scaled column.
JITTER = 1e-10
EULER_GAMMA = 0.5772156649015329
#: Rows of a block whose distances are held at a time.
STRIPE = 256
BLOCK_SALT, FIRST_SALT = 0, 1

_SCORES = "column_name string, mi_score double"
_PARTS = "feature int, n long, total double"


def digamma_table(most: int) -> np.ndarray:
    """The digamma function at 0 (unused), 1, ..., ``most``: harmonic numbers less Euler's constant."""
    return np.concatenate(([np.nan, 0.0], np.cumsum(1.0 / np.arange(1, max(most, 1))))) - EULER_GAMMA


def _stripes(n: int):
    return (slice(s, s + STRIPE) for s in range(0, n, STRIPE))


def continuous_information(x: np.ndarray, y: np.ndarray, k: int = NEIGHBOURS) -> tuple[int, float]:
    """Rows that count and the estimate for two continuous columns (Kraskov, Stoegbauer, Grassberger, first form).

    A row's reach is the distance of its k-th neighbour in the maximum metric; fewer rows than k + 1 lower k.
    """
    n = len(x)
    if n < 2:
        return 0, 0.0
    k = min(k, n - 1)
    psi, total = digamma_table(n), 0.0
    for s in _stripes(n):
        dx, dy = np.abs(x[s, None] - x), np.abs(y[s, None] - y)
        # Entry 0 is the row itself.
        reach = np.partition(np.maximum(dx, dy), k, axis=1)[:, k, None]
        for d in (dx, dy):
            total -= psi[np.maximum((d < reach).sum(axis=1), 1)].sum()
    return n, float(psi[n] + psi[k] + total / n)


def class_information(x: np.ndarray, labels: np.ndarray, k: int = NEIGHBOURS) -> tuple[int, float]:
    """Rows that count and the estimate for a continuous column and classes (Ross).

    A row's reach is the distance of its k-th neighbour of the same class; a class of fewer rows lowers k, and one of a single row is left out.
    """
    _, labels, sizes = np.unique(labels, return_inverse=True, return_counts=True)
    kept = sizes[labels] > 1
    x, labels = x[kept], labels[kept]
    n = len(x)
    if n == 0:
        return 0, 0.0
    size = sizes[labels]
    reached = np.minimum(k, size - 1)
    psi, total = digamma_table(n), 0.0
    for s in _stripes(n):
        d = np.abs(x[s, None] - x)
        own = np.where(labels[s, None] == labels, d, np.inf)
        nearest = np.partition(own, range(1, min(k, n - 1) + 1), axis=1)
        reach = nearest[np.arange(len(d)), reached[s]][:, None]
        total -= psi[np.maximum((d < reach).sum(axis=1), 1)].sum()
    return n, float(psi[n] + (psi[reached].sum() - psi[size].sum() + total) / n)


def _block_scores(features: int, classes: set[int], target: int, k: int):
    """Scores of one block for each of the columns 0 to ``features``; column ``target`` is the target."""

    def scores(block: pd.DataFrame) -> pd.DataFrame:
        cells = [block[f"c{i}"].to_numpy() for i in range(features + 1)]
        y, rows = cells[target], []
        for i in range(features):
            if target in classes:
                n, score = class_information(cells[i], y, k)
            elif i in classes:
                n, score = class_information(y, cells[i], k)
            else:
                n, score = continuous_information(cells[i], y, k)
            rows.append((i, n, n * score))
        return pd.DataFrame(rows, columns=["feature", "n", "total"])

    return scores


def _scaled(df: DataFrame, key: str, columns: list[str]) -> list[Column]:
    """Each column over its deviation, gaps at the median, with noise that depends on the row's key and the column's place."""
    raw = {c: finite_or_null(as_number(df, c)) for c in columns}
    fills = exact_quantiles(df, raw, [0.5])
    filled = {c: F.coalesce(raw[c], F.lit(float(fills[c][0] or 0.0))) for c in columns}
    found = df.agg(*[f(filled[c]) for c in columns for f in (F.stddev_pop, lambda x: F.avg(F.abs(x)))]).first()
    out = []
    for i, c in enumerate(columns):
        deviation = found[2 * i] if found[2 * i] and math.isfinite(found[2 * i]) else 1.0
        width = JITTER * max(1.0, (found[2 * i + 1] or 0.0) / deviation)
        noise = uniform(row_digest(df, [key], FIRST_SALT + i)) - F.lit(0.5)
        out.append(filled[c] / F.lit(deviation) + noise * F.lit(width))
    return out


def neighbour_mutual_information(
    df: DataFrame, key: str, target: str, features: list[str] | None = None, k: int = NEIGHBOURS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``(column_name, mi_score)`` in nats of every feature with the target, strongest first.

    Two columns of classes are counted exactly. If one or both are continuous, the digest of ``key`` deals all rows to blocks
    of about ``block_rows``, a task estimates the score of each feature within a block, and the blocks' scores are averaged by
    rows. A table of at most ``block_rows`` rows is one block, which is the plain estimator. Classes with a single row in a
    block do not count there, so a feature with about as many classes as a block has rows scores low.

    ``key`` should be unique: rows that share one share a block. Rows without a target are left out. Gaps and infinities of a numeric
    feature become its median, a missing class is a class of its own; a numeric target is continuous from eleven values on.
    Equal values are parted by noise of 1e-10 of the deviation, which depends on the key, so reruns agree. No rows give no scores above 0.
    """
    features = [c for c in df.columns if c not in (key, target)] if features is None else features
    spark, known = df.sparkSession, df.where(present(df, target))
    by_class = is_classification_target(known, target)
    if not by_class:
        known = known.where(finite_or_null(as_number(known, target)).isNotNull())
    numbers = [c for c in features if is_numeric(df.schema[c].dataType)]
    counted = [c for c in features if c not in numbers] if by_class else []
    estimated = [c for c in features if c not in counted]
    out = discrete_mutual_information(known, counted, target) if counted else spark.createDataFrame([], _SCORES)
    if estimated:
        columns = [*estimated, target]
        continuous = [c for c in columns if c in numbers or (c == target and not by_class)]
        cells = dict(zip(continuous, _scaled(known, key, continuous)))
        classes = {i for i, c in enumerate(columns) if c not in cells}
        for c in columns:
            if c not in cells:
                cells[c] = F.when(present(known, c), F.xxhash64(quoted(c).cast("string"))).otherwise(F.lit(0))
        blocks = max(1, math.ceil(known.count() / block_rows))
        dealt = known.select(
            F.pmod(row_digest(known, [key], BLOCK_SALT), F.lit(blocks)).alias("block"), *[cells[c].alias(f"c{i}") for i, c in enumerate(columns)])
        parts = dealt.groupBy("block").applyInPandas(_block_scores(len(estimated), classes, len(estimated), k), _PARTS)
        means = parts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        score = F.when(F.col("n") > 0, F.greatest(F.col("total") / F.col("n"), F.lit(0.0))).otherwise(0.0)
        name = F.element_at(F.array(*[F.lit(c) for c in estimated]), F.col("feature") + 1)
        out = out.unionByName(means.select(name.alias("column_name"), score.alias("mi_score")))
    return out.orderBy(F.desc("mi_score"), "column_name")
