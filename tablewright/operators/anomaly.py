"""Multivariate anomalies: isolation forest, local outlier factor, their consensus and what to do with it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.hashing import uniform_from_key
from tablewright.functions.numeric import as_number, numeric_columns, quoted
from tablewright.operators.neighbours import local_outlier_factor
from tablewright.operators.order_stats import exact_quantiles
from tablewright.runtime import cut_lineage, spread

# Fixed values.
TREES = 50
TREE_ROWS = 256
SEED = 42
SCORE_LIMIT = 0.5
NEIGHBOURS = 20
LOF_LIMIT = 1.5
REMOVAL_LIMIT_PCT = 5.0
FLAG_COLUMN = "_anomaly_flag"
EULER = 0.5772156649015329


def usable_columns(df: DataFrame, skip: tuple[str | None, ...] = ()) -> list[str]:
    """Numeric columns that vary, without the skipped ones (key and target)."""
    columns = numeric_columns(df, skip)
    if not columns:
        return []
    spread = df.agg(*[F.stddev_samp(as_number(df, c)).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if (spread[i] or 0.0) > 0]


def median_filled(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``(key, vec)`` with gaps filled by the column median."""
    exprs = {c: as_number(df, c) for c in columns}
    medians = exact_quantiles(df, exprs, [0.5])
    cells = [F.coalesce(exprs[c], F.lit(medians[c][0]).cast("double")) for c in columns]
    return df.select(quoted(key).alias(key), F.array(*cells).alias("vec"))


def _average_path(n: np.ndarray | float) -> np.ndarray:
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + EULER
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


_NODE = "tree int, node int, feature int, split double, path double, psi int"


def grow_forest(points: DataFrame, key: str, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED) -> DataFrame:
    """Node table of an isolation forest over ``(key, vec)``.

    Each tree takes about ``tree_rows`` rows chosen by a hash of tree and key: one pass, no sort of the
    table, and every tree is grown from its own small group. Leaves carry the path length they stand for.
    """
    total = points.count()
    share = 1.0 if total <= tree_rows else min(1.0, (tree_rows + 8 * tree_rows**0.5) / total)
    chosen = points.withColumn(
        "tree",
        F.explode(
            F.filter(
                F.sequence(F.lit(0), F.lit(trees - 1)),
                lambda t: uniform_from_key(F.lit(seed), t, F.col(key)) < F.lit(share),
            )
        ),
    ).select("tree", uniform_from_key(F.lit(seed), F.col("tree"), F.col(key)).alias("u"), "vec")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("u", kind="stable").head(tree_rows)
        data = np.stack(pdf["vec"].to_numpy())
        rng = np.random.default_rng([seed, tree])
        psi = len(data)
        depth_limit = int(np.ceil(np.log2(max(psi, 2))))
        nodes, todo = [], [(1, data, 0)]
        while todo:
            node, part, depth = todo.pop()
            spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) > 1 else np.empty(0, int)
            if depth >= depth_limit or len(spread) == 0:
                nodes.append((tree, node, -1, 0.0, depth + float(_average_path(len(part))), psi))
                continue
            feature = int(rng.choice(spread))
            low, high = part[:, feature].min(), part[:, feature].max()
            split = float(rng.uniform(low, high))
            left = part[:, feature] <= split
            nodes.append((tree, node, feature, split, 0.0, psi))
            todo += [(2 * node, part[left], depth + 1), (2 * node + 1, part[~left], depth + 1)]
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "split", "path", "psi"])

    return chosen.groupBy("tree").applyInPandas(grow, _NODE)


def isolation_scores(points: DataFrame, key: str, forest: DataFrame) -> DataFrame:
    """``(key, score, is_anomaly)``. The forest holds at most trees x 2 x tree_rows nodes, so it travels with the tasks."""
    nodes = forest.toPandas()
    tables = []
    for _, t in nodes.groupby("tree"):
        order = np.sort(t["node"].to_numpy())
        t = t.set_index("node").loc[order]
        place = {n: i for i, n in enumerate(order)}
        left = np.array([place.get(2 * n, i) for i, n in enumerate(order)])
        right = np.array([place.get(2 * n + 1, i) for i, n in enumerate(order)])
        tables.append((t["feature"].to_numpy(), t["split"].to_numpy(), t["path"].to_numpy(), left, right))
    scale = float(np.mean(_average_path(nodes.groupby("tree")["psi"].first().to_numpy()))) if len(nodes) else 1.0
    depth = max((int(np.log2(n)) for n in nodes["node"]), default=0)
    shared = points.sparkSession.sparkContext.broadcast(tables)

    @F.pandas_udf(T.DoubleType())
    def score(vec: pd.Series) -> pd.Series:
        x = np.stack(vec.to_numpy())
        rows = np.arange(len(x))
        total = np.zeros(len(x))
        for feature, split, path, left, right in shared.value:
            at = np.zeros(len(x), dtype=int)
            for _ in range(depth):
                f = feature[at]
                goes_left = x[rows, np.maximum(f, 0)] <= split[at]
                at = np.where(f < 0, at, np.where(goes_left, left[at], right[at]))
            total += path[at]
        return pd.Series(2.0 ** (-(total / max(len(shared.value), 1)) / max(scale, 1e-12)))

    return points.select(key, score("vec").alias("score")).withColumn("is_anomaly", F.col("score") > SCORE_LIMIT)


def isolation_forest(df: DataFrame, key: str, vec: Column, **options) -> DataFrame:
    points = spread(df.select(quoted(key).alias(key), vec.cast("array<double>").alias("vec")))
    return isolation_scores(points, key, grow_forest(points, key, **options))


def detect_anomalies(df: DataFrame, key: str, target: str | None = None, min_rows: int = 20) -> DataFrame | None:
    """``(key, score, lof, by_forest, by_lof, consensus)``; None for fewer than two varying columns or too few rows."""
    columns = usable_columns(df, (key, target))
    if len(columns) < 2 or df.limit(min_rows).count() < min_rows:
        return None
    # Read by both detectors, several times each.
    points = cut_lineage(spread(median_filled(df, key, columns)))
    forest = isolation_scores(points, key, grow_forest(points, key))
    factors = local_outlier_factor(points, key, F.col("vec"), NEIGHBOURS, LOF_LIMIT)
    return forest.join(factors, key).select(
        key, "score", "lof", F.col("is_anomaly").alias("by_forest"), F.col("is_outlier").alias("by_lof"),
        (F.col("is_anomaly") & F.col("is_outlier")).alias("consensus"),
    )


def anomaly_summary(found: DataFrame) -> DataFrame:
    """Counts and percentages of both detectors and of their consensus."""
    names = {"by_forest": "isolation_forest", "by_lof": "lof", "consensus": "consensus"}
    n = F.greatest(F.count("*"), F.lit(1))
    aggs = [F.count("*").alias("num_rows")]
    for c, name in names.items():
        aggs += [F.count_if(F.col(c)).alias(f"{name}_count"), (F.count_if(F.col(c)) * F.lit(100.0) / n).alias(f"{name}_pct")]
    return found.agg(*aggs)


@dataclass(frozen=True)
class AnomalyOutcome:
    rows: DataFrame
    action_taken: str
    affected: int
    consensus_pct: float


def apply_anomaly_action(df: DataFrame, key: str, found: DataFrame | None, action: str = "report") -> AnomalyOutcome:
    """Report, flag or remove the consensus rows; at 5% or more of the rows nothing is marked or removed."""
    if action not in ("report", "flag", "remove"):
        raise ValueError(f"unknown anomaly action: {action}")
    if found is None:
        flagged = df.withColumn(FLAG_COLUMN, F.lit(0)) if action == "flag" else df
        return AnomalyOutcome(flagged, action, 0, 0.0)
    summary = anomaly_summary(found).first()
    pct, count = summary["consensus_pct"], summary["consensus_count"]
    marked = found.where("consensus").select(key)
    affected = count if pct < REMOVAL_LIMIT_PCT else 0
    if action == "remove" and affected:
        return AnomalyOutcome(df.join(marked, key, "left_anti"), action, affected, pct)
    if action == "flag":
        if not affected:
            return AnomalyOutcome(df.withColumn(FLAG_COLUMN, F.lit(0)), action, 0, pct)
        flags = marked.withColumn(FLAG_COLUMN, F.lit(1))
        return AnomalyOutcome(df.join(flags, key, "left").fillna({FLAG_COLUMN: 0}), action, affected, pct)
    return AnomalyOutcome(df, action, affected if action != "report" else 0, pct)
