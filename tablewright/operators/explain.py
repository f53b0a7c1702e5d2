"""Shapley explanations: exact for linear models and trees, by sampled permutations for any model."""

from __future__ import annotations

from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.runtime import scratch_path, spread

# Rows used by the sampling explainer and sizes of the reports.
BACKGROUND_ROWS = 100
#: Numbers of the mixtures that a task makes at a time.
MIX_CELLS = 4_000_000
PERMUTATIONS = 16
LOCAL_ROWS = 3
LOCAL_FEATURES = 5


def linear_shapley(df: DataFrame, key: str, columns: list[str], coefficients: list[float]) -> DataFrame:
    """``(key, feature, phi)``: coefficient times distance from the mean, exact for linear models."""
    means = df.agg(*[F.avg(F.col(c).cast("double")) for c in columns]).first()
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), (F.lit(w) * (F.col(c).cast("double") - F.lit(m))).alias("phi"))
            for c, w, m in zip(columns, coefficients, means)
        ]
    )
    return df.select(key, F.inline(cells))


def global_importance(phi: DataFrame) -> DataFrame:
    """Mean absolute and signed Shapley value per feature, its direction and rank."""
    table = phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs"), F.avg("phi").alias("signed_mean"))
    # One row per feature.
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("mean_abs"), "feature")
    return table.select(
        F.row_number().over(w).alias("rank"), "feature", "mean_abs", "signed_mean",
        F.when(F.col("signed_mean") >= 0, "+").otherwise("-").alias("direction"),
    )


def extreme_rows(confidence: DataFrame, key: str, rows: int = LOCAL_ROWS) -> DataFrame:
    """The most and least confident rows of ``(key, confidence)``: two top-k reads, no sort of the table."""
    top = confidence.orderBy(F.desc("confidence"), key).limit(rows).withColumn("kind", F.lit("most"))
    low = confidence.orderBy("confidence", key).limit(rows).withColumn("kind", F.lit("least"))
    return top.unionByName(low)


def local_explanations(phi: DataFrame, chosen: DataFrame, key: str, features: int = LOCAL_FEATURES) -> DataFrame:
    """The strongest contributions of the chosen rows."""
    part = phi.join(F.broadcast(chosen.select(key, "kind")), key)
    w = Window.partitionBy("kind", key).orderBy(F.desc(F.abs("phi")), "feature")
    return part.withColumn("place", F.row_number().over(w)).where(F.col("place") <= features)


def confidence(scored: DataFrame) -> Column:
    """Largest class probability, or the size of the prediction for a regression."""
    if "probability" in scored.columns:
        return F.array_max(vector_to_array("probability"))
    return F.abs("prediction")


def sampled_shapley(
    model, rows: DataFrame, background: DataFrame, key: str, names: list[str], output: Column,
    permutations: int = PERMUTATIONS, seed: int = 42, features: str = "features",
) -> DataFrame:
    """``(key, feature, phi)`` for any model by sampled feature orders.

    For every row, background row and order, features switch one by one from the background to the row; the change of the output
    is the feature's share. Values add up to the output minus the mean background output. The background is
    at most ``BACKGROUND_ROWS`` rows, the sampling budget of this explainer, and travels as a literal.
    """
    base = np.array([r["v"] for r in background.select(vector_to_array(features).alias("v")).limit(BACKGROUND_ROWS).collect()])
    d = len(names)
    rng = np.random.default_rng(seed)
    # Every background row gets the same number of feature orders, so all weigh the same.
    orders = np.array([rng.permutation(d) for _ in range(-(-permutations // len(base))) for _ in base])
    starts = np.tile(base, (len(orders) // len(base), 1))
    # For each order and step: the features that come from the row, the one switched last, and the one switched next.
    place = np.argsort(orders, axis=1)
    from_row = (place[:, None, :] < np.arange(d + 1)[None, :, None]).reshape(-1, d)
    switched = np.hstack([np.full((len(orders), 1), -1), orders]).ravel()
    coming = np.hstack([orders, np.full((len(orders), 1), -1)]).ravel()
    shared = rows.sparkSession.sparkContext.broadcast((np.repeat(starts, d + 1, axis=0), from_row, switched, coming))
    key_type = rows.schema[key].dataType.simpleString()

    def mixes(batches):
        """All mixtures of a batch of rows as one matrix."""
        start, from_row, switched, coming = shared.value
        step = max(1, MIX_CELLS // start.size)
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, d)
            for low in range(0, batch.num_rows, step):
                part = x[low:low + step]
                mixed = np.where(from_row[None], part[:, None, :], start[None])
                ends = pa.array(np.arange(0, mixed.size + 1, d, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(np.arange(low, low + len(part)), len(start)))), pa.array(np.tile(switched, len(part)), pa.int32()),
                    pa.array(np.tile(coming, len(part)), pa.int32()), pa.ListArray.from_arrays(ends, pa.array(mixed.ravel()))], names=["key", "switched", "coming", "v"])

    mixed = spread(rows.select(F.col(key).alias("key"), vector_to_array(features).alias("v"))).mapInArrow(mixes, f"key {key_type}, switched int, coming int, v array<double>")
    scored = model.transform(mixed.select("key", "switched", "coming", array_to_vector("v").alias(features))).select("key", "switched", "coming", output.alias("out"))
    # A step's gain is its output less that of the step before: outputs count for the feature switched last and against the one coming next.
    # Mixtures of a row lie together, so they are added up before they move.
    gains = [F.sum(F.when(F.col("switched") == f, F.col("out")).when(F.col("coming") == f, -F.col("out"))) / F.lit(len(orders)) for f in range(d)]
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"phi{f}").alias("phi")) for f, n in enumerate(names)])
    sums = scored.groupBy("key").agg(*[g.alias(f"phi{f}") for f, g in enumerate(gains)])
    return sums.select(F.col("key").alias(key), F.inline(cells))


def tree_paths(spark: SparkSession, model) -> list[tuple[np.ndarray, list[tuple]]]:
    """Leaves of a fitted tree model, from its saved node table: scaled outputs and the conditions of their paths.

    A condition is (feature, what goes left, goes_left, share of the parent's rows). What goes left is a threshold, or a set of
    values for a split on categories, as one-hot columns have them.
    """
    path = scratch_path(spark, "model")
    model.write().overwrite().save(path)
    table = spark.read.parquet(f"{path}/data")
    kind = type(model).__name__
    scales = {0: 1.0}
    if "treeID" in table.columns:
        meta = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "metadata", "weights").collect()
        scales = {r["treeID"]: r["weights"] if "GBT" in kind else 1.0 / len(meta) for r in meta}
        table = table.select("treeID", "nodeData.*")
    else:
        table = table.withColumn("treeID", F.lit(0))
    nodes = {(r["treeID"], r["id"]): r for r in table.collect()}
    classes = "Classification" in kind and "GBT" not in kind
    leaves = []
    for tree, scale in scales.items():
        todo = [(nodes[(tree, 0)], [])]
        while todo:
            node, conditions = todo.pop()
            if node["leftChild"] < 0:
                stats = np.array(node["impurityStats"], dtype=float)
                value = stats / stats.sum() if classes else np.array([node["prediction"]])
                leaves.append((value * scale, conditions))
                continue
            split = node["split"]
            values = list(split["leftCategoriesOrThreshold"])
            below_left = values[0] if split["numCategories"] < 0 else np.array(values)
            for child, left in ((node["leftChild"], True), (node["rightChild"], False)):
                below = nodes[(tree, child)]
                condition = (split["featureIndex"], below_left, left, below["rawCount"] / node["rawCount"])
                todo.append((below, [*conditions, condition]))
    return leaves


def tree_shapley(
    model, rows: DataFrame, key: str, names: list[str], output_class: int = -1, features: str = "features"
) -> DataFrame:
    """``(key, feature, phi)``: exact path-dependent Shapley values of a tree, forest or boosted model.

    Each leaf is a product game over the few features of its path, solved in closed form for all rows of a
    batch at once. The leaves of the fitted model travel with the tasks. Boosted classifiers are explained on
    their raw margin.
    """
    leaves = tree_paths(rows.sparkSession, model)
    shared = rows.sparkSession.sparkContext.broadcast([(float(v[output_class]), path) for v, path in leaves])
    key_type, d = rows.schema[key].dataType.simpleString(), len(names)

    def explain(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack(pdf["v"].to_numpy())
            phi = np.zeros((len(x), d))
            for value, path in shared.value:
                phi += value * _leaf_shares(x, path, d)
            yield pd.DataFrame({
                "key": np.repeat(pdf["key"].to_numpy(), d), "feature": names * len(x), "phi": phi.ravel(),
            })

    vectors = spread(rows.select(F.col(key).alias("key"), vector_to_array(features).alias("v")))
    return vectors.mapInPandas(
        explain, f"key {key_type}, feature string, phi double"
    ).withColumnRenamed("key", key)


def _leaf_shares(x: np.ndarray, path: list[tuple], d: int) -> np.ndarray:
    """Shapley values of the game 'does the row reach this leaf', one column per feature."""
    out = np.zeros((len(x), d))
    used = sorted({f for f, *_ in path})
    hot = {f: np.ones(len(x)) for f in used}
    cold = {f: 1.0 for f in used}
    for f, below_left, left, share in path:
        goes_left = np.isin(x[:, f], below_left) if isinstance(below_left, np.ndarray) else x[:, f] <= below_left
        hot[f] = hot[f] * (goes_left == left)
        cold[f] *= share
    m = len(used)
    for j in used:
        # Polynomial of the other features: coefficient s sums the products over subsets of size s that are present.
        poly = np.zeros((len(x), m))
        poly[:, 0] = 1.0
        for i in used:
            if i != j:
                shifted = np.zeros_like(poly)
                shifted[:, 1:] = poly[:, :-1] * hot[i][:, None]
                poly = poly * cold[i] + shifted
        weights = np.array([factorial(s) * factorial(m - 1 - s) / factorial(m) for s in range(m)])
        out[:, j] = (poly @ weights) * (hot[j] - cold[j])
    return out


def tree_expectation(spark: SparkSession, model, output_class: int = -1) -> float:
    """Mean output of the model over its training rows, the base the Shapley values start from."""
    return float(sum(v[output_class] * np.prod([s for *_, s in path]) for v, path in tree_paths(spark, model)))


def mean_absolute_over_classes(per_class: DataFrame) -> DataFrame:
    """``(key, feature, phi)`` of a multi-class model: mean of absolute values over classes."""
    keys = [c for c in per_class.columns if c not in ("class", "phi")]
    return per_class.groupBy(*keys).agg(F.avg(F.abs("phi")).alias("phi"))


__all__ = [
    "confidence", "extreme_rows", "global_importance", "linear_shapley", "local_explanations",
    "mean_absolute_over_classes", "sampled_shapley", "tree_expectation", "tree_shapley",
]
