"""Winner choice and multi-objective ranking over result tables of any number of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.operators.metrics import gap_status
from tablewright.plans.models import COMPLEXITY, UNKNOWN_COMPLEXITY, FAMILIES

# Objective weights (performance, latency, size, cost) and limits.
PRESETS = {
    "balanced": (0.50, 0.20, 0.15, 0.15),
    "performance": (0.80, 0.10, 0.05, 0.05),
    "edge": (0.30, 0.35, 0.35, 0.00),
    "fast": (0.40, 0.40, 0.10, 0.10),
}
TIE_TOLERANCE = 0.005
GAP_PENALTY_FROM = 0.10
MIN_PENALTY = 0.5
SMALLEST = 0.001
METRIC_DIFFERENCE = 0.001
SPEED_RATIO = 1.2


def parse_weights(text: str | None, preset: str = "balanced") -> tuple[float, float, float, float]:
    """Four comma-separated weights scaled to sum one, or a preset."""
    if text:
        try:
            parts = [float(p) for p in text.split(",")]
        except ValueError:
            parts = []
        if len(parts) == 4 and sum(parts) > 0:
            return tuple(p / sum(parts) for p in parts)
    return PRESETS.get(preset.lower(), PRESETS["balanced"])


def complexity_of(library: Column) -> Column:
    """Complexity rank of a model by its class or family name."""
    last = F.lower(F.element_at(F.split(library, r"\."), -1))
    expr = None
    for family, rank in COMPLEXITY.items():
        names = [family, *[n.lower() for n in FAMILIES.get(family, ())]]
        expr = F.when(last.isin(*names), rank) if expr is None else expr.when(last.isin(*names), rank)
    return expr.otherwise(UNKNOWN_COMPLEXITY)


def select_winners(cv: DataFrame, lower_is_better: bool = False) -> DataFrame:
    """Best model per run from ``(run_id, model_name, library, cv_mean, cv_std, duration_seconds)``.

    Order: score, stability, simplicity, training time, each rounded so that noise cannot decide; then the name.
    """
    score = F.round("cv_mean", 4)
    order = [
        score.asc() if lower_is_better else score.desc(), F.round("cv_std", 4).asc(),
        complexity_of(F.col("library")).asc(), F.round("duration_seconds", 2).asc(), F.col("model_name").asc(),
    ]
    w = Window.partitionBy("run_id").orderBy(*order)
    margin = F.col("runner_up") - F.col("cv_mean") if lower_is_better else F.col("cv_mean") - F.col("runner_up")
    return (
        cv.withColumn("place", F.row_number().over(w))
        .withColumn("runner_up_name", F.lead("model_name").over(w))
        .withColumn("runner_up", F.lead("cv_mean").over(w))
        .where("place = 1")
        .select(
            "run_id", "model_name", "cv_mean", "cv_std", "runner_up_name", margin.alias("margin"),
            F.coalesce(F.abs(margin) <= TIE_TOLERANCE, F.lit(False)).alias("is_tie"),
        )
    )


def min_max(value: Column, run: str = "run_id") -> Column:
    """Value scaled to 0..1 within its run; a constant objective is 1 for all."""
    w = Window.partitionBy(run)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high == low, 1.0).otherwise(F.try_divide(value - low, high - low))


def composite_scores(
    models: DataFrame, weights: tuple[float, float, float, float] = PRESETS["balanced"], lower_is_better: bool = False
) -> DataFrame:
    """Weighted score of ``(run_id, model_name, metric, latency_ms, size_kb, cost_s, gap)`` with a penalty for overfitting."""
    floor = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(F.lit(SMALLEST))
    perf = min_max(F.coalesce(F.col("metric"), F.lit(0.0)))
    if lower_is_better:
        perf = min_max(-F.coalesce(F.col("metric"), F.lit(0.0)))
    parts = {
        "performance": perf, "latency": 1 - min_max(floor("latency_ms")), "size": 1 - min_max(floor("size_kb")),
        "cost": 1 - min_max(floor("cost_s")),
    }
    penalty = F.when(
        F.col("gap") > GAP_PENALTY_FROM, F.greatest(F.lit(MIN_PENALTY), 1 - F.col("gap"))
    ).otherwise(1.0)
    scored = models.withColumns(parts).withColumn("penalty", penalty)
    total = sum((F.col(p) * F.lit(w) for p, w in zip(parts, weights)), F.lit(0.0))
    return scored.withColumn("composite_score", F.round(total * F.col("penalty"), 4))


def rank_models(scored: DataFrame, failed: DataFrame) -> DataFrame:
    """All models of each run by score; failed ones come last with score 0. Rank 1 wins if its score is above 0."""
    good = scored.select("run_id", "model_name", "composite_score", "gap", F.lit(False).alias("failed"))
    bad = failed.select(
        "run_id", "model_name", F.lit(0.0).alias("composite_score"), F.lit(None).cast("double").alias("gap"),
        F.lit(True).alias("failed"),
    )
    w = Window.partitionBy("run_id").orderBy(F.desc("composite_score"), "failed", "model_name")
    return good.unionByName(bad).withColumn("rank", F.row_number().over(w)).select(
        "run_id", "rank", "model_name", "composite_score",
        F.when(F.col("failed"), "failed").otherwise(gap_status(F.col("gap"))).alias("status"),
        ((F.col("rank") == 1) & (F.col("composite_score") > 0)).alias("is_winner"),
    )


def trade_offs(ranked: DataFrame) -> DataFrame:
    """Each run's winner against every other model: score difference and how much faster the winner is.

    ``ranked`` has (run_id, rank, model_name, composite_score, metric, latency_ms). Runs are small groups of
    candidates, and the winner is one row per run, so this is a plain equi-join on the run.
    """
    usable = ranked.where("composite_score > 0")
    w = Window.partitionBy("run_id").orderBy("rank")
    first = usable.withColumn("__place", F.row_number().over(w))
    best = first.where("__place = 1").select(
        "run_id", F.col("model_name").alias("winner"), F.col("metric").alias("w_metric"), F.col("latency_ms").alias("w_latency")
    )
    diff = F.col("w_metric") - F.col("metric")
    ratio = F.try_divide(F.col("latency_ms"), F.when(F.col("w_latency") > 0, F.col("w_latency")))
    joined = first.where("__place > 1").join(best, "run_id")
    return joined.select(
        "run_id", "winner", F.col("model_name").alias("challenger"),
        F.when(F.abs(diff) > METRIC_DIFFERENCE, diff).alias("metric_difference"),
        F.when((F.col("latency_ms") > 0) & (ratio > SPEED_RATIO), ratio).alias("times_faster"),
    ).where("metric_difference IS NOT NULL OR times_faster IS NOT NULL")


def feature_consensus(importances: DataFrame, top: int = 3) -> DataFrame:
    """The strongest features of each model side by side, from ``(run_id, model_name, feature, importance)``."""
    w = Window.partitionBy("run_id", "model_name").orderBy(F.desc("importance"), "feature")
    placed = importances.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)
    return placed.groupBy("run_id", "model_name").agg(
        *[F.max(F.when(F.col("place") == i, F.col("feature"))).alias(f"feature_{i}") for i in range(1, top + 1)]
    )
