"""Model diagnosis: overfitting, underfitting, imbalance, and the parameters to try next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits of the diagnosis.
SEVERE_GAP, CRITICAL_GAP, MODERATE_GAP = 0.15, 0.25, 0.08
ERROR_RATIO = 1.4
LOW_VAL, LOW_TRAIN, LOW_R2 = 0.65, 0.70, 0.30
IMBALANCE_ACCURACY, IMBALANCE_DISTANCE = 0.80, 0.15
GAP_REDUCED = 0.02
# Parameters suggested per model family and issue.
SUGGESTIONS = {
    ("random_forest", "overfitting"): {"max_depth": 8, "min_samples_split": 6, "min_samples_leaf": 3, "max_features": "sqrt"},
    ("random_forest", "underfitting"): {"n_estimators": 200, "max_depth": None, "min_samples_split": 2},
    ("gradient_boosting", "overfitting"): {
        "max_depth": 4, "min_child_weight": 5, "subsample": 0.8, "colsample_bytree": 0.8, "reg_alpha": 0.5, "reg_lambda": 1.0,
    },
    ("gradient_boosting", "underfitting"): {"max_depth": 7, "learning_rate": 0.1},
    ("logistic_regression", "overfitting"): {"C": 0.1},
    ("logistic_regression", "underfitting"): {"C": 10.0},
    ("ridge", "overfitting"): {"alpha": 10.0},
    ("ridge", "underfitting"): {"alpha": 0.1},
}


def metric_pairs(metric_log: DataFrame, metric: str) -> DataFrame:
    """Train and validation value of the metric, with validation accuracy and macro F1, per run and model."""
    pick = lambda split, name: F.max(
        F.when((F.col("split_type") == split) & (F.col("metric_name") == name), F.col("metric_value"))
    )
    return metric_log.groupBy("run_id", "model_name").agg(
        pick("train", metric).alias("train_value"), pick("val", metric).alias("val_value"),
        pick("val", "accuracy").alias("accuracy"), F.coalesce(pick("val", "f1_macro"), pick("val", "f1")).alias("f1_macro"),
    )


def _issue(cond: Column, category: str, severity: Column | str, gap: Column) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(
        cond, F.struct(F.lit(category).alias("category"), severity.alias("severity"), F.round(gap, 4).alias("metric_gap"))
    )


def diagnose(pairs: DataFrame, metric: str, is_classification: bool) -> DataFrame:
    """One row per issue found in ``metric_pairs``; models without issues have no row."""
    val = F.coalesce(F.col("val_value"), F.lit(0.0))
    train = F.coalesce(F.col("train_value"), val)
    gap, none = train - val, F.lit(None).cast("double")
    issues = []
    if is_classification:
        severity = F.when(gap >= CRITICAL_GAP, "critical").when(gap >= SEVERE_GAP, "high").otherwise("medium")
        issues.append(_issue(gap >= MODERATE_GAP, "overfitting", severity, gap))
        issues.append(_issue((val < LOW_VAL) & (train < LOW_TRAIN), "underfitting", "high", none))
        accuracy, f1 = F.coalesce(F.col("accuracy"), F.lit(0.0)), F.coalesce(F.col("f1_macro"), F.lit(0.0))
        neglected = (accuracy > IMBALANCE_ACCURACY) & (accuracy - f1 >= IMBALANCE_DISTANCE)
        issues.append(_issue(neglected, "class_imbalance", "medium", none))
    elif metric == "r2":
        issues.append(_issue(gap >= SEVERE_GAP, "overfitting", "high", gap))
        issues.append(_issue(val < LOW_R2, "underfitting", "high", none))
    elif metric in ("rmse", "mae"):
        issues.append(_issue(val / (train + F.lit(1e-6)) >= ERROR_RATIO, "overfitting", "high", val - train))
    found = F.filter(F.array(*issues), lambda x: x.isNotNull())
    return pairs.select("run_id", "model_name", F.inline(found))


def model_health(pairs: DataFrame, issues: DataFrame) -> DataFrame:
    """healthy, warning or critical per model, with its number of issues."""
    counts = issues.groupBy("run_id", "model_name").agg(
        F.count("*").alias("issues"), F.max((F.col("severity") == "critical").cast("int")).alias("critical")
    )
    joined = pairs.join(counts, ["run_id", "model_name"], "left")
    health = F.when(F.col("critical") == 1, "critical").when(F.col("issues") > 0, "warning").otherwise("healthy")
    return joined.select("run_id", "model_name", F.coalesce("issues", F.lit(0)).alias("issues"), health.alias("health"))


def suggested_params(family: str, issues: set[str], current: dict | None = None) -> dict:
    """Current parameters with the changes for the family; overfitting goes before underfitting."""
    issue = "overfitting" if "overfitting" in issues else "underfitting" if "underfitting" in issues else None
    return {**(current or {}), **SUGGESTIONS.get((family, issue), {})}


def refinement_verdict(pairs: DataFrame, lower_is_better: bool = False) -> DataFrame:
    """Compares first and refined fits from their train, val and test values; the refined model is promoted on val.

    Columns: run_id, model_name, then train_0, val_0, test_0 and train_1, val_1, test_1.
    """
    sign = -1.0 if lower_is_better else 1.0
    gap = lambda i: (F.col(f"train_{i}") - F.col(f"val_{i}")) * F.lit(sign)
    reduced = gap(0) - gap(1)
    kept = (F.col("test_1") - F.col("test_0")) * F.lit(sign) >= 0
    better = (F.col("val_1") - F.col("val_0")) * F.lit(sign) > 0
    verdict = F.when((reduced > GAP_REDUCED) & kept, "success").when(kept, "stable").otherwise("neutral")
    return pairs.select(
        "run_id", "model_name", F.round(reduced, 4).alias("gap_reduced"), kept.alias("test_kept"),
        verdict.alias("verdict"), (better & (verdict != "neutral")).alias("promote"),
    )
