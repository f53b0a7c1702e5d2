"""Evaluation metrics as aggregates over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.ranking_values import running_totals


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``(label, prediction, n)``: the only pass over the scored rows that class metrics need."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def binary_metrics(df: DataFrame, label: str, prediction: str, positive=1) -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class; an empty denominator gives 0."""
    yes, said = F.col("label") == F.lit(positive), F.col("prediction") == F.lit(positive)
    n = F.col("n")
    part = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    sums = confusion(df, label, prediction).agg(
        F.sum("n").alias("rows"), part(F.col("label") == F.col("prediction")).alias("right"),
        part(yes & said).alias("tp"), part(~yes & said).alias("fp"), part(yes & ~said).alias("fn"),
    )
    return sums.select(
        _ratio(F.col("right"), F.col("rows")).alias("accuracy"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )


def class_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, also for classes that are only predicted."""
    sides = confusion(df, label, prediction).select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("said"),
                         F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp")),
                F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("actual"),
                         F.col("n").alias("said"), F.lit(0).cast("bigint").alias("tp")),
            )
        )
    )
    sums = sides.groupBy("class").agg(F.sum("actual").alias("support"), F.sum("said").alias("said"), F.sum("tp").alias("tp"))
    return sums.select(
        "class", "support", _ratio(F.col("tp"), F.col("said")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("said") + F.col("support")).alias("f1"), "tp",
    )


def multiclass_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy with weighted and macro averages of precision, recall and F1."""
    per = class_metrics(df, label, prediction)
    aggs = [_ratio(F.sum("tp"), F.sum("support")).alias("accuracy")]
    for m in ("precision", "recall", "f1"):
        aggs.append(_ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"{m}_weighted"))
        aggs.append(F.avg(m).alias(f"{m}_macro"))
    return per.agg(*aggs)


def roc_auc(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """Exact area under the ROC curve with ties averaged.

    Rows are counted per distinct score first, so a score shared by many rows is one record; the negatives below each
    score come from running totals that never sort all scores in one task.
    """
    counts = df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    return _area(running_totals(counts, "score", ["neg"]))


def _area(totals: DataFrame, *by: str) -> DataFrame:
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return totals.groupBy(*by).agg(F.try_divide(wins, pairs).alias("roc_auc"), F.sum("pos").alias("support")).drop(*([] if by else ["support"]))


def roc_auc_ovr(df: DataFrame, label: str, scores: str, classes: int) -> DataFrame:
    """One-vs-rest area under the curve, weighted by class size, of all classes in one scan; ``scores`` is an array by class number."""
    cells = F.transform(F.slice(scores, 1, classes), lambda score, c: F.struct(c.alias("class"), (F.col(label).cast("int") == c).alias("yes"), score.cast("double").alias("score")))
    counts = df.select(F.inline(cells)).groupBy("class", "score").agg(F.count_if("yes").alias("pos"), F.count_if(~F.col("yes")).alias("neg"))
    areas = _area(running_totals(counts, "score", ["neg"], ("class",)), "class").where("support > 0")
    # As many rows as classes.
    return areas.agg((F.sum(F.col("roc_auc") * F.col("support")) / F.sum("support")).alias("roc_auc"))


def regression_metrics(df: DataFrame, label: str, prediction: str, by: tuple[str, ...] = ()) -> DataFrame:
    """RMSE, MAE and R2, for all rows or per group. The spread of the label comes from its variance, in the same pass."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    sums = df.groupBy(*by).agg(
        F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"), F.var_pop(y).alias("spread")
    )
    return sums.select(
        *by, F.sqrt("mse").alias("rmse"), "mae", (1 - F.try_divide(F.col("mse"), F.col("spread"))).alias("r2")
    )


def log_loss(df: DataFrame, probability_of_truth: Column, eps: float = 2.220446049250313e-16) -> DataFrame:
    p = F.least(F.greatest(probability_of_truth.cast("double"), F.lit(eps)), F.lit(1 - eps))
    return df.agg(F.avg(-F.log(p)).alias("log_loss"))


def generalisation_gap(metric_log: DataFrame, metric: str, lower_is_better: bool = False) -> DataFrame:
    """Train minus test score per run and model (test minus train for errors), with its verdict."""
    wide = metric_log.where(F.col("metric_name") == metric).groupBy("run_id", "model_name").agg(
        F.max(F.when(F.col("split_type") == "train", F.col("metric_value"))).alias("train_value"),
        F.max(F.when(F.col("split_type") == "test", F.col("metric_value"))).alias("test_value"),
    )
    diff = F.col("test_value") - F.col("train_value") if lower_is_better else F.col("train_value") - F.col("test_value")
    gap = F.round(F.greatest(diff, F.lit(0.0)), 4)
    return wide.withColumn("gap", gap).withColumn("status", gap_status(F.col("gap")))


def gap_status(gap: Column) -> Column:
    return F.when(gap <= 0.05, "stable").when(gap > 0.10, "overfitting").otherwise("moderate")
