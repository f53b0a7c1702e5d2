"""Training: cross-validation with transforms refitted inside each fold, metrics per split, voting ensemble."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators import metrics as M
from tablewright.operators.features import FITTED, encode_label, feature_names, label_table
from tablewright.operators.split import assign_folds, forward_folds, quota_split, sequential_split
from tablewright.plans.knn_model import NeighboursModel
from tablewright.plans.models import balanced_weights, build_estimator
from tablewright.plans.routing import complete, feature_stages
from tablewright.plans.spec import Candidate, ModelPlan
from tablewright.runtime import cut_lineage, spread
from tablewright.sources.writers import EXPERIMENT_SCHEMA, METRIC_SCHEMA

# Fixed values.
ENSEMBLE_NAME = "Weighted Ensemble"
ENSEMBLE_SIZE = 3
KEPT_IMPORTANCES = 5
WORKERS = 4


@dataclass
class Experiment:
    """Outcome of one candidate. One that is refused is recorded here; a failure of the work itself is raised."""

    model_name: str
    library: str
    status: str = "pending"
    metrics: dict[str, dict[str, float]] = field(default_factory=dict)  # split -> metric -> value
    fold_metrics: list[dict[str, float]] = field(default_factory=list)
    importances: list[tuple[str, float]] = field(default_factory=list)
    duration_seconds: float = 0.0
    model: PipelineModel | None = None
    estimator: PipelineModel | None = None  # works on vectors; ``model`` takes raw rows
    fold_models: list[PipelineModel] = field(default_factory=list)
    error: str | None = None
    hyperparams: dict = field(default_factory=dict)
    scored: dict[int | str, DataFrame] = field(default_factory=dict, repr=False)  # fold or split -> rows that a search has scored, for the ensemble

    def cv(self, metric: str) -> tuple[float, float]:
        """Mean and population deviation of a fold metric."""
        values = [f[metric] for f in self.fold_metrics if metric in f]
        mean = sum(values) / len(values)
        return mean, (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5


def prepare(df: DataFrame, plan: ModelPlan, features: list[str], order_col: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows with ``label`` and ``split``, written once; and the class table of a classification task."""
    known = df.where(F.col(plan.target_column).isNotNull())
    table = None
    if plan.is_classification:
        table = cut_lineage(label_table(known, plan.target_column))
        known = encode_label(known, plan.target_column, table)
    else:
        known = known.withColumn("label", F.col(plan.target_column).cast("double"))
    if plan.is_sequential:
        if order_col is None:
            raise ValueError("a sequential split needs an order column")
        split = sequential_split(known, order_col, plan.evaluation.test_size)
    else:
        label = "label" if plan.is_classification else None
        split = quota_split(known, features, label, plan.evaluation.test_size)
    return cut_lineage(spread(split)), table


def evaluate(scored: DataFrame, plan: ModelPlan, classes: int) -> dict[str, float]:
    """All metrics of scored rows; one aggregate for the class metrics and one for the curve."""
    if not plan.is_classification:
        return M.regression_metrics(scored, "label", "prediction").first().asDict()
    # Classes x classes rows: all class metrics come from this one small table.
    counts = {(r["label"], r["prediction"]): r["n"] for r in M.confusion(scored, "label", "prediction").collect()}
    out = class_scores(counts, binary=plan.task_type == "binary_classification")
    chances = vector_to_array("probability") if "probability" in scored.columns else None
    if "probability_array" in scored.columns:
        chances = F.col("probability_array")
    if chances is not None and classes >= 2:
        p = scored.select("label", chances.alias("p"))
        if classes == 2:
            one = p.select((F.col("label") == 1).alias("yes"), F.col("p")[1].alias("score"))
            auc = M.roc_auc(one, F.col("yes"), "score").first()[0]
        else:
            auc = M.roc_auc_ovr(p, "label", "p", classes).first()[0]
        if auc is not None:
            out["roc_auc"] = auc
    return out


def class_scores(counts: dict[tuple[float, float], int], binary: bool) -> dict[str, float]:
    """Accuracy and averaged precision, recall and F1 from a confusion table; empty denominators give 0."""
    ratio = lambda a, b: float(a) / b if b else 0.0
    total = sum(counts.values())
    support, said = {}, {}
    for (actual, predicted), n in counts.items():
        support[actual] = support.get(actual, 0) + n
        said[predicted] = said.get(predicted, 0) + n
    out = {"accuracy": ratio(sum(n for (a, b), n in counts.items() if a == b), total)}
    per = {}
    for c in {*support, *said, *((1.0,) if binary else ())}:
        tp, actual, predicted = counts.get((c, c), 0), support.get(c, 0), said.get(c, 0)
        per[c] = {"precision": ratio(tp, predicted), "recall": ratio(tp, actual), "f1": ratio(2 * tp, actual + predicted)}
    if binary:
        out.update(per[1.0])
        out["f1_macro"] = out["f1_weighted"] = out["f1"]
        return out
    for name in ("precision", "recall", "f1"):
        out[f"{name}_weighted"] = out[name] = sum(m[name] * support.get(c, 0) for c, m in per.items()) / max(total, 1)
        out[f"{name}_macro"] = sum(m[name] for m in per.values()) / max(len(per), 1)
    return out


def _fold_scores(scored: DataFrame, plan: ModelPlan) -> dict[str, float]:
    """Accuracy and macro F1 over all classes, or RMSE and R2."""
    if not plan.is_classification:
        r = M.regression_metrics(scored, "label", "prediction").first()
        return {"rmse": r["rmse"], "r2": r["r2"]}
    r = M.multiclass_metrics(scored, "label", "prediction").first()
    return {"accuracy": r["accuracy"], "f1_macro": r["f1_macro"]}


@dataclass
class FeatureSet:
    """Rows as vectors, made by transforms fitted on some of them, and what estimators need to know of those."""

    transforms: PipelineModel
    rows: DataFrame
    names: list[str]
    fitted_on: Column
    count: int
    label_std: float
    weight: str | None

    def training(self) -> DataFrame:
        return self.rows.where(self.fitted_on)


def make_features(folded: DataFrame, fitted_on: Column, plan: ModelPlan, types: dict[str, str]) -> FeatureSet:
    """Fits the transforms on the given rows only and writes the vectors of all rows once, for all candidates."""
    # Target codes leave a fitted row's own part out of the sums.
    marked = folded.withColumn(FITTED, F.coalesce(fitted_on & complete(folded, types, plan), F.lit(False)))
    train = marked.where(FITTED)
    transforms = Pipeline(stages=feature_stages(train, types, plan)).fit(train)
    vectors = transforms.transform(marked)
    names = feature_names(vectors)
    rows, fitted_on = vectors.select("label", "split", "fold", "features", FITTED), F.col(FITTED)
    weight = None
    if plan.evaluation.handle_imbalance and plan.is_classification:
        weight = "weight"
        rows = balanced_weights(rows, "label", weight, fitted_on)
    rows = cut_lineage(rows)
    count, std = rows.where(fitted_on).agg(F.count("*"), F.stddev_pop("label")).first()
    return FeatureSet(transforms, rows, names, fitted_on, count, std or 1.0, weight)


def _stages(features: FeatureSet, plan: ModelPlan, candidate: Candidate, classes: int, seed: int) -> list:
    return build_estimator(
        candidate, plan.task_type, features.count, classes, features.label_std, features.weight, seed
    )


def _fit(features: FeatureSet, plan: ModelPlan, candidate: Candidate, classes: int, seed: int) -> PipelineModel:
    return Pipeline(stages=_stages(features, plan, candidate, classes, seed)).fit(features.training())


def _scored(result: Experiment, model: PipelineModel, rows: DataFrame, part: int | str) -> DataFrame:
    """Scored rows; those of a search are stored, and kept by the fold or split they are of."""
    scored = model.transform(rows)
    if isinstance(model.stages[-1], NeighboursModel):
        result.scored[part] = scored
    return scored


def train_candidate(
    folds: list[FeatureSet], final: FeatureSet, plan: ModelPlan, candidate: Candidate, classes: int, seed: int = 42
) -> Experiment:
    """Cross-validation on train and validation rows, a fit on train rows, and metrics of both splits.

    ``folds[i]`` has its transforms fitted without fold i, so nothing of a held-out fold is seen before it is scored. A candidate whose library or parameters are refused
    is recorded as failed and does not stop the others. A fit or a search that breaks down is raised: tables without its rows would look like a whole result.
    """
    result = Experiment(candidate.name, candidate.library, hyperparams=dict(candidate.params))
    start = time.perf_counter()
    try:
        _stages(final, plan, candidate, classes, seed)
    except (ValueError, TypeError) as problem:
        result.status, result.error = "failed", f"{type(problem).__name__}: {problem}"[:500]
        result.duration_seconds = time.perf_counter() - start
        return result
    for i, features in enumerate(folds):
        model = _fit(features, plan, candidate, classes, seed)
        result.fold_metrics.append(_fold_scores(_scored(result, model, held_out(features, i), i), plan))
        result.fold_models.append(model)
    result.estimator = _fit(final, plan, candidate, classes, seed)
    result.model = PipelineModel(stages=[*final.transforms.stages, *result.estimator.stages])
    for split in ("val", "train"):
        scored = _scored(result, result.estimator, final.rows.where(F.col("split") == split), split)
        result.metrics[split] = evaluate(scored, plan, classes)
    result.importances = importances(result.estimator, final.names)
    result.status = "success"
    result.duration_seconds = time.perf_counter() - start
    return result


def all_trained(results: list[Experiment]) -> list[Experiment]:
    """The results, if none failed: for tables that have to hold every candidate."""
    failed = [f"{r.model_name}: {r.error}" for r in results if r.status != "success"]
    if failed:
        raise RuntimeError(f"not all candidates were trained; {'; '.join(failed)}")
    return results


def held_out(features: FeatureSet, fold: int) -> DataFrame:
    return features.rows.where((F.col("split") != "test") & (F.col("fold") == fold))


def importances(model: PipelineModel, names: list[str]) -> list[tuple[str, float]]:
    """Tree importances or mean absolute coefficients by feature, largest first."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    elif hasattr(last, "coefficientMatrix"):
        values = abs(last.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(last, "coefficients"):
        values = abs(last.coefficients.toArray())
    else:
        return []
    names = names if len(names) >= len(values) else [f"feature_{i}" for i in range(len(values))]
    return sorted(((n, float(v)) for n, v in zip(names, values)), key=lambda t: (-t[1], t[0]))


def with_folds(data: DataFrame, plan: ModelPlan, features: list[str], seed: int = 42, order_col: str | None = None) -> DataFrame:
    """Adds ``fold`` by the plan's strategy, written once, so that all candidates are judged on the same folds.

    Stratified and plain folds deal out groups of equal rows; a time series is chained forward; a hold-out has the validation rows as its only fold.
    """
    strategy = plan.evaluation.cv_strategy
    if strategy == "holdout":
        folded = data.withColumn("fold", F.when(F.col("split") == "val", 0).when(F.col("split") == "train", -1))
    elif plan.is_sequential:
        folded = forward_folds(data, order_col, plan.evaluation.n_folds, F.col("split") != "test")
    else:
        label = "label" if plan.is_classification and strategy == "stratified_kfold" else None
        folded = assign_folds(data, features, plan.evaluation.n_folds, label, seed)
    return cut_lineage(folded)


def fitted_in(plan: ModelPlan, fold: int) -> Column:
    """The rows that the model of a fold is fitted on."""
    others = F.col("fold") < fold if plan.fits_on_earlier_folds else F.col("fold") != fold
    return (F.col("split") != "test") & others


def train_all(
    folds: list[FeatureSet], final: FeatureSet, plan: ModelPlan, classes: int, workers: int = WORKERS, seed: int = 42
) -> list[Experiment]:
    """All candidates as concurrent Spark jobs over the same vectors."""
    order = sorted(plan.candidates, key=lambda c: c.priority)
    with ThreadPoolExecutor(max_workers=min(workers, len(order))) as pool:
        return list(pool.map(lambda c: train_candidate(folds, final, plan, c, classes, seed), order))


# --- voting ---------------------------------------------------------------------------------------------------


def ensemble_weights(scores: list[tuple[str, float]], is_classification: bool) -> list[tuple[str, float]]:
    """Weights of the best three models by their CV score: F1, or one over RMSE; rounded, and summing to one."""
    ranked = sorted(scores, key=lambda s: (-s[1] if is_classification else s[1], s[0]))[:ENSEMBLE_SIZE]
    raw = [max(0.01, s) if is_classification else 1.0 / max(0.001, s) for _, s in ranked]
    weights = [round(r / sum(raw), 4) for r in raw]
    weights[-1] = round(1.0 - sum(weights[:-1]), 4)
    return [(name, w) for (name, _), w in zip(ranked, weights)]


def soft_vote(probabilities: list[Column], weights: list[float]) -> tuple[Column, Column]:
    """Weighted mean of probability arrays, and the class with the largest (the first wins a tie)."""
    scaled = [_times(p, w) for p, w in zip(probabilities, weights)]
    mean = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), scaled)
    return mean, (F.array_position(mean, F.array_max(mean)) - 1).cast("double")


def _times(values: Column, weight: float) -> Column:
    return F.transform(values, lambda v: v * F.lit(weight))


def hard_vote(predictions: list[Column], weights: list[float]) -> Column:
    """Class with the largest total weight; the smaller class wins a tie."""
    votes = F.array(*[F.struct(p.cast("double").alias("c"), F.lit(w).alias("w")) for p, w in zip(predictions, weights)])
    totals = F.transform(
        F.array_sort(F.array_distinct(F.transform(votes, lambda v: v["c"]))),
        lambda c: F.struct(
            F.aggregate(F.filter(votes, lambda v: v["c"] == c), F.lit(0.0), lambda acc, v: acc + v["w"]).alias("w"),
            (-c).alias("c"),
        ),
    )
    return -F.array_max(totals)["c"]


def vote(df: DataFrame, models: list[PipelineModel], weights: list[float], is_classification: bool, known: dict[int, DataFrame] | None = None) -> DataFrame:
    """Scores rows with all members and combines them: soft vote, hard vote, or weighted mean.

    Members run one after the other over the same rows, so no join is needed to bring them together. They start from the
    first of ``known``, which are the rows as members, by number, have scored them already.
    """
    base, first, found = list(df.columns), min(known or {}, default=None), set()
    for i in sorted(range(len(models)), key=lambda i: i != first):
        scored = known[i] if i == first else models[i].transform(df)
        keep = {f"__pred{i}": F.col("prediction")}
        if "probability" in scored.columns:
            keep[f"__prob{i}"] = vector_to_array("probability")
            found.add(i)
        df = scored.select(*base, *[c for c in df.columns if c.startswith("__p")], *[e.alias(n) for n, e in keep.items()])
    predictions = [F.col(f"__pred{i}") for i in range(len(models))]
    probabilities = [F.col(f"__prob{i}") for i in sorted(found)]
    if not is_classification:
        total = reduce(lambda a, b: a + b, [p * F.lit(w) for p, w in zip(predictions, weights)])
        return df.select(*base, (total / F.lit(sum(weights))).alias("prediction"))
    if len(probabilities) == len(models):
        mean, best = soft_vote(probabilities, weights)
        return df.select(*base, mean.alias("__vote")).select(
            *base, best_of("__vote").alias("prediction"), F.col("__vote").alias("probability_array")
        )
    return df.select(*base, hard_vote(predictions, weights).alias("prediction"))


def best_of(array: str) -> Column:
    return (F.array_position(F.col(array), F.array_max(array)) - 1).cast("double")


# --- whole experiment -----------------------------------------------------------------------------------------


def add_ensemble(
    results: list[Experiment], folds: list[FeatureSet], final: FeatureSet, plan: ModelPlan, classes: int
) -> Experiment | None:
    """The weighted ensemble as one more experiment; None below two models.

    It is judged on the folds of its members, with the models those folds already have.
    """
    good = [r for r in results if r.status == "success"]
    if len(good) < 2:
        return None
    metric = "f1_macro" if plan.is_classification else "rmse"
    weights = ensemble_weights([(r.model_name, r.cv(metric)[0]) for r in good], plan.is_classification)
    by_name = {r.model_name: r for r in good}
    start = time.perf_counter()
    w = [x for _, x in weights]
    result = Experiment(ENSEMBLE_NAME, "ensemble", "success", hyperparams={"weights": dict(weights)})
    for i, features in enumerate(folds):
        members = [by_name[n].fold_models[i] for n, _ in weights]
        scored = vote(held_out(features, i), members, w, plan.is_classification, _known(by_name, weights, i))
        result.fold_metrics.append(_fold_scores(scored, plan))
    members = [by_name[n].estimator for n, _ in weights]
    for split in ("val", "train"):
        scored = vote(final.rows.where(F.col("split") == split), members, w, plan.is_classification, _known(by_name, weights, split))
        result.metrics[split] = evaluate(scored, plan, classes)
    result.importances = weights
    result.duration_seconds = time.perf_counter() - start
    return result


def _known(by_name: dict[str, Experiment], weights: list[tuple[str, float]], part: int | str) -> dict[int, DataFrame]:
    """Rows of a fold or split that members of an ensemble have scored and stored, by the member's number."""
    return {k: by_name[n].scored[part] for k, (n, _) in enumerate(weights) if part in by_name[n].scored}


def evaluate_on_test(results: list[Experiment], final: FeatureSet, plan: ModelPlan, classes: int) -> None:
    """Test metrics of every model; they come after cross-validation and have no part in choosing the winner."""
    test = final.rows.where("split = 'test'")
    by_name = {r.model_name: r for r in results}
    for r in results:
        if r.status != "success":
            continue
        if r.estimator is not None:
            scored = _scored(r, r.estimator, test, "test")
        else:
            weights = r.hyperparams["weights"]
            members = [by_name[n].estimator for n in weights]
            scored = vote(test, members, list(weights.values()), plan.is_classification, _known(by_name, list(weights.items()), "test"))
        r.metrics["test"] = evaluate(scored, plan, classes)


@dataclass
class PreparedFeatures:
    """Rows split and folded, and their vectors: one set per fold, and one fitted on all training rows."""

    data: DataFrame
    folds: list[FeatureSet]
    final: FeatureSet
    classes: int


def prepare_features(df: DataFrame, plan: ModelPlan, types: dict[str, str], features: list[str], order_col: str | None = None, seed: int = 42) -> PreparedFeatures:
    data, table = prepare(df, plan, features, order_col)
    folded = with_folds(data, plan, features, seed, order_col)
    folds = [make_features(folded, fitted_in(plan, i), plan, types) for i in range(plan.fold_count)]
    final = make_features(folded, F.col("split") == "train", plan, types)
    return PreparedFeatures(data, folds, final, table.count() if table is not None else 0)


def run_prepared(prepared: PreparedFeatures, plan: ModelPlan, with_ensemble: bool = True, seed: int = 42, workers: int = WORKERS) -> list[Experiment]:
    """All candidates and their ensemble, with test metrics last."""
    folds, final, classes = prepared.folds, prepared.final, prepared.classes
    results = train_all(folds, final, plan, classes, workers, seed)
    if with_ensemble:
        extra = add_ensemble(results, folds, final, plan, classes)
        results += [extra] if extra else []
    evaluate_on_test(results, final, plan, classes)
    return results


def run_experiments(
    df: DataFrame, plan: ModelPlan, types: dict[str, str], features: list[str], order_col: str | None = None,
    with_ensemble: bool = True, seed: int = 42, workers: int = WORKERS,
) -> tuple[list[Experiment], DataFrame]:
    """Split, train, ensemble, and test evaluation; the winner is chosen from the result tables."""
    prepared = prepare_features(df, plan, types, features, order_col, seed)
    return run_prepared(prepared, plan, with_ensemble, seed, workers), prepared.data


def experiment_tables(spark: SparkSession, run_id: str, results: list[Experiment]) -> tuple[DataFrame, DataFrame]:
    """Results as the two run tables: models, and one row per metric, split and fold."""
    import json

    models, metrics = [], []
    for r in results:
        models.append((
            run_id, r.model_name, r.library, r.status, r.duration_seconds, json.dumps(r.hyperparams, default=str), None, r.error,
        ))
        for split, values in r.metrics.items():
            metrics += [(run_id, r.model_name, split, None, k, float(v)) for k, v in values.items() if v is not None]
        for i, values in enumerate(r.fold_metrics):
            metrics += [(run_id, r.model_name, "cv", i, k, float(v)) for k, v in values.items() if v is not None]
    return spark.createDataFrame(models, EXPERIMENT_SCHEMA), spark.createDataFrame(metrics, METRIC_SCHEMA)


def cv_summary(metric_log: DataFrame) -> DataFrame:
    """Mean and population deviation over folds, per run, model and metric."""
    return metric_log.where("split_type = 'cv'").groupBy("run_id", "model_name", "metric_name").agg(
        F.count("*").alias("folds"), F.avg("metric_value").alias("cv_mean"), F.stddev_pop("metric_value").alias("cv_std")
    )


def batch_score(model: PipelineModel, df: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Predictions with confidence and, per class, probability columns; classes are decoded by position."""
    scored = model.transform(df)
    cells = [F.col("prediction")]
    if classes:
        names = F.array(*map(F.lit, classes))
        cells.append(F.get(names, F.col("prediction").cast("int")).alias("predicted_class"))
    if "probability" in scored.columns:
        p = vector_to_array("probability")
        cells.append((p[1] if classes is not None and len(classes) == 2 else F.array_max(p)).alias("confidence"))
        cells += [p[i].alias(f"probability_{c}") for i, c in enumerate(classes or [])]
    return scored.select(*df.columns, *cells)


def inference_latency_ms(model: PipelineModel, df: DataFrame, repeats: int = 3) -> float:
    """Mean milliseconds to score the rows, without writing them anywhere."""
    times = []
    for _ in range(repeats):
        start = time.perf_counter()
        model.transform(df).write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - start)
    return round(1000 * sum(times) / repeats, 3)


def model_size_kb(spark: SparkSession, path: str) -> float:
    """Size of a saved model; only file lengths are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return round((files.agg(F.sum("length")).first()[0] or 0) / 1024, 2)


__all__ = [
    "ENSEMBLE_NAME", "Experiment", "FeatureSet", "add_ensemble", "all_trained", "batch_score", "cv_summary", "ensemble_weights",
    "evaluate", "evaluate_on_test", "experiment_tables", "hard_vote", "importances",
    "inference_latency_ms", "make_features", "model_size_kb", "prepare", "run_experiments", "soft_vote", "train_all", "train_candidate",
    "vote",
]
