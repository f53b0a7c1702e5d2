"""Model families: from library names to MLlib estimators."""

from __future__ import annotations

from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.plans.knn_model import Neighbours
from tablewright.plans.spec import Candidate

# Class names and short names of each family, its complexity rank, and defaults.
FAMILIES = {
    "logistic_regression": ("LogisticRegression",),
    "ridge": ("Ridge",),
    "naive_bayes": ("GaussianNB",),
    "knn": ("KNeighborsClassifier", "KNeighborsRegressor"),
    "decision_tree": ("DecisionTreeClassifier", "DecisionTreeRegressor"),
    "random_forest": ("RandomForestClassifier", "RandomForestRegressor", "RandomForest", "rf"),
    "linear_svc": ("SVC",),
    "gradient_boosting": (
        "GradientBoostingClassifier", "GradientBoostingRegressor", "XGBClassifier", "XGBRegressor",
        "XGBoostClassifier", "XGBoostRegressor", "LGBMClassifier", "LGBMRegressor", "CatBoostClassifier",
        "CatBoostRegressor", "xgboost", "xgb", "lightgbm", "lgbm", "lgb", "catboost", "cb",
    ),
}
COMPLEXITY = {
    "logistic_regression": 1, "ridge": 1, "naive_bayes": 1, "knn": 2, "decision_tree": 2, "random_forest": 3,
    "linear_svc": 3, "gradient_boosting": 4, "ensemble": 6,
}
UNKNOWN_COMPLEXITY = 4
SCALED_FAMILIES = ("logistic_regression", "ridge", "linear_svc", "knn")
WEIGHTED_FAMILIES = ("logistic_regression", "random_forest", "decision_tree", "gradient_boosting", "linear_svc")


#: The depth MLlib allows, for trees without a limit.
DEEPEST = 30


#: Parameters that each family reads, and why others that are suggested or common are not.
PARAMETERS = {
    "logistic_regression": {"C", "max_iter"}, "ridge": {"alpha"}, "naive_bayes": set(), "linear_svc": {"C", "max_iter"}, "knn": {"n_neighbors", "weights"},
    "decision_tree": {"max_depth", "min_samples_split", "min_samples_leaf"},
    "random_forest": {"n_estimators", "max_depth", "min_samples_split", "min_samples_leaf", "max_features"},
    "gradient_boosting": {"n_estimators", "max_depth", "min_child_weight", "colsample_bytree", "learning_rate", "subsample", "validation_col"},
}
REFUSALS = {"reg_alpha": "boosted trees have no penalty on leaf weights here", "reg_lambda": "boosted trees have no penalty on leaf weights here"}


def refused_parameters(family: str, params: dict) -> dict[str, str]:
    """Parameters that a family does not read, with the reason."""
    return {k: REFUSALS.get(k, f"{family} has no such parameter") for k in params if k not in PARAMETERS[family]}


def _least_leaf(p: dict) -> int:
    """Rows of a leaf; a least size for splitting is met by leaves of half of it."""
    return max(int(p.get("min_samples_leaf", 1)), -(-int(p.get("min_samples_split", 2)) // 2))


def family_of(library: str) -> str:
    """Family by class name (any dotted path) or short name, in any case."""
    last = library.strip().rsplit(".", 1)[-1].lower()
    for family, names in FAMILIES.items():
        if last == family or last in {n.lower() for n in names}:
            return family
    raise ValueError(f"unknown model library '{library}'; known: {', '.join(supported_models())}")


def supported_models() -> list[str]:
    return sorted({n for names in FAMILIES.values() for n in names})


def balanced_weights(df: DataFrame, label: str, output: str = "weight", counted: Column | None = None) -> DataFrame:
    """Adds n / (classes x class size) to each row, counted over all rows or some of them.

    The class table is broadcast: one row per class.
    """
    counts = (df if counted is None else df.where(counted)).groupBy(label).agg(F.count("*").alias("__c"))
    total, classes = counts.agg(F.sum("__c"), F.count("*")).first()
    weights = counts.select(label, (F.lit(float(total)) / (F.lit(classes) * F.col("__c"))).alias(output))
    return df.join(F.broadcast(weights), label, "left")


def build_estimator(
    candidate: Candidate,
    task_type: str,
    rows: int,
    classes: int = 2,
    label_std: float = 1.0,
    weight_col: str | None = None,
    seed: int = 42,
    features: str = "features",
    label: str = "label",
):
    """Stages (scaler if the family needs one, then the estimator) for a candidate.

    ``rows`` and ``label_std`` translate inverse-strength and ridge penalties to MLlib's averaged loss.
    """
    family, p = family_of(candidate.library), dict(candidate.params)
    regression = task_type not in ("binary_classification", "multiclass_classification")
    stages, column = [], features
    if family in SCALED_FAMILIES:
        column = f"{features}__scaled"
        stages.append(StandardScaler(inputCol=features, outputCol=column, withMean=True, withStd=True))
    common = {"featuresCol": column, "labelCol": label}
    if weight_col and family in WEIGHTED_FAMILIES and not regression:
        common["weightCol"] = weight_col
    rows = max(rows, 1)

    if family == "logistic_regression":
        model = LogisticRegression(
            **common, maxIter=int(p.get("max_iter", 100)), regParam=1.0 / (float(p.get("C", 1.0)) * rows),
            standardization=False, family="multinomial" if classes > 2 else "auto",
        )
    elif family == "ridge":
        model = LinearRegression(
            **common, elasticNetParam=0.0, standardization=False,
            regParam=float(p.get("alpha", 1.0)) * max(label_std, 1e-12) / rows,
        )
    elif family == "naive_bayes":
        model = NaiveBayes(**common, modelType="gaussian")
    elif family == "linear_svc":
        base = LinearSVC(**common, regParam=1.0 / (float(p.get("C", 1.0)) * rows), maxIter=int(p.get("max_iter", 100)))
        model = base if classes <= 2 else OneVsRest(classifier=base, **common)
    elif family == "decision_tree":
        cls = DecisionTreeRegressor if regression else DecisionTreeClassifier
        model = cls(**common, maxDepth=int(p.get("max_depth") or DEEPEST), minInstancesPerNode=_least_leaf(p), seed=seed)
    elif family == "random_forest":
        cls = RandomForestRegressor if regression else RandomForestClassifier
        # With node numbers kept, tasks of a level need not be sent all trees grown so far; the trees are the same.
        model = cls(
            **common, cacheNodeIds=True, numTrees=int(p.get("n_estimators", 100)), maxDepth=int(p.get("max_depth") or DEEPEST),
            minInstancesPerNode=_least_leaf(p),
            featureSubsetStrategy=str(p.get("max_features", "auto")), seed=seed,
        )
    elif family == "gradient_boosting":
        cls = GBTRegressor if regression else GBTClassifier
        base = cls(
            **common, maxIter=int(p.get("n_estimators", 100)), maxDepth=int(p.get("max_depth", 3)), minInstancesPerNode=max(1, round(float(p.get("min_child_weight", 1)))),
            featureSubsetStrategy=str(float(p["colsample_bytree"])) if float(p.get("colsample_bytree", 1)) < 1 else "all", stepSize=float(p.get("learning_rate", 0.1)), subsamplingRate=float(p.get("subsample", 1.0)), seed=seed,
        )
        if p.get("validation_col"):
            base = base.setValidationIndicatorCol(p["validation_col"])
        model = base if regression or classes <= 2 else OneVsRest(classifier=base, **common)
    else:
        if p.get("weights", "uniform") not in ("uniform", "distance"):
            raise ValueError(f"weights must be uniform or distance; got {p['weights']!r}")
        model = Neighbours(**common, k=int(p.get("n_neighbors", 5)), classes=0 if regression else classes, byDistance=p.get("weights") == "distance")
    return [*stages, model]
