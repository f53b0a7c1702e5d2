"""The modelling plan: validated choices that parameterise the Spark jobs."""

from __future__ import annotations

from dataclasses import dataclass, field

# Allowed choices and ranges.
TASKS = (
    "binary_classification", "multiclass_classification", "regression", "clustering", "time_series_forecasting",
)
CLASSIFICATION = ("binary_classification", "multiclass_classification")
MISSING = ("mean", "median", "mode", "knn", "drop", "none")
OUTLIERS = ("iqr_cap", "zscore_cap", "winsorize", "none")
SCALING = ("standard", "minmax", "robust", "none")
ENCODINGS = ("onehot", "target_enc", "freq_enc", "ordinal", "none")
CV_STRATEGIES = ("stratified_kfold", "kfold", "timeseries_split", "holdout")
FOLD_RANGE = (2, 20)
TEST_RANGE = (0.05, 0.4)
CANDIDATE_RANGE = (2, 6)
PRIORITY_RANGE = (1, 5)


def _choice(name: str, value, allowed) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(map(str, allowed))}; got {value!r}")


def _range(name: str, value, bounds) -> None:
    if not bounds[0] <= value <= bounds[1]:
        raise ValueError(f"{name} must lie between {bounds[0]} and {bounds[1]}; got {value!r}")


@dataclass(frozen=True)
class Preprocessing:
    missing_strategy: str = "median"
    outlier_strategy: str = "none"
    scale_strategy: str = "none"
    drop_columns: tuple[str, ...] = ()

    def __post_init__(self):
        _choice("missing_strategy", self.missing_strategy, MISSING)
        _choice("outlier_strategy", self.outlier_strategy, OUTLIERS)
        _choice("scale_strategy", self.scale_strategy, SCALING)


@dataclass(frozen=True)
class Features:
    numeric_transforms: tuple[str, ...] = ()
    categorical_strategy: str = "onehot"
    datetime_features: tuple[str, ...] = ("year", "month", "day", "dayofweek", "is_weekend")
    interaction_features: bool = False
    text_vectorizer: str | None = "tfidf"

    def __post_init__(self):
        _choice("categorical_strategy", self.categorical_strategy, ENCODINGS)
        _choice("text_vectorizer", self.text_vectorizer, ("tfidf", "bow", "none", None))


@dataclass(frozen=True)
class Candidate:
    name: str
    library: str
    priority: int = 1
    params: dict = field(default_factory=dict)

    def __post_init__(self):
        _range("priority", self.priority, PRIORITY_RANGE)


@dataclass(frozen=True)
class Evaluation:
    primary_metric: str = "f1_macro"
    cv_strategy: str = "stratified_kfold"
    n_folds: int = 5
    handle_imbalance: bool = False
    test_size: float = 0.2

    def __post_init__(self):
        _choice("cv_strategy", self.cv_strategy, CV_STRATEGIES)
        _range("n_folds", self.n_folds, FOLD_RANGE)
        _range("test_size", self.test_size, TEST_RANGE)


@dataclass(frozen=True)
class ModelPlan:
    task_type: str
    target_column: str
    candidates: tuple[Candidate, ...]
    preprocessing: Preprocessing = Preprocessing()
    features: Features = Features()
    evaluation: Evaluation = Evaluation()

    def __post_init__(self):
        _choice("task_type", self.task_type, TASKS)
        _range("number of candidates", len(self.candidates), CANDIDATE_RANGE)

    @property
    def is_classification(self) -> bool:
        return self.task_type in CLASSIFICATION

    @property
    def fold_count(self) -> int:
        """Models that cross-validation fits per candidate; a hold-out is judged once, on the validation rows."""
        return 1 if self.evaluation.cv_strategy == "holdout" else self.evaluation.n_folds

    @property
    def fits_on_earlier_folds(self) -> bool:
        """Whether a fold's model sees only folds with a smaller number, not all others."""
        return self.is_sequential or self.evaluation.cv_strategy == "holdout"

    @property
    def is_sequential(self) -> bool:
        return self.task_type == "time_series_forecasting" or self.evaluation.cv_strategy == "timeseries_split"
