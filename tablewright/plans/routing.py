"""From semantic column types and a plan to the feature stages of an ML pipeline."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.numeric import present
from tablewright.functions.text import is_id_name
from tablewright.operators.features import (
    ZSCORE_LIMIT,
    CategoryEncoder,
    CategoryImputer,
    ColumnScaler,
    DateParts,
    FenceCapper,
    Interactions,
    LogShift,
    NumericImputer,
    TargetMeans,
    TextParts,
    TfIdf,
)
from tablewright.plans.knn_model import NeighbourImputer
from tablewright.plans.spec import ModelPlan

# How semantic types are routed.
CATEGORICAL_TYPES = ("categorical", "boolean", "high_cardinality")
STRUCTURED_TYPES = ("email", "url", "ip_address", "uuid", "phone_number")

#: How a plan's choice for missing numbers is filled. Rows with a gap are dropped from fitting only (``complete``); rows to be scored
#: with one take the median, as results keep all rows.
FILLS = {"mean": "mean", "median": "median", "mode": "most_frequent", "drop": "median", "none": "none"}


def complete(df: DataFrame, types: dict[str, str], plan: ModelPlan) -> Column:
    """Whether a row may be fitted on: under ``drop``, one without a gap in its numeric columns."""
    if plan.preprocessing.missing_strategy != "drop":
        return F.lit(True)
    return reduce(lambda a, b: a & b, [present(df, c) for c in route(types, plan)["numeric"]], F.lit(True))


def route(types: dict[str, str], plan: ModelPlan) -> dict[str, list[str]]:
    """Columns per kind of treatment; target, dropped and id columns go nowhere."""
    out: dict[str, list[str]] = {"numeric": [], "categorical": [], "datetime": [], "text": [], "structured": []}
    for c, kind in types.items():
        if c == plan.target_column or c in plan.preprocessing.drop_columns or is_id_name(c, plan.target_column):
            continue
        if kind in CATEGORICAL_TYPES:
            out["categorical"].append(c)
        elif kind in ("datetime", "text"):
            out[kind].append(c)
        elif kind in STRUCTURED_TYPES:
            out["structured"].append(c)
        else:
            out["numeric"].append(c)
    return out


def feature_stages(
    df: DataFrame, types: dict[str, str], plan: ModelPlan, label: str = "label", output: str = "features"
) -> list:
    """Unfitted stages; fit them on training rows only. ``df`` is only asked for the number of classes, by target codes."""
    columns = route(types, plan)
    stages, parts = [], []

    numeric = columns["numeric"]
    if numeric:
        names = [f"{c}__num" for c in numeric]
        if plan.preprocessing.missing_strategy == "knn":
            stages.append(NeighbourImputer(inputCols=numeric, outputCols=names))
        else:
            stages.append(NumericImputer(inputCols=numeric, outputCols=names, strategy=FILLS[plan.preprocessing.missing_strategy]))
        if plan.preprocessing.outlier_strategy in ("iqr_cap", "winsorize"):
            stages.append(FenceCapper(inputCols=names))
        elif plan.preprocessing.outlier_strategy == "zscore_cap":
            stages.append(FenceCapper(inputCols=names, kind="zscore", multiplier=ZSCORE_LIMIT))
        if "log" in plan.features.numeric_transforms:
            stages.append(LogShift(inputCols=names))
        if plan.preprocessing.scale_strategy != "none":
            stages.append(ColumnScaler(inputCols=names, kind=plan.preprocessing.scale_strategy))
        if plan.features.interaction_features and len(names) > 1:
            products = Interactions(inputCols=names)
            stages.append(products)
            parts += products.names()
        parts = names + parts

    categorical = columns["categorical"]
    if categorical and plan.features.categorical_strategy != "none":
        filled = [f"{c}__cat" for c in categorical]
        stages.append(CategoryImputer(inputCols=categorical, outputCols=filled))
        strategy = plan.features.categorical_strategy
        if strategy in ("freq_enc", "ordinal"):
            kind = "frequency" if strategy == "freq_enc" else "ordinal"
            coded = [f"{c}_code" for c in filled]
            stages.append(CategoryEncoder(inputCols=filled, outputCols=coded, kind=kind))
            parts += coded
        elif strategy == "target_enc":
            # As many classes as the label table has; labels are numbered from 0.
            classes = int((df.agg(F.max(label)).first()[0] or 0) + 1) if plan.is_classification else 0
            coded = [f"{c}_code" for c in filled]
            everything = sorted(c for names in columns.values() for c in names)
            means = TargetMeans(inputCols=filled, outputCols=coded, labelCol=label, foldCols=everything, classes=max(classes, 2) if plan.is_classification else 0)
            stages.append(means)
            parts += means.names()
        else:
            index, coded = ([f"{c}_{end}" for c in filled] for end in ("index", "code"))
            stages.append(CategoryEncoder(inputCols=filled, outputCols=index, kind="index"))
            # Unknown categories have a slot of their own, the last one, which is left out: they are all zeros.
            stages.append(OneHotEncoder(inputCols=index, outputCols=coded, handleInvalid="keep", dropLast=True))
            parts += coded

    if columns["datetime"]:
        dates = DateParts(inputCols=columns["datetime"], parts=list(plan.features.datetime_features))
        stages += [dates, ColumnScaler(inputCols=dates.names())]
        parts += dates.names()

    for c in columns["structured"]:
        strings = TextParts(inputCols=[c], semanticType=types[c])
        stages.append(strings)
        parts += strings.names()

    if plan.features.text_vectorizer in ("tfidf", "bow"):
        for c in columns["text"]:
            stages.append(TfIdf(inputCol=c, outputCol=f"{c}__tfidf"))
            parts.append(f"{c}__tfidf")

    if not parts:
        raise ValueError("the plan leaves no column to learn from")
    stages.append(VectorAssembler(inputCols=parts, outputCol=output, handleInvalid="keep"))
    return stages
