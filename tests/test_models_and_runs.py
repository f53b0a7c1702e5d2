"""Training, ensembles, explanations, ranking, run tables, sources, cleaning and streaming."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tablewright.operators import catalogue as K
from tablewright.operators import clean as C
from tablewright.operators import diagnosis as D
from tablewright.operators import explain as E
from tablewright.operators import features as X
from tablewright.operators import ranking as R
from tablewright.operators import risk
from tablewright.plans import training as TR
from tablewright.plans.knn_model import Neighbours, NeighboursModel
from tablewright.plans.models import COMPLEXITY, family_of, supported_models
from tablewright.plans.models import refused_parameters
from tablewright.plans.refinement import refine
from tablewright.plans.routing import feature_stages
from tablewright.plans.spec import Candidate, Evaluation, Features, ModelPlan
from tablewright.runtime import scratch_path
from tablewright.sources import digests, readers, writers

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2))
    frame = pd.DataFrame({
        "row": range(400), "x1": x[:, 0], "x2": x[:, 1], "s": rng.choice(["u", "v"], 400),
        "y": np.where(x[:, 0] + 0.5 * x[:, 1] > 0, "yes", "no"), "z": 3 * x[:, 0] - x[:, 1] + rng.normal(scale=0.1, size=400),
    })
    return spark.createDataFrame(frame).persist()


TYPES = {"x1": "numeric", "x2": "numeric", "s": "categorical"}


def test_experiment_beats_the_majority_and_failures_are_recorded(spark, separable):
    plan = ModelPlan(
        "binary_classification", "y",
        (
            Candidate("Linear", "sklearn.linear_model.LogisticRegression"),
            Candidate("Tree", "DecisionTreeClassifier", params={"max_depth": 4}),
            Candidate("Near", "sklearn.neighbors.KNeighborsClassifier", params={"n_neighbors": 7}),
            Candidate("Broken", "sklearn.neighbors.KNeighborsClassifier", params={"weights": "odd"}),
        ),
        features=Features(categorical_strategy="freq_enc"), evaluation=Evaluation(n_folds=2),
    )
    results, data = TR.run_experiments(separable, plan, TYPES, ["x1", "x2", "s"])
    by_name = {r.model_name: r for r in results}
    assert by_name["Broken"].status == "failed" and "weights" in by_name["Broken"].error
    assert by_name["Near"].status == "success" and by_name["Near"].metrics["test"]["accuracy"] > 0.85
    assert by_name["Linear"].metrics["test"]["accuracy"] > 0.9
    assert by_name["Linear"].importances[0][0].startswith("x1")
    weights = by_name[TR.ENSEMBLE_NAME].hyperparams["weights"]
    assert sum(weights.values()) == pytest.approx(1.0) and len(by_name[TR.ENSEMBLE_NAME].fold_metrics) == 2
    assert by_name[TR.ENSEMBLE_NAME].metrics["test"]["roc_auc"] > 0.9
    models, log = TR.experiment_tables(spark, "r", results)
    cv = TR.cv_summary(log).where("metric_name = 'f1_macro'").join(models, ["run_id", "model_name"])
    winners = R.select_winners(cv)
    overlap = spark.createDataFrame([("r", 0, 0, 0)], "run_id string, train_val int, train_test int, val_test int")
    checks = {r["check"]: r["result"] for r in K.consistency_checks(models, log, winners, overlap).collect()}
    assert set(checks.values()) == {"pass"}
    scored = TR.batch_score(by_name["Linear"].model, separable, ["no", "yes"])
    assert scored.where("predicted_class = y").count() > 360
    assert scored.where("abs(probability_no + probability_yes - 1) > 1e-9").count() == 0


def test_a_candidate_that_breaks_down_is_no_result(spark, separable, monkeypatch):
    """A search that fails is raised, as the metric table would look whole without its rows; a refused candidate is recorded, and counts as missing where all are asked for."""
    search = NeighboursModel._transform

    def broken(self, df):
        raise OSError("no space left on device")

    linear, near = Candidate("Linear", "LogisticRegression"), Candidate("Near", "KNeighborsClassifier")
    plan = ModelPlan("binary_classification", "y", (linear, near), features=Features(categorical_strategy="freq_enc"), evaluation=Evaluation(n_folds=2))
    prepared = TR.prepare_features(separable, plan, TYPES, ["x1", "x2", "s"])
    monkeypatch.setattr(NeighboursModel, "_transform", broken)
    with pytest.raises(OSError, match="no space left"):
        TR.train_candidate(prepared.folds, prepared.final, plan, near, 2)
    with pytest.raises(OSError, match="no space left"):
        TR.run_prepared(prepared, plan)
    monkeypatch.setattr(NeighboursModel, "_transform", search)
    refused = TR.train_candidate(prepared.folds, prepared.final, plan, Candidate("Odd", "NoSuchModel"), 2)
    assert refused.status == "failed" and "NoSuchModel" in refused.error
    with pytest.raises(RuntimeError, match="Odd: ValueError"):
        TR.all_trained([refused])


def test_neighbours_as_a_stage(spark, separable):
    """Classes, chances and numbers as the joins give them; saved and loaded; rows keep their other columns."""
    rows = VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(separable.withColumn("label", (F.col("y") == "yes").cast("double")))
    train, test = rows.where("row % 4 > 0"), rows.where("row % 4 = 0").drop("label")
    x, q = (np.array(df.select("x1", "x2").orderBy("row").collect()) for df in (train, test))
    labels, z = (np.array([r[0] for r in train.orderBy("row").select(c).collect()]) for c in ("label", "z"))
    order = np.argsort(((q[:, None] - x[None]) ** 2).sum(-1), axis=1)[:, :5]
    model = Neighbours(k=5).fit(train)
    path = scratch_path(spark, "neighbours")
    model.write().overwrite().save(path)
    for one in (model, NeighboursModel.load(path)):
        found = one.transform(test).orderBy("row").collect()
        assert [r["prediction"] for r in found] == [float(v > 2) for v in labels[order].sum(axis=1)]
        assert np.allclose([r["probability"][1] for r in found], labels[order].mean(axis=1)) and "s" in found[0].asDict()
    numbers = Neighbours(k=5, classes=0, labelCol="z", byDistance=True).fit(train).transform(test).orderBy("row").collect()
    weights = 1 / np.sqrt(((q[:, None] - x[order]) ** 2).sum(-1))
    assert np.allclose([r["prediction"] for r in numbers], (weights * z[order]).sum(axis=1) / weights.sum(axis=1))


def test_neighbours_are_searched_once_for_a_set_of_rows(spark, separable, monkeypatch):
    searched, search = [], NeighboursModel._transform

    def watched(self, df):
        scored = search(self, df)
        searched.append(scored)
        return scored

    monkeypatch.setattr(NeighboursModel, "_transform", watched)
    near, linear = Candidate("Near", "KNeighborsClassifier"), Candidate("Linear", "LogisticRegression")
    plan = ModelPlan("binary_classification", "y", (linear, near), features=Features(categorical_strategy="freq_enc"), evaluation=Evaluation(n_folds=2))
    prepared = TR.prepare_features(separable, plan, TYPES, ["x1", "x2", "s"])
    results = TR.run_prepared(prepared, plan)
    assert [r.status for r in results] == ["success"] * 3 and len(searched) == 5
    # The scored rows are read, not found again.
    assert all("ExistingRDD" in plan and "Join" not in plan and "Python" not in plan for plan in (df._jdf.queryExecution().executedPlan().toString() for df in searched))
    weights, rows = results[-1].hyperparams["weights"], prepared.final.rows.where("split = 'test'")
    members = [next(r.estimator for r in results if r.model_name == n) for n in weights]
    plain = TR.evaluate(TR.vote(rows, members, list(weights.values()), True), plan, 2)
    assert plain == pytest.approx(results[-1].metrics["test"])


def test_forward_folds_fit_nothing_of_the_future(spark, separable):
    plan = ModelPlan(
        "regression", "z", (Candidate("Ridge", "Ridge"), Candidate("Tree", "DecisionTreeRegressor", params={"max_depth": 3})),
        features=Features(categorical_strategy="ordinal"), evaluation=Evaluation(n_folds=3, cv_strategy="timeseries_split", primary_metric="rmse"),
    )
    data, _ = TR.prepare(separable, plan, ["x1", "x2", "s"], "row")
    folded = TR.with_folds(data, plan, ["x1", "x2", "s"], order_col="row")
    test_from = folded.where("split = 'test'").agg(F.min("row")).first()[0]
    for i in range(3):
        fitted = folded.where(TR.fitted_in(plan, i)).agg(F.max("row"), F.count("*")).first()
        judged = folded.where((F.col("fold") == i) & (F.col("split") != "test")).agg(F.min("row"), F.max("row"), F.count("*")).first()
        assert fitted[0] < judged[0] <= judged[1] < test_from and judged[2] == 320 // 4 and fitted[1] == 320 - (3 - i) * 80
    results, _ = TR.run_experiments(separable, plan, TYPES, ["x1", "x2", "s"], "row")
    assert [r.status for r in results] == ["success"] * 3 and len(results[0].fold_metrics) == 3


def test_a_holdout_is_judged_once(spark, separable):
    plan = ModelPlan(
        "binary_classification", "y", (Candidate("Linear", "LogisticRegression"), Candidate("Bayes", "GaussianNB")),
        features=Features(categorical_strategy="freq_enc"), evaluation=Evaluation(cv_strategy="holdout"),
    )
    results, _ = TR.run_experiments(separable, plan, TYPES, ["x1", "x2", "s"])
    linear = results[0]
    assert len(linear.fold_metrics) == 1 and linear.fold_metrics[0]["accuracy"] == pytest.approx(linear.metrics["val"]["accuracy"])


def test_target_codes_hold_no_label_of_their_own(spark):
    """A label that is noise must stay noise: codes of unique categories are the mean of the other folds."""
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"c": [f"c{k}" for k in range(300)], "label": rng.integers(0, 2, 300).astype(float), X.FITTED: True})
    df = spark.createDataFrame(frame)
    means = X.TargetMeans(inputCols=["c"], outputCols=["code"], foldCols=["c"], classes=2)
    model = means.fit(df)
    rows = model.transform(df).toPandas()
    assert abs(np.corrcoef(rows["code"], rows["label"])[0, 1]) < 0.25
    assert rows["code"].nunique() <= 5
    flipped = df.withColumn("label", F.when(F.col("c") == "c7", 1 - F.col("label")).otherwise(F.col("label")))
    again = means.fit(flipped).transform(flipped).toPandas()
    assert again.loc[again["c"] == "c7", "code"].item() == rows.loc[rows["c"] == "c7", "code"].item()
    path = scratch_path(spark, "means")
    model.write().overwrite().save(path)
    unseen = spark.createDataFrame([("zz",), (None,), ("c7",)], "c string")
    found = [r["code"] for r in X.TargetMeansModel.load(path).transform(unseen).collect()]
    whole = frame["label"].mean()
    assert found == pytest.approx([whole, whole, (frame["label"][7] + 10 * whole) / 11])


def test_one_hot_of_many_categories_is_sparse(spark):
    df = spark.range(100_000).select((F.col("id") % 50_000).cast("string").alias("c"), F.lit(1.0).alias("label"))
    plan = ModelPlan("regression", "label", (Candidate("a", "Ridge"), Candidate("b", "Ridge")), features=Features(categorical_strategy="onehot"))
    stages = feature_stages(df, {"c": "high_cardinality"}, plan)
    out = Pipeline(stages=stages).fit(df).transform(df.union(spark.createDataFrame([("new", 1.0)], df.schema)))
    shown = out.select("c", F.col("features").cast("string").alias("v"))
    codes = {r["c"]: r["v"] for r in shown.where("c in ('0', '10', '9999', 'new')").distinct().collect()}
    place = {c: i for i, c in enumerate(sorted(map(str, range(50_000))))}
    assert codes.pop("new") == "(50000,[],[])"
    assert codes == {c: f"(50000,[{place[c]}],[1.0])" for c in ("0", "10", "9999")}
    assert shown.select("v").distinct().count() == 50_001


def test_refinement_tries_refuses_and_promotes(spark, separable):
    noisy = separable.withColumn("y", F.when(F.col("row") % 3 == 0, F.when(F.col("y") == "yes", "no").otherwise("yes")).otherwise(F.col("y")))
    forest = Candidate("Forest", "RandomForestClassifier", params={"n_estimators": 10})
    boost = Candidate("Boost", "XGBClassifier", params={"n_estimators": 15, "max_depth": 6})
    plan = ModelPlan("binary_classification", "y", (forest, boost), features=Features(categorical_strategy="freq_enc"), evaluation=Evaluation(n_folds=2, primary_metric="f1_macro"))
    prepared = TR.prepare_features(noisy, plan, TYPES, ["x1", "x2", "s"])
    results = TR.run_prepared(prepared, plan, with_ensemble=False)
    found = refine(spark, "r", results, "Forest", prepared, plan)
    assert "overfitting" in found.issues and found.refined.status == "success" and found.refined.hyperparams["max_depth"] == 8
    assert {r["parameter"]: r["outcome"] for r in found.lineage.collect()} == dict.fromkeys(("max_depth", "min_samples_split", "min_samples_leaf", "max_features"), "tried")
    verdict = found.verdict.first()
    gap = lambda r: r.metrics["train"]["f1_macro"] - r.metrics["val"]["f1_macro"]
    assert verdict["gap_reduced"] == pytest.approx(gap(found.first) - gap(found.refined), abs=1e-4)
    assert found.winner is (found.refined if verdict["promote"] else found.first)
    outcomes = {r["parameter"]: r["outcome"] for r in refine(spark, "r", results, "Boost", prepared, plan).lineage.collect()}
    assert outcomes["max_depth"] == "tried" and outcomes["reg_alpha"].startswith("refused:") and outcomes["reg_lambda"].startswith("refused:")
    for family, issue in D.SUGGESTIONS:
        assert set(refused_parameters(family, D.SUGGESTIONS[family, issue])) <= {"reg_alpha", "reg_lambda"}


def test_artifacts_of_all_runs_in_one_job(spark):
    root = scratch_path(spark, "artifacts")
    runs = spark.createDataFrame([("a",), ("b",), ("c",)], "run_id string")
    summary = spark.createDataFrame([("a", 3, float("nan")), ("b", 4, 1.5)], "run_id string, num_rows bigint, duplicate_pct double")
    writers.write_artifacts({"quality_report": summary, "dataset_summary": summary.select("run_id", "num_rows")}, root)
    writers.write_artifacts({"quality_report": summary.where("run_id = 'b'").withColumn("num_rows", F.lit(9).cast("bigint"))}, root)
    found = {r["run_id"]: r for r in writers.read_run_artifacts(spark, root, runs).collect()}
    assert found["a"]["quality_report"]["num_rows"] == 3 and found["a"]["quality_report"]["duplicate_pct"] is None
    assert found["b"]["quality_report"]["num_rows"] == 9 and found["b"]["dataset_summary"]["num_rows"] == 4
    assert found["c"]["quality_report"] is None and found["a"]["execution_plan"] is None
    writers.write_artifacts({"risk_assessment": spark.createDataFrame([("a", 1), ("a", 2)], "run_id string, total_risks bigint")}, root)
    with pytest.raises(Exception, match="more than one risk_assessment"):
        writers.read_run_artifacts(spark, root, runs).collect()
    with pytest.raises(ValueError, match="no such artifacts"):
        writers.write_artifacts({"odd": summary}, root)
    spark.range(2).write.parquet(f"{root}/models/a/forest")
    spark.range(2).write.parquet(f"{root}/models/a/linear")
    assert [tuple(r) for r in writers.saved_models(spark, root).collect()] == [("a", 2)]


def test_regression_experiment(spark, separable):
    plan = ModelPlan(
        "regression", "z", (Candidate("Ridge", "Ridge"), Candidate("Forest", "RandomForestRegressor", params={"n_estimators": 5, "max_depth": 4})),
        features=Features(categorical_strategy="ordinal"), evaluation=Evaluation(n_folds=2, primary_metric="rmse"),
    )
    results, _ = TR.run_experiments(separable, plan, TYPES, ["x1", "x2", "s"])
    by_name = {r.model_name: r for r in results}
    assert by_name["Ridge"].metrics["test"]["r2"] > 0.99 and by_name["Ridge"].status == "success"
    assert by_name[TR.ENSEMBLE_NAME].metrics["test"]["r2"] > 0.8


def test_boosting_handles_several_classes(spark, separable):
    three = separable.withColumn("k", F.floor(F.least(F.greatest(F.col("x1"), F.lit(-1.4)), F.lit(1.4)) + 1.5).cast("int"))
    plan = ModelPlan(
        "multiclass_classification", "k", (Candidate("Boost", "XGBClassifier", params={"n_estimators": 3}), Candidate("Bayes", "GaussianNB")),
        features=Features(categorical_strategy="freq_enc"), evaluation=Evaluation(n_folds=2, handle_imbalance=True),
    )
    results, _ = TR.run_experiments(three, plan, TYPES, ["x1", "x2", "s"])
    assert [r.error for r in results] == [None] * 3
    assert results[0].metrics["test"]["accuracy"] > 0.8 and "roc_auc" not in results[0].metrics["test"]
    assert TR.ENSEMBLE_NAME == results[-1].model_name


def test_class_scores():
    counts = {(0.0, 0.0): 5, (0.0, 1.0): 1, (1.0, 1.0): 3, (1.0, 0.0): 1}
    out = TR.class_scores(counts, binary=True)
    assert out["accuracy"] == 0.8 and out["precision"] == 0.75 and out["recall"] == 0.75
    multi = TR.class_scores({("a", "a"): 2, ("b", "a"): 1, ("c", "b"): 1}, binary=False)
    assert multi["f1_macro"] == pytest.approx((0.8 + 0 + 0) / 3) and multi["accuracy"] == 0.5


def test_ensemble_weights():
    got = TR.ensemble_weights([("a", 0.9), ("b", 0.6), ("c", 0.0), ("d", -1.0)], True)
    assert [n for n, _ in got] == ["a", "b", "c"] and sum(w for _, w in got) == pytest.approx(1.0)
    assert TR.ensemble_weights([("a", 2.0), ("b", 1.0)], False)[0][0] == "b"


def test_votes(spark):
    df = spark.createDataFrame([([0.6, 0.4], [0.3, 0.7], 0.0, 1.0, 1.0)], "p array<double>, q array<double>, a double, b double, c double")
    mean, best = TR.soft_vote([F.col("p"), F.col("q")], [0.5, 0.5])
    assert df.select(best).first()[0] == 1.0 and np.allclose(df.select(mean).first()[0], [0.45, 0.55])
    assert df.select(TR.hard_vote([F.col(c) for c in "abc"], [0.5, 0.25, 0.25])).first()[0] == 0.0
    assert df.select(TR.hard_vote([F.col(c) for c in "abc"], [0.4, 0.35, 0.25])).first()[0] == 1.0


def test_model_names():
    assert family_of("lightgbm.LGBMClassifier") == "gradient_boosting" and family_of("rf") == "random_forest"
    assert all(family_of(n) in COMPLEXITY for n in supported_models())
    with pytest.raises(ValueError):
        family_of("my.Own")


@pytest.fixture(scope="module")
def vectors(spark, separable):
    rows = separable.withColumn("label", (F.col("y") == "yes").cast("double"))
    return VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(rows).persist()


def _largest_gap(spark, scored, output, phi, base):
    sums = phi.groupBy("row").agg(F.sum("phi").alias("s"))
    return scored.select("row", output.alias("o")).join(sums, "row").select(F.max(F.abs(F.col("o") - F.col("s") - base))).first()[0]


@pytest.mark.parametrize("kind,params", [
    (DecisionTreeClassifier, {"maxDepth": 4}), (RandomForestRegressor, {"numTrees": 3, "maxDepth": 3, "labelCol": "z"}),
    (GBTRegressor, {"maxIter": 3, "maxDepth": 2, "labelCol": "z"}), (GBTClassifier, {"maxIter": 3, "maxDepth": 2}),
])
def test_tree_values_add_up(spark, vectors, kind, params):
    model = kind(**params).fit(vectors)
    scored = model.transform(vectors)
    output = F.col("prediction")
    if "probability" in scored.columns:
        output = vector_to_array("probability")[1]
    if kind is GBTClassifier:
        output = vector_to_array("rawPrediction")[1]
    phi = E.tree_shapley(model, vectors, "row", ["x1", "x2"])
    assert phi.count() == 800
    assert _largest_gap(spark, scored, output, phi, E.tree_expectation(spark, model)) < 1e-9


def test_tree_values_equal_enumeration():
    # Leaf reached when f0 <= 0 (left, 40% of rows) and f1 > 1 (right, 25% of those).
    path = [(0, 0.0, True, 0.4), (1, 1.0, False, 0.25)]
    x = np.array([[-1.0, 2.0], [-1.0, 0.0], [1.0, 2.0], [1.0, 0.0]])
    got = E._leaf_shares(x, path, 2)
    for row, (a, b) in zip(got, [(1, 1), (1, 0), (0, 1), (0, 0)]):
        v = lambda s0, s1: (a if s0 else 0.4) * (b if s1 else 0.25)
        expected0 = 0.5 * (v(1, 0) - v(0, 0)) + 0.5 * (v(1, 1) - v(0, 1))
        assert row[0] == pytest.approx(expected0)


def test_sampled_values_add_up_and_match_linear(spark, vectors):
    model = LogisticRegression().fit(vectors)
    background, rows = vectors.where("row < 20"), vectors.where("row BETWEEN 30 AND 34")
    margin = vector_to_array("rawPrediction")[1]
    phi = E.sampled_shapley(model, rows, background, "row", ["x1", "x2"], margin)
    base = model.transform(background).agg(F.avg(margin)).first()[0]
    assert _largest_gap(spark, model.transform(rows), margin, phi, base) < 1e-9
    mean = background.agg(F.avg("x1")).first()[0]
    x1 = {r["row"]: r["x1"] for r in rows.collect()}
    for r in phi.where("feature = 'x1'").collect():
        assert r["phi"] == pytest.approx(model.coefficients[0] * (x1[r["row"]] - mean), abs=1e-9)


def test_winner_ties_prefer_stable_then_simple(spark):
    rows = [("r", "big", "xgb", 0.9, 0.02, 9.0), ("r", "small", "LogisticRegression", 0.90001, 0.02, 9.0), ("r", "wild", "rf", 0.90001, 0.2, 1.0)]
    df = spark.createDataFrame(rows, "run_id string, model_name string, library string, cv_mean double, cv_std double, duration_seconds double")
    w = R.select_winners(df).first()
    assert w["model_name"] == "small" and w["runner_up_name"] == "big" and w["is_tie"]
    errors = R.select_winners(df.withColumn("cv_mean", F.col("cv_mean") + F.when(F.col("model_name") == "wild", -0.5).otherwise(0)), True).first()
    assert errors["model_name"] == "wild" and not errors["is_tie"]


def test_composite_of_one_model_and_weights(spark):
    df = spark.createDataFrame([("r", "m", 0.8, 0.0, 5.0, 1.0, 0.6)], "run_id string, model_name string, metric double, latency_ms double, size_kb double, cost_s double, gap double")
    r = R.composite_scores(df).first()
    assert r["performance"] == 1.0 and r["penalty"] == 0.5 and r["composite_score"] == 0.25
    assert R.parse_weights("1,1,1,1") == (0.25,) * 4 and R.parse_weights("x", "fast") == R.PRESETS["fast"]


def test_diagnosis_and_suggestions(spark):
    rows = [("r", "over", 0.99, 0.7, 0.9, 0.6), ("r", "under", 0.6, 0.5, 0.5, 0.5), ("r", "fine", 0.9, 0.89, 0.9, 0.89)]
    pairs = spark.createDataFrame(rows, "run_id string, model_name string, train_value double, val_value double, accuracy double, f1_macro double")
    issues = D.diagnose(pairs, "f1_macro", True)
    got = {(r["model_name"], r["category"]): r["severity"] for r in issues.collect()}
    assert got == {("over", "overfitting"): "critical", ("over", "class_imbalance"): "medium", ("under", "underfitting"): "high", ("under", "overfitting"): "medium"}
    health = {r["model_name"]: r["health"] for r in D.model_health(pairs, issues).collect()}
    assert health == {"over": "critical", "under": "warning", "fine": "healthy"}
    assert D.suggested_params("ridge", {"overfitting", "underfitting"}, {"x": 1}) == {"x": 1, "alpha": 10.0}
    assert D.suggested_params("naive_bayes", {"overfitting"}) == {}


def test_replay_counts_missing_metrics_as_zero(spark):
    schema = "run_id string, model_name string, metric_name string, metric_value double"
    old = spark.createDataFrame([("r", "m", "f1", 0.5)], schema)
    new = spark.createDataFrame([("r", "m", "f1", 0.505), ("r", "m", "auc", 0.9)], schema)
    verdict = K.replay_verdict(K.replay_differences(old, new)).first()
    assert (verdict["metrics"], verdict["matches"], verdict["reproduced"]) == (2, 1, False)


def test_run_tables_round_trip(spark):
    root = scratch_path(spark, "runs")
    models = spark.createDataFrame([("r1", "m", "rf", "success", 1.0, "{}", None, None)], writers.EXPERIMENT_SCHEMA)
    log = spark.createDataFrame([("r1", "m", "val", None, "f1", 0.5)], writers.METRIC_SCHEMA)
    for _ in range(2):
        writers.append_experiments(models, log, root)
    back_models, back_log = writers.read_experiments(spark, root)
    assert back_models.count() == 2 and back_log.where("run_id = 'r1'").count() == 2


def test_read_formats(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1, "s": "a"},\n {"x": 2, "s": null}]')
    (tmp_path / "b.json").write_text('{"x": 1}\n{"x": 2}\n{"x": 3}\n')
    (tmp_path / "c.csv").write_text('x,s\n1,"a,b"\n2,"say ""hi"""\n')
    assert readers.read_table(spark, str(tmp_path / "a.json")).count() == 2
    assert readers.read_table(spark, str(tmp_path / "b.json")).count() == 3
    rows = readers.read_table(spark, str(tmp_path / "c.csv")).collect()
    assert [r["s"] for r in rows] == ["a,b", 'say "hi"'] and rows[0]["x"] == 1
    with pytest.raises(FileNotFoundError):
        readers.read_table(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path / "c.xlsx"))


def test_fingerprints(spark, tmp_path, monkeypatch):
    import hashlib

    (tmp_path / "a.csv").write_text("x\n1\n")
    monkeypatch.setattr(digests, "CHUNK_BYTES", 2)  # files are never held whole
    one = readers.file_fingerprint(spark, str(tmp_path / "a.csv")).first()
    assert one["md5"] == hashlib.md5(b"x\n1\n").hexdigest() and one["sha256"] == hashlib.sha256(b"x\n1\n").hexdigest()
    (tmp_path / "b.csv").write_text("x\n2\n")
    both = readers.file_fingerprint(spark, str(tmp_path)).first()
    (tmp_path / "b.csv").write_text("x\n3\n")
    (tmp_path / "odd name #1%20.csv").write_text("x\n4\n")
    changed = readers.file_fingerprint(spark, str(tmp_path)).first()
    assert both["files"] == 2 and changed["files"] == 3 and both["md5"] != changed["md5"] and both["sha256"] != changed["sha256"]
    df = spark.range(100).withColumn("v", F.when(F.col("id") > 3, F.rand(1)))
    a, b = readers.content_fingerprint(df).first(), readers.content_fingerprint(df.repartition(7).orderBy("v")).first()
    assert a == b and a != readers.content_fingerprint(df.where("id > 0")).first()
    twice = spark.createDataFrame([(1,), (1,)], "x int")
    thrice = spark.createDataFrame([(2,), (2,)], "x int")
    assert readers.content_fingerprint(twice).first() != readers.content_fingerprint(thrice).first()


def test_clean_dataset(spark):
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({
        "row_id": range(300), "user_id": range(300), "x": np.append(rng.normal(size=296), [50, 60, -70, 80]),
        "w": np.append(rng.normal(size=296), [40, -60, 70, 80]), "flat": 1.0, "note": "n", "target": rng.normal(size=300),
    })
    frame["twice"] = frame["w"] * 2
    df = spark.createDataFrame(frame)
    out, report = C.clean_dataset(df, "row_id", "target", ["note"], "cap", True, "report")
    assert ("user_id", "Non-predictive ID Column") in report.cols_dropped and ("note", "Explicitly Ignored") in report.cols_dropped
    assert ("flat", "Zero Variance") in report.cols_dropped and {c for c, r in report.cols_dropped if r == "High VIF"} == {"w", "twice"}
    assert report.capped_columns == ["x"] and out.agg(F.max("x")).first()[0] < 10
    assert set(out.columns) == {"row_id", "x", "target"}
    removed, rep = C.clean_dataset(df, "row_id", "target", ["note", "twice"], "report", False, "remove")
    assert removed.count() == rep.cleaned_rows == 300 - rep.rows_removed
    assert rep.rows_removed >= 4 or rep.consensus_pct >= 5.0
    assert C.clean_summary(df, rep).first()["rows_removed"] == rep.rows_removed


def test_no_risks_is_info(spark):
    none = spark.createDataFrame([], "severity string, category string, column_name string, description string, recommendation string")
    assert tuple(risk.overall_severity(none).first()) == ("INFO", 0)


def test_source_rules():
    """Words that must not occur anywhere in the code."""
    text = "\n".join(p.read_text() for p in ROOT.glob("tablewright/**/*.py"))
    for banned in ("localCheckpoint", ".crossJoin(", "sc.parallelize"):
        assert banned not in text


@pytest.mark.parametrize("kind", ["tree", "forest", "boosting"])
def test_tree_values_add_up_with_one_hot_columns(spark, kind):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor

    df = spark.range(400).selectExpr("id AS row", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 3 = 1 THEN 'b' ELSE 'c' END AS c", "CAST(id % 7 AS double) AS x",
                                     "CAST(IF(id % 3 = 0, 10, 0) + id % 7 AS double) AS label")
    stages = [StringIndexer(inputCol="c", outputCol="i"), OneHotEncoder(inputCol="i", outputCol="o", dropLast=False), VectorAssembler(inputCols=["o", "x"], outputCol="features")]
    rows = Pipeline(stages=stages).fit(df).transform(df)
    model = {"tree": DecisionTreeRegressor(), "forest": RandomForestRegressor(numTrees=5, seed=1), "boosting": GBTRegressor(maxIter=4, seed=1)}[kind].fit(rows)
    phi = E.tree_shapley(model, rows, "row", ["a", "b", "c", "x"]).groupBy("row").agg(F.sum("phi").alias("total"))
    gap = model.transform(rows).join(phi, "row").select(F.abs(F.col("prediction") - F.col("total") - E.tree_expectation(spark, model)).alias("gap"))
    assert gap.agg(F.max("gap")).first()[0] < 1e-6


def test_json_files_of_all_kinds_keep_their_records(spark, tmp_path):
    from tablewright.sources.readers import read_table

    folder = tmp_path / "mixed.json"
    folder.mkdir()
    (folder / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    (folder / "b.json").write_text('{"a": 3}\n{"a": 4}\n{"a": 5}\n')
    (folder / "c.json").write_text('{\n  "a": 6\n}\n')
    assert sorted(r["a"] for r in read_table(spark, str(folder)).collect()) == [1, 2, 3, 4, 5, 6]
    (folder / "d.json").write_text('{"a": 7}\n{"a": ')
    with pytest.raises(Exception):
        read_table(spark, str(folder), schema="a bigint").collect()


def test_csv_without_line_breaks_is_split(spark, tmp_path):
    path = str(tmp_path / "many.csv")
    Path(path).write_text("k,s\n" + "".join(f'{i},"a, ""{i}"""\n' for i in range(50_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        whole = readers.read_table(spark, path, schema="k long, s string")
        split = readers.read_table(spark, path, schema="k long, s string", line_breaks=False)
        assert whole.rdd.getNumPartitions() == 1 < split.rdd.getNumPartitions()
        assert whole.exceptAll(split).count() == split.exceptAll(whole).count() == 0 and split.count() == 50_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    broken = str(tmp_path / "broken.csv")
    Path(broken).write_text('k,s\n1,"a\nb"\n')
    assert readers.read_table(spark, broken, schema="k long, s string").first()["s"] == "a\nb"
    with pytest.raises(Exception):
        readers.read_table(spark, broken, schema="k long, s string", line_breaks=False).collect()


def test_trees_of_a_large_table_train_on_bounded_parts(spark, sf_dir, monkeypatch):
    from tablewright import runtime
    from tablewright.workloads import modelling as W
    from tablewright.workloads.registry import QUERIES

    parts, cut = [], W.cut_lineage
    monkeypatch.setattr(W, "KEPT_CELLS", 1000)
    monkeypatch.setattr(runtime, "PART_CELLS", 2000)
    monkeypatch.setattr(W, "cut_lineage", lambda df: parts.append(df.rdd.getNumPartitions()) or cut(df))
    assert QUERIES["model_gradient_boosting"](spark, sf_dir).count() == 3
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert parts[0] >= rows * 9 // 2000
