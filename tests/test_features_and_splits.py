"""Feature stages, splits and folds: edge cases and invariants."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tablewright.operators import features as X
from tablewright.operators import order_stats
from tablewright.operators import split as S
from tablewright.plans.knn_model import NeighbourImputer, NeighbourImputerModel
from tablewright.plans.routing import complete, feature_stages, route
from tablewright.plans.training import make_features
from tablewright.plans.spec import Candidate, Evaluation, Features, ModelPlan, Preprocessing
from tablewright.runtime import attach_lookup, scratch_path

TWO = (Candidate("a", "RandomForest"), Candidate("b", "LogisticRegression"))


def test_lookup_splits_heavy_keys(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    table = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 10).where("k <> 7")
    expected = {(r["id"], r["k"], r["v"]) for r in attach_lookup(rows, table, ["k"], 4000, "n").collect()}
    found = {(r["id"], r["k"], r["v"]) for r in attach_lookup(rows, table, ["k"], 4000, "n", broadcast_rows=10).collect()}
    assert found == expected and (7, 7, None) in found and len(found) == 4000


def test_imputers(spark):
    df = spark.createDataFrame([(1.0, "b"), (1.0, "a"), (4.0, "a"), (4.0, "b"), (None, None), (float("nan"), None)], "x double, s string")
    fill = lambda s: X.NumericImputer(inputCols=["x"], strategy=s).fit(df).getOrDefault("fills")[0]
    assert (fill("mean"), fill("median"), fill("most_frequent")) == (2.5, 2.5, 1.0)
    out = X.CategoryImputer(inputCols=["s"]).fit(df).transform(df)
    assert out.where("s = 'a'").count() == 4
    with pytest.raises(ValueError):
        X.NumericImputer(inputCols=["x"], strategy="guess").fit(df)


def test_cap_keeps_nulls_and_log_shifts(spark):
    df = spark.createDataFrame([(float(v),) for v in range(20)] + [(1000.0,), (None,)], "x double")
    out = X.FenceCapper(inputCols=["x"], outputCols=["y"]).fit(df).transform(df)
    values = [v for v in [r["y"] for r in out.collect()]]
    assert values[-1] is None and max(v for v in values if v is not None) < 1000
    low = spark.createDataFrame([(-3.0,), (0.0,), (5.0,)], "x double")
    got = [r["x"] for r in X.LogShift(inputCols=["x"]).fit(low).transform(low).collect()]
    assert np.allclose(got, np.log1p(np.array([-3.0, 0.0, 5.0]) + 4.0))


def test_encoders_on_unseen_values(spark):
    train = spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "s string")
    test = spark.createDataFrame([("a",), ("z",), (None,)], "s string")
    for kind, expected in (("frequency", [2 / 3, 0.0, 0.0]), ("ordinal", [0.0, -1.0, -1.0])):
        model = X.CategoryEncoder(inputCols=["s"], outputCols=["c"], kind=kind).fit(train)
        path = scratch_path(spark, "encoder")
        model.write().overwrite().save(path)
        for m in (model, X.CategoryEncoderModel.load(path)):
            got = {r["s"]: r["c"] for r in m.transform(test).collect()}
            assert [got[k] for k in ("a", "z", None)] == pytest.approx(expected)


@pytest.mark.parametrize("runs", [16, 512])
def test_sorted_codes(spark, monkeypatch, runs):
    monkeypatch.setattr(X, "CODE_RUNS", runs)
    counts = spark.range(3000).select(F.format_string("Customer#%06d", F.col("id") * 7).alias("value"), F.lit(1).alias("n"))
    codes = {r["value"]: r["code"] for r in X.sorted_codes(counts).collect()}
    assert codes == {v: float(i) for i, v in enumerate(sorted(codes))} and len(codes) == 3000


def test_scaler_of_constant_column(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    for kind in ("standard", "minmax", "robust"):
        assert [r["x"] for r in X.ColumnScaler(inputCols=["x"], kind=kind).fit(df).transform(df).collect()] == [0.0, 0.0]


def test_numeric_labels_sort_by_value(spark):
    df = spark.createDataFrame([(10,), (2,), (1,), (10,)], "t int")
    assert [(r["class"], r["label"]) for r in X.label_table(df, "t").orderBy("label").collect()] == [(1.0, 0.0), (2.0, 1.0), (10.0, 2.0)]


def test_tfidf_stage_equals_operator(spark):
    docs = spark.createDataFrame([(1, "one two two x"), (2, "two three"), (3, ""), (4, None)], "id long, text string")
    model = X.TfIdf(inputCol="text", outputCol="v").fit(docs.where("text IS NOT NULL"))
    terms = model.getOrDefault("terms")
    expected = {(r["id"], r["term"]): r["weight"] for r in X.tfidf(docs.where("text IS NOT NULL"), "id", "text").collect()}
    for r in model.transform(docs).collect():
        for i, term in enumerate(terms):
            assert r["v"][i] == pytest.approx(expected.get((r["id"], term), 0.0))


@pytest.mark.parametrize("strategy", ["onehot", "ordinal", "freq_enc", "target_enc"])
def test_whole_feature_job_saves_and_handles_unseen(spark, strategy):
    rows = [(float(i % 7), "abc"[i % 3], f"2020-0{1 + i % 9}-01", "http://a.b/c", float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "x double, s string, d string, u string, label double")
    types = {"x": "numeric", "s": "categorical", "d": "datetime", "u": "url", "label": "numeric"}
    plan = ModelPlan(
        "binary_classification", "label", TWO, Preprocessing(outlier_strategy="iqr_cap", scale_strategy="standard"),
        Features(categorical_strategy=strategy, numeric_transforms=("log",)),
    )
    model = Pipeline(stages=feature_stages(df, types, plan)).fit(df)
    path = scratch_path(spark, "stages")
    model.write().overwrite().save(path)
    strange = spark.createDataFrame([(None, "new", "no date", None, 0.0)], df.schema)
    a, b = model.transform(strange).first()["features"], PipelineModel.load(path).transform(strange).first()["features"]
    assert a == b and not np.isnan(a.toArray()).any()
    assert len(X.feature_names(model.transform(df))) == len(a)


def test_routing_leaves_out_ids_and_target():
    plan = ModelPlan("regression", "y", TWO, Preprocessing(drop_columns=("z",)))
    got = route({"y": "numeric", "z": "numeric", "user_id": "numeric", "a": "numeric", "b": "boolean", "t": "text", "e": "email"}, plan)
    assert got == {"numeric": ["a"], "categorical": ["b"], "datetime": [], "text": ["t"], "structured": ["e"]}


def test_plan_rejects_bad_choices():
    for bad in (
        lambda: ModelPlan("ranking", "y", TWO), lambda: ModelPlan("regression", "y", TWO[:1]),
        lambda: Evaluation(n_folds=1), lambda: Evaluation(test_size=0.5), lambda: Candidate("a", "b", priority=9),
        lambda: Preprocessing(missing_strategy="guess"), lambda: Features(categorical_strategy="hash"),
    ):
        with pytest.raises(ValueError):
            bad()


@pytest.fixture(scope="module")
def repeated(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({
        "a": rng.integers(0, 40, 5000), "b": rng.integers(0, 10, 5000).astype(float),
        "y": rng.choice(["p", "q", "r"], 5000, p=[0.6, 0.3, 0.1]),
    })
    frame.loc[:1600, ["a", "b"]] = [99, 9.0]  # one group holds a third of the rows
    frame.loc[5000] = [123, 1.0, "rare"]
    frame.loc[::50, "b"] = np.nan
    return spark.createDataFrame(frame).persist()


def _whole(df, column):
    return df.groupBy("a", "b").agg(F.count_distinct(column).alias("n")).agg(F.max("n")).first()[0] == 1


@pytest.mark.parametrize("label", ["y", None])
def test_quota_split_keeps_groups_and_shares(spark, repeated, label):
    out = S.quota_split(repeated, ["a", "b"], label)
    assert out.count() == 5001 and _whole(out, "split")
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert set(counts) == {"train", "val", "test"}
    overlap = S.split_overlap(out, ["a", "b"]).first()
    assert tuple(overlap) == (0, 0, 0)
    if label:
        assert out.where("y = 'rare'").count() == 1
    again = S.quota_split(repeated.repartition(5), ["a", "b"], label)
    assert {r["split"]: r["count"] for r in again.groupBy("split").count().collect()} == counts


def test_quota_is_close_for_many_groups(spark):
    df = spark.range(20000).select("id", (F.col("id") % 2).alias("y"))
    out = S.quota_split(df, ["id"], "y", 0.25)
    for r in out.groupBy("y").pivot("split", ["train", "val", "test"]).count().collect():
        assert (r["test"], r["val"], r["train"]) == (2500, 1500, 6000)


def test_hash_split_keeps_groups(spark, repeated):
    assert _whole(S.hash_split(repeated, ["a", "b"]), "split")


def test_null_places_matter_in_group_ids(spark):
    df = spark.createDataFrame([(None, 1), (1, None)], "a int, b int")
    assert S.with_groups(df, ["a", "b"]).select(S.GROUP).distinct().count() == 2


def test_sequential_split_keeps_ties_and_order(spark, monkeypatch):
    df = spark.range(1000).select("id", F.floor(F.col("id") / 30).cast("double").alias("t"))
    for fetch in (20_000, 30):
        monkeypatch.setattr(order_stats, "FETCH_ROWS", fetch)
        out = S.sequential_split(df, "t", 0.2)
        assert out.groupBy("t").agg(F.count_distinct("split").alias("n")).agg(F.max("n")).first()[0] == 1
        ends = {r["split"]: (r["lo"], r["hi"]) for r in out.groupBy("split").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).collect()}
        assert ends["train"][1] < ends["val"][0] and ends["val"][1] < ends["test"][0]


@pytest.mark.parametrize("label", ["y", None])
def test_folds_partition_groups(spark, repeated, label):
    out = S.assign_folds(repeated, ["a", "b"], 4, label)
    assert out.count() == 5001 and _whole(out, "fold") and out.select("fold").distinct().count() == 4


def test_fold_strategy_names(spark, repeated):
    assert S.fold_strategy(repeated, ["a", "b"], True) == "StratifiedGroupKFold"
    assert S.fold_strategy(spark.range(5), ["id"], False) == "KFold"


def test_plan_choices_for_gaps_and_outliers(spark):
    rows = [(i, float(i % 10), None if i % 5 == 0 else float(i % 10) * 2, "ab"[i % 2], float(i % 2)) for i in range(60)] + [(60, 1e6, 1.0, "a", 0.0)]
    df = spark.createDataFrame(rows, "row long, x double, y double, s string, label double")
    types = {"x": "numeric", "y": "numeric", "s": "categorical"}
    plan = lambda missing, outliers="none", codes="none": ModelPlan(
        "binary_classification", "label", TWO, Preprocessing(missing_strategy=missing, outlier_strategy=outliers), Features(categorical_strategy=codes))
    fitted = lambda p: Pipeline(stages=feature_stages(df, types, p)).fit(df)
    vectors = lambda p: {r["row"]: r["features"].toArray() for r in fitted(p).transform(df).collect()}

    by_neighbours = vectors(plan("knn"))
    assert len(by_neighbours) == 61 and all(len(v) == 2 for v in by_neighbours.values())
    # Row 0 lies nearest to the rows with x = 1.
    assert by_neighbours[1][1] == by_neighbours[0][1] == 2.0 != vectors(plan("median"))[0][1]
    with pytest.raises(ValueError, match="missing in y"):
        fitted(plan("none"))
    whole = df.where("y IS NOT NULL")
    bare = Pipeline(stages=feature_stages(whole, types, plan("none"))).fit(whole)
    assert bare.transform(whole).count() == 49
    with pytest.raises(Exception, match="missing value in y"):
        bare.transform(df).select("features").collect()
    capped = vectors(plan("median", "zscore_cap"))
    x = np.array([r[1] for r in rows])
    assert capped[60][0] == pytest.approx(x.mean() + 3 * x.std()) and capped[3][0] == 3.0
    assert [r["row"] for r in df.where(complete(df, types, plan("drop"))).collect()] == [r[0] for r in rows if r[2] is not None]
    assert df.where(complete(df, types, plan("mean"))).count() == 61
    with pytest.raises(ValueError, match="no column"):
        feature_stages(df, {"s": "categorical"}, plan("median"))


def test_neighbour_imputer_equals_a_plain_version(spark):
    rng = np.random.default_rng(5)
    values = rng.normal(size=(400, 3)) * [1, 50, 3]
    values[:130] = values[0]  # a third of the rows are equal
    values[rng.random((400, 3)) < 0.15] = np.nan
    values[7, 0] = np.inf
    frame = pd.DataFrame(values, columns=["a", "b", "c d"])
    df = spark.createDataFrame(frame.assign(row=range(400)))
    names = ["a", "b", "c d"]
    model = NeighbourImputer(inputCols=names, outputCols=["oa", "ob", "oc"], k=3).fit(df)
    path = scratch_path(spark, "imputer")
    model.write().overwrite().save(path)
    found = [model.transform(df), NeighbourImputerModel.load(path).transform(df)]
    found = [np.array([[r["oa"], r["ob"], r["oc"]] for r in sorted(f.collect(), key=lambda r: r["row"])]) for f in found]
    known = np.where(np.isinf(values), np.nan, values)
    scaled = np.where(np.isnan(known), np.nanmedian(known, axis=0), known) / np.nanstd(known, axis=0)
    expected = known.copy()
    for i, j in zip(*np.where(np.isnan(known))):
        others = [c for c in range(3) if c != j]
        members = np.where(~np.isnan(known[:, j]))[0]
        distance = np.sqrt(((scaled[members][:, others] - scaled[i, others]) ** 2).sum(axis=1))
        expected[i, j] = known[members[np.argsort(distance, kind="stable")[:3]], j].mean()
    assert np.allclose(found[0], expected) and np.allclose(found[1], expected)
    nothing = df.where("row < 0")
    assert model.transform(nothing).count() == 0
    assert NeighbourImputer(inputCols=["a"]).fit(df).transform(df).where("a IS NULL").count() == 0
    assert NeighbourImputer(inputCols=names).fit(nothing).transform(df).where("a IS NULL OR b IS NULL").count() == 0


def test_dropped_rows_are_not_fitted_but_scored(spark):
    rows = [(None if i % 4 == 0 else float(i), float(i % 2), "test" if i % 5 == 0 else "train", i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "x double, label double, split string, fold int")
    plan = ModelPlan("binary_classification", "label", TWO, Preprocessing(missing_strategy="drop"))
    made = make_features(df, F.col("split") == "train", plan, {"x": "numeric"})
    fitted = [x for x, _, split, _ in rows if x is not None and split == "train"]
    assert made.rows.count() == 60 and made.count == made.training().count() == len(fitted)
    tested = sorted(r["features"][0] for r in made.rows.where("split = 'test'").collect())
    assert tested == sorted(float(np.median(fitted)) if x is None else x for x, _, split, _ in rows if split == "test")
