"""Model training, scoring and explanation on the given tables."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.numeric import plain_round
from tablewright.functions.hashing import row_digest
from tablewright.operators import explain as E
from tablewright.operators import metrics as M
from tablewright.operators import neighbours as N
from tablewright.operators import ranking as R
from tablewright.operators import split as S
from tablewright.operators.features import feature_names
from tablewright.plans import training as TR
from tablewright.plans.models import build_estimator
from tablewright.plans.refinement import refine
from tablewright.plans.spec import Candidate, Evaluation, Features, ModelPlan
from tablewright.runtime import KEPT_CELLS, bounded_parts, cut_lineage, scratch_path, spread
from tablewright.streaming.scoring import score_stream, start_scoring
from tablewright.workloads.registry import Tables, digest_sql, query

_TYPES = {"lang": "categorical", "source": "categorical", "n_chars": "numeric", "words": "numeric"}


def _labelled_documents(t: Tables) -> DataFrame:
    docs = t("documents").select(
        "doc_id", "lang", "source", "n_chars", F.size(F.split("text", r"\s+")).alias("words")
    )
    return docs.join(t("labels"), "doc_id")


def _plan(*candidates: Candidate, target: str = "quality", task: str = "binary_classification", **evaluation) -> ModelPlan:
    return ModelPlan(
        task, target, candidates, features=Features(categorical_strategy="freq_enc", text_vectorizer=None),
        evaluation=Evaluation(n_folds=2, **evaluation),
    )


_TWO = (
    Candidate("Logistic", "sklearn.linear_model.LogisticRegression"),
    Candidate("Tree", "sklearn.tree.DecisionTreeClassifier", params={"max_depth": 4}),
)


@query("experiment_metrics")
def experiment_metrics(t: Tables) -> DataFrame:
    """Three candidates, neighbours among them, and their ensemble: split, folds, fits, metrics per split, as one metric table."""
    plan = _plan(*_TWO, Candidate("Neighbours", "sklearn.neighbors.KNeighborsClassifier"), handle_imbalance=True)
    results, _ = TR.run_experiments(_labelled_documents(t), plan, _TYPES, list(_TYPES))
    _, log = TR.experiment_tables(t.spark, "documents", TR.all_trained(results))
    return log


@query("experiment_winner")
def experiment_winner(t: Tables) -> DataFrame:
    """The winner of a multi-class experiment by its folds, over all customers."""
    types = {"c_nationkey": "numeric", "c_acctbal": "numeric"}
    plan = _plan(*_TWO, target="c_mktsegment", task="multiclass_classification")
    results, _ = TR.run_experiments(t("customer"), plan, types, list(types), with_ensemble=False)
    models, log = TR.experiment_tables(t.spark, "customer", TR.all_trained(results))
    cv = TR.cv_summary(log).where("metric_name = 'f1_macro'").join(models, ["run_id", "model_name"])
    return R.select_winners(cv).select("run_id", "model_name", "runner_up_name", "is_tie")


def _line_vectors(t: Tables) -> DataFrame:
    df = t("lineitem").select(
        "l_quantity", "l_discount", "l_tax", "l_linenumber", F.month("l_shipdate").alias("month"),
        F.xxhash64("*").alias("line"), F.col("l_extendedprice").alias("label"), "l_returnflag",
    )
    return VectorAssembler(
        inputCols=["l_quantity", "l_discount", "l_tax", "l_linenumber", "month"], outputCol="features"
    ).transform(df)


def _fit_regression(t: Tables, library: str, **params) -> DataFrame:
    lines = _line_vectors(t)
    rows = lines.count()
    # MLlib's trees keep a partition's rows as one cached block.
    lines = bounded_parts(lines, rows) if rows * len(lines.columns) > KEPT_CELLS else spread(lines, rows)
    split = cut_lineage(S.hash_split(lines, ["l_quantity", "l_discount", "l_tax", "l_linenumber", "month"]))
    train = split.where("split = 'train'")
    rows, std = train.agg(F.count("*"), F.stddev_pop("label")).first()
    stages = build_estimator(Candidate(library, library, params=params), "regression", rows, label_std=std)
    scored = Pipeline(stages=stages).fit(train).transform(split)
    return M.regression_metrics(scored, "label", "prediction", ("split",))


@query("model_ridge")
def model_ridge(t: Tables) -> DataFrame:
    return _fit_regression(t, "sklearn.linear_model.Ridge", alpha=1.0)


@query("model_random_forest")
def model_random_forest(t: Tables) -> DataFrame:
    return _fit_regression(t, "RandomForestRegressor", n_estimators=10, max_depth=5)


@query("model_gradient_boosting")
def model_gradient_boosting(t: Tables) -> DataFrame:
    return _fit_regression(t, "xgboost.XGBRegressor", n_estimators=5, max_depth=3)


def _fit_classes(t: Tables, library: str, **params) -> DataFrame:
    df = t("embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    from pyspark.ml.functions import array_to_vector

    df = df.select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector("v").alias("features"))
    df = cut_lineage(df.withColumn("fold", F.pmod(F.xxhash64("vec_id"), F.lit(5))))
    train = df.where("fold > 0")
    stages = build_estimator(Candidate(library, library, params=params), "multiclass_classification", train.count(), 10)
    scored = Pipeline(stages=stages).fit(train).transform(df.where("fold = 0"))
    return M.multiclass_metrics(scored, "label", "prediction")


@query("model_naive_bayes")
def model_naive_bayes(t: Tables) -> DataFrame:
    return _fit_classes(t, "sklearn.naive_bayes.GaussianNB")


@query("model_decision_tree")
def model_decision_tree(t: Tables) -> DataFrame:
    return _fit_classes(t, "sklearn.tree.DecisionTreeClassifier", max_depth=5)


@query("model_logistic_regression")
def model_logistic_regression(t: Tables) -> DataFrame:
    return _fit_classes(t, "sklearn.linear_model.LogisticRegression", max_iter=20)


@query("model_linear_svc")
def model_linear_svc(t: Tables) -> DataFrame:
    df = VectorAssembler(inputCols=["n_chars", "words"], outputCol="features").transform(_labelled_documents(t))
    df = df.withColumn("label", F.col("quality").cast("double"))
    stages = build_estimator(Candidate("svc", "sklearn.svm.SVC"), "binary_classification", df.count())
    return M.binary_metrics(Pipeline(stages=stages).fit(df).transform(df), "label", "prediction")


_KNN = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, """ + digest_sql(["vec_id"]) + """ % 5 = 0 AS test FROM embeddings),
n AS (SELECT a.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rn
 FROM e a JOIN e b ON a.test AND NOT b.test)
"""


def _knn_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = t("embeddings").withColumn("test", F.pmod(row_digest(t("embeddings"), ["vec_id"]), F.lit(5)) == 0)
    return e.where(~F.col("test")), e.where("test")


@query("knn_classifier", _KNN + """SELECT vec_id, prediction FROM (SELECT vec_id, label AS prediction, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, label) AS p
FROM n WHERE rn <= 5 GROUP BY vec_id, label) WHERE p = 1""")
def knn_classifier(t: Tables) -> DataFrame:
    train, test = _knn_sides(t)
    return N.knn_classify(train, test, "vec_id", F.col("embedding"), "label")


@query("knn_regressor", _KNN + "SELECT vec_id, round(avg(label), 6) AS prediction FROM n WHERE rn <= 5 GROUP BY vec_id")
def knn_regressor(t: Tables) -> DataFrame:
    train, test = _knn_sides(t)
    return N.knn_regress(train, test, "vec_id", F.col("embedding"), "label").withColumn("prediction", F.round("prediction", 6))


def _quality_model(t: Tables, **params):
    df = VectorAssembler(inputCols=["n_chars", "words"], outputCol="features").transform(_labelled_documents(t))
    df = cut_lineage(df.withColumn("label", F.col("quality").cast("double")))
    stages = build_estimator(Candidate("m", "LogisticRegression", params=params), "binary_classification", df.count())
    return Pipeline(stages=stages).fit(df), df


@query("batch_scores")
def batch_scores(t: Tables) -> DataFrame:
    model, df = _quality_model(t)
    return TR.batch_score(model, df.select("doc_id", "features"), ["poor", "good"]).drop("features")


@query("model_cost")
def model_cost(t: Tables) -> DataFrame:
    """Size of the saved model and its time to score all labelled documents."""
    model, df = _quality_model(t)
    path = scratch_path(t.spark, "model")
    model.write().overwrite().save(path)
    size, latency = TR.model_size_kb(t.spark, path), TR.inference_latency_ms(model, df.select("features"))
    return df.agg(F.count("*").alias("num_rows")).withColumns({"size_kb": F.lit(size), "latency_ms": F.lit(latency)})


@query("stream_scores")
def stream_scores(t: Tables) -> DataFrame:
    """All events scored as a stream of files into a folder of scored rows."""
    events = t("events")
    train = VectorAssembler(inputCols=["user_id"], outputCol="features").transform(events.withColumn("label", F.col("value")))
    model = Pipeline(stages=[
        VectorAssembler(inputCols=["user_id"], outputCol="features", handleInvalid="keep"),
        LinearRegression(maxIter=5, regParam=0.1),
    ]).fit(train.drop("features"))
    contract = T.StructType([T.StructField("user_id", T.LongType())])
    source, sink = scratch_path(t.spark, "incoming"), scratch_path(t.spark, "scored")
    events.write.parquet(source)
    scored = score_stream(t.spark, source, contract, model, [events.schema["event_id"]])
    running = start_scoring(scored, sink, scratch_path(t.spark, "progress"))
    running.awaitTermination()
    return t.spark.read.parquet(sink).agg(F.count("*").alias("num_rows"), F.count_distinct("event_id").alias("events"))


@query("refined_model")
def refined_model(t: Tables) -> DataFrame:
    """One refinement pass over a forest: the parameters that its diagnosis asks for, the verdict on all splits."""
    forest = Candidate("Forest", "RandomForestClassifier", params={"n_estimators": 5})
    plan = _plan(forest, Candidate("Bayes", "GaussianNB"), target="toxic", primary_metric="f1")
    prepared = TR.prepare_features(_labelled_documents(t), plan, _TYPES, list(_TYPES))
    results = TR.all_trained(TR.run_prepared(prepared, plan, with_ensemble=False))
    found = refine(t.spark, "documents", results, "Forest", prepared, plan)
    tried = found.lineage.where("outcome = 'tried'").groupBy("run_id").agg(F.array_join(F.sort_array(F.collect_list("parameter")), ",").alias("tried"))
    return t.spark.createDataFrame([("documents", "Forest")], "run_id string, model_name string").join(found.verdict, ["run_id", "model_name"], "left").join(tried, "run_id", "left")


_COEFFICIENTS = {"l_quantity": 0.5, "l_discount": -20.0, "l_tax": 8.0}
_PHI = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {w!r}::DOUBLE * ({c} - (SELECT avg({c}) FROM lineitem)) AS phi FROM lineitem" for c, w in _COEFFICIENTS.items()
)


@query("shapley_linear", f"""
SELECT feature, count(*) AS num_rows, round(avg(phi), 6) + 0.0 AS mean_phi, round(min(phi), 6) AS low, round(max(phi), 6) AS high FROM ({_PHI}) GROUP BY feature""")
def shapley_linear(t: Tables) -> DataFrame:
    return _linear_phi(t).groupBy("feature").agg(
        F.count("*").alias("num_rows"), plain_round(F.avg("phi"), 6).alias("mean_phi"), F.round(F.min("phi"), 6).alias("low"),
        F.round(F.max("phi"), 6).alias("high"),
    )


def _linear_phi(t: Tables) -> DataFrame:
    lines = t("lineitem").withColumn("line", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return E.linear_shapley(lines, "line", list(_COEFFICIENTS), list(_COEFFICIENTS.values()))


_PART_PHI = " UNION ALL ".join(
    f"SELECT p_partkey, '{c}' AS feature, {w!r}::DOUBLE * ({c} - (SELECT avg({c}) FROM part)) AS phi FROM part"
    for c, w in (("p_size", 2.0), ("p_retailprice", -0.3))
)


def _part_phi(t: Tables) -> DataFrame:
    return E.linear_shapley(t("part"), "p_partkey", ["p_size", "p_retailprice"], [2.0, -0.3])


@query("shapley_global", f"""
SELECT row_number() OVER (ORDER BY mean_abs DESC, feature) AS rank, feature, round(mean_abs, 6) AS mean_abs, round(signed_mean, 6) + 0.0 AS signed_mean
FROM (SELECT feature, avg(abs(phi)) AS mean_abs, avg(phi) AS signed_mean FROM ({_PART_PHI}) GROUP BY feature)""")
def shapley_global(t: Tables) -> DataFrame:
    return E.global_importance(_part_phi(t)).select(
        F.col("rank").cast("bigint").alias("rank"), "feature", F.round("mean_abs", 6).alias("mean_abs"),
        plain_round(F.col("signed_mean"), 6).alias("signed_mean"),
    )


@query("shapley_local", f"""
WITH c AS (SELECT p_partkey, 1 / (1 + exp(-(p_size - 25) / 10.0)) AS conf FROM part),
k AS (SELECT p_partkey, 'most' AS kind FROM (SELECT * FROM c ORDER BY conf DESC, p_partkey LIMIT 3)
 UNION ALL SELECT p_partkey, 'least' FROM (SELECT * FROM c ORDER BY conf, p_partkey LIMIT 3))
SELECT kind, p_partkey, feature, round(phi, 6) AS phi, row_number() OVER (PARTITION BY kind, p_partkey ORDER BY abs(phi) DESC, feature) AS place
FROM k JOIN ({_PART_PHI}) USING (p_partkey)""")
def shapley_local(t: Tables) -> DataFrame:
    conf = t("part").select("p_partkey", (1 / (1 + F.exp(-(F.col("p_size") - 25) / 10.0))).alias("confidence"))
    found = E.local_explanations(_part_phi(t), E.extreme_rows(conf, "p_partkey"), "p_partkey")
    return found.select("kind", "p_partkey", "feature", F.round("phi", 6).alias("phi"), F.col("place").cast("bigint").alias("place"))


@query("shapley_trees")
def shapley_trees(t: Tables) -> DataFrame:
    """Exact values of a fitted forest for all order lines, averaged per feature."""
    rows = _line_vectors(t)
    model = RandomForestRegressor(numTrees=3, maxDepth=4, seed=42).fit(rows)
    return E.global_importance(E.tree_shapley(model, rows, "line", feature_names(rows)))


@query("shapley_sampled")
def shapley_sampled(t: Tables) -> DataFrame:
    """Sampled values of any model for all labelled rows against 100 background rows."""
    return _sampled(t)[0]


@query("shapley_sampled_sums", "SELECT doc_id, 0.0::DOUBLE AS gap FROM documents JOIN labels USING (doc_id)")
def shapley_sampled_sums(t: Tables) -> DataFrame:
    """What the sampled values of a row add up to, less its output and plus the mean output of the background: nothing."""
    phi, scored, background = _sampled(t)
    chance = vector_to_array("probability")[1]
    mean = background.agg(F.avg(chance)).first()[0]
    sums = phi.groupBy("doc_id").agg(F.sum("phi").alias("total")).join(scored.select("doc_id", chance.alias("out")), "doc_id")
    return sums.select("doc_id", plain_round(F.col("total") - F.col("out") + F.lit(mean), 6).alias("gap"))


def _sampled(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sampled values of the chance of good quality, and the scored rows and background."""
    df = VectorAssembler(inputCols=["n_chars", "words"], outputCol="features").transform(_labelled_documents(t))
    df = cut_lineage(df.withColumn("label", F.col("quality").cast("double")))
    model = LogisticRegression().fit(df)
    order = lambda salt: F.xxhash64(F.lit(salt), F.col("doc_id"))
    background = cut_lineage(df.orderBy(order(2)).limit(E.BACKGROUND_ROWS))
    phi = E.sampled_shapley(model, df, background, "doc_id", ["n_chars", "words"], vector_to_array("probability")[1])
    return phi, model.transform(df), model.transform(background)


@query("feature_importances")
def feature_importances(t: Tables) -> DataFrame:
    rows = _line_vectors(t)
    model = Pipeline(stages=[RandomForestRegressor(numTrees=5, maxDepth=4, seed=42)]).fit(rows)
    top = TR.importances(model, feature_names(rows))[: TR.KEPT_IMPORTANCES]
    return t.spark.createDataFrame(top, "feature string, importance double")
