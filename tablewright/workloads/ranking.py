"""Metrics, winner choice, ranking, diagnosis and run tables.

Results of many runs are derived from all events: a user is a run, an event type is a model and
the values of a user's events of that type, by part of the day, give its scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.numeric import plain_round
from tablewright.operators import catalogue as K
from tablewright.operators import diagnosis as D
from tablewright.operators import metrics as M
from tablewright.operators import ranking as R
from tablewright.plans.models import balanced_weights
from tablewright.plans.training import cv_summary, ensemble_weights, hard_vote, soft_vote
from tablewright.runtime import scratch_path
from tablewright.sources import writers
from tablewright.workloads.registry import Tables, query

# --- scored rows: lineitem flags as labels, a noisy rule as prediction -----------------------------------------

_SCORED = """(SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
 CASE WHEN l_linestatus = 'O' AND l_quantity > 25 THEN 1 ELSE 0 END AS prediction, l_discount * 10 AS score,
 l_extendedprice AS y, l_quantity * 2000 AS p, l_returnflag AS kind,
 CASE WHEN l_quantity > 40 THEN 'A' WHEN l_linestatus = 'O' THEN 'N' ELSE 'R' END AS guess FROM lineitem)"""


def _scored(t: Tables) -> DataFrame:
    quantity = F.col("l_quantity")
    return t("lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        ((F.col("l_linestatus") == "O") & (quantity > 25)).cast("int").alias("prediction"),
        (F.col("l_discount") * 10).alias("score"), F.col("l_extendedprice").alias("y"), (quantity * 2000).alias("p"),
        F.col("l_returnflag").alias("kind"),
        F.when(quantity > 40, "A").when(F.col("l_linestatus") == "O", "N").otherwise("R").alias("guess"),
    )


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[plain_round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("metrics_binary", f"""
SELECT round((tp + tn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
 round(2 * tp / (2 * tp + fp + fn), 6) AS f1
FROM (SELECT count(*)::DOUBLE AS n, count(*) FILTER (label = 1 AND prediction = 1)::DOUBLE AS tp, count(*) FILTER (label = 0 AND prediction = 0)::DOUBLE AS tn,
 count(*) FILTER (label = 0 AND prediction = 1)::DOUBLE AS fp, count(*) FILTER (label = 1 AND prediction = 0)::DOUBLE AS fn FROM {_SCORED})""")
def metrics_binary(t: Tables) -> DataFrame:
    return _rounded(M.binary_metrics(_scored(t), "label", "prediction"))


_PER_CLASS = f"""(SELECT c AS class, count(*) FILTER (kind = c) AS support,
 count(*) FILTER (kind = c AND guess = c) / count(*) FILTER (guess = c) AS precision,
 count(*) FILTER (kind = c AND guess = c) / count(*) FILTER (kind = c) AS recall,
 2 * count(*) FILTER (kind = c AND guess = c) / (count(*) FILTER (guess = c) + count(*) FILTER (kind = c)) AS f1,
 count(*) FILTER (kind = c AND guess = c) AS tp
 FROM {_SCORED}, (SELECT unnest(['A', 'N', 'R']) AS c) GROUP BY c)"""


@query("metrics_per_class", f"SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM {_PER_CLASS}")
def metrics_per_class(t: Tables) -> DataFrame:
    return _rounded(M.class_metrics(_scored(t), "kind", "guess").drop("tp"))


@query("metrics_multiclass", "SELECT round(sum(tp) / sum(support), 6) AS accuracy, " + ", ".join(
    f"round(sum({m} * support) / sum(support), 6) AS {m}_weighted, round(avg({m}), 6) AS {m}_macro" for m in ("precision", "recall", "f1")
) + f" FROM {_PER_CLASS}")
def metrics_multiclass(t: Tables) -> DataFrame:
    return _rounded(M.multiclass_metrics(_scored(t), "kind", "guess"))


def _auc_sql(label: str, score: str) -> str:
    return f"""SELECT (sum(r) FILTER (yes) - pos * (pos + 1) / 2.0) / (pos * (n - pos)) FROM (
 SELECT yes, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r, count(*) OVER () AS n,
 count(*) FILTER (yes) OVER () AS pos FROM (SELECT {label} AS yes, {score} AS s FROM {_SCORED})) GROUP BY pos, n"""


@query("roc_auc", f"SELECT round(({_auc_sql('label = 1', 'score')}), 6) AS roc_auc")
def roc_auc(t: Tables) -> DataFrame:
    return _rounded(M.roc_auc(_scored(t), F.col("label") == 1, "score"))


_OVR = {"A": "score", "N": "p / 100000.0", "R": "1 - score"}


@query("roc_auc_one_vs_rest", "SELECT round(" + " + ".join(
    f"({_auc_sql(f'kind = {c!r}', s)}) * (SELECT avg((kind = '{c}')::INT) FROM {_SCORED})" for c, s in _OVR.items()
) + ", 6) AS roc_auc")
def roc_auc_one_vs_rest(t: Tables) -> DataFrame:
    scores = F.array(F.col("score"), F.col("p") / 100000.0, 1 - F.col("score"))
    number = F.when(F.col("kind") == "A", 0).when(F.col("kind") == "N", 1).otherwise(2)
    return _rounded(M.roc_auc_ovr(_scored(t).select(number.alias("label"), scores.alias("scores")), "label", "scores", 3))


@query("metrics_regression", f"""
SELECT round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae,
 round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2 FROM {_SCORED}""")
def metrics_regression(t: Tables) -> DataFrame:
    return _rounded(M.regression_metrics(_scored(t), "y", "p"))


@query("log_loss", f"""
SELECT round(avg(-ln(least(greatest(CASE WHEN label = 1 THEN score ELSE 1 - score END, 2.220446049250313e-16), 1 - 2.220446049250313e-16))), 6) AS log_loss
FROM {_SCORED}""")
def log_loss(t: Tables) -> DataFrame:
    truth = F.when(F.col("label") == 1, F.col("score")).otherwise(1 - F.col("score"))
    return _rounded(M.log_loss(_scored(t), truth))


@query("class_weights", f"""
SELECT label, count(*) AS num_rows, round(max((SELECT count(*) FROM {_SCORED}) / (2.0 * c)), 6) AS weight
FROM {_SCORED} JOIN (SELECT label, count(*) AS c FROM {_SCORED} GROUP BY label) USING (label) GROUP BY label""")
def class_weights(t: Tables) -> DataFrame:
    weighted = balanced_weights(_scored(t), "label")
    return weighted.groupBy("label").agg(F.count("*").alias("num_rows"), F.round(F.max("weight"), 6).alias("weight"))


# --- result tables ---------------------------------------------------------------------------------------------

_LOG = """(SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS model_name,
 CASE hour(ts) // 6 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'test' ELSE 'cv' END AS split_type,
 'f1_macro' AS metric_name, ln(1 + avg(value)) / 5 AS metric_value FROM events GROUP BY 1, 2, 3)"""


def _metric_log(t: Tables) -> DataFrame:
    part = F.floor(F.hour("ts") / 6)
    split = F.when(part == 0, "train").when(part == 1, "val").when(part == 2, "test").otherwise("cv")
    return t("events").groupBy(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("model_name"), split.alias("split_type")
    ).agg((F.log(1 + F.avg("value")) / 5).alias("metric_value")).withColumn("metric_name", F.lit("f1_macro"))


_FOLDS = """(SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS model_name, hour(ts) // 8 AS fold,
 ln(1 + avg(value)) / 5 AS metric_value FROM events GROUP BY 1, 2, 3)"""


def _fold_log(t: Tables) -> DataFrame:
    return t("events").groupBy(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("model_name"),
        F.floor(F.hour("ts") / 8).cast("int").alias("fold"),
    ).agg((F.log(1 + F.avg("value")) / 5).alias("metric_value")).withColumns(
        {"metric_name": F.lit("f1_macro"), "split_type": F.lit("cv")}
    )


_CV = f"(SELECT run_id, model_name, count(*) AS folds, avg(metric_value) AS cv_mean, stddev_pop(metric_value) AS cv_std FROM {_FOLDS} GROUP BY 1, 2)"


@query("cv_summary", f"SELECT run_id, model_name, folds, round(cv_mean, 6) AS cv_mean, round(cv_std, 6) AS cv_std FROM {_CV}")
def cv_summary_query(t: Tables) -> DataFrame:
    return _rounded(cv_summary(_fold_log(t)).drop("metric_name"))


_LIBRARY = "CASE model_name WHEN 'click' THEN 'LogisticRegression' WHEN 'view' THEN 'RandomForestClassifier' WHEN 'purchase' THEN 'XGBClassifier' ELSE 'DecisionTreeClassifier' END"
_COMPLEXITY = "CASE model_name WHEN 'click' THEN 1 WHEN 'view' THEN 3 WHEN 'purchase' THEN 4 ELSE 2 END"


@query("winners", f"""
WITH o AS (SELECT *, row_number() OVER w AS place, lead(cv_mean) OVER w AS nxt, lead(model_name) OVER w AS nxt_name
  FROM {_CV} WINDOW w AS (PARTITION BY run_id ORDER BY round(cv_mean, 4) DESC, round(cv_std, 4), {_COMPLEXITY}, model_name))
SELECT run_id, model_name, round(cv_mean, 6) AS cv_mean, round(cv_std, 6) AS cv_std, nxt_name AS runner_up_name, round(cv_mean - nxt, 6) + 0.0 AS margin,
 coalesce(abs(cv_mean - nxt) <= 0.005, false) AS is_tie FROM o WHERE place = 1""")
def winners(t: Tables) -> DataFrame:
    return _rounded(R.select_winners(_cv_table(t)))


def _cv_table(t: Tables) -> DataFrame:
    library = F.expr(_LIBRARY)
    return cv_summary(_fold_log(t)).withColumns({"library": library, "duration_seconds": F.lit(1.0)})


@query("generalisation_gap", f"""
WITH g AS (SELECT run_id, model_name, max(metric_value) FILTER (split_type = 'train') AS tr, max(metric_value) FILTER (split_type = 'test') AS te
  FROM {_LOG} GROUP BY 1, 2),
h AS (SELECT *, CASE WHEN tr IS NULL OR te IS NULL THEN 0.0 ELSE round(greatest(tr - te, 0), 4) END AS gap FROM g)
SELECT run_id, model_name, round(tr, 6) AS train_value, round(te, 6) AS test_value, gap,
 CASE WHEN gap <= 0.05 THEN 'stable' WHEN gap > 0.1 THEN 'overfitting' ELSE 'moderate' END AS status FROM h""")
def generalisation_gap(t: Tables) -> DataFrame:
    return _rounded(M.generalisation_gap(_metric_log(t), "f1_macro"))


# Objectives of every run and model.
_MODELS = """(SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS model_name, ln(1 + avg(value)) / 5 AS metric,
 ln(1 + max(value)) AS latency_ms, ln(1 + sum(value)) AS size_kb, ln(1 + stddev_pop(value)) AS cost_s,
 ln(1 + max(value) - avg(value)) / 20 AS gap FROM events GROUP BY 1, 2)"""


def _models(t: Tables) -> DataFrame:
    v = "value"
    return t("events").groupBy(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("model_name")
    ).agg(
        (F.log(1 + F.avg(v)) / 5).alias("metric"), F.log(1 + F.max(v)).alias("latency_ms"), F.log(1 + F.sum(v)).alias("size_kb"),
        F.log(1 + F.stddev_pop(v)).alias("cost_s"), (F.log(1 + F.max(v) - F.avg(v)) / 20).alias("gap"),
    )


_NORM = "CASE WHEN max({x}) OVER r = min({x}) OVER r THEN 1.0 ELSE ({x} - min({x}) OVER r) / (max({x}) OVER r - min({x}) OVER r) END"
_FLOOR = "CASE WHEN {c} > 0 THEN {c} ELSE 0.001 END"
_PARTS = f"""(SELECT *, {_NORM.format(x='metric')} AS performance,
 1 - ({_NORM.format(x='(' + _FLOOR.format(c='latency_ms') + ')')}) AS latency, 1 - ({_NORM.format(x='(' + _FLOOR.format(c='size_kb') + ')')}) AS size,
 1 - ({_NORM.format(x='(' + _FLOOR.format(c='cost_s') + ')')}) AS cost,
 CASE WHEN gap > 0.1 THEN greatest(0.5, 1 - gap) ELSE 1.0 END AS penalty FROM {_MODELS} WINDOW r AS (PARTITION BY run_id))"""
_TOTAL = "round((0.5 * performance + 0.2 * latency + 0.15 * size + 0.15 * cost) * penalty, 4)"


@query("normalised_objectives", f"""
SELECT run_id, model_name, round(performance, 6) + 0.0 AS performance, round(latency, 6) + 0.0 AS latency, round(size, 6) + 0.0 AS size, round(cost, 6) + 0.0 AS cost FROM {_PARTS}""")
def normalised_objectives(t: Tables) -> DataFrame:
    return _rounded(R.composite_scores(_models(t)).select("run_id", "model_name", "performance", "latency", "size", "cost"))


@query("composite_scores", f"SELECT run_id, model_name, round(penalty, 6) AS penalty, {_TOTAL} AS composite_score FROM {_PARTS}")
def composite_scores(t: Tables) -> DataFrame:
    return _rounded(R.composite_scores(_models(t)).select("run_id", "model_name", "penalty", "composite_score"))


@query("composite_scores_edge", f"""
SELECT run_id, model_name, round((0.3 * performance + 0.35 * latency + 0.35 * size) * penalty, 4) AS composite_score FROM {_PARTS}""")
def composite_scores_edge(t: Tables) -> DataFrame:
    weights = R.parse_weights("0.6, 0.7, 0.7, 0")
    return R.composite_scores(_models(t), weights).select("run_id", "model_name", "composite_score")


_RANKED = f"""(SELECT run_id, model_name, composite_score, row_number() OVER (PARTITION BY run_id ORDER BY composite_score DESC, failed, model_name) AS rank,
 failed, gap FROM (SELECT run_id, model_name, {_TOTAL} AS composite_score, false AS failed, gap FROM {_PARTS} WHERE model_name <> 'error'
 UNION ALL SELECT run_id, model_name, 0.0, true, NULL FROM {_MODELS} WHERE model_name = 'error'))"""


@query("rankings", f"""
SELECT run_id, rank, model_name, composite_score, CASE WHEN failed THEN 'failed' WHEN gap <= 0.05 THEN 'stable' WHEN gap > 0.1 THEN 'overfitting' ELSE 'moderate' END AS status,
 rank = 1 AND composite_score > 0 AS is_winner FROM {_RANKED.replace("WHERE model_name <> 'error'", "WHERE model_name <> 'error'")}""".replace(
    f"FROM {_PARTS} WHERE", f"FROM {_PARTS.replace(f'FROM {_MODELS}', f'FROM {_MODELS} WHERE model_name <> {chr(39)}error{chr(39)}')} WHERE"))
def rankings(t: Tables) -> DataFrame:
    models = _models(t)
    failed = F.col("model_name") == "error"
    return R.rank_models(R.composite_scores(models.where(~failed)), models.where(failed)).withColumn(
        "rank", F.col("rank").cast("bigint")
    )


@query("trade_offs", f"""
WITH s AS (SELECT run_id, model_name, metric, latency_ms, {_TOTAL} AS score FROM {_PARTS}),
p AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, model_name) AS place FROM s WHERE score > 0),
j AS (SELECT c.run_id, w.model_name AS winner, c.model_name AS challenger,
 CASE WHEN abs(w.metric - c.metric) > 0.001 THEN w.metric - c.metric END AS d,
 CASE WHEN c.latency_ms > 0 AND w.latency_ms > 0 AND c.latency_ms / w.latency_ms > 1.2 THEN c.latency_ms / w.latency_ms END AS f
 FROM p c JOIN p w ON c.run_id = w.run_id AND w.place = 1 AND c.place > 1)
SELECT run_id, winner, challenger, round(d, 6) AS metric_difference, round(f, 6) AS times_faster FROM j WHERE d IS NOT NULL OR f IS NOT NULL""")
def trade_offs(t: Tables) -> DataFrame:
    scored = R.composite_scores(_models(t))
    ranked = R.rank_models(scored, scored.limit(0)).join(scored.select("run_id", "model_name", "metric", "latency_ms"), ["run_id", "model_name"])
    return _rounded(R.trade_offs(ranked))


_IMPORTANCE = """(SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS model_name, concat('f', isodow(ts)) AS feature,
 ln(1 + avg(value)) AS importance FROM events GROUP BY 1, 2, 3)"""


def _importances(t: Tables) -> DataFrame:
    return t("events").groupBy(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("model_name"),
        F.concat(F.lit("f"), F.weekday("ts") + 1).alias("feature"),
    ).agg(F.log(1 + F.avg("value")).alias("importance"))


@query("feature_consensus", f"""
SELECT run_id, model_name, max(feature) FILTER (p = 1) AS feature_1, max(feature) FILTER (p = 2) AS feature_2, max(feature) FILTER (p = 3) AS feature_3
FROM (SELECT *, row_number() OVER (PARTITION BY run_id, model_name ORDER BY importance DESC, feature) AS p FROM {_IMPORTANCE}) GROUP BY 1, 2""")
def feature_consensus(t: Tables) -> DataFrame:
    return R.feature_consensus(_importances(t))


@query("strongest_and_weakest", f"""
SELECT run_id, max(feature) FILTER (hi = 1) AS most_important, max(feature) FILTER (lo = 1) AS least_important
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY importance DESC, feature) AS hi,
 row_number() OVER (PARTITION BY run_id ORDER BY importance, feature DESC) AS lo FROM (
 SELECT run_id, feature, max(importance) AS importance FROM {_IMPORTANCE} GROUP BY 1, 2)) GROUP BY 1""")
def strongest_and_weakest(t: Tables) -> DataFrame:
    best = _importances(t).groupBy("run_id", "feature").agg(F.max("importance").alias("importance"))
    return K.strongest_and_weakest(best)


_PAIRS = f"""(SELECT run_id, model_name, max(metric_value) FILTER (split_type = 'train') AS tr, max(metric_value) FILTER (split_type = 'val') AS va
 FROM {_LOG} GROUP BY 1, 2)"""
_DIAGNOSIS = f"""(SELECT run_id, model_name, 'overfitting' AS category, CASE WHEN gap >= 0.25 THEN 'critical' WHEN gap >= 0.15 THEN 'high' ELSE 'medium' END AS severity,
 round(gap, 4) AS metric_gap FROM (SELECT *, coalesce(tr, va, 0) - coalesce(va, 0) AS gap FROM {_PAIRS}) WHERE gap >= 0.08
 UNION ALL SELECT run_id, model_name, 'underfitting', 'high', NULL FROM {_PAIRS} WHERE coalesce(va, 0) < 0.65 AND coalesce(tr, va, 0) < 0.7)"""


@query("diagnosis", f"SELECT * FROM {_DIAGNOSIS}")
def diagnosis(t: Tables) -> DataFrame:
    return D.diagnose(D.metric_pairs(_metric_log(t), "f1_macro"), "f1_macro", True)


@query("model_health", f"""
SELECT p.run_id, p.model_name, count(d.category) AS issues,
 CASE WHEN bool_or(d.severity = 'critical') THEN 'critical' WHEN count(d.category) > 0 THEN 'warning' ELSE 'healthy' END AS health
FROM {_PAIRS} p LEFT JOIN {_DIAGNOSIS} d ON p.run_id = d.run_id AND p.model_name = d.model_name GROUP BY 1, 2""")
def model_health(t: Tables) -> DataFrame:
    pairs = D.metric_pairs(_metric_log(t), "f1_macro")
    return D.model_health(pairs, D.diagnose(pairs, "f1_macro", True))


@query("diagnosis_regression", """
WITH p AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS model_name, avg(value) FILTER (hour(ts) // 6 = 0) AS tr, avg(value) FILTER (hour(ts) // 6 = 1) AS va
 FROM events GROUP BY 1, 2)
SELECT run_id, model_name, 'overfitting' AS category, 'high' AS severity FROM p WHERE coalesce(va, 0) / (coalesce(tr, va, 0) + 1e-6) >= 1.4""")
def diagnosis_regression(t: Tables) -> DataFrame:
    part = F.floor(F.hour("ts") / 6)
    split = F.when(part == 0, "train").when(part == 1, "val").otherwise("test")
    log = t("events").groupBy(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("model_name"), split.alias("split_type")
    ).agg(F.avg("value").alias("metric_value")).withColumn("metric_name", F.lit("rmse"))
    return D.diagnose(D.metric_pairs(log, "rmse"), "rmse", False).drop("metric_gap")


_SIX = ("train_0", "val_0", "test_0", "train_1", "val_1", "test_1")


@query("refinement_verdicts", "WITH p AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS model_name, " + ", ".join(
    f"coalesce(ln(1 + avg(value) FILTER (hour(ts) // 4 = {i})), 0) AS {c}" for i, c in enumerate(_SIX)) + """ FROM events GROUP BY 1, 2),
v AS (SELECT *, (train_0 - val_0) - (train_1 - val_1) AS red, test_1 - test_0 >= 0 AS kept, val_1 - val_0 > 0 AS better FROM p)
SELECT run_id, model_name, round(red, 4) + 0.0 AS gap_reduced, kept AS test_kept, CASE WHEN red > 0.02 AND kept THEN 'success' WHEN kept THEN 'stable' ELSE 'neutral' END AS verdict,
 better AND kept AS promote FROM v""")
def refinement_verdicts(t: Tables) -> DataFrame:
    part = F.floor(F.hour("ts") / 4)
    wide = t("events").groupBy(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("model_name")).agg(
        *[F.coalesce(F.log(1 + F.avg(F.when(part == i, F.col("value")))), F.lit(0.0)).alias(c) for i, c in enumerate(_SIX)]
    )
    return _rounded(D.refinement_verdict(wide), 4)


_REPLAY = f"""(SELECT r.run_id, r.model_name, r.metric_value AS replayed, coalesce(o.metric_value, 0) AS original
 FROM (SELECT * FROM {_LOG} WHERE split_type = 'val') r LEFT JOIN (SELECT * FROM {_LOG} WHERE split_type = 'test') o
 ON r.run_id = o.run_id AND r.model_name = o.model_name)"""


def _differences(t: Tables) -> DataFrame:
    log = _metric_log(t)
    return K.replay_differences(log.where("split_type = 'test'"), log.where("split_type = 'val'"))


@query("replay_differences", f"""
SELECT run_id, model_name, 'f1_macro' AS metric_name, round(original, 6) AS original_value, round(replayed, 6) AS replayed_value,
 round(abs(original - replayed), 6) AS difference, abs(original - replayed) <= 0.01 AS is_match FROM {_REPLAY}""")
def replay_differences(t: Tables) -> DataFrame:
    return _rounded(_differences(t))


@query("replay_verdicts", f"""
SELECT run_id, count(*) AS metrics, count(*) FILTER (abs(original - replayed) <= 0.01) AS matches,
 avg((abs(original - replayed) <= 0.01)::INT) >= 0.9 AS reproduced FROM {_REPLAY} GROUP BY 1""")
def replay_verdicts(t: Tables) -> DataFrame:
    return K.replay_verdict(_differences(t))


@query("run_catalogue", """
SELECT CAST(user_id AS VARCHAR) AS run_id, count(*) AS events, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen,
 min_by(event_type, (-value, event_id)) AS winner FROM events GROUP BY user_id""")
def run_catalogue(t: Tables) -> DataFrame:
    e = t("events").withColumn("run_id", F.col("user_id").cast("string"))
    runs = e.groupBy("run_id").agg(F.count("*").alias("events"), F.max("ts").alias("last_seen"))
    best = e.groupBy("run_id").agg(F.min_by("event_type", F.struct(-F.col("value"), F.col("event_id"))).alias("winner"))
    return K.run_catalogue(runs, best, "last_seen").withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))


@query("latest_run", """
SELECT run_id, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen FROM (
 SELECT CAST(user_id AS VARCHAR) AS run_id, max(ts) AS last_seen FROM events GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 1)""")
def latest_run(t: Tables) -> DataFrame:
    runs = t("events").groupBy(F.col("user_id").cast("string").alias("run_id")).agg(F.max("ts").alias("last_seen"))
    return K.latest_run(runs, "last_seen").withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))


@query("metric_log_round_trip", f"""
SELECT run_id, split_type, count(*) AS metrics, round(avg(metric_value), 6) AS mean_value FROM (
 SELECT CAST(event_type AS VARCHAR) AS run_id, CAST(user_id AS VARCHAR) AS model_name, 'val' AS split_type, ln(1 + avg(value)) AS metric_value FROM events GROUP BY 1, 2)
GROUP BY 1, 2""")
def metric_log_round_trip(t: Tables) -> DataFrame:
    """Results of every event type and user appended to the run tables and read back."""
    log = t("events").groupBy(
        F.col("event_type").alias("run_id"), F.col("user_id").cast("string").alias("model_name")
    ).agg(F.log(1 + F.avg("value")).alias("metric_value")).selectExpr(
        "run_id", "model_name", "'val' AS split_type", "CAST(NULL AS int) AS fold", "'f1' AS metric_name", "metric_value"
    )
    models = log.selectExpr(
        "run_id", "model_name", "'knn' AS library", "'success' AS status", "1.0D AS duration_seconds", "'{}' AS hyperparams",
        "CAST(NULL AS string) AS model_path", "CAST(NULL AS string) AS error",
    )
    root = scratch_path(t.spark, "runs")
    writers.append_experiments(models, log, root)
    _, back = writers.read_experiments(t.spark, root)
    return back.groupBy("run_id", "split_type").agg(
        F.count("*").alias("metrics"), F.round(F.avg("metric_value"), 6).alias("mean_value")
    )


@query("run_artifacts", """
SELECT event_type AS run_id, count(*) AS num_rows, CAST(0 AS BIGINT) AS duplicate_rows, true AS plan_missing FROM events GROUP BY 1""")
def run_artifacts(t: Tables) -> DataFrame:
    """Artifacts of a run per event type written as JSON and read side by side."""
    events, root = t("events"), scratch_path(t.spark, "runs")
    runs = events.select(F.col("event_type").alias("run_id")).distinct()
    parts = events.groupBy(F.col("event_type").alias("run_id"))
    summary = parts.agg(F.count("*").alias("num_rows"), F.lit(len(events.columns)).cast("bigint").alias("num_cols"), F.lit("events").alias("file_name"))
    # Rows are equal in every column but the id only if their ids are too.
    quality = parts.agg(F.count("*").alias("num_rows"), (F.count("*") - F.count_distinct("event_id")).alias("duplicate_rows"))
    writers.write_artifacts({"dataset_summary": summary, "quality_report": quality}, root)
    found = writers.read_run_artifacts(t.spark, root, runs)
    return found.select(
        "run_id", F.col("dataset_summary.num_rows").alias("num_rows"), F.col("quality_report.duplicate_rows").alias("duplicate_rows"),
        F.col("execution_plan").isNull().alias("plan_missing"),
    )


@query("consistency_checks")
def consistency_checks(t: Tables) -> DataFrame:
    log, cv = _metric_log(t), _cv_table(t)
    models = cv.select("run_id", "model_name", "library", F.lit("success").alias("status"), F.lit("{}").alias("hyperparams"))
    overlap = cv.select("run_id").distinct().selectExpr("run_id", "0 AS train_val", "0 AS train_test", "0 AS val_test")
    return K.consistency_checks(models, log, R.select_winners(cv), overlap)


@query("consistency_of_artifacts", """
WITH e AS (SELECT event_type AS run_id, count(*) % 2 = 0 AS even, count(DISTINCT user_id) AS users, CASE WHEN count(*) % 2 = 0 THEN 'regression' ELSE 'clustering' END AS planned FROM events GROUP BY 1)
SELECT run_id, 'task as planned' AS "check", CASE WHEN even THEN 'pass' ELSE 'warn' END AS result, concat(planned, ' / regression') AS detail FROM e
UNION ALL SELECT run_id, 'models saved', 'pass', CAST(users AS VARCHAR) FROM e""")
def consistency_of_artifacts(t: Tables) -> DataFrame:
    """The checks that look at a run's plan, results and saved models; plans and results go through their artifacts."""
    events, root = t("events"), scratch_path(t.spark, "runs")
    runs = events.groupBy(F.col("event_type").alias("run_id")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("models"))
    plan = runs.select("run_id", F.when(F.col("n") % 2 == 0, "regression").otherwise("clustering").alias("task_type"), F.lit("y").alias("target_column"))
    done = runs.select("run_id", F.lit("regression").alias("task_type"), F.col("n").alias("num_candidates"))
    writers.write_artifacts({"execution_plan": plan, "experiment_results": done}, root)
    log, cv = _metric_log(t), _cv_table(t)
    models = runs.select("run_id", F.lit("m").alias("model_name"), F.lit("rf").alias("library"), F.lit("success").alias("status"), F.lit("{}").alias("hyperparams"))
    overlap = runs.selectExpr("run_id", "0 AS train_val", "0 AS train_test", "0 AS val_test")
    found = K.consistency_checks(models, log, R.select_winners(cv), overlap, writers.read_run_artifacts(t.spark, root, runs), runs)
    return found.where(F.col("check").isin("task as planned", "models saved"))


# --- voting ----------------------------------------------------------------------------------------------------

_W = dict(ensemble_weights([("a", 0.91), ("b", 0.83), ("c", 0.77), ("d", 0.5)], True))
_MEMBERS = {"a": "l_discount * 10", "b": "l_tax * 12.5", "c": "l_quantity / 50"}


@query("soft_vote", "SELECT prediction, count(*) AS num_rows, round(avg(p1), 6) AS mean_probability FROM (SELECT " + " + ".join(
    f"{_W[m]!r}::DOUBLE * ({e})" for m, e in _MEMBERS.items()) + " AS p1, CAST(p1 > " + " + ".join(
    f"{_W[m]!r}::DOUBLE * (1 - {e})" for m, e in _MEMBERS.items()) + " AS BIGINT) AS prediction FROM lineitem) GROUP BY 1")
def soft_vote_query(t: Tables) -> DataFrame:
    probabilities = [F.expr(f"array(1 - {e}, {e})") for e in _MEMBERS.values()]
    mean, best = soft_vote(probabilities, list(_W.values()))
    return t("lineitem").select(mean.alias("p"), best.cast("bigint").alias("prediction")).groupBy("prediction").agg(
        F.count("*").alias("num_rows"), F.round(F.avg(F.col("p")[1]), 6).alias("mean_probability")
    )


@query("hard_vote", "SELECT CAST(CASE WHEN " + " + ".join(f"CASE WHEN {e} > 0.55 THEN {_W[m]!r} ELSE 0 END" for m, e in _MEMBERS.items()) +
       " > 0.5 THEN 1 ELSE 0 END AS BIGINT) AS prediction, count(*) AS num_rows FROM lineitem GROUP BY 1")
def hard_vote_query(t: Tables) -> DataFrame:
    votes = [F.expr(f"CAST({e} > 0.55 AS double)") for e in _MEMBERS.values()]
    return t("lineitem").select(hard_vote(votes, list(_W.values())).cast("bigint").alias("prediction")).groupBy("prediction").agg(
        F.count("*").alias("num_rows")
    )


@query("average_vote", "SELECT l_returnflag, round(avg(" + " + ".join(f"{_W[m]!r} * ({e})" for m, e in _MEMBERS.items()) + "), 6) AS mean_vote FROM lineitem GROUP BY 1")
def average_vote(t: Tables) -> DataFrame:
    total = sum((F.expr(e) * F.lit(w) for e, w in zip(_MEMBERS.values(), _W.values())), F.lit(0.0))
    return t("lineitem").groupBy("l_returnflag").agg(F.round(F.avg(total), 6).alias("mean_vote"))
