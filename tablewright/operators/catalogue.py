"""Run catalogue, replay and consistency checks, and ready-made look-ups over run tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
REPLAY_TOLERANCE = 0.01
REPLAY_SHARE = 0.90
WEIGHT_TOLERANCE = 0.001


def search_runs(runs: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows that contain the text in any of the columns, whatever the case."""
    wanted = F.lower(F.lit(text.strip()))
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c).cast("string")).contains(wanted), F.lit(False)) for c in columns])
    return runs.where(hit)


def replay_differences(original: DataFrame, replayed: DataFrame) -> DataFrame:
    """Each replayed metric against the original one (0 when absent), with whether it matches."""
    keys = ["run_id", "model_name", "metric_name"]
    before = original.select(*keys, F.col("metric_value").alias("original_value"))
    joined = replayed.select(*keys, F.col("metric_value").alias("replayed_value")).join(before, keys, "left")
    diff = F.abs(F.coalesce(F.col("original_value"), F.lit(0.0)) - F.col("replayed_value"))
    return joined.select(
        *keys, F.coalesce("original_value", F.lit(0.0)).alias("original_value"), "replayed_value",
        diff.alias("difference"), (diff <= REPLAY_TOLERANCE).alias("is_match"),
    )


def replay_verdict(differences: DataFrame) -> DataFrame:
    """Share of matching metrics per run; at least 90% counts as reproduced."""
    share = F.avg(F.col("is_match").cast("double"))
    return differences.groupBy("run_id").agg(
        F.count("*").alias("metrics"), F.count_if("is_match").alias("matches"), (share >= REPLAY_SHARE).alias("reproduced")
    )


def latest_run(runs: DataFrame, time_col: str) -> DataFrame:
    """The most recent run; the larger id wins equal times."""
    return runs.agg(F.max(F.struct(time_col, "run_id")).alias("m")).select("m.run_id", f"m.{time_col}")


def run_catalogue(runs: DataFrame, winners: DataFrame, time_col: str) -> DataFrame:
    """Runs with their winners, newest first."""
    return runs.join(winners, "run_id", "left").orderBy(F.desc(time_col), F.desc("run_id"))


def strongest_and_weakest(importances: DataFrame) -> DataFrame:
    """Most and least important feature per run, by absolute value; names break ties."""
    strength = F.abs("importance")
    return importances.groupBy("run_id").agg(
        F.min_by("feature", F.struct(-strength, F.col("feature"))).alias("most_important"),
        F.max_by("feature", F.struct(-strength, F.col("feature"))).alias("least_important"),
    )


def _check(name: str, ok: Column, level: str, detail: Column) -> Column:
    return F.struct(
        F.lit(name).alias("check"), F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise(level).alias("result"),
        detail.cast("string").alias("detail"),
    )


def consistency_checks(
    experiments: DataFrame, metric_log: DataFrame, winners: DataFrame, overlap: DataFrame, artifacts: DataFrame | None = None, saved: DataFrame | None = None,
) -> DataFrame:
    """``(run_id, check, result, detail)``: is a finished run complete and free of leakage?

    ``overlap`` has one row per run with the distinct rows shared by each pair of splits. With ``artifacts`` of the runs, the task of the plan must be that of
    the results; with ``saved`` (``run_id, models``), each run must have a saved model.
    """
    models = experiments.groupBy("run_id").agg(F.count_if(F.col("status") == "success").alias("succeeded"))
    logged = metric_log.groupBy("run_id").agg(
        F.count_if(F.col("split_type") == "cv").alias("cv_rows"),
    )
    tested = metric_log.where("split_type = 'test'").select("run_id", "model_name").distinct()
    won = winners.select("run_id", "model_name").join(
        tested.withColumn("tested", F.lit(True)), ["run_id", "model_name"], "left"
    ).select("run_id", F.col("model_name").alias("winner"), "tested")
    weights = experiments.where("library = 'ensemble'").select(
        "run_id",
        F.aggregate(
            F.map_values(F.from_json(F.get_json_object("hyperparams", "$.weights"), "map<string,double>")),
            F.lit(0.0), lambda acc, w: acc + w,
        ).alias("weight_sum"),
    )
    facts = models.join(logged, "run_id", "left").join(won, "run_id", "left").join(weights, "run_id", "left").join(
        overlap, "run_id", "left"
    )
    shared = F.col("train_val") + F.col("train_test") + F.col("val_test")
    checks = F.array(
        _check("models trained", F.col("succeeded") > 0, "fail", F.col("succeeded")),
        _check("winner selected", F.col("winner").isNotNull(), "fail", F.col("winner")),
        _check("winner tested", F.col("tested"), "fail", F.col("winner")),
        _check("cross-validated", F.col("cv_rows") > 0, "fail", F.col("cv_rows")),
        # Rows that differ only in dropped values can coincide after the transform, so this one warns.
        _check("splits disjoint", shared == 0, "warn", shared),
        _check(
            "ensemble weights", F.col("weight_sum").isNull() | (F.abs(F.col("weight_sum") - 1) <= WEIGHT_TOLERANCE), "warn",
            F.col("weight_sum"),
        ),
    )
    if artifacts is not None:
        tasks = artifacts.select("run_id", F.col("execution_plan.task_type").alias("planned"), F.col("experiment_results.task_type").alias("done"))
        facts = facts.join(tasks, "run_id", "left")
        shown = F.concat_ws(" / ", F.coalesce("planned", F.lit("none")), F.coalesce("done", F.lit("none")))
        # A run without a plan has nothing to depart from.
        checks = F.concat(checks, F.array(_check("task as planned", F.col("planned").isNull() | (F.col("planned") == F.col("done")), "warn", shown)))
    if saved is not None:
        facts = facts.join(saved.select("run_id", F.col("models").alias("saved")), "run_id", "left")
        checks = F.concat(checks, F.array(_check("models saved", F.col("saved") > 0, "warn", F.coalesce("saved", F.lit(0)))))
    return facts.select("run_id", F.inline(checks))
