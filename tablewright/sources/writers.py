"""Writing tables, artifacts and run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.sources.readers import sanitise

EXPERIMENT_SCHEMA = (
    "run_id string, model_name string, library string, status string, duration_seconds double, "
    "hyperparams string, model_path string, error string"
)
METRIC_SCHEMA = (
    "run_id string, model_name string, split_type string, fold int, metric_name string, metric_value double"
)
# Artifact files of a run and the fields the run catalogue reads from them.
ARTIFACTS = {
    "dataset_summary": "file_name string, file_format string, num_rows bigint, num_cols bigint, dataset_hash string",
    "quality_report": "num_rows bigint, num_cols bigint, duplicate_rows bigint, duplicate_pct double",
    "risk_assessment": "overall_severity string, total_risks bigint",
    "execution_plan": "task_type string, target_column string, reasoning string",
    "experiment_results": (
        "task_type string, primary_metric string, num_candidates bigint, num_succeeded bigint, num_failed bigint, "
        "winner struct<model_name: string, reason: string, cv_f1_macro_mean: double>"
    ),
    "comparison_results": (
        "primary_metric string, num_compared bigint, winner struct<model_name: string, composite_score: double>"
    ),
    "critique_report": "initial_winner_name string, refinement_successful boolean",
    "explainability_results": "model_name string, explainer_type string, num_features bigint",
}


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> str:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue='""')
    elif fmt in ("json", "jsonl"):
        writer.json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported format: {fmt}")
    return path


def export_tables(
    tables: dict[str, DataFrame], root: str, kind: str = "all", fmt: str = "parquet"
) -> dict[str, str]:
    """Writes the cleaned, feature and split tables, or one of them; splits are partitioned by ``split``."""
    if kind != "all" and kind not in tables:
        raise ValueError(f"nothing to export as '{kind}'; available: {', '.join(sorted(tables))}")
    chosen = tables if kind == "all" else {kind: tables[kind]}
    return {
        name: write_table(df, f"{root.rstrip('/')}/{name}", fmt, ["split"] if "split" in df.columns else None)
        for name, df in chosen.items()
    }


def write_artifacts(artifacts: dict[str, DataFrame], root: str) -> str:
    """Artifacts of all runs in one job: each table has a ``run_id`` and one row per run, written as a JSON line without NaN or infinities.

    They lie in a folder per run and artifact; those that come again take the place of the old ones, others stay.
    """
    unknown = sorted(set(artifacts) - set(ARTIFACTS))
    if unknown:
        raise ValueError(f"no such artifacts: {', '.join(unknown)}; known: {', '.join(ARTIFACTS)}")
    path, rows = f"{root.rstrip('/')}/artifacts", None
    for name, df in artifacts.items():
        clean = sanitise(df)
        line = F.to_json(F.struct(*[F.col(c) for c in clean.columns if c != "run_id"]))
        one = clean.select(F.col("run_id").cast("string").alias("run_id"), F.lit(name).alias("artifact"), line.alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    if rows is not None:
        rows.repartition("run_id", "artifact").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "artifact").text(path)
    return path


def append_experiments(experiments: DataFrame, metrics: DataFrame, root: str) -> None:
    """Adds the models of a run and their metrics to the run tables, partitioned by run."""
    for name, df in (("experiments", experiments), ("metric_log", metrics)):
        df.write.mode("append").partitionBy("run_id").parquet(f"{root.rstrip('/')}/{name}")


def read_experiments(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    base = root.rstrip("/")
    return (
        spark.read.schema(EXPERIMENT_SCHEMA).parquet(f"{base}/experiments"),
        spark.read.schema(METRIC_SCHEMA).parquet(f"{base}/metric_log"),
    )


def read_run_artifacts(spark: SparkSession, root: str, run_ids: DataFrame) -> DataFrame:
    """All artifacts of every run side by side, by one scan: one struct column per artifact, NULL where a run lacks it.

    Two rows of an artifact in one run raise an error.
    """
    lines = spark.read.schema("value string, run_id string, artifact string").text(f"{root.rstrip('/')}/artifacts")
    cells = []
    for name, fields in ARTIFACTS.items():
        kind = T.StructType.fromDDL(fields)
        mine = F.when(F.col("artifact") == name, F.from_json("value", kind))
        twice = F.raise_error(F.lit(f"more than one {name} in a run")).cast(kind)
        cells.append(F.when(F.count(mine) > 1, twice).otherwise(F.first(mine, ignorenulls=True)).alias(name))
    return run_ids.select(F.col("run_id").cast("string").alias("run_id")).distinct().join(lines.groupBy("run_id").agg(*cells), "run_id", "left")


def saved_models(spark: SparkSession, root: str) -> DataFrame:
    """``run_id, models``: models that lie below ``root/models/<run>/<model>``, from one listing; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root.rstrip('/')}/models").select("path")
    found = files.select(F.regexp_extract("path", r"/models/([^/]+)/", 1).alias("run_id"), F.regexp_extract("path", r"/models/[^/]+/([^/]+)/", 1).alias("model"))
    return found.where("model <> ''").groupBy("run_id").agg(F.count_distinct("model").alias("models"))
