"""The refinement pass: diagnose the winner, try the parameters that the diagnosis asks for, and promote what is better on validation rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tablewright.operators.diagnosis import diagnose, metric_pairs, refinement_verdict, suggested_params
from tablewright.plans.models import family_of, refused_parameters
from tablewright.plans.spec import Candidate, ModelPlan
from tablewright.plans.training import Experiment, PreparedFeatures, evaluate_on_test, experiment_tables, train_candidate

LINEAGE_SCHEMA = "run_id string, model_name string, parameter string, first_value string, refined_value string, outcome string"
_VERDICT = "run_id string, model_name string, train_0 double, val_0 double, test_0 double, train_1 double, val_1 double, test_1 double"
LOWER_IS_BETTER = ("rmse", "mae", "log_loss")


@dataclass
class Refinement:
    """What a pass found: the issues, what became of each suggested parameter, the refined model if one was fitted, and whether it takes the winner's place."""

    first: Experiment
    issues: set[str]
    lineage: DataFrame
    verdict: DataFrame
    refined: Experiment | None = None
    promoted: bool = False

    @property
    def winner(self) -> Experiment:
        return self.refined if self.promoted else self.first


def metric_of(plan: ModelPlan) -> str:
    """The plan's metric, or the one that its task has instead."""
    if plan.is_classification:
        return plan.evaluation.primary_metric
    return plan.evaluation.primary_metric if plan.evaluation.primary_metric in ("rmse", "mae", "r2") else "r2"


def refine(spark: SparkSession, run_id: str, results: list[Experiment], winner: str, features: PreparedFeatures, plan: ModelPlan, seed: int = 42) -> Refinement:
    """One pass over the winner, on the folds and vectors that it was judged on.

    A suggested parameter that the model family cannot take is refused by name, with the reason, and the others are tried. Without an issue, or without a parameter
    that changes anything, nothing is fitted. Test scores are reported and can veto a promotion, which is decided on validation scores.
    """
    first = next(r for r in results if r.model_name == winner)
    metric = metric_of(plan)
    _, log = experiment_tables(spark, run_id, [first])
    pairs = metric_pairs(log, metric)
    issues = {r["category"] for r in diagnose(pairs, metric, plan.is_classification).select("category").collect()}
    none = spark.createDataFrame([], _VERDICT)
    if first.library == "ensemble":
        return Refinement(first, issues, spark.createDataFrame([], LINEAGE_SCHEMA), refinement_verdict(none))
    family = family_of(first.library)
    wanted = suggested_params(family, issues, first.hyperparams)
    refused = refused_parameters(family, wanted)
    taken = {k: v for k, v in wanted.items() if k not in refused}
    changed = {k for k, v in wanted.items() if first.hyperparams.get(k, ...) != v}
    lineage = spark.createDataFrame([
        (run_id, first.model_name, k, str(first.hyperparams[k]) if k in first.hyperparams else None, str(wanted[k]), f"refused: {refused[k]}" if k in refused else "tried")
        for k in sorted(changed)
    ], LINEAGE_SCHEMA)
    if not changed - set(refused):
        return Refinement(first, issues, lineage, refinement_verdict(none))
    candidate = Candidate(f"{first.model_name} refined", first.library, params=taken)
    refined = train_candidate(features.folds, features.final, plan, candidate, features.classes, seed)
    if refined.status != "success":
        return Refinement(first, issues, lineage, refinement_verdict(none), refined)
    if "test" not in refined.metrics:
        evaluate_on_test([refined], features.final, plan, features.classes)
    row = (run_id, first.model_name, *[float(r.metrics[split][metric]) for r in (first, refined) for split in ("train", "val", "test")])
    verdict = refinement_verdict(spark.createDataFrame([row], _VERDICT), metric in LOWER_IS_BETTER)
    return Refinement(first, issues, lineage, verdict, refined, bool(verdict.first()["promote"]))
