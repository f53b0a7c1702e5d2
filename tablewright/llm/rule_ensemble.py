"""Quality classifier: rules from tree paths, weighted by a lasso logistic regression, as a column expression."""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.quality_rules import Condition, Rule, holds
from tablewright.llm.statistics import FEATURES, label_of, with_statistics
from tablewright.llm.tables import stored

#: The forest that the rules come from, and the weight of the lasso.
TREES, DEPTH, LASSO = 16, 3, 0.0005
#: Most labelled rows that are fitted; of more, an even share by hash.
MOST_ROWS = 200_000
#: From this score on a text is predicted to be good.
THRESHOLD = 0.7

_LINE = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)$")


def path_rules(forest) -> list[Rule]:
    """Every path from a root to a node as a conjunction; equal rules once, and of two complements the first."""
    rules: dict[frozenset, Rule] = {}
    for tree in forest.trees:
        path: list[tuple[int, Condition]] = []
        for line in tree.toDebugString.split("\n"):
            if not (m := _LINE.match(line)):
                continue
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, Condition(FEATURES[int(m[2])], m[3] == ">", float(m[4])))]
            rule = tuple(c for _, c in path)
            opposite = frozenset({Condition(rule[0].feature, not rule[0].above, rule[0].threshold)}) if len(rule) == 1 else None
            if opposite not in rules:
                rules.setdefault(frozenset(rule), rule)
    return list(rules.values())


def _indicators(rules: list[Rule]) -> list[Column]:
    return [F.when(holds(r), F.lit(1.0)).otherwise(F.lit(0.0)) for r in rules]


def fit_score(rows: DataFrame, seed: int = 7) -> Column:
    """A score 0 to 1 as an expression of ``FEATURES``, from rows with ``FEATURES`` and ``label`` (0 or 1).

    Rows of one label only give that label's score, no rows at all give 0.5.
    """
    found = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(found) < 2:
        return F.lit(float(next(iter(found), 0.5)))
    share = min(1.0, MOST_ROWS / sum(found.values()))
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64(*FEATURES), F.lit(1 << 20)) < int(share * (1 << 20)))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", seed=seed, maxBins=64).fit(vectors)
    if not (rules := path_rules(forest)):
        return F.lit(found.get(1, 0) / sum(found.values()))
    seen = stored(rows.select("label", array_to_vector(F.array(*_indicators(rules))).alias("features")), "rules")
    fit = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=60).fit(seen)
    weighted = [(w, r) for w, r in zip(fit.coefficients.toArray().tolist(), rules) if w != 0]
    total = sum((F.lit(w) * i for (w, _), i in zip(weighted, _indicators([r for _, r in weighted]))), F.lit(float(fit.intercept)))
    return 1 / (1 + F.exp(-total))


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of all documents; held-out ids are never learned from.

    NULL text is scored as an empty one; a NULL id is a row like any other. Equal texts have equal scores.
    """
    rows = stored(with_statistics(docs, "text", "doc_id"), "statistics")
    score = fit_score(stored(rows.where(~held_out()).join(label_of(labels, "quality"), "doc_id").select(*FEATURES, "label"), "labelled"))
    return rows.select("doc_id", held_out().alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are predicted to be good, with the columns they had."""
    rows = stored(with_statistics(docs, "text", "doc_id"), "statistics")
    score = fit_score(stored(rows.where(~held_out()).join(label_of(labels, "quality"), "doc_id").select(*FEATURES, "label"), "labelled"))
    whole = docs.select(F.struct("*").alias("_row")).withColumn("_text", F.col("_row.text"))
    # The row number keeps the optimiser from copying the statistics into every rule.
    counted = with_statistics(whole, "_text", "_row").withColumn("_at", F.monotonically_increasing_id())
    return counted.where((score >= THRESHOLD) & (F.col("_at") >= 0)).select("_row.*")
