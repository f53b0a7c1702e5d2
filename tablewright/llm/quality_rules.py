"""Quality rules: a decision list learned by sequential covering, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.statistics import FEATURES, label_of, with_statistics
from tablewright.llm.tables import stored

#: Thresholds tried per statistic, most rules, most conditions of a rule.
GRID, MOST_RULES, MOST_CONDITIONS = 48, 10, 3
#: A rule must be right on this part of the rows it was not grown on, and cover this part of the labelled rows (three at least).
LEAST_PRECISION, LEAST_COVER = 0.9, 0.0005


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    return reduce(Column.__and__, (c.column() for c in rule), F.lit(True))


def _grid(rows: DataFrame) -> dict[str, list[float]]:
    cuts = [k / GRID for k in range(1, GRID)]
    found = rows.agg(*[F.percentile_approx(f, cuts, 10_000).alias(f) for f in FEATURES]).first()
    return {f: sorted({float(v) for v in found[f] or []}) for f in FEATURES}


def _counts(rows: DataFrame, grid: dict[str, list[float]]) -> dict[str, list[list[int]]]:
    """For each statistic and each slot between thresholds: rows labelled 0 and 1."""
    below = lambda f: F.size(F.filter(F.array(*map(F.lit, grid[f])), lambda t: t < F.col(f)))
    slot = [F.struct(F.lit(k).alias("feature"), below(f).alias("slot")) for k, f in enumerate(FEATURES) if grid[f]]
    found = rows.select("label", F.explode(F.array(*slot)).alias("at")).groupBy("at.feature", "at.slot").agg(
        F.sum(1 - F.col("label")).alias("bad"), F.sum("label").alias("good")).collect()
    out = {f: [[0, 0] for _ in range(len(grid[f]) + 1)] for f in FEATURES}
    for r in found:
        out[FEATURES[r["feature"]]][r["slot"]] = [r["bad"], r["good"]]
    return out


def _best(counts: dict[str, list[list[int]]], grid: dict[str, list[float]], least: float) -> Condition | None:
    """The condition with the largest gain of information on rows labelled 0."""
    best, chosen = 0.0, None
    for f, slots in counts.items():
        bad, good = (sum(s[k] for s in slots) for k in (0, 1))
        if not bad:
            continue
        before, low_bad, low_good = log2(bad / (bad + good)), 0, 0
        for k, threshold in enumerate(grid[f]):
            low_bad, low_good = low_bad + slots[k][0], low_good + slots[k][1]
            for above, b, g in ((False, low_bad, low_good), (True, bad - low_bad, good - low_good)):
                if b >= least and (gain := b * (log2(b / (b + g)) - before)) > best + 1e-9:
                    best, chosen = gain, Condition(f, above, threshold)
    return chosen


def learn_rules(rows: DataFrame) -> list[Rule]:
    """An ordered list of rules that find rows with ``label`` 0, from ``FEATURES``, ``label`` and ``grown`` (boolean).

    A rule grows, condition by condition, on the rows with ``grown``, and loses its last conditions while that does not hurt it
    on the others; the rows it covers are set aside before the next one. It ends at the first rule that is not
    precise enough. ``rows`` is read once per condition; what reaches the driver are counts per statistic and threshold.
    """
    total, bad = rows.agg(F.count("*"), F.sum(1 - F.col("label"))).first()
    if not bad:
        return []
    grid, left, rules, least = _grid(rows), rows, [], max(3.0, LEAST_COVER * total)
    while len(rules) < MOST_RULES:
        rule: Rule = ()
        growing = left.where("grown")
        while len(rule) < MOST_CONDITIONS:
            counts = _counts(growing.where(holds(rule)), grid)
            if all(s[1] == 0 for s in counts[FEATURES[0]]) or (condition := _best(counts, grid, least)) is None:
                break
            rule += (condition,)
        if not rule:
            break
        held = [holds(rule[:k]) for k in range(1, len(rule) + 1)]
        sums = left.where("NOT grown").agg(*[F.struct(F.sum(F.when(h, 1 - F.col("label"))).alias("bad"), F.sum(F.when(h, F.col("label"))).alias("good")) for h in held]).first()
        worth = [(((s["bad"] or 0) - (s["good"] or 0)) / max(1, (s["bad"] or 0) + (s["good"] or 0)), -k) for k, s in enumerate(sums)]
        kept = -max(worth)[1]
        b, g = sums[kept]["bad"] or 0, sums[kept]["good"] or 0
        if b < least / 2 or b < LEAST_PRECISION * (b + g):
            break
        rules.append(rule[:kept + 1])
        left = left.where(~holds(rule[:kept + 1]))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, NULL if none does."""
    return reduce(lambda c, k: c.when(holds(rules[k]), F.lit(k + 1)), range(len(rules)), F.when(F.lit(False), F.lit(0)))


def labelled(statistics: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows with what rules may look at; two thirds of the ids are for growing."""
    rows = statistics.join(label_of(labels, "quality"), "doc_id").select(*FEATURES, "label", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("grown"))
    return stored(rows, "labelled")


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``rule`` (the first learned rule that holds) and ``kept``.

    NULL and empty texts have no words, so they fail the base rule. Without labels no rule is learned and the base rule decides.
    """
    rows = stored(with_statistics(docs, "text", "doc_id"), "statistics")
    rules = learn_rules(labelled(rows, labels))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("rule", verdict(rules)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & F.col("rule").isNull()).alias("kept"), "rule")
