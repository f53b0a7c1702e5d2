"""Mixing sources to target weights by hash thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.tables import WORD, checked_broadcast, cuts, key_of, order_hash, stored

#: Weights of the sources in the order of their names, repeating; share of all sizes; most copies of a document.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size`` with one row per source -> and ``target``.

    Sources in the order of their code points (NULL last) get the weights in turn and share ``share`` of all sizes; no
    target passes ``most`` times its source's size, and what is above goes to the others by weight. The water level is
    found from running sums in the order in which sources fill up; the windows hold one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    full = sizes.withColumn("weight", weight).withColumn("most", F.lit(float(most)) * F.col("source_size"))
    full = full.withColumn("fills_at", F.col("most") / F.col("weight"))
    order, everything = Window.orderBy("fills_at", F.col("source").asc_nulls_last()), Window.partitionBy()
    rows = full.withColumns({
        "before": F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open_weight": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        "budget": F.lit(share) * F.sum("source_size").over(everything),
    }).withColumn("level", (F.col("budget") - F.col("before")) / F.col("open_weight"))
    # The first source that the level does not fill is where the level holds; without one, all are full.
    holds = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "level"))).over(everything)["level"]
    return rows.select("source", "source_size", F.when(holds.isNull(), F.col("most"))
                       .otherwise(F.least("most", holds * F.col("weight"))).alias("target"))


def mixed(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """How often each row is taken so that its source's sizes come near the source's target.

    ``rows`` has ``source``, ``size`` (NULL counts as 0), ``place`` (a hash, 0 to 2**60 - 1) and any other columns under
    other names; it is read several times, so give it stored. Returns its rows with ``source_size``, ``target`` and
    ``copies``. A source is taken whole as often as its target holds it; the rest of the target is a budget, and the
    rows whose hash is under the source's threshold are taken once more, so a larger target takes a superset.
    A source's sum misses its target by at most half the size of its boundary row (rows of one hash count as
    one). The same rows give the same result however they are partitioned. An empty table gives an empty
    result; sizes of zero are never short of copies.
    """
    keyed = rows.withColumns({"group": key_of("source"), "size": F.coalesce("size", F.lit(0)).cast("bigint")})
    sizes = stored(keyed.groupBy("source", "group").agg(F.sum("size").alias("source_size")))
    goals = targets(sizes.select("source", "source_size"), weights, share, most).withColumn("group", key_of("source"))
    whole = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(
        F.least(F.lit(most - 1), F.floor(F.col("target") / F.col("source_size")))).cast("int")
    goals = stored(goals.withColumn("whole", whole).withColumn(
        "budget", F.col("target") - F.col("whole") * F.col("source_size")).drop("source"))
    ends = cuts(keyed.select("group", "place", "size"), goals.select("group", "budget"))
    known = checked_broadcast(stored(goals.join(ends, "group")))
    more = (F.col("place") <= F.col("last")).cast("int")
    out = keyed.join(known, "group").withColumn("copies", F.col("whole") + more)
    return out.select(*rows.columns, "source_size", "target", "copies")


def narrowed(docs: DataFrame) -> DataFrame:
    """What the mix decides on: id, source, size in words, and a hash of the whole row's id and text."""
    return docs.select("doc_id", "source", word_count().alias("size"), order_hash(F.col("doc_id"), F.col("text")).alias("place"))


def mix_documents(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` (words taken, repeats counted) of all documents.

    NULL text has size 0; a NULL source is a source of its own; equal rows are taken alike.
    """
    taken = mixed(stored(narrowed(docs), "mix"), **settings)
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def apply_mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with the columns it had."""
    decided = mixed(stored(narrowed(docs), "mix"), **settings)
    # Equal (source, hash) means equal id and text, so the decision is found again by a threshold per source.
    taken = decided.groupBy(key_of("source").alias("_group")).agg(
        F.min("copies").alias("_least"), F.max("copies").alias("_most"),
        F.max(F.struct("copies", "place")).getField("place").alias("_last"))
    kept = docs.select(F.struct("*").alias("_row"), key_of("source").alias("_group"),
                       order_hash(F.col("doc_id"), F.col("text")).alias("_place"))
    kept = kept.join(checked_broadcast(stored(taken)), "_group")
    copies = F.when(F.col("_place") <= F.col("_last"), F.col("_most")).otherwise(F.col("_least"))
    return kept.select("_row", F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy")).select("_row.*")
