"""Sharding by a k-d tree over metadata, with weighted medians."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.tables import ORDER_BITS, checked_broadcast, cuts, stored

#: Bits of a place: the dimension's value, then the text, then the row.
VALUE_BITS, TEXT_BITS, ROW_BITS = 20, 22, 18
#: A bucket of places that holds at most this part of a budget is not cut.
CLOSE = 1e-4
#: Rows numbered by one task.
CHUNK_ROWS = 50_000


def code(value: Column, seed: int = 0) -> Column:
    """A category as a number in [0, 1); NULL is 0."""
    return F.when(value.isNull(), F.lit(0.0)).otherwise(F.pmod(F.xxhash64(value.cast("string"), F.lit(seed)), F.lit(1 << 20)) / float(1 << 20))


def metadata(docs: DataFrame) -> DataFrame:
    """Id, size in bytes, checksum and dimensions of each document.

    The dimensions are the logarithm of the size, source, language and checksum. ``text_code`` and ``row_code`` order
    rows that are equal in a dimension: equal texts stand side by side, and are cut only where a median falls among them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("bigint") + 1
    crc = F.crc32(text.cast("binary"))
    row = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 12)) * 64 + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(64))
    return docs.select(
        F.col("doc_id"), size.alias("size"), crc.alias("text_crc32"), F.log2(size.cast("double")).alias("d_size"), code(F.col("source")).alias("d_source"),
        code(F.col("lang"), 1).alias("d_lang"), (crc / float(1 << 32)).alias("d_text"),
        F.pmod(F.xxhash64(text), F.lit(1 << TEXT_BITS)).alias("text_code"), row.alias("row_code"))


def _of_node(values: dict[int, int], shards: int, otherwise: int, kind: str) -> Column:
    """What ``values`` has for the node of a row."""
    return F.element_at(F.array(*[F.lit(values.get(k, otherwise)).cast(kind) for k in range(shards)]), F.col("_first") + 1)


def kd_shards(rows: DataFrame, shards: int, dimensions: list[str]) -> DataFrame:
    """``rows`` with ``shard`` 0 to ``shards - 1``, whose sums of ``size`` are near equal.

    ``rows`` (stored: it is read several times) has ``size``, ``text_code``, ``row_code`` and the numeric ``dimensions``, NULL
    counting as the least value. A node that stands for several shards is cut along the dimension that is widest
    in it, in parts of that dimension's range over all rows (the first of them on a tie), at the weighted median,
    or at the matching share of an odd number of shards. Nodes are as many as shards; the cut is found from
    histograms. An empty table stays empty; with fewer rows than shards some shards are empty.
    """
    filled = rows.withColumns({d: F.coalesce(d, F.lit(-1.0)).cast("double") for d in dimensions})
    spans = filled.agg(*[F.struct(F.min(d).alias("low"), F.max(d).alias("high")).alias(d) for d in dimensions], F.count("*").alias("_rows")).first()
    levels = (shards - 1).bit_length() if spans["_rows"] else 0
    spans = {d: (spans[d]["low"] or 0.0, spans[d]["high"] or 0.0) for d in dimensions}
    value = {d: F.floor((F.col(d) - low) / (high - low) * ((1 << VALUE_BITS) - 1)).cast("bigint") if high > low else F.lit(0).cast("bigint")
             for d, (low, high) in spans.items()}
    placed = filled.withColumns({"_first": F.lit(0), "_count": F.lit(shards)})
    # Each level halves what a node stands for; after the last one every node is a shard.
    for _ in range(levels):
        open_rows = placed.where("_count > 1")
        width = [F.struct((F.max(value[d]) - F.min(value[d])).alias("width"), F.lit(-k).alias("at")) for k, d in enumerate(dimensions)]
        widest = (F.greatest(*width) if len(width) > 1 else width[0])["at"]
        # Fewer nodes than shards: their numbers come to the driver and stand in the rows' expressions, so that no scan needs a look-up.
        nodes = open_rows.groupBy("_first", "_count").agg(F.sum("size").alias("_bytes"), (-widest).alias("_axis")).collect()
        left = {n["_first"]: n["_count"] // 2 for n in nodes}
        axis = _of_node({n["_first"]: n["_axis"] for n in nodes}, shards, 0, "int")
        along = reduce(lambda c, k: c.when(axis == k, value[dimensions[k]]), range(1, len(dimensions)), F.when(axis == 0, value[dimensions[0]]))
        place = F.shiftleft(along, TEXT_BITS + ROW_BITS) + F.shiftleft(F.col("text_code"), ROW_BITS) + F.col("row_code")
        budgets = [(str(n["_first"]), n["_bytes"] * left[n["_first"]] / n["_count"]) for n in nodes]
        ends = cuts(open_rows.select(F.col("_first").cast("string").alias("group"), place.alias("place"), "size"),
                    rows.sparkSession.createDataFrame(budgets, "group string, budget double"), CLOSE).collect()
        # A node is known by its first shard; those that stand for one shard stay whole.
        right = place > _of_node({int(e["group"]): e["last"] for e in ends}, shards, (1 << ORDER_BITS) - 1, "bigint")
        half = _of_node(left, shards, 0, "int")
        placed = stored(placed.select(
            *filled.columns, (F.col("_first") + F.when(right, half).otherwise(0)).alias("_first"),
            F.when(half == 0, F.col("_count")).when(right, F.col("_count") - half).otherwise(half).alias("_count")))
    return placed.withColumnRenamed("_first", "shard").drop("_count")


def with_slots(rows: DataFrame, order: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, ... without gaps within each ``shard``.

    Shards are numbered in chunks of about ``chunk_rows`` rows, cut by a hash of the order columns, so no task holds a
    whole shard; the chunks' counts give their first slots.
    """
    chunks = max(1, rows.count() // chunk_rows)
    parts = rows.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    upto = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("shard", "_chunk").agg(F.count("*").alias("_n"))
    starts = stored(counts.select("shard", "_chunk", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start")))
    number = F.row_number().over(Window.partitionBy("shard", "_chunk").orderBy(*order))
    return parts.join(checked_broadcast(starts), ["shard", "_chunk"]).withColumn("slot", (F.col("_start") + number - 1).cast("bigint")).drop("_chunk", "_start")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of all documents; the law is ``bytes``.

    A NULL text has no bytes and size 1. Equal rows are documents of their own. ``grown_shard`` belongs to another law and is NULL.
    """
    rows = stored(metadata(docs), "metadata")
    placed = kd_shards(rows, shards, ["d_source", "d_size", "d_lang", "d_text"])
    placed = with_slots(placed, ["text_code", "row_code", "doc_id", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, shards: DataFrame, path: str) -> None:
    """Writes the documents, one folder per shard; ``shards`` is the result of ``shard_documents`` on unique ids."""
    docs.join(shards.select("doc_id", "shard"), "doc_id").write.partitionBy("shard").parquet(path)
