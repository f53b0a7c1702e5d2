"""Removal of long byte strings that occur more than once, by suffix arrays of shards."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.suffixes import array, suffix_order
from tablewright.llm.tables import checked_broadcast, stored
from tablewright.llm.words import mixed, text_slices
from tablewright.runtime import small_batches

#: Bytes of a string that may not occur twice.
LENGTH = 400
#: Text of a shard, also the most of one key, whose strings are compared by their hashes if it has more; ids that may be broadcast.
SHARD_BYTES, FOUND_ROWS = 1 << 20, 500_000
#: Bytes whose starts are hashed at once (a text is not cut), and bytes of pieces or texts that a task gives out at once.
HASHED_BYTES, GIVEN_BYTES = 1 << 18, 4 << 20
#: Between strings of a shard; no UTF-8 text has this byte.
GAP = 0xFF

_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _gram(length: int) -> int:
    """Bytes of the grams whose least hash is a string's key: a power of two, about a twelfth of the string."""
    return 1 << max(0, (length // 12).bit_length() - 1) if length >= 12 else 1


def string_keys(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For every start of ``length`` bytes the least hash of the grams in them, which depends on those bytes only; and all grams' hashes."""
    gram = _gram(length)
    hashes = _BYTES[data]
    width = 1
    while width < gram:
        hashes = mixed(hashes[:-width] * np.uint64(0xD6E8FEB86659FD93) + hashes[width:])
        width *= 2
    span, least, width = length - gram + 1, hashes, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = span - width
    return np.minimum(least[:-rest], least[rest:]) if rest else least, hashes


def string_hashes(data: np.ndarray, length: int, seed: int) -> np.ndarray:
    """For every start of ``length`` bytes a hash of all of them."""
    count, blocks, out, at, width = len(data) - length + 1, mixed(_BYTES[data] + np.uint64(seed)), None, 0, 1
    while True:
        if length & width:
            part = blocks[at:at + count]
            out = part if out is None else mixed(out * np.uint64(0xD6E8FEB86659FD93) + part)
            at += width
        if 2 * width > length:
            return out
        blocks = mixed(blocks[:-width] * np.uint64(0xD6E8FEB86659FD93) + blocks[width:])
        width *= 2


def _named(docs: DataFrame) -> DataFrame:
    """``doc_id, name, text``; rows with equal names are equal, and their results are."""
    text = F.coalesce(F.col("text"), F.lit(""))
    name = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), text)))
    return docs.select("doc_id", name.alias("name"), text.alias("text"))


def stretches(named: DataFrame, length: int) -> DataFrame:
    """``name, key, digest, at, starts, inner``: every start of a string, in stretches of neighbouring starts with one key.

    A stretch of n starts covers n + length - 1 bytes, of which ``digest`` is taken. Equal strings have equal keys, so
    what repeats is found among the stretches of one key; within one stretch only if its key's gram is in it twice (``inner``).
    """
    schema = pa.schema([("name", pa.binary()), ("key", pa.int64()), ("digest", pa.binary()), ("at", pa.int32()), ("starts", pa.int32()), ("inner", pa.bool_())])
    span = length - _gram(length) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, _, data, offsets in text_slices(batch.column(1), HASHED_BYTES):
                if len(data) < length:
                    continue
                (keys, hashes), counts = string_keys(data, length), np.maximum(np.diff(offsets) - length + 1, 0)
                valid = np.zeros(len(data) + 1, np.int8)
                np.add.at(valid, offsets[:-1][counts > 0], 1)
                np.add.at(valid, (offsets[:-1] + counts)[counts > 0], -1)
                valid = np.cumsum(valid[:len(keys)], dtype=np.int8).astype(bool)
                fresh = np.ones(len(keys), bool)
                fresh[1:] = keys[1:] != keys[:-1]
                fresh[offsets[:-1][offsets[:-1] < len(keys)]] = True
                fresh[1:] |= valid[1:] != valid[:-1]
                first = np.flatnonzero(fresh)
                starts = np.diff(np.append(first, len(keys)))
                first, starts = first[valid[first]], starts[valid[first]]
                rows = np.searchsorted(offsets, first, "right") - 1
                view = memoryview(np.ascontiguousarray(data))
                digests = [hashlib.blake2b(view[a:a + n + length - 1], digest_size=16).digest() for a, n in zip(first.tolist(), starts.tolist())]
                inner = [np.count_nonzero(hashes[a:a + n + span - 1] == k) > 1 for a, n, k in zip(first.tolist(), starts.tolist(), keys[first])]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows + begin)), pa.array(keys[first].view(np.int64)), pa.array(digests, pa.binary()),
                    pa.array((first - offsets[rows]).astype(np.int32)), pa.array(starts.astype(np.int32)), pa.array(inner, pa.bool_())], schema=schema)

    return named.select("name", "text").mapInArrow(run, "name binary, key bigint, digest binary, at int, starts int, inner boolean")


def _pieces(texts: DataFrame, length: int) -> DataFrame:
    """``shard, key, digest, piece``: the text of the wanted stretches of each row of ``text, wanted``."""
    schema = pa.schema([("shard", pa.int32()), ("key", pa.int64()), ("digest", pa.binary()), ("piece", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, key, digest, piece, held = [], [], [], [], 0
            for text, wanted in zip(batch.column(0), batch.column(1)):
                data = text.as_py().encode()
                for w in wanted.as_py():
                    shard.append(w["shard"])
                    key.append(w["key"])
                    digest.append(w["digest"])
                    piece.append(data[w["at"]:w["at"] + w["starts"] + length - 1])
                    held += len(piece[-1])
                if held > GIVEN_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((shard, key, digest, piece), schema.types)], schema=schema)
                    shard, key, digest, piece, held = [], [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((shard, key, digest, piece), schema.types)], schema=schema)

    return texts.mapInArrow(run, "shard int, key bigint, digest binary, piece binary")


def _repeated(base: np.ndarray, length: int) -> np.ndarray:
    """Where in ``base`` strings start that start elsewhere as well."""
    order, shared = suffix_order(base, length)
    marks = array(len(base), bool)
    marks[:] = False
    for a in range(0, len(order), 1 << 20):
        hit = np.flatnonzero(shared[a:a + (1 << 20)] >= length) + a
        hit = hit[hit > 0]
        marks[order[hit]] = True
        marks[order[hit - 1]] = True
    return marks


def shard_repeats(pieces: DataFrame, length: int) -> DataFrame:
    """``key, digest, low, high``: runs of starts (relative, half open) that repeat within the shards of ``pieces``.

    ``pieces`` is partitioned and sorted by shard. A task writes a shard's pieces behind each other, into a file if they are many,
    sorts their suffixes, and marks neighbours that share ``length`` bytes. A piece that comes twice (from equal rows) counts once.
    """
    schema = pa.schema([("key", pa.int64()), ("digest", pa.binary()), ("low", pa.int32()), ("high", pa.int32())])

    def solved(blocks: list[np.ndarray], keys: list[int], digests: list[bytes], sizes: list[int]) -> Iterator[pa.RecordBatch]:
        base, at = array(sum(map(len, blocks)), np.uint8), 0
        while blocks:
            block = blocks.pop(0)
            base[at:at + len(block)] = block
            at += len(block)
        marks = _repeated(base, length)
        ends = np.cumsum(np.array(sizes) + 1)
        for a in range(0, len(keys), 50_000):
            out: tuple[list, list, list, list] = ([], [], [], [])
            for k in range(a, min(len(keys), a + 50_000)):
                begin = ends[k] - sizes[k] - 1
                own = np.concatenate([[0], marks[begin:begin + sizes[k] - length + 1].astype(np.int8), [0]])
                for low, high in np.flatnonzero(np.diff(own)).reshape(-1, 2).tolist():
                    for column, value in zip(out, (keys[k], digests[k], low, high)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, keys, digests, sizes = None, [], [], [], []
        seen: set[tuple[int, bytes]] = set()
        for batch in batches:
            parts: list[bytes] = []
            for shard, key, digest, piece in zip(*(batch.column(c) for c in range(4))):
                if shard.as_py() != now:
                    if parts:
                        blocks.append(np.frombuffer(b"".join(parts), np.uint8))
                        parts = []
                    if keys:
                        yield from solved(blocks, keys, digests, sizes)
                    now, blocks, keys, digests, sizes, seen = shard.as_py(), [], [], [], [], set()
                name = key.as_py(), digest.as_py()
                if name in seen:
                    continue
                seen.add(name)
                keys.append(name[0])
                digests.append(name[1])
                parts += [piece.as_py(), bytes([GAP])]
                sizes.append(len(parts[-2]))
            if parts:
                joined = np.frombuffer(b"".join(parts), np.uint8)
                held = array(len(joined), np.uint8) if sum(map(len, blocks)) < 64 << 20 else np.memmap(tempfile.TemporaryFile(), np.uint8, "w+", shape=(len(joined),))
                held[:] = joined
                blocks.append(held)
        if keys:
            yield from solved(blocks, keys, digests, sizes)

    return pieces.mapInArrow(run, "key bigint, digest binary, low int, high int")


def string_repeats(pieces: DataFrame, length: int) -> DataFrame:
    """As ``shard_repeats``, for keys of any size: strings are equal if 128 bits of hashes are, which Spark counts.

    Strings are grouped by all their bytes, so no task has more of a key than others; those of one group are only counted.
    """
    schema = pa.schema([("key", pa.int64()), ("digest", pa.binary()), ("at", pa.int32()), ("one", pa.int64()), ("two", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, piece in enumerate(batch.column(3)):
                data = np.frombuffer(piece.as_py(), np.uint8)
                for a in range(0, len(data) - length + 1, HASHED_BYTES):
                    part = data[a:a + HASHED_BYTES + length - 1]
                    one, two = string_hashes(part, length, 1), string_hashes(part, length, 2)
                    row = pa.array(np.full(len(one), k))
                    yield pa.RecordBatch.from_arrays([batch.column(1).take(row), batch.column(2).take(row), pa.array(np.arange(a, a + len(one), dtype=np.int32)),
                                                      pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], schema=schema)

    starts = stored(pieces, "pieces").mapInArrow(run, "key bigint, digest binary, at int, one bigint, two bigint")
    # The same start comes twice from equal rows.
    place = F.xxhash64("key", "digest", "at")
    repeated = starts.groupBy("one", "two").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low < high").select("one", "two")
    marked = starts.join(checked_broadcast(stored(repeated, "repeated"), FOUND_ROWS), ["one", "two"], "left_semi").select("key", "digest", "at").distinct()
    run_of = F.col("at") - F.row_number().over(Window.partitionBy("key", "digest").orderBy("at"))
    return marked.withColumn("run", run_of).groupBy("key", "digest", "run").agg(F.min("at").alias("low"), (F.max("at") + 1).alias("high")).drop("run")


def repeated_spans(named: DataFrame, length: int = LENGTH) -> DataFrame:
    """``name, spans``: per named row of ``name, text`` the byte ranges of repeated strings; rows without any are left out.

    1. Starts are grouped in stretches by a key of their string; only keys whose gram occurs twice can hold repeats.
    2. Equal stretches are counted: if there are two, all their starts repeat. One of each stands for them from here on.
    3. The different stretches of a key go to one shard, whose suffix array with common-prefix lengths shows the starts that repeat.
    4. Keys with more text than a shard are not sorted: all their strings are counted by their hashes.
    """
    all_stretches = stored(stretches(named, length), "stretches")
    kinds = all_stretches.groupBy("key", "digest").agg(
        F.count("*").alias("n"), F.min(F.struct("name", "at")).alias("first"), F.first("starts").alias("starts"), F.first("inner").alias("inner"))
    keys = kinds.groupBy("key").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.max("inner").alias("any_inner"),
                                     F.sum(F.col("starts") + (length - 1)).alias("key_bytes")).where("total > 1 OR any_inner")
    again = stored(kinds.join(keys, "key"), "again")
    whole = again.where("n > 1").select("key", "digest", F.lit(0).alias("low"), F.col("starts").alias("high"))
    mixed_keys = again.where("kinds > 1 OR (n = 1 AND inner)")
    heavy = F.col("key_bytes") > SHARD_BYTES
    sizes = mixed_keys.agg(F.coalesce(F.sum(F.when(~heavy, F.col("starts") + (length - 1))), F.lit(0)).alias("bytes"), F.count_if(heavy).alias("heavy")).first()
    shards = max(1, -(-sizes["bytes"] // SHARD_BYTES))

    def pieces_of(rows: DataFrame, shard: Column) -> DataFrame:
        wanted = rows.select(F.col("first.name").alias("name"), F.struct(
            shard.cast("int").alias("shard"), "key", "digest", F.col("first.at").alias("at"), "starts").alias("one"))
        wanted = stored(wanted.groupBy("name").agg(F.collect_list("one").alias("wanted")), "wanted")
        texts = named.select("name", "text").join(checked_broadcast(wanted.select("name"), FOUND_ROWS), "name", "left_semi")
        return _pieces(texts.join(wanted, "name").select("text", "wanted"), length)

    pieces = pieces_of(mixed_keys.where(~heavy), F.pmod(F.xxhash64("key"), F.lit(shards)))
    pieces = pieces.repartition(int(shards), "shard").sortWithinPartitions("shard")
    found = shard_repeats(pieces, length)
    if sizes["heavy"]:
        found = found.unionByName(string_repeats(pieces_of(mixed_keys.where(heavy), F.lit(0)), length))
    # A stretch that comes twice is marked as a whole already.
    single = again.where("n = 1").select("key", "digest")
    found = stored(found, "found").join(single, ["key", "digest"], "left_semi")
    marks = stored(whole.unionByName(found), "marks")
    spans = all_stretches.join(marks, ["key", "digest"]).select("name", F.struct((F.col("at") + F.col("low")).alias("low"), (F.col("at") + F.col("high") + (length - 1)).alias("high")).alias("span"))
    return spans.groupBy("name").agg(F.collect_set("span").alias("spans"))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text`` of all documents.

    Texts are taken as UTF-8; a NULL text is empty. ``kept_text`` is the remaining bytes as text, where a cut character is replaced.
    Rows that are equal in id and text repeat each other, and each has its row.
    """
    named = _named(docs)
    with small_batches(docs.sparkSession):
        spans = stored(repeated_spans(named.select("name", "text"), length), "spans")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            held = 0
            for doc, text, spans in zip(batch.column(0), batch.column(1), batch.column(2)):
                data, at, kept, removed = text.as_py().encode(), 0, [], 0
                merged: list[list[int]] = []
                for low, high in sorted((s["low"], s["high"]) for s in spans.as_py()):
                    if merged and low <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], high)
                    else:
                        merged.append([low, high])
                for low, high in merged:
                    kept.append(data[at:low])
                    at, removed = high, removed + high - low
                rest = b"".join([*kept, data[at:]])
                for column, value in zip(out, (doc.as_py(), len(data), removed, len(merged), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace"))):
                    column.append(value)
                held += len(rest)
                if held > GIVEN_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)
                    out, held = [[], [], [], [], [], []], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)

    with_spans, doc_id = checked_broadcast(spans.select("name"), FOUND_ROWS), F.col("doc_id").cast("bigint").alias("doc_id")
    # Texts without any span stay where they are, and as they are.
    none = F.lit(0).cast("bigint")
    alone = named.join(with_spans, "name", "left_anti").select(
        doc_id, F.octet_length("text").cast("bigint").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.col("text").alias("kept_text"))
    moved = named.join(with_spans, "name", "left_semi").join(spans, "name").select(doc_id, "text", "spans")
    return alone.unionByName(moved.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string"))


def removal_digests(docs: DataFrame) -> DataFrame:
    """``without_repeats`` without the texts."""
    return without_repeats(docs).drop("kept_text")
