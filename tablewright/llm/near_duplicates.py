"""Near-duplicates by an inverted join on MinHash coordinates."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.components import components
from tablewright.llm.groups import sorted_groups
from tablewright.llm.tables import WORD, checked_broadcast, stored
from tablewright.llm.words import mixed, shingles, text_slices, word_hashes

#: Words of a shingle, and per cent of the union that two linked sets share at least.
WIDTH, PER_CENT = 5, 85
#: Coordinates of a signature, and the probability with which a linked pair may share too few of them to be found.
COORDINATES, MISSED = 64, 1e-7
#: Bits of a set's parity sketch. Two sets differ in no fewer places than their sketches do; sets that differ in d
#: places show more than ``most_bits(d)`` different bits with a probability of less than 1e-8.
BITS = 1024
#: Rows of a list that are compared with rows of the list at a time.
SIDE_ROWS, ALL_ROWS = 512, 4096
#: Ids that may be broadcast to find texts again.
FOUND_ROWS = 500_000

_SEEDS = mixed(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTOR, _SHIFT = _SEEDS[:COORDINATES] | np.uint64(1), _SEEDS[COORDINATES:]


def least_matches(per_cent: int) -> int:
    """Coordinates that a pair at the similarity shares, but with probability ``MISSED``: binomial in the similarity."""
    p, below = per_cent / 100, 0.0
    for k in range(COORDINATES + 1):
        below += math.comb(COORDINATES, k) * p ** k * (1 - p) ** (COORDINATES - k)
        if below > MISSED:
            return k
    return COORDINATES


def _sets(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of rows: distinct shingle hashes, sorted within each row, their offsets, and all shingles' offsets."""
    for _, _, data, offsets in text_slices(column):
        hashes, first, _, _ = word_hashes(data, offsets)
        found, at = shingles(hashes, first, width)
        parts = [np.unique(found[a:b]) for a, b in zip(at[:-1], at[1:])]
        yield np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def _digest(part: np.ndarray) -> bytes | None:
    return hashlib.blake2b(part.tobytes(), digest_size=16).digest() if len(part) else None


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per non-empty set: the least value of each coordinate's hash, with the coordinate in the lowest six bits."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(starts), COORDINATES), np.uint64)
    for k in range(COORDINATES):
        least = np.minimum.reduceat(values * _FACTOR[k] + _SHIFT[k], starts) if len(starts) else 0
        out[:, k] = (least & ~np.uint64(63)) | np.uint64(k)
    return out.view(np.int64)


def parities(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """For each set, ``BITS`` parities of how many of its hashes fall in each slot."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    slot = (values >> np.uint64(17)) & np.uint64(BITS - 1)
    held = np.bincount(rows * BITS + slot.astype(np.int64), minlength=(len(offsets) - 1) * BITS).astype(np.uint8) & 1
    return [row.tobytes() for row in np.packbits(held.reshape(-1, BITS), axis=1)]


def most_bits(differ: np.ndarray) -> np.ndarray:
    """Different bits of sketches whose sets differ in ``differ`` places: six deviations above the mean, at most ``differ``."""
    two, four = (1 - 2 / BITS) ** differ, (1 - 4 / BITS) ** differ
    spread = np.sqrt(np.maximum(0, BITS / 4 * (1 - four) + BITS ** 2 / 4 * (four - two ** 2)))
    return np.minimum(differ, BITS / 2 * (1 - two) + 6 * spread + 1)


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """``id, mark, n_shingles, digest, signature, parity`` of each row of ``id, text``; ``mark`` tells texts of equal ids apart.

    ``digest`` and ``signature`` (see ``signatures``) are NULL for texts without words.
    """
    schema = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("signature", pa.list_(pa.int64())), ("parity", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for values, offsets in _sets(batch.column(2), width):
                rows, counts = len(offsets) - 1, np.diff(offsets)
                held = signatures(values, offsets)
                ends = np.concatenate([[0], np.cumsum(np.where(counts > 0, COORDINATES, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(held.ravel()), mask=pa.array(counts == 0))
                digests = pa.array([_digest(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), batch.column(1).slice(at, rows), pa.array(counts), digests, lists, pa.array(parities(values, offsets), pa.binary())], schema=schema)
                at += rows

    return docs.select("id", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, "id bigint, mark bigint, n_shingles bigint, digest binary, signature array<bigint>, parity binary")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``digest, hashes`` for the rows of ``id, text`` whose ``id, mark`` are in ``wanted``, once per digest."""
    schema = pa.schema([("digest", pa.binary()), ("hashes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values, offsets in _sets(batch.column(0), width):
                digests = pa.array([_digest(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([digests, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))], schema=schema)

    name = F.xxhash64("id", "mark").alias("name")
    named = docs.select(F.xxhash64("id", F.xxhash64("text")).alias("name"), "text")
    found = named.join(checked_broadcast(stored(wanted.select(name).distinct(), "wanted"), FOUND_ROWS), "name", "left_semi").select("text")
    return stored(found.mapInArrow(run, "digest binary, hashes array<bigint>").dropDuplicates(["digest"]), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets share at least ``per_cent`` of their union."""
    left, right = (sets.select(F.col("digest").alias(c), F.col("hashes").alias(f"h{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("ha", "hb"))
    return both.where(100 * shared >= per_cent * (F.size("ha") + F.size("hb") - shared)).select("a", "b")


def _near_size(a: str, b: str, per_cent: int):
    return (100 * F.least(a, b) >= per_cent * F.greatest(a, b))


def _side_pairs(lists: DataFrame, facts: DataFrame, per_cent: int, nearest: bool) -> DataFrame:
    """Pairs of one list with different labels that may be links.

    ``lists`` has ``value, digest, label``, and ``facts`` has ``digest, n, bytes, parity`` once per digest; they are brought together for lists
    with several labels only. The members under a list's most frequent label need no comparison among themselves. The others
    are compared with all members, in blocks, inside tasks: by size, by equal coordinates (one byte of each), and by their
    sketches. Only pairs that pass come out; with ``nearest``, for each of the others the nearest member under each label.
    """
    by_label = stored(lists.groupBy("value", "label").agg(F.count("*").alias("n")).groupBy("value").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("members"), F.max("n").alias("most")).where("members > most"), "lists")
    rows = lists.join(by_label, "value").withColumns({
        "sides": F.ceil((F.col("members") - F.col("most")) / SIDE_ROWS).cast("int"), "alls": F.ceil(F.col("members") / ALL_ROWS).cast("int")})
    spot = lambda n, seed: F.pmod(F.xxhash64("digest", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["value", "side", "all", "role", "digest", "label"]
    side = rows.where("label <> main").withColumns({"side": spot("sides", 1), "role": F.lit(0)}).withColumn("all", each("alls")).select(columns)
    every = rows.withColumns({"all": spot("alls", 2), "role": F.lit(1)}).withColumn("side", each("sides")).select(columns)
    full = stored(side.unionByName(every), "members").join(facts, "digest").select(*columns, "n", "bytes", "parity")
    placed = full.repartition("value", "side", "all").sortWithinPartitions("value", "side", "all", "role")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    share, matches = (100 - per_cent) / (100 + per_cent), least_matches(per_cent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, 3):
            role = group.column("role").to_numpy()
            cut = int((role == 0).sum())
            if not cut or cut == len(role):
                continue
            digest, n = group.column("digest").to_pylist(), group.column("n").to_numpy()
            label = np.unique(np.array([v.hex() for v in group.column("label").to_pylist()]), return_inverse=True)[1]
            coded = np.frombuffer(b"".join(group.column("bytes").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            parity = np.frombuffer(b"".join(group.column("parity").to_pylist()), np.uint64).reshape(-1, BITS // 64)
            left, right = [], []
            for i in range(cut):
                fits = np.flatnonzero((label[cut:] != label[i]) & (100 * np.minimum(n[cut:], n[i]) >= per_cent * np.maximum(n[cut:], n[i]))) + cut
                fits = fits[(coded[fits] == coded[i]).sum(1) >= matches] if len(fits) else fits
                bits = np.bitwise_count(parity[fits] ^ parity[i]).sum(1)
                near = bits <= most_bits(np.floor(share * (n[fits] + n[i]) + 1e-9))
                fits, bits = fits[near], bits[near]
                if nearest and len(fits):
                    fits = fits[np.argsort(bits, kind="stable")]
                    fits = fits[np.unique(label[fits], return_index=True)[1]]
                for j in fits:
                    left.append(min(digest[i], digest[j]))
                    right.append(max(digest[i], digest[j]))
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], schema=schema)

    return placed.mapInArrow(run, "a binary, b binary").distinct()


def near_components(rows: DataFrame, docs: DataFrame, width: int, per_cent: int) -> DataFrame:
    """``digest, label`` of the sets that are linked with another set; ``rows`` is ``sketched(docs)``, stored.

    1. Equal sets are one node. Coordinate values that one node has alone are dropped, and a node with fewer than the
       least number of matches left is skipped: it cannot match anyone.
    2. Ordered from rare to frequent, the values of two nodes with m values in common meet within all but the last
       m - 1 of each, so nodes are posted under those only.
    3. In each list every node is tried against the node whose values are the most frequent; the links, confirmed on full
       sets, give components. Pairs of one list that are in one component by then need no proof. The others are compared in
       blocks: first only with the nearest node of each other component, then, among the components that are left, all.
    """
    matches = least_matches(per_cent)
    nodes = stored(rows.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min(F.struct("id", "mark")).alias("at"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), F.first("parity").alias("parity")), "nodes")
    postings = nodes.select("digest", F.explode("signature").alias("value"))
    shared = postings.groupBy("value").agg(F.count("*").alias("times")).where("times > 1")
    ordered = postings.join(shared, "value").groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("times", "value"))).alias("values"), F.sum("times").alias("weight"))
    ordered = ordered.where(F.size("values") >= matches).select("digest", "weight", F.slice("values", 1, F.size("values") - (matches - 1)).getField("value").alias("values"))
    kept = stored(nodes.join(ordered, "digest"), "candidates")
    lists = kept.select("digest", "weight", F.explode("values").alias("value"))
    heads = lists.groupBy("value").agg(F.max_by("digest", F.struct("weight", "digest")).alias("a"), F.count("*").alias("members")).where("members > 1").drop("members")
    tried = lists.join(heads, "value").where("a <> digest").select("a", F.col("digest").alias("b")).distinct()
    left, right = (kept.select(F.col("digest").alias(c), F.col("n").alias(f"n{c}"), F.col("signature").alias(f"s{c}")) for c in "ab")
    tried = tried.join(left, "a").join(right, "b").where(_near_size("na", "nb", per_cent) & (F.size(F.array_intersect("sa", "sb")) >= matches)).select("a", "b")
    sets = full_sets(docs, kept.select("at.*"), width)
    links = stored(confirmed(stored(tried, "pairs"), sets, per_cent), "links")
    labels = components(links)
    coded = F.unhex(F.array_join(F.transform("signature", lambda v: F.lpad(F.hex(F.pmod(F.shiftright(v, 6), F.lit(256))), 2, "0")), ""))
    facts = kept.select("digest", "n", coded.alias("bytes"), "parity")
    for nearest in (True, False):
        known = kept.join(labels, kept["digest"] == labels["node"], "left").select(
            "digest", F.coalesce("label", "digest").alias("label"), F.explode("values").alias("value"))
        more = stored(confirmed(stored(_side_pairs(stored(known, "known"), facts, per_cent, nearest), "pairs"), sets, per_cent), "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)
    return labels


def _classified(texts: DataFrame, width: int, per_cent: int) -> DataFrame:
    """``id, mark, n_shingles, digest, class, component_id`` of each row of ``id, text``; ``class`` and ``digest`` are NULL without words."""
    rows = stored(sketched(texts, width), "sketches")
    labels = near_components(rows, texts, width, per_cent)
    least = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("least"))
    named = stored(least.join(labels, least["digest"] == labels["node"], "left").select("digest", F.coalesce("label", "digest").alias("class"), "least"), "named")
    groups = named.groupBy("class").agg(F.min("least").alias("component_id"))
    classes = stored(named.join(groups, "class").select("digest", "class", "component_id"), "classes")
    out = rows.select("id", "mark", "n_shingles", "digest").join(checked_broadcast(classes), "digest", "left")
    return out.withColumn("component_id", F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id")))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("id"), "text")


def deduplicated(docs: DataFrame, width: int = WIDTH, per_cent: int = PER_CENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of all documents.

    Texts without words (NULL, empty, white space) are linked with nothing and are their own component. The component's id is
    its smallest ``doc_id`` that is not NULL; a document is kept if it has that id, so rows that repeat an id are kept together.
    """
    return _classified(_texts(docs), width, per_cent).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def first_of_each(docs: DataFrame, width: int = WIDTH, per_cent: int = PER_CENT) -> DataFrame:
    """The documents without their near-duplicates: of each component one row with the smallest id, with the columns it had.

    A row whose id is NULL stands for its component only if no other row can. Texts without words all stay.
    """
    rows = stored(_classified(_texts(docs), width, per_cent), "classified").where("digest IS NOT NULL")
    first = rows.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("at")).select("at.id", "at.mark")
    name = F.xxhash64("id", "mark").alias("_name")
    times = rows.groupBy(name).agg(F.count("*").alias("_times"))
    kept = stored(first.select(name).distinct().join(times, "_name"), "kept")
    whole = docs.select(F.struct("*").alias("_row"), F.xxhash64(F.col("doc_id").cast("bigint"), F.xxhash64("text")).alias("_name"))
    blank = whole.where(~F.rlike(F.coalesce("_row.text", F.lit("")), F.lit(WORD)))
    worded = whole.where(F.rlike("_row.text", F.lit(WORD)))
    once = worded.join(checked_broadcast(kept.where("_times = 1").select("_name"), FOUND_ROWS), "_name", "left_semi")
    # Rows that are repeated whole are the only ones that have to meet.
    again = worded.join(checked_broadcast(kept.where("_times > 1").select("_name"), FOUND_ROWS), "_name", "left_semi").dropDuplicates(["_name"])
    return once.unionByName(again).unionByName(blank).select("_row.*")
