"""Benchmark decontamination: random-walk embeddings, bit sampling over item-sized windows, exact edit distance."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.tables import checked_broadcast, stored
from tablewright.llm.words import mixed, text_slices, word_hashes

#: A window matches an item if at most this part of the item's words is inserted, deleted or replaced.
EDIT_SHARE = 0.1
#: Part of the windows with that many edits that the sampling is to find for each class of item lengths; more repetitions than these are an error.
RECALL, MOST_REPETITIONS = 0.95, 100
#: Items of a class, and edited copies of them, on which that part is measured.
TRIAL_ITEMS, TRIAL_COPIES = 200, 800
#: Coordinates sampled for every item, and further ones for each class of item lengths; classes grow by this factor.
SHARED_SAMPLES, CLASS_SAMPLES, CLASS_FACTOR = 2, 2, 1.5
#: Words of an item, from a place that each repetition draws, among which it samples: over more words edits add up.
ANCHOR_WORDS = 20
#: Words of items that are searched for in one pass over the documents; more items take more passes.
PASS_WORDS = 1_000_000
#: Slots of a table that tells quickly which sampled words no item has.
SLOTS = 1 << 20


def _seed(*parts: int) -> np.uint64:
    return mixed(np.array([hash(parts) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]


def _folded(key: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return mixed(key * np.uint64(0x9E3779B97F4A7C15) + symbol)


def _walk(words: np.ndarray, at: np.ndarray, step: int, to: int) -> np.ndarray:
    """Positions after the steps ``step`` to ``to - 1``: a random bit of the current word and step says whether to move on.

    Two texts with few edits between them walk in step again soon after each edit, so the words that they show at equal steps
    (their embeddings) differ in few places.
    """
    last = len(words) - 1
    for j in range(step, to):
        at = np.minimum(at + ((words[at] >> np.uint64(j & 63)) & np.uint64(1)).astype(at.dtype), last)
    return at


@dataclass
class Plan:
    """The sampled steps of one repetition, and what the items show at them."""

    seed: np.uint64
    shared: list[int]
    classes: dict[int, list[int]] = field(default_factory=dict)
    anchors: dict[int, int] = field(default_factory=dict)
    numbers: list[int] = field(default_factory=list)
    shared_seen: list[np.ndarray] = field(default_factory=list)
    keys: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)


def _class_of(length: int) -> int:
    return int(math.log(max(1, length), CLASS_FACTOR) + 1e-9)


def _steps(rng: random.Random, count: int, low: float, high: float) -> list[int]:
    return sorted(rng.randrange(int(low), max(int(low) + 1, int(high))) for _ in range(count))


def _plan(repetition: int, lengths: list[int], shared: float = 0.7, reached: float = 1.4) -> Plan:
    """Steps that nearly all walks reach before their item ends (a walk of j steps passes about j / 2 words), and the word where the walks of a class start.

    If ``shared`` and ``reached`` are 1, all walks reach them: j steps pass at most j words.
    """
    rng, seed = random.Random(1009 + repetition), _seed(17, repetition)
    plan = Plan(seed, _steps(rng, SHARED_SAMPLES, 0, shared * min(*lengths, ANCHOR_WORDS)))
    for c in sorted({_class_of(n) for n in lengths}):
        least = min(n for n in lengths if _class_of(n) == c)
        reach = min(least, ANCHOR_WORDS)
        plan.classes[c] = _steps(rng, CLASS_SAMPLES, plan.shared[-1], max(plan.shared[-1] + 1, reached * reach))
        plan.anchors[c] = rng.randrange(least - reach + 1)
    return plan


def _sampled(plan: Plan, words: np.ndarray, at: np.ndarray, steps: list[int], step: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    for to in steps:
        at = _walk(words, at, step, to)
        key, step = _folded(key, words[at]), to
    return at, key, step


def _item_key(plan: Plan, words: np.ndarray) -> np.uint64:
    c = _class_of(len(words))
    shuffled = np.append(mixed(words ^ plan.seed), np.uint64(0))
    _, key, _ = _sampled(plan, shuffled, np.full(1, plan.anchors[c]), plan.shared + plan.classes[c], 0, np.zeros(1, np.uint64))
    return key[0]


def _edited(words: np.ndarray, edits: int, rng: random.Random) -> np.ndarray:
    out = words.tolist()
    for _ in range(edits):
        at, kind = rng.randrange(len(out)) if out else 0, rng.randrange(3)
        if kind == 0 or not out:
            out.insert(at, rng.getrandbits(64))
        elif kind == 1:
            out[at] = rng.getrandbits(64)
        else:
            del out[at]
    return np.array(out or [1], np.uint64)


class _Trial:
    """Edited copies of a class's items in random text, and which of them no repetition has found yet."""

    def __init__(self, c: int, items: list[np.ndarray], share: float, rng: random.Random):
        self.c, self.items = c, items if len(items) <= TRIAL_ITEMS else rng.sample(items, TRIAL_ITEMS)
        noise = lambda n: np.frombuffer(rng.randbytes(8 * n), np.uint64)
        texts, spots, counts, of, at = [], [], [], [], 0
        for k, w in enumerate(self.items):
            limit = int(share * len(w))
            for _ in range(-(-TRIAL_COPIES // len(self.items))):
                edited = _edited(w, limit, rng)
                # Candidates from which the check sees all of the copy. Its walk goes on into other words.
                low, high = at + limit + len(edited) - len(w), at + 3 * limit
                texts += [noise(2 * limit), edited, noise(2 * ANCHOR_WORDS)]
                spots.append(np.arange(low, high + 1))
                counts.append(len(spots[-1]))
                of.append(k)
                at += sum(map(len, texts[-3:]))
        self.text, self.spots, self.of = np.concatenate(texts), np.concatenate(spots), np.repeat(of, counts)
        self.begins, self.missed = np.cumsum(counts) - counts, np.ones(len(counts), bool)

    def run(self, plan: Plan) -> None:
        own = np.array([_item_key(plan, w) for w in self.items], np.uint64)
        shuffled = np.append(mixed(self.text ^ plan.seed), np.uint64(0))
        _, key, _ = _sampled(plan, shuffled, self.spots + plan.anchors[self.c], plan.shared + plan.classes[self.c], 0, np.zeros(len(self.spots), np.uint64))
        self.missed &= ~np.logical_or.reduceat(key == own[self.of], self.begins)

    def short_of(self, recall: float) -> bool:
        """Whether the part that is found, less one standard error, is under ``recall``."""
        miss = self.missed.mean()
        return miss + math.sqrt(miss * (1 - miss) / len(self.missed)) > 1 - recall


def plans_for(items: list[np.ndarray], recall: float = RECALL, share: float = EDIT_SHARE) -> list[Plan]:
    """Repetitions until those of each class of lengths find its items with the most edits allowed with probability ``recall``.

    That is tried on edited copies of the items of a class to which an edit is allowed. A repetition looks only for the classes that
    need it; items without edits allowed need two. Every item is found for certain where it stands unchanged: items whose own walk
    runs past their end in all repetitions have one more, with steps that cannot.
    """
    rng, classes = random.Random(5), [_class_of(len(w)) for w in items]
    trials = {}
    for c in sorted(set(classes)):
        if own := [w for w, k in zip(items, classes) if k == c and int(share * len(w)) > 0]:
            trials[c] = _Trial(c, own, share, rng)
    plans, open_classes = [], set(classes)
    while open_classes:
        if len(plans) == MOST_REPETITIONS:
            raise ValueError(f"{MOST_REPETITIONS} repetitions find less than {recall} of the items in the length classes {sorted(open_classes)}")
        plan = _plan(len(plans), [len(w) for w, c in zip(items, classes) if c in open_classes])
        plan.numbers = [i for i, c in enumerate(classes) if c in open_classes]
        plans.append(plan)
        for c in open_classes & set(trials):
            trials[c].run(plan)
        open_classes = {c for c in open_classes if len(plans) < 2 or (c in trials and trials[c].short_of(recall))}
    inside: set[int] = set()
    for plan in plans:
        inside |= _with_keys(plan, items, classes)
    if outside := sorted(set(range(len(items))) - inside):
        plan = _plan(len(plans), [len(items[i]) for i in outside], 1, 1)
        plan.numbers = outside
        _with_keys(plan, items, classes)
        plans.append(plan)
    return plans


def _with_keys(plan: Plan, items: list[np.ndarray], classes: list[int]) -> set[int]:
    """Sets what the items of a plan show at its steps; returns those whose walk stays inside the item."""
    bits, inside = [np.zeros(SLOTS, bool) for _ in plan.shared], set()
    found: dict[int, list[tuple[int, int]]] = {}
    for i in plan.numbers:
        w, c = items[i], classes[i]
        shuffled = np.append(mixed(w ^ plan.seed), np.uint64(0))
        at, key, step = np.full(1, plan.anchors[c]), np.zeros(1, np.uint64), 0
        for k, to in enumerate(plan.shared):
            at, key, step = _sampled(plan, shuffled, at, [to], step, key)
            bits[k][key & np.uint64(SLOTS - 1)] = True
        at, key, _ = _sampled(plan, shuffled, at, plan.classes[c], step, key)
        if at[0] < len(w):
            inside.add(i)
        found.setdefault(c, []).append((int(key[0]), i))
    plan.shared_seen = bits
    for c, pairs in found.items():
        pairs.sort()
        plan.keys[c] = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.int64)
    return inside


def candidates(words: np.ndarray, plans: list[Plan], first: np.ndarray = np.zeros(1, np.int64)) -> tuple[np.ndarray, np.ndarray]:
    """Window starts and item numbers with equal samples in some repetition; ``words`` may hold several texts, which begin at ``first``."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, items = [], []
    for plan in plans:
        shuffled = np.append(mixed(words ^ plan.seed), np.uint64(0))
        start = at = np.arange(len(words), dtype=np.int32)
        key, step = np.zeros(len(words), np.uint64), 0
        for k, to in enumerate(plan.shared):
            at, key, step = _sampled(plan, shuffled, at, [to], step, key)
            ok = np.flatnonzero(plan.shared_seen[k][key & np.uint64(SLOTS - 1)])
            start, at, key = start[ok], at[ok], key[ok]
        for c, (keys, numbers) in plan.keys.items():
            _, full, _ = _sampled(plan, shuffled, at, plan.classes[c], step, key)
            low, high = np.searchsorted(keys, full, "left"), np.searchsorted(keys, full, "right")
            hit = np.flatnonzero(high > low)
            counts = high[hit] - low[hit]
            # The window starts before the word where the walk did, but in the same text.
            begin = first[np.searchsorted(first, start[hit], "right") - 1]
            starts.append(np.repeat(np.maximum(start[hit].astype(np.int64) - plan.anchors[c], begin), counts))
            items.append(numbers[np.repeat(low[hit], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)])
    return np.concatenate(starts), np.concatenate(items)


def least_edits(item: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """For each row of ``segments`` the least word edit distance between the item and any part of the row."""
    ramp = np.arange(segments.shape[1] + 1)
    cost = np.zeros((len(segments), len(ramp)), np.int64)
    for i, word in enumerate(item):
        new = np.empty_like(cost)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(cost[:, :-1] + (segments != word), cost[:, 1:] + 1)
        cost = np.minimum.accumulate(new - ramp, axis=1) + ramp
    return cost.min(axis=1)


def _verified(words: np.ndarray, first: np.ndarray, items: list[np.ndarray], starts: np.ndarray, numbers: np.ndarray, share: float) -> list[tuple[int, int, int, int]]:
    """Row, item, first word of the best window in the row and its edits; one per row and item."""
    rows = np.searchsorted(first, starts, "right") - 1
    found: dict[tuple[int, int], tuple[int, int]] = {}
    order = np.unique(np.stack([numbers, starts, rows]), axis=1)
    for number in np.unique(order[0]):
        item = items[number]
        inside = order[0] == number
        at, row = order[1][inside], order[2][inside]
        limit = int(share * len(item))
        width = len(item) + 2 * limit
        low = np.maximum(first[row], at - limit)
        spots = low[:, None] + np.arange(width)
        # Words outside the row match nothing.
        segments = np.where(spots < first[row + 1][:, None], np.append(words, np.uint64(0))[np.minimum(spots, len(words))], np.uint64(0))
        for piece in range(0, len(at), 4096):
            part = slice(piece, piece + 4096)
            for a, r, e in zip(at[part], row[part], least_edits(item, segments[part])):
                if e <= limit and (e, a) < found.get((r, number), (limit + 1, 0))[:2]:
                    found[r, number] = (int(e), int(a))
    return [(int(r), int(n), int(a - first[r]), e) for (r, n), (e, a) in sorted(found.items())]


def matches(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE, recall: float = RECALL) -> DataFrame:
    """``doc_id, item_id, start_word, n_words, edits``: where documents hold an item of the benchmark, the best place per document and item.

    Words are what stands between white space, A-Z in lower case. The items of a pass are few enough to be sent to every task
    (``PASS_WORDS``); more items take more passes over the documents. Items without words match nothing, equal items and
    items whose id is NULL are found like others, NULL texts hold nothing, and equal rows have a row each.
    """
    spark = docs.sparkSession
    items = stored(benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), "text"), "items")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    passes = max(1, math.ceil(size / (6 * PASS_WORDS)))
    schema = "doc_id bigint, item_id bigint, start_word bigint, n_words bigint, edits bigint"
    arrow = pa.schema([(n, pa.int64()) for n in ("doc_id", "item_id", "start_word", "n_words", "edits")])
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = None
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).orderBy("item_id", "text").toPandas()
        hashed = [word_hashes(d, o)[0] for t in part["text"] for _, _, d, o in text_slices(pa.array([t]))]
        ids = [None if i is None or i != i else int(i) for i, w in zip(part["item_id"], hashed) if len(w)]
        hashed = [w for w in hashed if len(w)]
        if not hashed:
            continue
        shared = spark.sparkContext.broadcast((ids, hashed, plans_for(hashed, recall, share)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, hashed, plans = shared.value
            for batch in batches:
                for begin, _, data, offsets in text_slices(batch.column(1)):
                    words, first, _, _ = word_hashes(data, offsets)
                    hits = _verified(words, first, hashed, *candidates(words, plans, first), share)
                    docs = batch.column(0).take(pa.array([begin + h[0] for h in hits], pa.int64()))
                    columns = [docs, pa.array([ids[h[1]] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.int64()),
                               pa.array([len(hashed[h[1]]) for h in hits], pa.int64()), pa.array([h[3] for h in hits], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

        found = texts.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item of the benchmark, with the columns they had; rows whose ``doc_id`` is NULL are told apart by their text."""
    name = F.xxhash64("doc_id", "text")
    named = docs.select(F.struct("*").alias("_row"), name.alias("_name"))
    texts = named.select(F.col("_name").alias("doc_id"), F.col("_row.text").alias("text"))
    leaks = stored(matches(texts, benchmark).select(F.col("doc_id").alias("_name")).distinct(), "leaks")
    return named.join(checked_broadcast(leaks), "_name", "left_anti").select("_row.*")
