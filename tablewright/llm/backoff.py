"""Katz backoff: bigram and word counts with Good-Turing discounts, exactly normalised backoff weights, and the log-probability of every text.

Counting and scoring share one shuffle. Documents are taken in slices of some million tokens; of each slice, every distinct pair of context and word goes
to the context's bucket once, with its count in training documents and the places (documents of the slice) where it stands. A bucket has all counts of its
contexts, so it scores pairs that were seen; discounts depend on a count alone, so documents are credited with counts of counts and the discounts are put in
at the end. Pairs that were not seen back off: their buckets ask the words' buckets for word counts, make each context's weight of them, and go on with the
word's probability. The word model backs off to one unknown word in the same way.

Contexts that hold more than a bucket's share of a sample (``hot``) are dealt over all buckets by the following word, and single pairs that do so stay with
their slice: only their counts, one number each, are summed. The sample decides where rows go, never what comes out.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.groups import sorted_groups
from tablewright.llm.words import mixed, text_slices, word_hashes
from tablewright.runtime import scratch_path

#: Counts up to this one are discounted.
LARGEST = 5
#: Tokens of a slice, and bytes of text whose pairs a bucket holds. Blobs between them number slices x buckets: raise both with the executors' memory.
SLICE_TOKENS, BUCKET_BYTES = 2_500_000, 32 << 20
#: Partitions for each bucket.
SPREAD = 4
#: Documents of the sample that finds hot contexts and pairs, and the most of either.
SAMPLE_ROWS, MOST_HOT = 20_000, 100_000
#: No word holds a space.
START, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" start", b" end"))

ROWS = "kind string, key bigint, part bigint, number bigint, x double, y double, data binary"
_ROWS = pa.schema([("kind", pa.string()), ("key", pa.int64()), ("part", pa.int64()), ("number", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("data", pa.binary())])


def packed(**arrays: np.ndarray | bytes) -> bytes:
    """Arrays as one deflated string; whole numbers take as few bytes as their largest needs."""
    small = {k: v.astype(np.min_scalar_type(v.max())) if isinstance(v, np.ndarray) and v.dtype.kind == "i" and len(v) and v.min() >= 0 else v for k, v in arrays.items()}
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(small, protocol=5))


def unpacked(data: bytes) -> dict:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows ``kind, key, part, number, x, y, data``."""
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROWS)], schema=_ROWS)


def top_bits(values: np.ndarray, bits: int) -> np.ndarray:
    return (values >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)


def _runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new value starts in rows sorted by the keys."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for key in sorted_keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _pair(ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(ctx * np.uint64(0x9E3779B97F4A7C15) + word)


def tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of rows: the first row, the hashes of all tokens, an end after each row, and the number of tokens of each row."""
    for first, _, data, offsets in text_slices(column):
        hashes, at, _, _ = word_hashes(data, offsets)
        yield first, np.insert(hashes, at[1:], END), np.diff(at) + 1


def contexts(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.empty_like(words)
    out[1:] = words[:-1]
    out[np.cumsum(counts) - counts] = START
    return out


class Hot:
    """Contexts, and pairs of context and word, that are dealt differently."""

    def __init__(self, ctx: list[int], pairs: list[tuple[int, int]]) -> None:
        self.ctx = np.sort(np.array(ctx, np.uint64))
        a, b = (np.array([p[k] for p in pairs], np.uint64) for k in (0, 1))
        order = np.argsort(_pair(a, b))
        self.pair_ctx, self.pair_word = a[order], b[order]
        self.keys = _pair(self.pair_ctx, self.pair_word)

    def context(self, ctx: np.ndarray) -> np.ndarray:
        """Number of each context, -1 where it is not hot."""
        if not len(self.ctx):
            return np.full(len(ctx), -1)
        at = np.minimum(np.searchsorted(self.ctx, ctx), len(self.ctx) - 1)
        return np.where(self.ctx[at] == ctx, at, -1)

    def pair(self, ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(ctx), -1)
        at = np.minimum(np.searchsorted(self.keys, _pair(ctx, word)), len(self.keys) - 1)
        return np.where((self.pair_ctx[at] == ctx) & (self.pair_word[at] == word), at, -1)


def hot_keys(training: DataFrame, fraction: float, buckets: int) -> Hot:
    """Contexts and pairs with more than a quarter of a bucket's share of the tokens of a sample of training texts."""
    share = max(1 / (4 * buckets), 1 / MOST_HOT)
    schema = pa.schema([("kind", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words, counts in tokens(batch.column(0)):
                ctx = contexts(words, counts)
                order = np.lexsort((words, ctx))
                ctx, words = ctx[order], words[order]
                found = [(0, np.zeros(1, np.uint64), np.zeros(1, np.uint64), np.array([len(words)]))]
                for kind, at in ((1, _runs(ctx)), (2, _runs(ctx, words))):
                    n = np.diff(np.append(at, len(ctx)))
                    at, n = at[n > share / 2 * len(words)], n[n > share / 2 * len(words)]
                    found.append((kind, ctx[at], words[at] * np.uint64(kind - 1), n))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*[(np.full(len(n), k), a.view(np.int64), b.view(np.int64), n) for k, a, b, n in found])], schema=schema)

    seen = training.sample(fraction, seed=1).mapInArrow(run, "kind bigint, a bigint, b bigint, n bigint").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    # At most 2 / share rows of a slice come here and few more of all.
    total = seen.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    rows = seen.where((F.col("kind") > 0) & (F.col("n") > share * total)).collect()
    unsigned = lambda x: x & ((1 << 64) - 1)
    return Hot([unsigned(r.a) for r in rows if r.kind == 1], [(unsigned(r.a), unsigned(r.b)) for r in rows if r.kind == 2])


def slice_rows(words: np.ndarray, counts: np.ndarray, train: np.ndarray, beside: bytes, number: int, hot: Hot, bits: int) -> Iterator[tuple]:
    """What a slice sends to buckets: its pairs with training counts and places, and one row about its documents, which the buckets hand on."""
    doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    ctx = contexts(words, counts)
    aside = {}
    hot_ctx, hot_pair = hot.context(ctx), hot.pair(ctx, words)
    for name, held in (("ctx", hot_ctx), ("pair", hot_pair)):
        keys, n = np.unique(held[held >= 0] * len(counts) + doc[held >= 0].astype(np.int64), return_counts=True)
        aside |= {f"{name}_at": keys // max(len(counts), 1), f"{name}_doc": keys % max(len(counts), 1), f"{name}_n": n}
    sums = np.bincount(aside["pair_at"], weights=aside["pair_n"] * train[aside["pair_doc"]], minlength=len(hot.keys)) if len(hot.keys) else []
    yield from (("hot2", k, 0, int(n), 0.0, 0.0, None) for k, n in enumerate(sums) if n)
    yield "docs", number, 0, int(train.sum()), 0.0, 0.0, packed(beside=beside, counts=counts, train=train, **aside)
    if len(hot.keys):
        rest = hot_pair < 0
        ctx, words, doc = ctx[rest], words[rest], doc[rest]
    del hot_ctx, hot_pair
    order = np.lexsort((words, ctx))
    ctx, words, doc = ctx[order], words[order], doc[order]
    at = _runs(ctx, words)
    held = np.diff(np.append(at, len(ctx)))
    trained = np.add.reduceat(train[doc].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
    ctx, words = ctx[at], words[at]
    bucket = top_bits(np.where(hot.context(ctx) >= 0, _pair(ctx, words), ctx), bits)
    if len(hot.ctx):
        doc = doc[np.argsort(np.repeat(bucket, held), kind="stable")]
        order = np.argsort(bucket, kind="stable")
        ctx, words, held, trained, bucket = ctx[order], words[order], held[order], trained[order], bucket[order]
    ends = np.concatenate([[0], np.cumsum(held)])
    edges = np.searchsorted(bucket, np.arange((1 << bits) + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        low, high = edges[b], edges[b + 1]
        start = _runs(ctx[low:high])
        distinct, inverse = np.unique(words[low:high], return_inverse=True)
        yield "pairs", b, number, 0, 0.0, 0.0, packed(ctx=ctx[low:high][start], degree=np.diff(np.append(start, high - low)), words=distinct, word=inverse.astype(np.int64), trained=trained[low:high], held=held[low:high], doc=doc[ends[low]:ends[high]].astype(np.int64))


def sliced(docs: DataFrame, names: list[str], hot: Hot, bits: int) -> DataFrame:
    """``slice_rows`` of all rows of ``_text, _train`` and further columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 24, 0
        words, counts, train, beside, size = [], [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(beside)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            for row in slice_rows(np.concatenate(words), np.concatenate(counts), np.concatenate(train), sink.getvalue().to_pybytes(), base + number, hot, bits):
                yield _batch([row])

        for batch in batches:
            at = 0
            for first, found, n in tokens(batch.column(0)):
                words.append(found)
                counts.append(n)
                train.append(batch.column(1).slice(first, len(n)).to_numpy(zero_copy_only=False).astype(bool))
                beside.append(pa.RecordBatch.from_arrays([c.slice(first, len(n)) for c in batch.columns[2:]], names=names))
                size += len(found)
                at = first + len(n)
                if size >= SLICE_TOKENS:
                    yield from flush()
                    number, size = number + 1, 0
                    words, counts, train, beside = [], [], [], []
            assert at == batch.num_rows
        if words:
            yield from flush()

    return docs.mapInArrow(run, ROWS)


def bucket_rows(bucket: int, rows: list[dict], hot: Hot, bits: int) -> Iterator[tuple]:
    """All that a bucket knows: its model, the pairs it has to back off for, words to ask for, and what its seen pairs are worth to each document.

    ``rows`` are the slices' pairs, each with ``number`` of the slice.
    """
    ctx = np.concatenate([np.repeat(r["ctx"], r["degree"]) for r in rows])
    word = np.concatenate([r["words"][r["word"]] for r in rows])
    trained = np.concatenate([r["trained"] for r in rows])
    runs = np.concatenate([[0], np.cumsum([len(r["word"]) for r in rows])])
    order = np.lexsort((word, ctx))
    ctx, word = ctx[order], word[order]
    at = _runs(ctx, word)
    pair = np.empty(len(order), np.int32)
    pair[order] = np.repeat(np.arange(len(at), dtype=np.int32), np.diff(np.append(at, len(order))))
    ctx, word = ctx[at], word[at]
    count = np.bincount(pair, weights=trained, minlength=len(at)).astype(np.int64)
    del order, trained
    first = _runs(ctx)
    degree = np.diff(np.append(first, len(ctx)))
    of_ctx = np.repeat(np.arange(len(first)), degree)
    total = np.add.reduceat(count, first)
    least = np.minimum.reduceat(np.where(count > 0, count, np.iinfo(np.int64).max), first)
    ctx = ctx[first]
    number = hot.context(ctx)
    yield from (("hot1", int(k), int(low), int(n), 0.0, 0.0, None) for k, low, n in zip(number, least, total) if k >= 0 and n)
    yield from (("stats", r, 0, int(n), 0.0, 0.0, None) for r, n in enumerate(np.bincount(np.minimum(count, LARGEST + 2), minlength=LARGEST + 3)[:LARGEST + 2]) if r and n)

    words, of_word = np.unique(word, return_inverse=True)
    sums = np.bincount(of_word, weights=count, minlength=len(words)).astype(np.int64)
    home = top_bits(words, bits)
    edges = np.searchsorted(home, np.arange((1 << bits) + 1))
    for h in np.flatnonzero(np.diff(edges)).tolist():
        yield "words", h, bucket, 0, 0.0, 0.0, packed(words=words[edges[h]:edges[h + 1]], counts=sums[edges[h]:edges[h + 1]])

    # Contexts are tokens as well, all but the start; hot ones are counted with their slices.
    cool = number < 0
    token = np.where(cool & (ctx != START), np.log10(total + 1.0), 0.0)
    known = cool & (ctx != START) & (total > 0)
    norm = np.where(cool & (total > 0), np.log10(np.maximum(total + (least > LARGEST), 1)), 0.0)
    worth = np.log10(np.maximum(count, 1)) - norm[of_ctx]
    few = np.minimum(count, LARGEST + 1)
    missed: dict[str, list[np.ndarray]] = {"ctx": [], "word": [], "slice": [], "doc": []}
    for k, r in enumerate(rows):
        mine = np.repeat(pair[runs[k]:runs[k + 1]], r["held"])
        doc = r["doc"].astype(np.int64)
        gone = count[mine] == 0
        for name, values in (("ctx", of_ctx[mine[gone]]), ("word", of_word[mine[gone]]), ("slice", np.full(int(gone.sum()), k)), ("doc", doc[gone])):
            missed[name].append(values.astype(np.int32))
        docs, local = np.unique(doc, return_inverse=True)
        in_ctx = of_ctx[mine]
        tally = lambda weights: np.bincount(local, weights=weights, minlength=len(docs))  # noqa: E731, B023
        yield "sums", int(r["number"]), bucket, 0, 0.0, 0.0, packed(
            doc=docs, score=tally(worth[mine]), base=tally(token[in_ctx]), known=tally(known[in_ctx]).astype(np.int64),
            few=np.bincount(local * (LARGEST + 2) + few[mine], minlength=len(docs) * (LARGEST + 2)))
    model = count > 0
    yield "model", bucket, -1, 0, 0.0, 0.0, packed(
        ctx=ctx, total=total, least=np.minimum(least, LARGEST + 1), degree=np.add.reduceat(model.astype(np.int64), first), word=of_word[model], count=count[model],
        slices=np.array([r["number"] for r in rows]), **{f"missed_{name}": np.concatenate(values) for name, values in missed.items()})


def _grouped(rows: DataFrame, parts: int, of_group) -> DataFrame:
    """``of_group(key, rows)`` for all rows of a key, sorted by ``kind`` and ``part``; the rows it yields.

    With ``SPREAD`` times as many partitions as keys, few keys share one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, 1):
            for row in of_group(table.column(0)[0].as_py(), table.to_pylist()):
                yield _batch([row])

    names = ["key", "kind", "part", "number", "x", "y", "data"]
    return rows.select(*names).repartition(SPREAD * parts, "key").sortWithinPartitions("key", "kind", "part").mapInArrow(run, ROWS)


def _kept(rows: DataFrame, name: str) -> DataFrame:
    """Written in a folder per kind, so that each kind is read alone."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.partitionBy("kind").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def discounts(seen: dict[int, int]) -> np.ndarray:
    """What counts 0 to ``LARGEST`` + 1 are multiplied with, from how many have each count: Good-Turing, as Katz has it.

    Where the numbers do not allow it (a count is missing, or a factor is not between 0 and 1), an absolute discount takes its place.
    """
    n = np.array([seen.get(r, 0) for r in range(LARGEST + 2)], float)
    out = np.ones(LARGEST + 2)
    r = np.arange(1, LARGEST + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        beyond = (LARGEST + 1) * n[LARGEST + 1] / n[1]
        found = ((r + 1) * n[2:] / (r * n[1:-1]) - beyond) / (1 - beyond)
    if not (np.isfinite(found).all() and (found > 0).all() and (found < 1).all()):
        found = (r - (n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5)) / r
    out[1:-1] = found
    return out


class Words:
    """The word model: discounted counts, and the rest for one unknown word."""

    def __init__(self, seen: dict[int, int], tokens_seen: int, distinct: int) -> None:
        self.total, self.distinct, self.factor = tokens_seen, distinct, discounts(seen)
        few = sum(r * seen.get(r, 0) for r in range(1, LARGEST + 1))
        self.whole = tokens_seen + (few == 0)
        self.unknown = (self.whole - (tokens_seen - few) - sum(self.factor[r] * r * seen.get(r, 0) for r in range(1, LARGEST + 1))) / self.whole

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.factor[np.minimum(counts, LARGEST + 1)] * counts / self.whole, self.unknown)


def word_rows(home: int, rows: list[dict]) -> Iterator[tuple]:
    """The counts of a home's words, sent back to the buckets that asked; how many words have each count, all tokens (0) and all words (-1)."""
    held = [(r["part"], unpacked(r["data"])) for r in rows]
    _, inverse = np.unique(np.concatenate([x["words"] for _, x in held]), return_inverse=True)
    totals = np.bincount(inverse, weights=np.concatenate([x["counts"] for _, x in held])).astype(np.int64)
    low = 0
    for bucket, x in held:
        yield "reply", bucket, home, 0, 0.0, 0.0, packed(counts=totals[inverse[low:low + len(x["words"])]])
        low += len(x["words"])
    n = np.bincount(np.minimum(totals, LARGEST + 2), minlength=LARGEST + 3)
    n[0], n[LARGEST + 2] = totals.sum(), 0
    yield from (("stats", r, 0, int(k), 0.0, 0.0, None) for r, k in enumerate(n) if k)
    yield "stats", -1, 0, int((totals > 0).sum()), 0.0, 0.0, None


def backoff_rows(bucket: int, rows: list[dict], factor: np.ndarray, words: Words, hot: Hot) -> Iterator[tuple]:
    """What the pairs a bucket has not seen are worth to each document, by its contexts' backoff weights and its words' counts."""
    model = unpacked(rows[0]["data"])
    p = words.probability(np.concatenate([unpacked(r["data"])["counts"] for r in rows[1:]]).astype(np.int64))
    of_ctx = np.repeat(np.arange(len(model["ctx"])), model["degree"])
    count = model["count"].astype(np.int64)
    taken = np.bincount(of_ctx, weights=factor[np.minimum(count, LARGEST + 1)] * count, minlength=len(model["ctx"]))
    lower = np.bincount(of_ctx, weights=p[model["word"]], minlength=len(model["ctx"]))
    number = hot.context(model["ctx"])
    total = model["total"].astype(float)
    yield from (("hot", int(k), 0, 0, float(t), float(s), None) for k, t, s in zip(number, taken, lower) if k >= 0)
    weight = np.where((total > 0) & (number < 0), (total + (model["least"] > LARGEST) - taken) / (1 - lower), 1.0)
    value = np.log10(weight)[model["missed_ctx"]] + np.log10(p[model["missed_word"]])
    hot_of = number[model["missed_ctx"]]
    for k, name in enumerate(model["slices"].tolist()):
        mine = slice(*np.searchsorted(model["missed_slice"], [k, k + 1]))
        doc, h = model["missed_doc"][mine].astype(np.int64), hot_of[mine]
        if not len(doc):
            continue
        docs, local = np.unique(doc, return_inverse=True)
        yield "sums2", name, bucket, 0, 0.0, 0.0, packed(doc=docs, score=np.bincount(local, weights=value[mine]), hot_doc=doc[h >= 0], hot_at=h[h >= 0])


def scores(docs: DataFrame, training: Column, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``; the model is of the rows for which ``training`` holds.

    Tokens are words, lower-case, and one end for each text. ``score`` is the sum of the log10 of Katz's probabilities: of a pair seen ``c`` times after its
    context ``d(c) * c / n`` with Good-Turing's ``d``, of any other the word's probability times the weight that makes the context's probabilities add up to 1.
    A context all of whose counts are above ``LARGEST`` has one count added, so that something is left for other words. ``base_score`` adds one to every word's count.
    NULL and empty texts hold an end only. Equal rows are scored, and counted, each for itself. Without training rows all words are unknown (score 0).
    A text is worked on whole: about 100 bytes of memory for each of its words.
    """
    spark = docs.sparkSession
    kept = docs.select(*keep)
    names = [f"_keep{k}" for k in range(len(kept.columns))]
    ready = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"), F.coalesce(training, F.lit(False)).alias("_train"), *[F.col(c).alias(n) for c, n in zip(kept.columns, names)])
    rows, size = ready.agg(F.count("*"), F.sum(F.octet_length("_text"))).first()
    bits = max(0, math.ceil(math.log2(max(size or 1, 1) / BUCKET_BYTES)))
    parts = 1 << bits
    hot = hot_keys(ready.where("_train").select("_text"), min(1.0, SAMPLE_ROWS / max(rows, 1)), parts) if bits else Hot([], [])

    # One shuffle of pairs; what is about a slice goes along in a bucket of its own.
    spread = sliced(ready, names, hot, bits).withColumn("key", F.when(F.col("kind") == "pairs", F.col("key")).otherwise(-1 - F.col("key")))

    def first_pass(key: int, held: list[dict]) -> Iterator[tuple]:
        if key >= 0:
            yield from bucket_rows(key, [unpacked(r["data"]) | {"number": r["part"]} for r in held], hot, bits)
            return
        yield from ((r["kind"], -1 - key, r["part"], r["number"], 0.0, 0.0, r["data"]) for r in held)

    one = _kept(_grouped(spread, parts, first_pass), "pairs")
    by_key = lambda df, kind, *aggs: {r["key"]: r for r in df.where(F.col("kind") == kind).groupBy("key").agg(*aggs).collect()}
    number = F.sum("number").alias("n")
    ends = one.where("kind = 'docs'").agg(number).first()["n"] or 0
    pairs_n = {k: r["n"] for k, r in by_key(one, "hot2", number).items()}
    totals = by_key(one, "hot1", number, F.min("part").alias("least"))
    seen = {k: r["n"] for k, r in by_key(one, "stats", number).items()}
    for n in pairs_n.values():
        seen[n] = seen.get(n, 0) + 1
    factor = discounts(seen)

    # Words: asked for by every bucket, and once for the pairs that stayed with their slices.
    asked = one.where("kind = 'words'")
    if pairs_n:
        at = np.array(sorted(pairs_n))
        home = top_bits(hot.pair_word[at], bits)
        extra = [("words", int(h), -1, 0, 0.0, 0.0, bytearray(packed(words=hot.pair_word[at[home == h]], counts=np.array([pairs_n[k] for k in at[home == h]])))) for h in np.unique(home)]
        asked = asked.unionByName(spark.createDataFrame(extra, ROWS))
    two = _kept(_grouped(asked, parts, word_rows), "words")
    stats = {k: r["n"] for k, r in by_key(two, "stats", number).items()}
    words = Words({r: n for r, n in stats.items() if r > 0}, stats.get(0, 0), stats.get(-1, 0))

    def second_pass(key: int, held: list[dict]) -> Iterator[tuple]:
        yield from backoff_rows(key, held, factor, words, hot)

    three = _kept(_grouped(one.where("kind = 'model'").unionByName(two.where("kind = 'reply' and key >= 0")), parts, second_pass), "backoff")
    of_hot = by_key(three, "hot", F.sum("x").alias("taken"), F.sum("y").alias("lower"))
    replies = {r["part"]: unpacked(r["data"])["counts"] for r in two.where("kind = 'reply' and key = -1").collect()}

    # A hot context's sums, with its hot pairs; a few thousand numbers at most.
    count, least, taken, lower = (np.zeros(len(hot.ctx)) for _ in range(4))
    least += LARGEST + 1
    for k, r in totals.items():
        count[k], least[k] = r["n"], r["least"]
    for k, r in of_hot.items():
        taken[k], lower[k] = r["taken"], r["lower"]
    pair_value = np.zeros(len(hot.keys))
    for h in replies:
        for k, n in zip(at[home == h], replies[h]):
            c, owner = pairs_n[k], hot.context(hot.pair_ctx[[k]])[0]
            share = factor[min(c, LARGEST + 1)] * c
            pair_value[k] = math.log10(share)
            count[owner] += c
            least[owner] = min(least[owner], c)
            taken[owner] += share
            lower[owner] += float(words.probability(np.array([n]))[0])
    whole = count + (least > LARGEST)
    is_token = hot.ctx != START
    hot_norm = np.log10(np.maximum(whole, 1)) * (count > 0)
    hot_weight = np.log10(np.where(count > 0, (whole - taken) / np.maximum(1 - lower, 1e-300), 1.0))
    hot_base, hot_known = np.log10(count + 1) * is_token, (count > 0) & is_token
    factors, all_tokens = np.log10(factor), math.log10(words.total + words.distinct + 1)

    final = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, 1):
            held = table.to_pylist()
            docs_row = unpacked(held[0]["data"])
            n = docs_row["counts"].astype(np.int64)
            score, base, known = np.zeros(len(n)), np.full(len(n), math.log10(ends + 1)) - n * all_tokens, np.full(len(n), int(ends > 0))
            np.add.at(score, docs_row["ctx_doc"], -hot_norm[docs_row["ctx_at"]] * docs_row["ctx_n"])
            np.add.at(base, docs_row["ctx_doc"], hot_base[docs_row["ctx_at"]] * docs_row["ctx_n"])
            np.add.at(known, docs_row["ctx_doc"], hot_known[docs_row["ctx_at"]] * docs_row["ctx_n"].astype(np.int64))
            np.add.at(score, docs_row["pair_doc"], pair_value[docs_row["pair_at"]] * docs_row["pair_n"])
            for r in held[1:]:
                x = unpacked(r["data"])
                score[x["doc"]] += x["score"]
                if r["kind"] == "sums":
                    score[x["doc"]] += x["few"].reshape(-1, LARGEST + 2) @ factors
                    base[x["doc"]] += x["base"]
                    known[x["doc"]] += x["known"].astype(np.int64)
                else:
                    np.add.at(score, x["hot_doc"], hot_weight[x["hot_at"]])
            beside = pa.ipc.open_stream(docs_row["beside"]).read_all().combine_chunks().to_batches()
            columns = beside[0].columns if beside else []
            yield pa.RecordBatch.from_arrays([*columns, pa.array(~docs_row["train"]), pa.array(n), pa.array(known), pa.array(np.full(len(n), words.total)), pa.array(base), pa.array(score)], names=[*names, *final])

    kinds = ", ".join([f"{n} {f.dataType.simpleString()}" for n, f in zip(names, kept.schema.fields)] + ["held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"])
    gathered = one.where("kind in ('docs', 'sums')").unionByName(three.where("kind = 'sums2'")).select("key", "kind", "part", "data")
    out = gathered.repartition(SPREAD * parts, "key").sortWithinPartitions("key", "kind", "part").mapInArrow(last_pass, kinds)
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept.columns, names)], *final)


def score_texts(docs: DataFrame, text: str = "text", key: str = "doc_id", folds: int = 7, held_out: int = 2) -> DataFrame:
    """``scores`` with the rows whose ``crc32(key as text) % folds`` is not ``held_out`` for training; a NULL key counts as an empty text."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return scores(rows, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds != held_out).withColumnRenamed("doc_id", key)
