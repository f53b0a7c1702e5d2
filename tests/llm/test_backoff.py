"""Katz backoff against a plain model, with many small slices and buckets, and with hot contexts."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablewright.llm import backoff
from tablewright.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, score string, number int"


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def _held_out(key):
    return zlib.crc32(str("" if key is None else key).encode()) % 7 == 2


def _discounts(n):
    k = backoff.LARGEST
    try:
        beyond = (k + 1) * n[k + 1] / n[1]
        d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - beyond) / (1 - beyond) for r in range(1, k + 1)}
        usable = all(0 < x < 1 for x in d.values())
    except ZeroDivisionError:
        usable = False
    if not usable:
        part = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        d = {r: (r - part) / r for r in range(1, k + 1)}
    return lambda c: d.get(c, 1.0)


class Plain:
    """The model, all of it in dictionaries."""

    def __init__(self, texts):
        self.pairs, self.words = defaultdict(Counter), Counter()
        for text in texts:
            tokens = [*_words(text), "</end>"]
            self.words.update(tokens)
            for a, b in zip(["<start>", *tokens], tokens):
                self.pairs[a][b] += 1
        self.d = _discounts(Counter(c for x in self.pairs.values() for c in x.values()))
        self.dw = _discounts(Counter(self.words.values()))
        self.total = sum(self.words.values())
        self.whole = self.total + all(c > backoff.LARGEST for c in self.words.values())
        self.unknown = 1 - sum(self.dw(c) * c for c in self.words.values()) / self.whole

    def word(self, w):
        c = self.words[w]
        return self.dw(c) * c / self.whole if c else self.unknown

    def probability(self, context, w):
        seen = self.pairs.get(context)
        if not seen:
            return self.word(w)
        whole = sum(seen.values()) + (min(seen.values()) > backoff.LARGEST)
        if w in seen:
            return self.d(seen[w]) * seen[w] / whole
        left = 1 - sum(self.d(c) * c for c in seen.values()) / whole
        return left / (1 - sum(self.word(x) for x in seen)) * self.word(w)

    def row(self, key, text):
        tokens = [*_words(text), "</end>"]
        score = sum(math.log10(self.probability(a, b)) for a, b in zip(["<start>", *tokens], tokens))
        base = sum(math.log10((self.words[w] + 1) / (self.total + len(self.words) + 1)) for w in tokens)
        return key, _held_out(key), len(tokens), sum(w in self.words for w in tokens), self.total, base, score


def _same(found, expected):
    assert len(found) == len(expected)
    order = lambda r: (repr(r[0]), r[2], r[3], round(r[5], 6), round(r[6], 6))
    for a, b in zip(sorted(map(tuple, found), key=order), sorted(expected, key=order)):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-9, atol=1e-9), (a, b)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)] + ["The", "the", "THE", "É", "é"]
    texts = ["", None, " \n ", "one", "one", "a" * 5000]
    texts += [" ".join("the the" if rng.random() < 0.3 else words[int(rng.random() ** 3 * len(words))] for _ in range(rng.randrange(1, 80))) for _ in range(150)]
    return [(k, t, "s", 1) for k, t in enumerate(texts)] + [(4, "one", None, None), (None, "one the", None, None)]


@pytest.mark.parametrize("bucket_bytes", [1 << 30, 4000, 300])
def test_scores_equal_plain_model(spark, rows, monkeypatch, bucket_bytes):
    monkeypatch.setattr(backoff, "BUCKET_BYTES", bucket_bytes)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    plain = Plain([t for k, t, *_ in rows if not _held_out(k)])
    _same(backoff.score_texts(docs).collect(), [plain.row(k, t) for k, t, *_ in rows])


def test_hot_contexts_and_pairs_are_found(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).select("text")
    hot = backoff.hot_keys(docs, 1.0, 64)
    the = backoff.tokens(spark.createDataFrame([("the",)], "text string").toArrow().column(0).combine_chunks())
    assert next(the)[1][0] in hot.ctx and len(hot.keys) > 0 and set(hot.pair_ctx) <= set(hot.ctx)


def test_slices_smaller_than_batches(spark, rows):
    """Slices of some tokens give the same sums as one slice; run in this process."""
    import pyarrow as pa

    column = pa.array([t for _, t, *_ in rows])
    (_, words, counts), = backoff.tokens(column)
    train = np.arange(len(counts)) % 3 > 0
    hot = backoff.Hot([], [])

    def passed(cuts):
        ends, out = np.cumsum(counts), []
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            low = 0 if a == 0 else ends[a - 1]
            out += [backoff.unpacked(r[-1]) | {"number": n} for r in backoff.slice_rows(words[low:ends[b - 1]], counts[a:b], train[a:b], b"", n, hot, 0) if r[0] == "pairs"]
        found = list(backoff.bucket_rows(0, out, hot, 0))
        whole = np.zeros(len(counts))
        for r in found:
            if r[0] == "sums":
                x = backoff.unpacked(r[-1])
                whole[x["doc"].astype(int) + cuts[r[1]]] += x["score"]
        return whole, {r[1]: r[3] for r in found if r[0] == "stats"}

    one, many = passed([0, len(counts)]), passed([0, 1, 2, 50, 51, 120, len(counts)])
    assert np.allclose(one[0], many[0]) and one[1] == many[1]


def test_probabilities_of_a_context_add_up_to_one(spark, rows):
    training = [t for k, t, *_ in rows if not _held_out(k)]
    plain = Plain(training)
    context = max(plain.pairs, key=lambda c: len(plain.pairs[c]))
    key = next(k for k in range(10_000, 20_000) if _held_out(k))
    probes = [*plain.words, "unknown"]
    assert abs(sum(plain.probability(context, w) for w in probes) - 1) < 1e-9
    # The same by the operator: held-out texts of the context alone and of the context with a word differ by that word and the ends.
    texts = [(key, f"{context} {w}", None, None) for w in probes if w != "</end>"]
    scored = backoff.scores(spark.createDataFrame([*rows, *texts], SCHEMA), ~_held_column(), keep=("doc_id", "text")).where(f"doc_id = {key}").collect()
    ends = plain.probability(context, "</end>")
    first = plain.probability("<start>", context)
    total = ends + sum(10 ** r["score"] / first / plain.probability(r["text"].split()[1], "</end>") for r in scored)
    assert abs(total - 1) < 1e-8


def _held_column():
    from pyspark.sql import functions as F

    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2


def test_without_rows_or_training_rows(spark):
    assert backoff.score_texts(spark.createDataFrame([], SCHEMA)).count() == 0
    key = next(k for k in range(100) if _held_out(k))
    row, = backoff.score_texts(spark.createDataFrame([(key, "a b", None, None)], SCHEMA)).collect()
    assert tuple(row) == (key, True, 3, 0, 0, 0.0, 0.0)


def test_held_out_texts_are_likelier_than_by_the_base(spark, sf_dir):
    rows = [r for r in QUERIES["op12_katz_scores"](spark, sf_dir).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
