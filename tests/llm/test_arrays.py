"""Words, suffix arrays and embeddings, against plain versions."""

import io
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import suffixes
from tablewright.llm.decontamination import candidates, least_edits, plans_for
from tablewright.llm.warc import BLOCK_BYTES, _member, records_between
from tablewright.llm.words import shingles, text_slices, word_hashes

TEXTS = ["", None, "  a b\tc ", "é ü a b c d e f", "x" * 50 + "\n\x0by", "  kept together", "one"]


def test_words_and_slices():
    plain = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]
    seen = []
    for first, last, data, offsets in text_slices(pa.array(TEXTS), limit=10):
        hashes, at, starts, ends = word_hashes(data, offsets, lower=False)
        raw = data.tobytes()
        for row in range(last - first):
            seen.append([raw[a:b].decode() for a, b in zip(starts[at[row]:at[row + 1]], ends[at[row]:at[row + 1]])])
    assert seen == plain


def test_shingles_are_equal_where_words_are():
    texts = ["a b c d e f", "A B C D E F", "b c d e f", "a b c", "a b c d", ""]
    (_, _, data, offsets), = text_slices(pa.array(texts))
    hashes, first, _, _ = word_hashes(data, offsets)
    found, at = shingles(hashes, first)
    sets = [set(found[a:b].tolist()) for a, b in zip(at[:-1], at[1:])]
    assert [len(s) for s in sets] == [2, 2, 1, 1, 1, 0]
    assert sets[0] == sets[1] and sets[2] < sets[0] and not sets[3] & sets[4]


def _plain_suffixes(text, most):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    shared = [0]
    for a, b in zip(order, order[1:]):
        n = 0
        while n < most and max(a, b) + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        shared.append(n)
    return order, shared


@pytest.mark.parametrize("memory", [64 << 20, 2000])
def test_suffix_arrays(monkeypatch, memory):
    monkeypatch.setattr(suffixes, "MEMORY_BYTES", memory)
    monkeypatch.setattr(suffixes, "BLOCK", 1 << 20 if memory > 2000 else 64)
    monkeypatch.setattr(suffixes.Queue.__init__, "__defaults__", (memory,))
    for seed in range(40):
        rng = random.Random(seed)
        text = bytes(rng.randrange(97, 97 + rng.choice([1, 2, 26])) for _ in range(rng.randrange(1, 150)))
        text = text * rng.choice([1, 3]) + b"z" * rng.choice([0, 120])
        order, shared = suffixes.suffix_order(np.frombuffer(text, np.uint8), 50)
        plain, common = _plain_suffixes(text, 50)
        assert order.tolist() == plain and shared.tolist()[1:] == common[1:]


def test_least_edits():
    item, rows = np.array([1, 2, 3, 4]), np.array([[9, 1, 2, 3, 4, 9], [1, 2, 9, 4, 0, 0], [1, 3, 4, 0, 0, 0], [7, 7, 7, 7, 7, 7]])
    assert least_edits(item, rows).tolist() == [0, 1, 1, 4]


def test_windows_are_found_with_the_target_recall():
    rng = random.Random(4)
    word = lambda: rng.getrandbits(64)
    items = [np.array([word() for _ in range(rng.randrange(12, 60))], np.uint64) for _ in range(60)]
    plans, hits, tries = plans_for(items), 0, 0
    for number, item in enumerate(items):
        for edits in (0, len(item) // 10):
            changed = item.tolist()
            for _ in range(edits):
                changed[rng.randrange(len(changed))] = word()
            text = np.array([word() for _ in range(80)] + changed + [word() for _ in range(80)], np.uint64)
            starts, numbers = candidates(text, plans)
            found = bool(((numbers == number) & (abs(starts - 80) <= edits)).any())
            assert found or edits
            hits, tries = hits + found, tries + 1
    assert hits >= 0.9 * tries


def test_each_length_class_has_the_target_recall():
    rng = random.Random(6)
    words = lambda n: [rng.getrandbits(64) for _ in range(n)]
    items = [np.array(words(rng.randrange(*span)), np.uint64) for span, n in (((5, 10), 400), ((40, 90), 50), ((130, 200), 50)) for _ in range(n)]
    plans = plans_for(items)
    for low, high in ((40, 90), (130, 200)):
        hits = []
        for number, item in enumerate(items):
            if low <= len(item) < high:
                for _ in range(4):
                    changed, limit = item.tolist(), len(item) // 10
                    for at in rng.sample(range(len(item)), limit):
                        changed[at] = rng.getrandbits(64)
                    starts, numbers = candidates(np.array(words(80) + changed + words(80), np.uint64), plans)
                    hits.append(bool(((numbers == number) & (abs(starts - 80) <= limit)).any()))
        assert sum(hits) >= 0.93 * len(hits)


def test_unchanged_items_are_always_found():
    rng = random.Random(7)
    items = [np.array([rng.getrandbits(64) for _ in range(n)], np.uint64) for n in [*[3] * 1500, *range(4, 40)]]
    plans = plans_for(items)
    text = np.concatenate([*items, np.array([1] * 50, np.uint64)])
    at = np.cumsum([0, *map(len, items)])[:-1]
    found = set(zip(*(a.tolist() for a in candidates(text, plans))))
    assert found >= set(zip(at.tolist(), range(len(items))))


def test_headers_that_cross_a_block_may_be_long():
    rng = random.Random(1)
    first = _member("response", "urn:page:1", None, "u", "", rng.randbytes(BLOCK_BYTES - 150_000))
    second = _member("response", "urn:page:2", None, rng.randbytes(200_000).hex(), "", b"text")
    assert len(first) < BLOCK_BYTES - 100_000 and len(first) + 150_000 > BLOCK_BYTES
    data = first + second
    assert [h["warc-record-id"] for h, _ in records_between(io.BytesIO(data), len(data), 0, len(data))] == ["<urn:page:1>", "<urn:page:2>"]
