"""Token alignment and fill-in-the-middle against plain versions."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewright.llm import fill_in_middle as fim
from tablewright.llm import token_alignment as ta

SCHEMA = "doc_id bigint, text string, pair string, n int, frames string, _row string"
RNG = random.Random(5)
WORDS = ["the", "Theory", "naïve", "don't", "x", "  ", "日本語", "foo_bar", "3.14", "\n", "\tEnd", "Æon", "éé", "<s>", "<|endoftext|>", "a" * 40, "😀", "hello,world", " ", " nb"]
TEXTS = ["", None, " ", "one two", "one two", "a ▁ b", "<unk> </s> <0x41>", "x" * 3000, "tab\tand\r\nlines  with   spaces ", *[" ".join(RNG.choice(WORDS) for _ in range(RNG.randrange(1, 60))) for _ in range(60)]]
ROWS = [(k, t, "c", 1, "f", "r") for k, t in enumerate(TEXTS)] + [(3, "one two", "c", 1, None, None), (None, "the end", None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def tokenizers():
    pytest.importorskip("sentencepiece")
    return ta.pair_of(ta.TOKENIZERS, ta.FIRST, ta.SECOND)


def _plain_alignments(texts, pair):
    out = []
    for text in texts:
        a, b = (pair.a.encode(" " + (text or ""), add_special_tokens=False).ids, pair.b.encode(text or ""))
        raw = (" " + (text or "")).encode()
        if not text or b"".join(pair.bytes_a[x] for x in a) != raw or b"".join(pair.bytes_b[x] for x in b) != raw:
            out.append(None)
            continue
        spans = []
        for ids, of in ((a, pair.bytes_a), (b, pair.bytes_b)):
            at, found = 0, []
            for x in ids:
                found.append((at, at + len(of[x]), x))
                at += len(of[x])
            spans.append(found)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [[[x for s, e, x in side if low <= s and e <= high] for side in spans] for low, high in zip([0, *ends], ends)]
        links = [(x, y) for s, e, x in spans[0] for u, v, y in spans[1] if s < v and u < e]
        out.append((len(a), len(b), groups, links))
    return out


def test_alignment_equals_plain_version(docs, tokenizers):
    plain = _plain_alignments([r[1] for r in ROWS], tokenizers)
    counts = Counter(x for p in plain if p for x in p[3])
    highest = {}
    for (_, y), n in counts.items():
        highest[y] = max(highest.get(y, 0), n)
    expected = []
    for (key, *_), p in zip(ROWS, plain):
        if p is None:
            expected.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in p[2])
        expected.append((key, p[0], p[1], len(p[2]), len(p[3]), sum(counts[x] == highest[x[1]] for x in p[3]), sum(counts[x] for x in p[3]), hashlib.sha256(shown.encode()).hexdigest()))
    assert sum(p is None for p in plain) >= 3
    found = [tuple(r) for r in ta.align_tokenizers(docs).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_segments_are_encoded_as_whole_texts(spark, sf_dir, tokenizers):
    assert tokenizers.segmented
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect() if r.text]
    for text in texts:
        whole, parts = tokenizers.encoded([text]), tokenizers.encoded(ta._CUT.split(text))
        assert [[x for ids in side for x in ids] for side in parts] == [list(side[0]) for side in whole]


def test_alignment_in_pieces_and_with_little_memory(spark, docs, tokenizers, monkeypatch):
    texts = [r[1] for r in ROWS if r[1]]
    whole = ta.Aligner(tokenizers)
    expected = [whole.align([ta._CUT.split(t)])[0] for t in texts]
    monkeypatch.setattr(ta, "SEGMENTS", 3)
    monkeypatch.setattr(ta, "WINDOW_LINKS", 3)
    small = ta.Aligner(tokenizers)
    found = [small.align([ta._CUT.split(t)])[0] for t in texts]
    assert [x and x[:3] for x in found] == [x and x[:3] for x in expected]
    shown = {r["doc_id"]: r["groups"] for r in ta.aligned(docs.where("doc_id is not null"), groups=True).collect()}
    monkeypatch.setattr(ta, "PIECE_BYTES", 20)
    assert list(ta._pieces("aa bb " * 10, True)) != [ta._CUT.split("aa bb " * 10)]
    assert [s for p in ta._pieces("aa bb " * 10, True) for s in p] == ta._CUT.split("aa bb " * 10)
    assert shown[3] == ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in _plain_alignments(["one two"], tokenizers)[0][2])


def test_alignment_of_an_empty_table(spark, tokenizers):
    assert ta.align_tokenizers(spark.createDataFrame([], SCHEMA)).count() == 0


def _plain_cut(key, text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text or "")
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted(x % (n + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text or ""
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("frame_bytes", [1, 7, 64, 8192])
def test_fill_in_middle_equals_plain_version(spark, docs, frame_bytes):
    more = [(100 + k, t, "c", 1, None, None) for k, t in enumerate(["x<P>y", "<S", "<M>", "日" * 500 + "abc" * 400, "word " * 900])]
    rows = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    frames = fim.with_cuts(fim.framed(rows, keep=("doc_id", "text"), frame_bytes=frame_bytes))
    out = fim.output_texts(fim.filled(frames, keep=("doc_id", "text"))).collect()
    assert len(out) == len(ROWS) + len(more)
    forms = Counter()
    for r in out:
        n, form, prefix, middle, text = _plain_cut(r["doc_id"], r["text"])
        forms[form] += 1
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == (n, form, prefix, middle, text)
        assert r["output_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert set(forms) == {"plain", "psm", "spm"}


def test_frames_inflate_alone_and_only_cut_ones_are_read(spark):
    text = "word 日本 " * 4000
    frames, units, chars = fim.frames_of(memoryview(text.encode()), fim.zstandard.ZstdCompressor().compress, 1000)
    inflate = fim.zstandard.ZstdDecompressor().decompress
    assert b"".join(inflate(f["data"]) for f in frames).decode() == text and chars == len(text)
    read = []
    at, place, before = fim.place_of(frames, units // 2, lambda x: read.append(x) or inflate(x))
    assert len(read) == 1 and before == len("".join(re.findall("[A-Za-z]+|[^A-Za-z]", text)[:units // 2]))


def test_fill_in_middle_of_an_empty_table(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fill_in_middle_keeps_clashing_columns_apart(docs):
    assert fim.fill_in_middle(docs.withColumn("form", F.lit(1)).withColumn("output", F.lit("x"))).count() == len(ROWS)
