"""Alignment of the tokens that two tokenizers make of the same text.

Texts are tokenised whole by both. Where a token of each ends at the same byte and the next ones begin with a space, the document is cut in windows of
token ids; what a window's groups and links are depends on its ids alone and is remembered by them. Pairs of ids are counted over all documents.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.tables import stored
from tablewright.runtime import attach_lookup

TOKENIZERS = "/opt/tokenizers"
FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: What a task remembers before it starts anew: segments of text with their windows, and links of windows. With texts of ``PIECE_BYTES`` at a time
#: a worker stays below 400 MB.
SEGMENTS, WINDOW_LINKS, PIECE_BYTES = 300_000, 1_500_000, 1 << 20
#: Pairs of ids that may be broadcast with their counts; there are at most as many as entries of one vocabulary times those of the other.
PAIR_ROWS = 2_000_000

#: Neither tokenizer has a token across a space that follows a character other than white space; texts are encoded in the segments between these.
#: A space that ends the text stays with its segment.
_CUT = re.compile(r"(?<=\S) (?!\Z)")


class Pair:
    """Both tokenizers of a folder: ids of texts, and bytes of ids."""

    def __init__(self, folder: str, first: str, second: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(f"{folder}/{first}")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{second}")
        # Byte-level entries write the printable characters of Latin-1 as themselves, the other bytes as characters from 256 on, in order.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(sorted(set(range(256)) - set(shown)))}
        size = self.a.get_vocab_size(with_added_tokens=True)
        tokens = [self.a.id_to_token(i) or "" for i in range(size)]
        self.bytes_a = [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in tokens]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.segmented = not any(re.search("[^▁]▁", p) for p in pieces)

    def encoded(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of a space and each text by the first, and of each text by the second, which adds the space."""
        return [x.ids for x in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], self.b.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def pair_of(folder: str, first: str, second: str) -> Pair:
    return Pair(folder, first, second)


def window_alignments(a: np.ndarray, len_a: np.ndarray, b: np.ndarray, len_b: np.ndarray, windows: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of windows of ids, one after the other: their groups as text and how many they are, and all pairs of tokens whose bytes overlap, with where each window's end.

    ``len_a``, ``len_b`` are bytes of the tokens; ``windows`` is the number of tokens of each window on either side (two rows).
    """
    ends_a, ends_b = np.cumsum(len_a), np.cumsum(len_b)
    # Two tokens overlap up to the nearer of their ends, and no other two do so up to there.
    ends = np.union1d(ends_a, ends_b)
    first, second = a[np.searchsorted(ends_a, ends)], b[np.searchsorted(ends_b, ends)]
    last_a, last_b = np.cumsum(windows[0]) - 1, np.cumsum(windows[1]) - 1
    closed = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
    groups = np.diff(np.concatenate([[0], np.cumsum(closed[0])[last_a]]))
    # In the order of the text: the tokens of a group by the first, then by the second; what follows a token tells which comes next.
    group_a, group_b = (np.concatenate([[0], np.cumsum(c)[:-1]]) for c in closed)
    place = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    after = np.concatenate([np.where(closed[0], "|", ","), np.where(closed[1], ";", ",")])
    after[len(a) + last_b] = "\n"
    shown = "".join([f"{x}{y}" for x, y in zip(np.concatenate([a, b])[place].tolist(), after[place].tolist())])
    return shown.encode().split(b"\n")[:-1], groups, first, second, np.searchsorted(ends, ends_a[last_a], "right")


class Ragged:
    """Rows of numbers of different lengths, one after the other."""

    def __init__(self, kind: str) -> None:
        self.values, self.ends = array(kind), array("q", [0])

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        """Further rows, one after the other."""
        self.ends.frombytes((len(self.values) + np.cumsum(lengths)).astype(np.int64).tobytes())
        self.values.frombytes(values.astype(self.values.typecode).tobytes())

    def rows(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The wanted rows joined, and the length of each."""
        ends, values = np.frombuffer(self.ends, np.int64), np.frombuffer(self.values, self.values.typecode)
        start, length = ends[wanted], ends[wanted + 1] - ends[wanted]
        at = np.arange(length.sum()) + np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
        return values[at], length


class Aligner:
    """Aligns lists of segments; remembers segments' ids and windows' alignments up to a bound."""

    def __init__(self, pair: Pair) -> None:
        self.pair = pair
        self.bytes = pair.bytes_a, pair.bytes_b
        self.lengths = tuple(np.array([len(x) for x in t]) for t in self.bytes)
        self.spaced = tuple(np.array([x[:1] == b" " for x in t]) for t in self.bytes)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.right, self.counts, self.of_segment = array("b"), (array("q"), array("q")), Ragged("q")
        self.windows: dict[tuple[bytes, bytes], int] = {}
        self.texts: list[bytes] = []
        self.groups, self.links = array("q"), Ragged("q")

    def learn(self, segments: list[str]) -> None:
        """Encodes segments that are new, compares the bytes of both encodings with the text, and cuts the tokens in windows."""
        raws, right = [b" " + s.encode() for s in segments], np.ones(len(segments), bool)
        sides, sizes = [], []
        for k, rows in enumerate(self.pair.encoded(segments)):
            flat, of = list(chain.from_iterable(rows)), self.bytes[k]
            if b"".join([of[x] for x in flat]) != b"".join(raws):
                right &= [b"".join([of[x] for x in row]) == raw for row, raw in zip(rows, raws)]
            sides.append(np.array(flat, np.int32))
            sizes.append(np.fromiter(map(len, rows), np.int64, len(rows)))
        sides, sizes = [x[np.repeat(right, n)] for x, n in zip(sides, sizes)], [n * right for n in sizes]
        ends = [np.cumsum(length[x]) for length, x in zip(self.lengths, sides)]
        starts = [e - length[x] for e, length, x in zip(ends, self.lengths, sides)]
        # Where a token of each starts, one of each has ended; a segment starts with a space in both.
        anchors = np.intersect1d(*[s[spaced[x]] for s, spaced, x in zip(starts, self.spaced, sides)], assume_unique=True)
        cut = [np.append(np.searchsorted(s, anchors), len(s)) for s in starts]
        a, b = (x.tobytes() for x in sides)
        (i, k), found, new = [(4 * c).tolist() for c in cut], [], []
        for n in range(len(anchors)):
            key = a[i[n]:i[n + 1]], b[k[n]:k[n + 1]]  # the ids as they lie in memory
            number = self.windows.get(key)
            if number is None:
                number = self.windows[key] = len(self.windows)
                new.append(n)
            found.append(number)
        if new:
            held, tokens = [], np.array([np.diff(c) for c in cut])
            for x, n in zip(sides, tokens):
                rows = Ragged("i")
                rows.add(x, n)
                held.append(rows.rows(np.array(new))[0])
            texts, groups, first, second, last = window_alignments(held[0], self.lengths[0][held[0]], held[1], self.lengths[1][held[1]], tokens[:, new])
            self.texts += texts
            self.groups.frombytes(groups.astype(np.int64).tobytes())
            self.links.add(first.astype(np.int64) * len(self.lengths[1]) + second, np.diff(last, prepend=0))
        self.of_segment.add(np.array(found, np.int64), np.diff(np.searchsorted(cut[0][:-1], np.concatenate([[0], np.cumsum(sizes[0])]))))
        self.right.frombytes(right.tobytes())
        for counts, n in zip(self.counts, sizes):
            counts.frombytes(n.astype(np.int64).tobytes())
        self.known.update(zip(segments, range(len(self.known), len(self.known) + len(segments))))

    def align(self, pieces: list[list[str]]) -> list[tuple | None]:
        """For each list of segments ``n_a, n_b, n_groups, windows``, or None where the tokens' bytes are not the text's."""
        if len(self.known) > SEGMENTS or len(self.links.values) > WINDOW_LINKS:
            self.forget()
        known = self.known
        new = list(dict.fromkeys(s for p in pieces for s in p if s not in known))
        if new:
            self.learn(new)
        numbers = np.fromiter((known[s] for p in pieces for s in p), np.int64)
        edges = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        windows, per_segment = self.of_segment.rows(numbers)
        upto = lambda values: np.concatenate([[0], np.cumsum(values)])
        wrong = upto(np.frombuffer(self.right, np.int8)[numbers] == 0)[edges]
        n_a, n_b = (np.diff(upto(np.frombuffer(c, np.int64)[numbers])[edges]).tolist() for c in self.counts)
        bounds = upto(per_segment)[edges]
        groups = np.diff(upto(np.frombuffer(self.groups, np.int64)[windows])[bounds]).tolist()
        return [None if wrong[p + 1] > wrong[p] else (n_a[p], n_b[p], groups[p], windows[bounds[p]:bounds[p + 1]]) for p in range(len(pieces))]

    def pairs(self, windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For lists of windows: pairs of ids (first id x size of the second vocabulary + second id) with their counts, distinct in each list, and where each list ends."""
        owner = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
        values, length = self.links.rows(np.concatenate([*windows, np.zeros(0, np.int64)]))
        span = len(self.lengths[0]) * len(self.lengths[1])
        keys, counts = np.unique(np.repeat(owner, length) * span + values, return_counts=True)
        return keys % span, counts, np.searchsorted(keys, np.arange(1, len(windows) + 1) * span)


def _pieces(text: str | None, cut: bool) -> Iterator[list[str]]:
    """The segments of a text, in lists of bounded size."""
    if not text:
        return
    segments = _CUT.split(text) if cut else [text]
    if len(text) <= PIECE_BYTES:
        yield segments
        return
    held, size = [], 0
    for s in segments:
        if held and size + len(s) > PIECE_BYTES:
            yield held
            held, size = [], 0
        held.append(s)
        size += len(s)
    yield held


def aligned(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), folder: str = TOKENIZERS, first: str = FIRST, second: str = SECOND, groups: bool = False) -> DataFrame:
    """``keep``, ``n_a``, ``n_b``, ``n_groups``, ``groups_sha256``, ``links`` (pairs of ids and how often they overlap; a pair may come twice for a text of over
    ``PIECE_BYTES``), and, if wanted, the groups as text: ``a1,a2|b1;a3|b2,b3``.

    A text that is NULL or empty, or whose tokens' bytes are not its own, has no tokens.
    """
    kept = docs.select(*keep)
    names = [f"_keep{k}" for k in range(len(kept.columns))]
    ready = docs.select(F.col(text).alias("_text"), *[F.col(c).alias(name) for c, name in zip(kept.columns, names)])
    link = pa.struct([("pair", pa.int64()), ("n", pa.int64())])
    extra = ["n_a", "n_b", "n_groups", "groups_sha256", "links", *(["groups"] if groups else [])]

    def results(aligner: Aligner, texts: list[str | None]) -> list[pa.Array]:
        owner, pieces = [], []
        for row, value in enumerate(texts):
            for piece in _pieces(value, aligner.pair.segmented):
                owner.append(row)
                pieces.append(piece)
        totals, digests, wrong = np.zeros((3, len(texts)), np.int64), {}, set()
        shown: dict[int, list[bytes]] = {}
        lists: list[tuple[int, np.ndarray, np.ndarray]] = []
        at = 0
        while at < len(pieces):
            size, end = 0, at
            while end < len(pieces) and (end == at or size + sum(map(len, pieces[end])) <= PIECE_BYTES):
                size += sum(map(len, pieces[end]))
                end += 1
            held, owners = [], []
            for row, found in zip(owner[at:end], aligner.align(pieces[at:end])):
                if found is None:
                    wrong.add(row)
                    continue
                totals[:, row] += found[:3]
                digest = digests.get(row)
                if digest is None:
                    digest = digests[row] = hashlib.sha256()
                else:
                    digest.update(b";")
                part = b";".join([aligner.texts[w] for w in found[3].tolist()])
                digest.update(part)
                if groups:
                    shown.setdefault(row, []).append(part)
                held.append(found[3])
                owners.append(row)
            pairs, counts, ends = aligner.pairs(held)
            lists += [(row, pairs[a:b], counts[a:b]) for row, a, b in zip(owners, [0, *ends[:-1].tolist()], ends.tolist())]
            at = end
        for row in wrong:
            totals[:, row] = 0
            digests.pop(row, None)
            shown.pop(row, None)
        lists = [x for x in lists if x[0] not in wrong]
        size = np.bincount([x[0] for x in lists], weights=[len(x[1]) for x in lists], minlength=len(texts)) if lists else np.zeros(len(texts))
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(np.concatenate([x[k] for x in lists] or [np.zeros(0, np.int64)]), pa.int64()) for k in (1, 2)], fields=list(link))
        columns = [*[pa.array(t) for t in totals], pa.array([digests[r].hexdigest() if r in digests else "" for r in range(len(texts))]), pa.ListArray.from_arrays(pa.array(offsets), values)]
        return columns + ([pa.array([b";".join(shown.get(r, [])).decode() for r in range(len(texts))])] if groups else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(pair_of(folder, first, second))
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *results(aligner, part.column(0).to_pylist())], names=[*names, *extra])

    kinds = ", ".join([f"{name} {f.dataType.simpleString()}" for name, f in zip(names, kept.schema.fields)]
                      + ["n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links array<struct<pair bigint, n bigint>>" + (", groups string" if groups else "")])
    out = ready.mapInArrow(run, kinds)
    return out.select(*[F.col(name).alias(c) for c, name in zip(kept.columns, names)], *extra)


def pair_counts(links: DataFrame, second_size: int) -> DataFrame:
    """``pair, total, rows, best`` of rows ``pair, n``: all links of the pair, rows that hold it, and whether no pair of its second id has more links."""
    totals = stored(links.groupBy("pair").agg(F.sum("n").alias("total"), F.count("*").alias("rows")), "pair-counts")
    # One row per entry of the second vocabulary at most.
    highest = totals.groupBy((F.col("pair") % second_size).alias("_second")).agg(F.max("total").alias("_highest"))
    return totals.join(F.broadcast(highest), F.col("pair") % second_size == F.col("_second")).select("pair", "total", "rows", (F.col("total") == F.col("_highest")).alias("best"))


def align_tokenizers(docs: DataFrame, text: str = "text", key: str = "doc_id", folder: str = TOKENIZERS, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """One row per row of ``docs``: ``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A link is a pair of overlapping tokens; its count is how many links of all documents have its two ids. ``n_best`` are the links whose count is the highest of
    their second id, ties included, ``count_sum`` is the sum of the counts. Rows without tokens (see ``aligned``) have zeros and an empty digest; equal rows count
    each for itself; an empty table gives no rows. Other columns are not looked at.
    """
    rows = aligned(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), folder=folder, first=first, second=second)
    held = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "alignments")
    links = held.select("_row", F.inline("links"))
    counts = stored(pair_counts(links, pair_of(folder, first, second).b.get_piece_size()), "pair-ranks")
    total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    scored = attach_lookup(links, counts, ["pair"], total, "rows", PAIR_ROWS)
    sums = scored.groupBy("_row").agg(F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("total")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return held.join(sums, "_row", "left").select(F.col("doc_id").alias(key), "n_a", "n_b", "n_groups", zero("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
