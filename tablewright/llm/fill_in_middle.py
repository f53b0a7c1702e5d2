"""Fill-in-the-middle over texts that are kept as seekable zstandard frames.

A text is stored as independent frames, each with the units and characters before it, so that a cut is found by inflating one frame, and digests are
taken over a stream of frames. A unit is a run of the letters A-Z and a-z, or any other single character. A frame may end inside a run; the run counts
in the frame in which it starts, and cuts fall on starts of units only.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.tables import stored

#: Bytes of text in a frame, and the level at which frames are deflated.
FRAME_BYTES, LEVEL = 8192, 3
#: What stands before each part of an output, and the order of the parts by form.
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
ORDERS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
#: Per cent of documents that are rearranged, and per cent of these that take the form spm.
REARRANGED, SUFFIX_FIRST = 90, 20

FRAMES = "frames array<struct<units_before bigint, chars_before bigint, units bigint, open boolean, data binary>>"
_FRAMES = pa.list_(pa.struct([("units_before", pa.int64()), ("chars_before", pa.int64()), ("units", pa.int64()), ("open", pa.bool_()), ("data", pa.binary())]))

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
#: Bytes with which a UTF-8 character starts.
_FIRST = (np.arange(256) & 0xC0) != 0x80


def unit_starts(raw: np.ndarray, inside_run: bool) -> np.ndarray:
    """Whether a unit starts at each byte; ``inside_run`` tells that a letter comes before the first byte."""
    letter = _LETTER[raw]
    before = np.empty_like(letter)
    before[:1] = inside_run
    before[1:] = letter[:-1]
    return _FIRST[raw] & ~(letter & before)


def frames_of(raw: memoryview, deflate, frame_bytes: int) -> tuple[list[dict], int, int]:
    """The frames of a UTF-8 text, its units and its characters."""
    out: list[dict] = []
    units = chars = at = 0
    inside = False
    while at < len(raw):
        end = min(at + frame_bytes, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:  # a character is never parted
            end += 1
        part = np.frombuffer(raw[at:end], np.uint8)
        held = int(np.count_nonzero(unit_starts(part, inside)))
        out.append({"units_before": units, "chars_before": chars, "units": held, "open": inside, "data": deflate(raw[at:end])})
        units, chars, inside, at = units + held, chars + int(np.count_nonzero(_FIRST[part])), bool(_LETTER[part[-1]]), end
    return out, units, chars


def framed(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """``keep`` columns, ``n`` units, ``n_text_chars``, ``has_marks`` (a mark stands in the text) and ``frames`` of every row; NULL counts as empty, without frames."""
    kept = docs.select(*keep)
    names = [*kept.schema.fieldNames()]
    ready = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"), *[F.col(c).alias(f"_keep{k}") for k, c in enumerate(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deflate = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for value in part.column(0):
                    raw = memoryview(value.as_buffer())
                    whole = value.as_py()
                    rows.append((*frames_of(raw, deflate, frame_bytes), any(m in whole for m in MARKS.values())))
                frames, units, chars, marked = zip(*rows)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(units, pa.int64()), pa.array(chars, pa.int64()), pa.array(marked, pa.bool_()), pa.array(frames, _FRAMES)],
                                                 names=[*[f"_keep{k}" for k in range(len(names))], "n", "n_text_chars", "has_marks", "frames"])

    kinds = ", ".join(f"_keep{k} {f.dataType.simpleString()}" for k, f in enumerate(kept.schema.fields))
    found = ready.mapInArrow(run, f"{kinds}{', ' if kinds else ''}n bigint, n_text_chars bigint, has_marks boolean, {FRAMES}")
    return found.select(*[F.col(f"_keep{k}").alias(c) for k, c in enumerate(names)], "n", "n_text_chars", "has_marks", "frames")


def drawn(key: Column, seed: int, k: int) -> Column:
    """The ``k``-th (from 1) eight hexadecimal digits of the SHA-256 of seed and decimal key, as a number; a NULL key has no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("bigint")


def with_cuts(frames: DataFrame, key: str = "doc_id", seed: int = 1) -> DataFrame:
    """``form`` and the units before the ends of prefix and middle (``first_cut``, ``last_cut``), by hashes of the key alone."""
    one, two = (drawn(F.col(key), seed, k) % (F.col("n") + 1) for k in (1, 2))
    plain = (F.col("n") == 0) | F.col("has_marks") | (drawn(F.col(key), seed, 3) % 100 >= REARRANGED)
    form = F.when(plain, "plain").when(drawn(F.col(key), seed, 4) % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    return frames.withColumns({"form": form, "first_cut": F.least(one, two), "last_cut": F.greatest(one, two)})


def place_of(frames: list[dict], unit: int, inflate) -> tuple[int, int, int]:
    """Frame, byte in it and characters before the start of a unit of the text, by inflating that frame; the end of the text has a frame of its own."""
    at = bisect_right(frames, unit, key=lambda f: f["units_before"]) - 1
    while at >= 0 and not frames[at]["units"]:  # a frame inside a long run starts no unit
        at -= 1
    if at < 0 or unit >= frames[at]["units_before"] + frames[at]["units"]:
        return len(frames), 0, -1
    raw = np.frombuffer(inflate(frames[at]["data"]), np.uint8)
    place = int(np.flatnonzero(unit_starts(raw, frames[at]["open"]))[unit - frames[at]["units_before"]])
    return at, place, frames[at]["chars_before"] + int(np.count_nonzero(_FIRST[raw[:place]]))


def _between(frames: list[dict], a: tuple, b: tuple, inflate, deflate) -> Iterator[bytes]:
    """Deflated frames of the text from place to place: whole frames as they are, cut ones anew."""
    for k in range(a[0], min(b[0] + 1, len(frames))):
        start, end = a[1] if k == a[0] else 0, b[1] if k == b[0] else None
        if start == 0 and end is None:
            yield frames[k]["data"]
        elif end is None or end > start:
            yield deflate(inflate(frames[k]["data"])[start:end])


def rearranged(frames: list[dict], form: str, first_cut: int, last_cut: int, inflate, deflate) -> tuple[list[bytes], int | None, int | None]:
    """The output as deflated frames, and where the middle starts and ends in characters (None at the end of the text)."""
    if form == "plain":
        return [f["data"] for f in frames], None, None
    a, b = (place_of(frames, cut, inflate) for cut in (first_cut, last_cut))
    end = (len(frames), 0, -1)
    parts = {"prefix": ((0, 0, 0), a), "middle": (a, b), "suffix": (b, end)}
    out: list[bytes] = []
    for name in ORDERS[form]:
        out += [deflate(MARKS[name]), *_between(frames, *parts[name], inflate, deflate)]
    return out, a[2], b[2]


def restored(output: list[bytes], form: str, inflate) -> Iterator[bytes]:
    """The text of an output, piece by piece: marks are looked for in the stream, then the parts are read in the order of the text."""
    if form == "plain":
        yield from map(inflate, output)
        return
    order, found, starts, at, tail = ORDERS[form], [], [], 0, b""
    for data in output:
        starts.append(at)
        raw = inflate(data)
        window = tail + raw
        spot = 0
        while len(found) < 3 and (spot := window.find(MARKS[order[len(found)]], spot)) >= 0:
            found.append(at - len(tail) + spot)
            spot += 3
        at += len(raw)
        tail = window[-2:]
    bounds = {name: (found[k] + 3, found[k + 1] if k < 2 else at) for k, name in enumerate(order)}
    for name in ("prefix", "middle", "suffix"):
        low, high = bounds[name]
        k = max(bisect_right(starts, low) - 1, 0)
        while k < len(output) and starts[k] < high:
            raw = inflate(output[k])
            yield raw[max(low - starts[k], 0):high - starts[k]]
            k += 1


def _sha(parts: Iterable[bytes]) -> str:
    digest = hashlib.sha256()
    for part in parts:
        digest.update(part)
    return digest.hexdigest()


def filled(frames: DataFrame, keep: tuple[str, ...] = ("doc_id",), outputs: bool = True) -> DataFrame:
    """``keep``, ``n``, ``form``, ``prefix_chars``, ``middle_chars`` (NULL if plain), ``output`` (zstandard frames, if wanted) and SHA-256 of output and of the text restored from it.

    ``frames`` comes from ``framed`` and ``with_cuts``. No text is held whole: cuts inflate their own frames, digests one frame after the other.
    """
    kept = frames.select(*keep)
    names = [f"_keep{k}" for k in range(len(kept.columns))]
    ready = frames.select("frames", "n", "n_text_chars", "form", "first_cut", "last_cut", *[F.col(c).alias(name) for c, name in zip(kept.columns, names)])
    extra = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string()), *([("output", pa.list_(pa.binary()))] if outputs else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deflate, inflate = zstandard.ZstdCompressor(level=LEVEL).compress, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for held, n, chars, form, first, last in zip(*[c.to_pylist() for c in part.columns[:6]]):
                    output, a, b = rearranged(held, form, first, last, inflate, deflate)
                    a, b = (chars if x == -1 else x for x in (a, b))
                    row = (n, form, a, None if b is None else b - a, _sha(map(inflate, output)), _sha(restored(output, form, inflate)))
                    rows.append((*row, output) if outputs else row)
                columns = zip(*rows)
                yield pa.RecordBatch.from_arrays([*part.columns[6:], *[pa.array(c, kind) for c, (_, kind) in zip(columns, extra)]], names=[*names, *[name for name, _ in extra]])

    kinds = ", ".join([f"{name} {f.dataType.simpleString()}" for name, f in zip(names, kept.schema.fields)]
                      + ["n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string" + (", output array<binary>" if outputs else "")])
    out = ready.mapInArrow(run, kinds)
    return out.select(*[F.col(name).alias(c) for c, name in zip(kept.columns, names)], *[name for name, _ in extra])


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 1, outputs: bool = False) -> DataFrame:
    """Every text cut in three at hashed units and rearranged, one row per row of ``docs``; see ``filled``.

    NULL and empty texts are plain and have the digest of nothing; equal rows give equal rows; an empty table gives none. Columns of ``docs`` other
    than key and text are not looked at. A NULL key hashes as an empty one.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return filled(with_cuts(stored(framed(rows), "frames"), "doc_id", seed), ("doc_id",), outputs).withColumnRenamed("doc_id", key)


def output_texts(filled_rows: DataFrame, output: str = "output") -> DataFrame:
    """``filled_rows`` with the outputs as strings instead of frames."""
    names = [c for c in filled_rows.columns if c != output]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inflate = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts = [b"".join(map(inflate, x)).decode() for x in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.large_string()).cast(pa.string())], names=[*names, output])

    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in filled_rows.schema.fields if f.name != output] + [f"`{output}` string"])
    return filled_rows.select(*names, output).mapInArrow(run, kinds)
