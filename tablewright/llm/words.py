"""Words and shingles of many texts at once, as arrays inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are worked on together; a longer text is worked on alone.
SLICE_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, last row + 1, bytes and row offsets of slices of a string column; NULL counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, len(column))
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words, the first word of each row (and the end), and the byte starts and ends of the words."""
    data = _LOWER[data] if lower else data
    space = _SPACE[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = space[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(~space & edge[:-1])
    edge[:-1] = space
    edge[offsets] = True
    ends = np.flatnonzero(~space & edge[1:]) + 1
    lengths = ends - starts
    kept = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(kept), pa.py_buffer(np.ascontiguousarray(data[~space]))]).dictionary_encode()
    distinct = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in found.dictionary.to_pylist()), np.uint64, len(found.dictionary))
    return distinct[found.indices.to_numpy()] if len(starts) else np.zeros(0, np.uint64), np.searchsorted(starts, offsets), starts, ends


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words and their row offsets; a shorter row has one window, an empty one none."""
    counts = np.diff(first)
    windows = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(windows)])
    rows = np.repeat(np.arange(len(counts)), windows)
    at = np.arange(offsets[-1]) - offsets[rows] + first[rows]
    length = np.minimum(counts, width)[rows]
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    out = length.astype(np.uint64)
    for k in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + np.where(length > k, padded[at + k], np.uint64(0)))
    return out, offsets
