"""External induced suffix sorting with common-prefix lengths, for one shard of text inside a task."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes up to which an array or a queue stays in memory; tuples that are sorted at once.
MEMORY_BYTES, BLOCK = 64 << 20, 1 << 16
#: Packed columns of a tuple's tail.
COLUMNS = 2


def array(length: int, kind: type) -> np.ndarray:
    """An array in memory, or one in a nameless file of this task if it is large; such files vanish with the task."""
    if length * np.dtype(kind).itemsize <= MEMORY_BYTES:
        return np.empty(length, kind)
    return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(length,))


def _places(length: int) -> type:
    """The type of places in ``length`` symbols, with room for sums of a place and a number of shared bytes."""
    return np.int32 if length < 1 << 30 else np.int64


class Queue:
    """A priority queue of tuples that spills sorted runs and gives all tuples back, smallest first, in blocks.

    A tuple is one value of each pushed column; columns compare from first to last, but for the last, which is carried along.
    """

    def __init__(self, memory: int = MEMORY_BYTES):
        self.memory, self.held, self.bytes, self.runs = memory, [], 0, []

    def push(self, columns: list[np.ndarray]) -> None:
        self.held.append([np.ascontiguousarray(c) for c in columns])
        self.bytes += sum(c.nbytes for c in columns)
        if self.bytes > self.memory:
            run = self._sorted()
            on_disk = [array_on_disk(c) for c in run]
            self.runs.append(on_disk)

    def _sorted(self) -> list[np.ndarray]:
        # One column at a time, so that a second copy of all is never held.
        columns = []
        for c in range(len(self.held[0])):
            columns.append(np.concatenate([part[c] for part in self.held]))
            for part in self.held:
                part[c] = None
        self.held, self.bytes = [], 0
        order = np.lexsort(columns[-2::-1])
        for c in range(len(columns)):
            columns[c] = columns[c][order]
        return columns

    def blocks(self) -> Iterator[list[np.ndarray]]:
        if self.held:
            self.runs.append(self._sorted())
        if not self.runs:
            return
        if len(self.runs) == 1:
            run = self.runs[0]
            for a in range(0, len(run[0]), BLOCK):
                yield [np.array(c[a:a + BLOCK]) for c in run]
            return
        at, step = [0] * len(self.runs), max(64, BLOCK // len(self.runs))
        waiting: list[np.ndarray] | None = None
        load = list(range(len(self.runs)))
        while load or (waiting is not None and len(waiting[0])):
            parts = [waiting] if waiting is not None else []
            for r in load:
                run, a = self.runs[r], at[r]
                if a >= len(run[0]):
                    continue
                b = at[r] = min(len(run[0]), a + step)
                # The last column says of which run this is the last tuple read, if more are to come.
                ends = np.full(b - a, -1, np.int64)
                if b < len(run[0]):
                    ends[-1] = r
                parts.append([*(np.array(c[a:b]) for c in run), ends])
            if not parts:
                return
            columns = [np.concatenate(c) for c in zip(*parts)]
            order = np.lexsort(columns[-3::-1])
            columns = [c[order] for c in columns]
            stops = np.flatnonzero(columns[-1] >= 0)
            cut = int(stops[0]) + 1 if len(stops) else len(order)
            load = [int(columns[-1][cut - 1])] if len(stops) else []
            waiting = [c[cut:] for c in columns]
            yield [c[:cut] for c in columns[:-1]]


def array_on_disk(values: np.ndarray) -> np.ndarray:
    out = np.memmap(tempfile.TemporaryFile(), values.dtype, "w+", shape=values.shape)
    out[:] = values
    return out


def _left_most(text: np.ndarray) -> np.ndarray:
    """Positions whose suffix is smaller than the next one's while the one before is not; the end is one."""
    length = len(text)
    marks, rising, after = array(length, bool), True, None
    for b in range(length, 0, -BLOCK):
        a = max(0, b - BLOCK)
        piece = np.array(text[a:b])
        following = np.append(piece[1:], piece[-1:] if after is None else after)
        sign = np.sign(following.astype(np.int64) - piece.astype(np.int64))
        if b == length:
            sign[-1] = 1
        # Equal neighbours are of the type of the first unequal one to the right.
        known = np.minimum.accumulate(np.where(sign != 0, np.arange(len(sign)), len(sign))[::-1])[::-1]
        marks[a:b] = np.where(known < len(sign), sign[np.minimum(known, len(sign) - 1)] > 0, rising)
        rising, after = bool(marks[a]), piece[0]
    found = [np.flatnonzero(np.array(marks[max(a, 1):a + BLOCK]) & ~np.array(marks[max(a, 1) - 1:min(length, a + BLOCK) - 1])) + max(a, 1) for a in range(0, length, BLOCK)]
    out = array(sum(map(len, found)), np.int64)
    np.concatenate(found, out=out)
    return out


class _Tails:
    """Tails of suffixes, up to and with the next left-most position, as packed columns.

    A complete tail ends in a symbol above all others: of two texts that agree up to the end of the shorter tail, the one
    whose tail ends there is the larger. Tails too long for the columns get a number in their order instead.
    """

    def __init__(self, text: np.ndarray, stops: np.ndarray, top: int):
        self.text, self.stops, self.infinite = text, stops, top + 1
        self.bits = max(1, int(self.infinite).bit_length())
        self.each = 64 // self.bits
        self.room = self.each * COLUMNS
        # The number of the next stop behind each position.
        self.next_stop = array(len(text), np.int32)
        bounds = np.concatenate([[0], stops, [len(text)]])
        for a in range(0, len(bounds) - 1, BLOCK):
            part = bounds[a:a + BLOCK + 1]
            self.next_stop[part[0]:part[-1]] = np.repeat(np.arange(a, a + len(part) - 1, dtype=np.int32), np.diff(part))

    def ends(self, at: np.ndarray) -> np.ndarray:
        return self.next_stop[at]

    def packed(self, at: np.ndarray, end: np.ndarray, skip: int = 0) -> list[np.ndarray]:
        last, out = len(self.text) - 1, []
        left = end - at - skip  # symbols of the tail from here on, less one
        for c in range(COLUMNS):
            column = np.zeros(len(at), np.uint64)
            live = np.flatnonzero(left >= c * self.each - 1)
            for k in range(c * self.each, (c + 1) * self.each):
                live = live[left[live] >= k - 1]
                symbol = self.text[np.minimum(at[live] + (skip + k), last)].astype(np.uint64)
                symbol[left[live] == k - 1] = self.infinite
                column[live] |= symbol << np.uint64(self.bits * ((c + 1) * self.each - 1 - k))
            out.append(column)
        return out

    def long_order(self, at: np.ndarray, end: np.ndarray, rank: np.ndarray | None) -> np.ndarray:
        """Dense numbers of long tails in their order; equal ones share a number, unless ``rank`` parts them."""
        group, skip = np.zeros(len(at), np.int64), 0
        while True:
            columns = [group, *self.packed(at, end, skip)]
            done = bool((at + skip + self.room > end + 1).all())
            if done and rank is not None:
                columns.append(rank)
            order = np.lexsort(columns[::-1])
            fresh = np.zeros(len(at), bool)
            for c in columns:
                fresh[1:] |= c[order][1:] != c[order][:-1]
            group[order] = np.cumsum(fresh)
            if done:
                return group
            skip += self.room


def _blocks(length: int) -> Iterator[np.ndarray]:
    for a in range(0, length, BLOCK):
        yield np.arange(a, min(length, a + BLOCK))


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of ``values[low + 1 : high + 1]`` for each pair, from tables of powers of two."""
    out, length = np.empty(len(low), values.dtype), high - low
    power, table = 0, np.array(values)
    while len(length) and length.max() >= 1 << power:
        now = np.flatnonzero((length >= 1 << power) & (length < 2 << power))
        out[now] = np.minimum(table[low[now] + 1], table[high[now] + 1 - (1 << power)])
        step = 1 << power
        table[:-step] = np.minimum(table[:-step], table[step:]) if step < len(table) else table[:-step]
        power += 1
    return out


def _shared(base: np.ndarray, left: np.ndarray, right: np.ndarray, most: int) -> np.ndarray:
    """Equal bytes from two positions on, at most ``most``; ``base`` is padded by eight bytes."""
    words = np.ndarray((len(base) - 7,), ">u8", base, strides=(1,))
    out, live, last = np.zeros(len(left), np.int64), np.arange(len(left)), len(words) - 1
    for k in range(0, most, 8):
        x = words[np.minimum(left[live] + k, last)].astype(np.uint64) ^ words[np.minimum(right[live] + k, last)].astype(np.uint64)
        differ = np.flatnonzero(x)
        same = np.zeros(len(differ), np.int64)
        for shift in range(56, 0, -8):
            same += (x[differ] >> np.uint64(shift)) == 0
        out[live[differ]] = k + same
        live = live[x == 0]
        if not len(live):
            break
    out[live] = most
    return np.minimum(out, most)


def _sort(text: np.ndarray, top: int, starts: np.ndarray, base: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``text`` in the order of their suffixes, and how many bytes of ``base`` each shares with the one before.

    ``text`` ends in a symbol below all others; ``starts`` says where each symbol begins in ``base``; shared bytes count up to ``most``.
    """
    stops = _left_most(text)
    tails = _Tails(text, stops, top)
    inner = stops[:-1]  # the end itself is the smallest suffix
    kind = _places(len(base))
    names, order, common = array(len(stops), kind), array(len(stops), kind), array(len(stops), np.uint16)

    # Names of the pieces between left-most positions.
    queue = Queue()
    lengths_end = np.arange(1, len(stops))
    long = np.flatnonzero(stops[1:] - inner + 2 > tails.room)
    long_name = np.zeros(len(inner), np.int64)
    if len(long):
        long_name[long] = tails.long_order(inner[long], stops[long + 1], None)
    for at in _blocks(len(inner)):
        queue.push([*tails.packed(inner[at], stops[lengths_end[at]]), long_name[at], at.astype(kind)])
    names[len(stops) - 1] = 0
    name, before = 0, None
    for *key, at in queue.blocks():
        fresh = np.ones(len(at), bool)
        fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in key])
        fresh[0] = before is None or any(c[0] != b for c, b in zip(key, before))
        names[at] = name + np.cumsum(fresh)
        name, before = name + int(fresh.sum()), [c[-1] for c in key]

    # Their order: at once if the names differ, else by sorting the text of names.
    origin = array(len(stops), kind)
    origin[:] = starts[stops]
    if name == len(inner):
        order[names] = np.arange(len(stops))
        common[0] = 0
        for at in _blocks(len(stops) - 1):
            common[at + 1] = _shared(base, origin[order[at]], origin[order[at + 1]], most)
    else:
        order, common = _sort(names, name, origin, base, most)
    rank = array(len(stops), kind)
    rank[order] = np.arange(len(stops))

    # From it the order of all suffixes: tuples of tail and rank, out of the queue in order.
    length = len(text)
    long = np.concatenate([at[stops[tails.ends(at)] - at + 2 > tails.room] for at in _blocks(length - 1)] or [np.zeros(0, np.int64)])
    long_rank = tails.long_order(long, stops[tails.ends(long)], rank[tails.ends(long)]) if len(long) else long
    queue = Queue()
    for at in _blocks(length - 1):
        end = tails.ends(at)
        last = np.array(rank[end])
        a, b = np.searchsorted(long, [at[0], at[-1] + 1])
        last[long[a:b] - at[0]] = long_rank[a:b]
        queue.push([*tails.packed(at, stops[end]), last, at.astype(kind)])
    out, shared = array(length, kind), array(length, np.uint16)
    out[0], shared[0], filled, before = length - 1, 0, 1, None
    for *key, at in queue.blocks():
        end = tails.ends(at)
        left = np.concatenate([[before[0] if before else length - 1], at[:-1]])
        equal = stops[end] - at + 2 <= tails.room
        for k, column in enumerate(key[:-1]):
            equal[1:] &= column[1:] == column[:-1]
            equal[0] &= before is not None and column[0] == before[1][k]
        left_end = tails.ends(left)
        got = np.empty(len(at), np.int64)
        same, other = np.flatnonzero(equal), np.flatnonzero(~equal)
        got[same] = np.minimum(most, origin[end[same]] - starts[at[same]] + _least(common, rank[left_end[same]], rank[end[same]]).astype(np.int64))
        got[other] = _shared(base, starts[left[other]], starts[at[other]], most)
        out[filled:filled + len(at)], shared[filled:filled + len(at)] = at, got
        filled, before = filled + len(at), (at[-1], [c[-1] for c in key[:-1]])
    return out, shared


def suffix_order(base: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of ``base`` (uint8) and the bytes that neighbours share, counted up to ``most`` (at most 65,535)."""
    text = array(len(base) + 1, np.uint16)
    for at in _blocks(len(base)):
        text[at] = base[at].astype(np.uint16) + 1
    text[len(base)] = 0
    padded = array(len(base) + 1 + 8, np.uint8)
    padded[:len(base)], padded[len(base):] = base, 0
    starts = array(len(base) + 1, _places(len(base)))
    for at in _blocks(len(base) + 1):
        starts[at] = at
    order, shared = _sort(text, 256, starts, padded, most)
    return order[1:], shared[1:]
