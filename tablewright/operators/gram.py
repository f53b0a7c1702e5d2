"""Moments of all pairs of columns in one scan, as blocks of matrices.

A task keeps, for every pair of blocks of columns, the counts, means, squares and products over the rows where both columns are present, taken from matrix
products of its batches. Blocks are merged by the formulas for parted samples, first within sixteen heaps of tasks, then over these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tablewright.functions.numeric import quoted

#: Columns of a block, and heaps in which tasks' blocks are merged first.
BLOCK_COLUMNS, HEAPS = 128, 16
_BLOCKS = "i int, j int, heap int, data binary"
_FIELDS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("heap", pa.int32()), ("data", pa.binary())])


def _moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Count, mean and squares of a's columns, mean and squares of b's, and products, over rows where both are present (not NaN)."""
    sides = []
    for x in (a, b):
        held = ~np.isnan(x)
        # Shifted by a value of each column, so that constant columns have squares of exactly zero.
        first = np.where(held.any(axis=0), x[held.argmax(axis=0), np.arange(x.shape[1])], 0.0)
        sides.append((first, held.astype(float), np.where(held, x - first, 0.0)))
    (first_a, held_a, a), (first_b, held_b, b) = sides
    n = held_a.T @ held_b
    some = np.maximum(n, 1)
    sum_a, sum_b = a.T @ held_b, held_a.T @ b
    mean_a, mean_b = sum_a / some, sum_b / some
    return np.stack([n, first_a[:, None] + mean_a, (a * a).T @ held_b - sum_a * mean_a, first_b[None, :] + mean_b, held_a.T @ (b * b) - sum_b * mean_b, a.T @ b - sum_a * mean_b])


def merged(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The moments of two samples together."""
    n = x[0] + y[0]
    part = np.where(n > 0, y[0] / np.maximum(n, 1), 0.0)
    a, b = y[1] - x[1], y[3] - x[3]
    weight = x[0] * part
    # Where one side is empty its mean says nothing.
    mean = lambda k, d: np.where(x[0] == 0, y[k], np.where(y[0] == 0, x[k], x[k] + d * part))
    return np.stack([n, mean(1, a), x[2] + y[2] + a * a * weight, mean(3, b), x[4] + y[4] + b * b * weight, x[5] + y[5] + a * b * weight])


def _emitted(held: dict[tuple[int, int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for (i, j, heap), data in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((i, j, heap, data.tobytes()), _FIELDS)], schema=_FIELDS)


def pair_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """``i, j, heap, data``: one row per pair of blocks of DOUBLE columns, with the six matrices of ``_moments``."""
    k = len(columns)
    width = lambda i: min(BLOCK_COLUMNS, k - i * BLOCK_COLUMNS)
    blocks = range(-(-k // BLOCK_COLUMNS))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], np.ndarray] = {}
        heap = TaskContext.get().partitionId() % HEAPS
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            parts = [x[:, i * BLOCK_COLUMNS:(i + 1) * BLOCK_COLUMNS] for i in blocks]
            for i in blocks:
                for j in blocks[i:]:
                    new = _moments(parts[i], parts[j])
                    held[(i, j, heap)] = merged(held[(i, j, heap)], new) if (i, j, heap) in held else new
        yield from _emitted(held)

    def merge(over_heaps: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int, int], np.ndarray] = {}
            for batch in batches:
                for r in batch.to_pylist():
                    key = r["i"], r["j"], 0 if over_heaps else r["heap"]
                    new = np.frombuffer(r["data"]).reshape(6, width(r["i"]), width(r["j"]))
                    held[key] = merged(held[key], new) if key in held else new
            yield from _emitted(held)
        return run

    rows = df.select(*[quoted(c) for c in columns]).mapInArrow(scan, _BLOCKS)
    return rows.repartition("i", "j", "heap").mapInArrow(merge(False), _BLOCKS).repartition("i", "j").mapInArrow(merge(True), _BLOCKS)


def pair_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """``col_a, col_b, correlation, rows`` of every pair over the rows where both are present: NULL for fewer than two rows, NaN if a side is constant."""
    names = list(columns)
    schema = pa.schema([("col_a", pa.string()), ("col_b", pa.string()), ("correlation", pa.float64()), ("rows", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                wide = [names[b * BLOCK_COLUMNS:(b + 1) * BLOCK_COLUMNS] for b in (r["i"], r["j"])]
                n, _, aa, _, bb, ab = np.frombuffer(r["data"]).reshape(6, *map(len, wide))
                with np.errstate(invalid="ignore", divide="ignore"):
                    value = ab / np.sqrt(aa * bb)
                a, b = np.nonzero(np.ones_like(n) if r["i"] < r["j"] else np.triu(np.ones_like(n), 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([wide[0][x] for x in a], pa.string()), pa.array([wide[1][x] for x in b], pa.string()), pa.array(value[a, b], mask=n[a, b] < 2), pa.array(n[a, b].astype(np.int64))], schema=schema)

    return pair_moments(df, names).mapInArrow(run, "col_a string, col_b string, correlation double, rows bigint")
