"""Session settings, shared scratch space and skew-aware key lookups."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of a side that may be broadcast, compared with a count before use, and cells of a table that is spread over the
# cores and kept between scans; a larger one is scanned again.
BROADCAST_ROWS = 100_000
KEPT_CELLS = 50_000_000
# Cells of a part where a task holds all of its rows.
PART_CELLS = 4_000_000

# Bytes of long rows that go to a Python worker at once: Spark holds such a batch off its heap more than once, and the worker holds it as well.
BATCH_BYTES = 4 << 20

_local_roots: dict[str, str] = {}


def build_session(app: str = "tablewright", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TABLEWRIGHT_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="tablewright-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on shared storage, so later passes reread it and survive lost executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)


def attach_lookup(
    rows: DataFrame,
    table: DataFrame,
    on: list[str],
    total: int,
    count_col: str,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left-join a table with one row per key back to rows whose keys may be very uneven.

    ``count_col`` of ``table`` says how many of the ``total`` rows carry the key. A table of at
    most ``broadcast_rows`` keys is broadcast. A larger one is cut in two: keys holding
    more than 1/1000 of the rows (at most 1000 of them) are broadcast, so their rows never move; the
    remaining, even keys take a shuffle join.
    """
    if total <= broadcast_rows:
        return rows.join(F.broadcast(table.drop(count_col)), on, "left")
    table = cut_lineage(table)
    if table.count() <= broadcast_rows:
        return rows.join(F.broadcast(table.drop(count_col)), on, "left")
    heavy = F.col(count_col) * 1000 > total
    if table.where(heavy).isEmpty():
        return rows.join(table.drop(count_col), on, "left")
    hot = F.broadcast(table.where(heavy).drop(count_col))
    cold = table.where(~heavy).drop(count_col)
    hot_rows = rows.join(hot, on, "inner")
    cold_rows = rows.join(F.broadcast(table.where(heavy).select(*on)), on, "left_anti").join(cold, on, "left")
    return hot_rows.unionByName(cold_rows)


@contextmanager
def small_batches(spark: SparkSession):
    """Steps that are run inside send long rows to Python workers ``BATCH_BYTES`` at a time; the session's own setting is put back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def reread(df: DataFrame, rows: int):
    """``df`` for work that passes over it several times.

    A table of few cells (by its counted rows) is spread over the cores and kept; a larger one is scanned
    again, column-pruned, on every pass.
    """
    if rows * max(len(df.columns), 1) > KEPT_CELLS:
        yield df
        return
    kept = df.repartition(df.sparkSession.sparkContext.defaultParallelism).persist()
    try:
        yield kept
    finally:
        kept.unpersist()


def bounded_parts(df: DataFrame, rows: int, part_cells: int | None = None) -> DataFrame:
    """``df`` in parts of bounded size, for steps whose tasks hold their rows; a file's own parts may be row groups of any size. A table of one part stays as it is."""
    parts = -(-rows * max(len(df.columns), 1) // (part_cells or PART_CELLS))
    return df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism)) if parts > 1 else df


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A small table over all cores, for heavy work per row; a large one keeps the partitions of its scan.

    A small file is often one row group and would otherwise be worked on by one core.
    """
    rows = df.count() if rows is None else rows
    if rows * max(len(df.columns), 1) > KEPT_CELLS:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
