"""Named queries over the given tables, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The given tables of one folder, read as Parquet with their own schema."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def query(name: str, sql: str | None = None):
    """Registers a function of ``Tables`` under a name."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def long_sql(columns: dict[str, str], source: str) -> str:
    """(column_name, v) rows of several numeric expressions."""
    parts = [f"SELECT '{name}' AS column_name, CAST({expr} AS DOUBLE) AS v FROM {source}" for name, expr in columns.items()]
    return " UNION ALL ".join(parts)


def digest_sql(parts: list[str], salt: int = 0) -> str:
    """The digest of a row in SQL, over expressions that print alike in both engines."""
    shown = ", ".join(f"CASE WHEN {p} IS NULL THEN '-' ELSE concat(length(CAST({p} AS VARCHAR)), ':', CAST({p} AS VARCHAR)) END" for p in parts)
    return f"CAST('0x' || substr(md5(concat_ws('|', '{salt}', {shown})), 1, 15) AS BIGINT)"
