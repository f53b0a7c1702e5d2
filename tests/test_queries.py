"""Every registered query runs, and equals its SQL where it has one."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from tablewright.workloads.registry import QUERIES, SQL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _shown(value):
    return repr(value) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted(tuple(_shown(r[c]) for c in columns) for r in df.collect())
    expected = duck.sql(SQL[name])
    assert columns == sorted(expected.columns)
    rows = [dict(zip(expected.columns, r)) for r in expected.fetchall()]
    assert found == sorted(tuple(_shown(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.count() >= (0 if name == "risk_anomalies" else 1)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 8
