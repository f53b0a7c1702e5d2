"""Neighbour joins, outlier factors and forests against brute force, also for heavily repeated vectors."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import anomaly as AN
from tablewright.operators import neighbours as N


def _frame(spark, x):
    return spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "vec": list(map(list, x))}))


def _brute(x, q, k, self_join):
    d = np.sqrt(((q[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    out = {}
    for i in range(len(q)):
        order = [j for j in np.lexsort((np.arange(len(x)), d[i])) if not (self_join and i == j)][:k]
        out[i] = [(j, d[i, j]) for j in order]
    return out


def _check(found, expected):
    got = {}
    for r in found.orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["neighbour"], r["distance"]))
    assert set(got) == set(expected)
    for i, want in expected.items():
        assert [j for j, _ in got[i]] == [j for j, _ in want], i
        assert np.allclose([d for _, d in got[i]], [d for _, d in want])


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(240, 3)), 2)
    x[:80] = [0.5, 0.5, 0.5]  # a third of the rows share one vector
    x[80:140] = np.round(rng.normal(scale=0.01, size=(60, 3)), 4)
    return x


@pytest.mark.parametrize("leaf, fan", [(10**6, 32), (16, 3), (40, 32)])
def test_self_join_is_exact(spark, points, monkeypatch, leaf, fan):
    monkeypatch.setattr(N, "BLOCK_ROWS", leaf)
    monkeypatch.setattr(N, "FAN", fan)
    found = N.nearest_neighbours(_frame(spark, points), None, "id", F.col("vec"), 7)
    _check(found, _brute(points, points, 7, True))


@pytest.mark.parametrize("leaf", [10**6, 10])
def test_join_of_two_tables_is_exact(spark, points, monkeypatch, leaf):
    monkeypatch.setattr(N, "BLOCK_ROWS", leaf)
    q = points[::5] + 0.001
    found = N.nearest_neighbours(_frame(spark, q), _frame(spark, points), "id", F.col("vec"), 4)
    _check(found, _brute(points, q, 4, False))


def test_few_members_give_all_of_them(spark):
    x = np.array([[0.0], [1.0], [5.0]])
    found = N.nearest_neighbours(_frame(spark, x), None, "id", F.col("vec"), 10)
    _check(found, _brute(x, x, 10, True))


def test_outlier_factor_with_repeated_vectors(spark, points, monkeypatch):
    k = 10
    near = _brute(points, points, k, True)
    kd = {i: max(d for _, d in n) for i, n in near.items()}
    lrd = {i: 1 / (np.mean([max(kd[j], d) for j, d in n]) + 1e-10) for i, n in near.items()}
    lof = {i: np.mean([lrd[j] for j, _ in n]) / lrd[i] for i, n in near.items()}
    for leaf in (10**6, 16):
        monkeypatch.setattr(N, "BLOCK_ROWS", leaf)
        found = {r["id"]: r["lof"] for r in N.local_outlier_factor(_frame(spark, points), "id", F.col("vec"), k).collect()}
        assert set(found) == set(lof)
        assert np.allclose([found[i] for i in sorted(lof)], [lof[i] for i in sorted(lof)])


def test_a_tree_that_may_not_grow_is_still_exact(spark, points, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    monkeypatch.setattr(N, "TREE_BYTES", 1000)
    found = N.nearest_neighbours(_frame(spark, points), None, "id", F.col("vec"), 7)
    _check(found, _brute(points, points, 7, True))


def _wide(spark, monkeypatch):
    """Vectors whose bounds prune nothing, and leaves so small that every query has dozens."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 20)
    return np.random.default_rng(4).normal(size=(900, 24))


def test_a_query_with_many_leaves_carries_its_vector_once(spark, monkeypatch):
    x = _wide(spark, monkeypatch)
    points = _frame(spark, x).select("id", "vec")
    tree = N.grow_tree(points, "bigint")
    assert len(tree.value.packs()) <= 5 * len(x) / N.BLOCK_ROWS  # leaves follow the members, not the fan
    routed = N._routed(points, tree, "bigint", 7).withColumn("limit", F.lit(100.0))
    visits = N._visits(routed, tree, "bigint").select("id", "vec", F.size("visits").alias("n")).collect()
    assert len(visits) == len(x) and min(r["n"] for r in visits) > 30


def test_leaves_searched_in_packs_are_exact(spark, monkeypatch):
    x = _wide(spark, monkeypatch)
    _check(N.nearest_neighbours(_frame(spark, x), None, "id", F.col("vec"), 7), _brute(x, x, 7, True))
    q = x[::3] + 0.01
    _check(N.nearest_neighbours(_frame(spark, q), _frame(spark, x), "id", F.col("vec"), 5), _brute(x, q, 5, False))


def test_a_search_that_prunes_nothing_stores_rows_and_no_pairs(spark, monkeypatch):
    """Neither lists of leaves nor copies of vectors for every block that a query has to see."""
    x = _wide(spark, monkeypatch)
    listed, copies, cut, search = [], [], N.cut_lineage, N._block_search

    def stored(df):
        out = cut(df)
        if "visits" in out.columns:
            listed.append(out.agg(F.max(F.size("visits"))).first()[0])
        return out

    def searched(queries, *args):
        copies.append(queries.count())
        return search(queries, *args)

    monkeypatch.setattr(N, "cut_lineage", stored)
    monkeypatch.setattr(N, "_block_search", searched)
    assert N.nearest_neighbours(_frame(spark, x), None, "id", F.col("vec"), 7).count() == 7 * len(x)
    assert listed and max(listed) <= N.NEXT_LEAVES and sum(copies) <= (1 + N.NEXT_LEAVES) * len(x)


@pytest.mark.parametrize("held", [1 << 30, 20_000])
def test_packs_keep_the_order_of_keys_among_equal_distances(spark, monkeypatch, held):
    """Keys are texts, many distances are equal, and members are searched in one part or several."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 20)
    monkeypatch.setattr(N, "HELD_BYTES", held)
    monkeypatch.setattr(N, "STORED_BYTES", 50 * 8 * 24)
    x = np.round(np.random.default_rng(5).normal(size=(600, 24)))
    df = _frame(spark, x).select(F.format_string("%04d", "id").alias("id"), "vec")
    found = N.nearest_neighbours(df, None, "id", F.col("vec"), 6)
    _check(found.select(F.col("id").cast("int"), F.col("neighbour").cast("int"), "distance", "rank"), _brute(x, x, 6, True))


def test_packs_take_a_key_that_is_null(spark, monkeypatch):
    """As a search of a single block does."""
    x = _wide(spark, monkeypatch)[:500]
    df = _frame(spark, x).select(F.when(F.col("id") != 7, F.col("id")).alias("id"), "vec")
    rows = []
    for leaf in (20, 10**6):
        monkeypatch.setattr(N, "BLOCK_ROWS", leaf)
        found = N.nearest_neighbours(df, None, "id", F.col("vec"), 6)
        rows.append(sorted((r["id"], r["rank"], r["neighbour"]) for r in found.where("id IS NOT NULL").collect()))
    assert rows[0] == rows[1] and {r[0] for r in rows[0]} == {*range(500)} - {7}


@pytest.mark.parametrize("scale, offset", [(1.0, 0.0), (1e-6, 1e6), (1e160, 0.0)])
def test_near_pairs_of_a_block_are_those_of_all_distances(scale, offset):
    rng = np.random.default_rng(8)
    b = rng.integers(0, 4, size=(300, 3)) * scale + offset
    a = np.vstack([b[:40], rng.random((40, 3)) * 4 * scale + offset])
    with np.errstate(over="ignore", invalid="ignore"):
        d = N._distances(a, b)
    want = np.argsort(d, axis=1, kind="stable")[:, :9]
    with np.errstate(over="ignore", invalid="ignore"):
        rows, columns, found = N._near_pairs(a, b, np.full(len(a), np.nan), 9)
    assert np.array_equal(columns.reshape(len(a), 9), want)
    assert np.array_equal(found, d[rows, columns])


def test_effort_of_a_query_does_not_grow_with_the_table(spark, monkeypatch):
    """Distances per query, over tables of 1, 4 and 16 times as many vectors of the plane."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 100)
    monkeypatch.setattr(N, "FAN", 8)
    effort = []
    for n in (1000, 4000, 16000):
        x = np.random.default_rng(n).random((n, 2))
        row = N.search_effort(_frame(spark, x), "id", F.col("vec"), 5).first()
        assert row["members"] == n and row["leaves"] >= n / 100
        effort.append((row["pivots_compared"] / n, row["members_compared"] / n))
    pivots, members = zip(*effort)
    assert max(members) < 1.5 * min(members) and members[-1] < 0.05 * 16000
    assert pivots[-1] < 4 * pivots[0]  # a level more for eight times the vectors


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(size=(500, 2)), [[9, 9], [-9, 8], [10, -9], [-8, -10], [0, 14]]])
    return spark.createDataFrame(pd.DataFrame({"id": range(505), "a": x[:, 0], "b": x[:, 1], "flat": 1.0})).persist()


def test_detectors_find_planted_rows(spark, planted):
    found = AN.detect_anomalies(planted, "id")
    both = {r["id"] for r in found.where("consensus").collect()}
    assert {500, 501, 502, 503, 504} <= both
    top = [r["id"] for r in found.orderBy(F.desc("score")).limit(5).collect()]
    assert set(top) == {500, 501, 502, 503, 504}
    again = AN.detect_anomalies(planted, "id").agg(F.sum("score")).first()[0]
    assert again == pytest.approx(found.agg(F.sum("score")).first()[0])


def test_actions(spark, planted):
    found = AN.detect_anomalies(planted, "id").withColumn("consensus", F.col("id") >= 500)
    removed = AN.apply_anomaly_action(planted, "id", found, "remove")
    flagged = AN.apply_anomaly_action(planted, "id", found, "flag")
    assert removed.affected == 5 and removed.rows.count() == 505 - removed.affected
    assert flagged.rows.agg(F.sum("_anomaly_flag")).first()[0] == removed.affected
    assert AN.apply_anomaly_action(planted, "id", found, "report").rows.count() == 505
    many = found.withColumn("consensus", F.col("id") < 100)
    assert AN.apply_anomaly_action(planted, "id", many, "remove").rows.count() == 505
    with pytest.raises(ValueError):
        AN.apply_anomaly_action(planted, "id", found, "hide")


def test_too_little_data_gives_none(spark):
    assert AN.detect_anomalies(spark.range(100).withColumn("x", F.col("id")).select("id", "x").drop("x"), "id", "id") is None
    few = spark.range(5).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"))
    assert AN.detect_anomalies(few, "id") is None


def test_forest_samples_are_bounded(spark):
    df = spark.range(20000).select("id", F.array(F.rand(1), F.rand(2)).alias("vec"))
    nodes = AN.grow_forest(df, "id", trees=5).toPandas()
    assert nodes["tree"].nunique() == 5 and (nodes["psi"] == 256).all()


def test_rows_of_a_single_part_are_scored_by_all_cores(spark, monkeypatch):
    """A file of one row group would be scored, and searched for neighbours, by one task."""
    parts, plain = [], {name: getattr(AN, name) for name in ("isolation_scores", "local_outlier_factor")}

    def counted(name):
        def call(points, *args):
            parts.append(points.rdd.getNumPartitions())
            return plain[name](points, *args)
        return call

    for name in plain:
        monkeypatch.setattr(AN, name, counted(name))
    df = spark.range(300).select("id", F.randn(1).alias("x"), F.randn(2).alias("y")).coalesce(1)
    assert AN.detect_anomalies(df, "id").count() == 300
    assert parts == [spark.sparkContext.defaultParallelism] * 2 and parts[0] > 1
