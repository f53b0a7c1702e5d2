"""Order statistics, profile, schema and association against NumPy and by their limits."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.functions import numeric as FN
from tablewright.operators import association as A
from tablewright.operators import gram as G
from tablewright.operators import metrics as M
from tablewright.operators import neighbour_information as NI
from tablewright.operators import order_stats as O
from tablewright.operators import profile as P
from tablewright.operators import schema as S
from tablewright.operators.ranking_values import tie_ranks
from tablewright.operators.schema import drop_identifiers, identifier_columns, infer_schema, tag_columns
from tablewright.runtime import bounded_parts


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(1)
    n = 6000
    return pd.DataFrame({
        "skewed": np.exp(rng.normal(0, 4, n)), "hot": np.where(rng.random(n) < 0.5, 7.0, rng.normal(0, 1, n)),
        "signed": rng.normal(-1e6, 1e5, n), "few": rng.integers(0, 5, n).astype(float), "same": np.full(n, 3.0),
        "huge": rng.choice([-1.7e308, 0.0, 1.7e308, 5e-324], n),
    })


PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


def test_narrowed_quantiles_equal_numpy(spark, values, monkeypatch):
    monkeypatch.setattr(O, "FETCH_ROWS", 50)
    monkeypatch.setattr(O, "ACCURACY", 100)
    monkeypatch.setattr(O, "CUTS", 16)
    df = spark.createDataFrame(values)
    found = O.exact_quantiles(df, {c: F.col(c) for c in values}, PROBS)
    for c in values.columns.drop("huge"):
        assert np.allclose(found[c], np.quantile(values[c], PROBS), rtol=1e-12), c
    assert found["huge"][0] == -1.7e308 and found["huge"][-1] == 1.7e308


@pytest.mark.parametrize("accuracy, fetch, cuts", [(10_000, 20_000, 256), (50, 20, 8), (1000, 5, 4)])
def test_collected_and_narrowed_agree_with_percentile(spark, values, monkeypatch, accuracy, fetch, cuts):
    monkeypatch.setattr(O, "ACCURACY", accuracy)
    monkeypatch.setattr(O, "FETCH_ROWS", fetch)
    monkeypatch.setattr(O, "CUTS", cuts)
    df = spark.createDataFrame(values.drop(columns="huge"))
    row = df.agg(*[F.percentile(c, F.array(*map(F.lit, PROBS))).alias(c) for c in df.columns]).first()
    assert O.exact_quantiles(df, {c: F.col(c) for c in df.columns}, PROBS) == {c: list(row[c]) for c in df.columns}


def test_a_rank_outside_its_bracket_is_found_all_the_same(spark, values):
    """A sketch may be as wrong as it likes."""
    df = spark.createDataFrame(values[["signed"]])
    ordered = np.sort(values["signed"].to_numpy())
    wrong = O.Sketch(6000, float(ordered[0]), float(ordered[-1]), (0.2, 0.4, 0.6), (float(ordered[10]), float(ordered[20]), float(ordered[30])))
    brackets = [O.Bracket("signed", float(ordered[10]), float(ordered[30]), 100, {3000, 12})]
    found = O.ranked_values(df, {"signed": F.col("signed")}, {"signed": wrong}, {}, {}, brackets)
    assert found == {("signed", 3000): ordered[3000], ("signed", 12): ordered[12]}


def test_order_values_both_ways(spark, values, monkeypatch):
    df = spark.createDataFrame(values[["hot"]])
    ranks, expected = [0, 17, 3000, 5999], np.sort(values["hot"].to_numpy())[[0, 17, 3000, 5999]]
    for fetch in (20_000, 50):
        monkeypatch.setattr(O, "FETCH_ROWS", fetch)
        assert O.order_values(df, F.col("hot"), lambda rows: ranks if rows == 6000 else []) == list(expected)


def test_quantiles_skip_nulls_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double")
    assert O.exact_quantiles(df, {"a": F.col("a"), "b": F.col("b")}, [0.5]) == {"a": [2.0], "b": [None]}


def test_tie_ranks_equal_pandas(spark, values):
    df = spark.createDataFrame(values[["hot"]])
    expected = dict(zip(values["hot"], values["hot"].rank()))
    assert {r["hot"]: r["rank"] for r in tie_ranks(df, "hot").collect()} == expected


def test_tie_ranks_of_groups(spark, values):
    frame = values[["hot", "signed"]].melt(var_name="c", value_name="x")
    expected = {(c, x): r for c, part in frame.groupby("c") for x, r in zip(part["x"], part["x"].rank())}
    assert {(r["c"], r["x"]): r["rank"] for r in tie_ranks(spark.createDataFrame(frame), "x", ("c",)).collect()} == expected


def test_profile_equals_pandas(spark, values, monkeypatch):
    frame = values.drop(columns="huge").copy()
    frame.loc[::7, "skewed"] = np.nan
    df = spark.createDataFrame(frame)
    for fetch in (20_000, 100):
        monkeypatch.setattr(O, "FETCH_ROWS", fetch)
        monkeypatch.setattr(P, "FETCH_ROWS", fetch)
        found = {r["column_name"]: r for r in P.profile_columns(df).collect()}
        for c in frame:
            s = frame[c].dropna()
            r = found[c]
            assert r["missing_count"] == frame[c].isna().sum()
            assert r["zero_variance"] == (s.var() == 0)
            assert np.isclose(r["mean"], s.mean()) and np.isclose(r["std"], s.std())
            assert np.isclose(r["skewness"], s.skew()) and np.isclose(r["kurtosis"], s.kurtosis())
            assert np.isclose(r["median"], s.median()) and np.isclose(r["mad"], (s - s.median()).abs().median())
            score = 0.6745 * (s - s.median()).abs() / ((s - s.median()).abs().median() or np.nan)
            assert r["modified_zscore_outliers_count"] == (score > 3.5).sum()
            if s.std() > 0:
                assert r["zscore_outliers_count"] == (((s - s.mean()) / s.std()).abs() > 3).sum()


def test_profile_scans_its_table_four_times(spark, values):
    """Rows that a pass-through hands on, over the rows of the table."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    for n in (2000, 40_000):  # collected whole, and by brackets
        read.value = 0
        df = spark.range(n).select((F.randn(1) * 3).alias("a"), F.exp(F.randn(2)).alias("b"), F.lit("x").alias("s"))
        P._column_statistics(df.mapInArrow(counted, df.schema), n)
        assert 3 * n < read.value <= (4 if n == 2000 else 5) * n, read.value / n


def test_a_stored_table_has_the_same_profile(spark, monkeypatch):
    """Numbers by packs of columns, for rows that are collected whole, by brackets and by brackets that are sketched again."""
    df = spark.range(4000).select(
        (F.randn(1) * 3).alias("a"), F.when(F.col("id") % 7 > 0, F.exp(F.randn(2))).alias("b"), (F.col("id") % 5).alias("few"), F.lit(2.0).alias("flat"),
        F.lit(None).cast("double").alias("none"), F.lit("x").alias("s")).persist()
    for fetch in (20_000, 1000, 3):
        monkeypatch.setattr(O, "FETCH_ROWS", fetch)
        monkeypatch.setattr(P, "FETCH_ROWS", fetch)
        plain, stored = (P._column_statistics(df, 4000, stored) for stored in (False, True))
        for one, other in zip(plain, stored, strict=True):
            for k, v in one.items():
                assert type(v) is type(other[k]), (one["column_name"], k)
                assert v == (pytest.approx(other[k], rel=1e-12, nan_ok=True) if isinstance(v, float) else other[k]), (one["column_name"], k)
    df.unpersist()


def test_counts_are_compiled_a_few_at_a_time(spark, monkeypatch):
    df = spark.range(100).select(*[(F.col("id") * k).alias(f"c{k}") for k in range(40)])
    groups = [{f"{f}{k}": getattr(F, f)(f"c{k}") for f in ("min", "max", "sum", "count", "avg")} for k in range(40)]
    sizes, plain = [], type(df).agg

    def agg(self, *columns):
        sizes.append(str(columns[0]).count("CAST"))
        return plain(self, *columns)

    monkeypatch.setattr(type(df), "agg", agg)
    found = O.counted_in_packs(df, groups)
    assert len(sizes) == 20 and found == {f"{f}{k}": float(v) for k in range(40) for f, v in (("min", 0), ("max", 99 * k), ("sum", 4950 * k), ("count", 100), ("avg", 49.5 * k))}


def test_equal_ends_of_a_bracket_hold_nothing_inside():
    brackets = [O.Bracket("x", 2.0, 2.0, 1e6, {5}), O.Bracket("x", 2.0, 3.0, 1e6, {9})]
    assert [len(c) for c in O.bracket_counts(brackets, {"x": F.lit(1.0)})] == [2, 4]
    assert list(O.bracket_held(brackets, {"x": F.lit(1.0)})) == ["held_b1"]


def test_profile_of_tiny_and_empty_frames(spark):
    empty = spark.createDataFrame([], "x double, s string")
    rows = {r["column_name"]: r for r in P.profile_columns(empty).collect()}
    assert rows["x"]["missing_pct"] == 0.0 and rows["x"]["mean"] is None and rows["x"]["zero_variance"]
    nulls = spark.createDataFrame([(None, "a"), (None, "a")], "x double, s string")
    rows = {r["column_name"]: r for r in P.profile_columns(nulls).collect()}
    assert rows["x"]["missing_pct"] == 100.0 and rows["s"]["zero_variance"]
    for n, skew, kurt, std in ((1, None, None, None), (2, None, None, 0.7071), (3, 0.0, None, 1.0)):
        r = P.profile_columns(spark.range(n).select(F.col("id").cast("double").alias("x"))).first()
        assert (r["skewness"], r["kurtosis"]) == (skew, kurt)
        assert r["std"] == pytest.approx(std, abs=1e-4) if std else r["std"] is None
    nan = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,)], "x double")
    assert P.profile_columns(nan).first()["missing_count"] == 1


def test_normality_p_rejects_skew_and_accepts_normal():
    rng = np.random.default_rng(0)

    def p(x):
        d = x - x.mean()
        m2 = (d**2).mean()
        return FN.normality_p(len(x), (d**3).mean() / m2**1.5, (d**4).mean() / m2**2 - 3)

    below = np.mean([p(rng.normal(size=200)) < 0.05 for _ in range(500)])
    assert 0.02 < below < 0.09
    assert p(rng.exponential(size=200)) < 1e-6
    assert FN.normality_p(19, 0.0, 0.0) is None


def test_duplicates_count_nulls_as_equal(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (2, None), (None, 2)], "a int, b int")
    assert P.duplicate_rows(df).first()["duplicate_rows"] == 1


def test_imbalance_of_one_class_is_one(spark):
    r = P.target_imbalance(spark.createDataFrame([("a",), ("a",), (None,)], "t string"), "t").first()
    assert (r["classes"], r["imbalance_ratio"], r["is_imbalanced"]) == (1, 1.0, False)


def test_schema_edge_cases(spark):
    df = spark.createDataFrame(
        [(i, "x@y.com" if i else "nobody", None, f"2020-01-{i + 1:02d}", 91.0, True, float("nan")) for i in range(6)],
        "id long, mixed string, empty string, dt string, lat double, flag boolean, gap double",
    )
    found = {r["column_name"]: r for r in infer_schema(df, "id").collect()}
    kinds = {c: r["inferred_type"] for c, r in found.items()}
    assert kinds["dt"] == "datetime" and kinds["lat"] == "numeric" and kinds["flag"] == "boolean"
    assert kinds["mixed"] == "categorical" and found["gap"]["null_count"] == 6
    assert found["empty"]["unique_count"] == 0 and found["mixed"]["sample_values"][0] == "nobody"
    nothing = infer_schema(spark.createDataFrame([], "a long, b string"), "a")
    assert {r["inferred_type"] for r in nothing.collect()} == {"unknown"}


def test_samples_reach_past_leading_nulls(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") > 1990, F.concat(F.lit("v"), "id")).alias("late"))
    found = {r["column_name"]: r["sample_values"] for r in infer_schema(df, "id").collect()}
    assert found["late"] == ["v1991", "v1992", "v1993"]


def test_identifier_names(spark):
    names = ["id", "Id", "user_id", "PassengerId", "row_num", "Unnamed: 0", "valid", "index", "paid", "grid"]
    assert identifier_columns(names, "index") == ["id", "Id", "user_id", "PassengerId", "row_num", "Unnamed: 0", "valid", "paid", "grid"]
    df = spark.range(2).withColumn("y", F.lit(1))
    assert drop_identifiers(df, "y").columns == ["y"]
    assert tag_columns(df, {"y": "numeric"}).schema["y"].metadata["semantic_type"] == "numeric"


def test_spearman_with_gaps(spark, values):
    frame = values[["skewed", "hot", "few"]].copy()
    frame.loc[::5, "few"] = np.nan
    df = spark.createDataFrame(frame)
    expected = frame.corr(method="spearman")
    for r in A.spearman_matrix(df).collect():
        assert r["correlation"] == pytest.approx(expected.loc[r["col_a"], r["col_b"]], abs=1e-12)


def test_correlations_of_all_pairs_take_one_scan(spark, monkeypatch):
    """Blocks, gaps and constant columns against pandas, and a table of a thousand columns."""
    monkeypatch.setattr(G, "BLOCK_COLUMNS", 3)
    rng = np.random.default_rng(8)
    frame = pd.DataFrame(rng.normal(1e6, 1.0, (500, 7)), columns=list("abcdefg"))
    frame["b"] += frame["a"]
    frame["c"] = 0.1
    frame = frame.mask(rng.random(frame.shape) < 0.3)
    frame.loc[frame.index[frame["a"].notna()], "g"] = np.nan
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(frame).repartition(5).cache()
    found = {(r["col_a"], r["col_b"]): r for r in G.pair_correlations(df.select(*[F.nanvl(c, F.lit(None)).alias(c) for c in df.columns]).mapInArrow(counted, df.schema), df.columns).collect()}
    assert len(found) == 21 and read.value == 500
    for (a, b), r in found.items():
        both = frame[[a, b]].dropna()
        assert r["rows"] == len(both)
        if len(both) < 2:
            assert r["correlation"] is None
        elif "c" in (a, b):
            assert np.isnan(r["correlation"])
        else:
            assert r["correlation"] == pytest.approx(both.corr().iloc[0, 1], abs=1e-9)
    monkeypatch.setattr(G, "BLOCK_COLUMNS", 128)
    wide = spark.range(60).select(*[(F.col("id") * (i + 1) + F.rand(i)).alias(f"x{i}") for i in range(1000)])
    assert G.pair_correlations(wide, wide.columns).agg(F.count("*"), F.min("correlation")).first()[0] == 499_500


def test_vif_of_collinear_columns_is_capped(spark):
    df = spark.range(50).select(
        F.col("id").alias("x"), (F.col("id") * 2 + 1).alias("y"), F.rand(1).alias("noise"), F.lit(1).alias("flat")
    )
    found = {r["column_name"]: r["vif"] for r in A.variance_inflation(df).collect()}
    assert found["x"] == pytest.approx(1e5) and found["y"] == pytest.approx(1e5) and "noise" not in found


def test_mutual_information_counts_missing_as_a_class(spark):
    df = spark.createDataFrame([("a", 0), (None, 1), ("a", 0), (None, 1)] * 5, "x string, y int")
    r = A.mutual_information(df, "y").first()
    assert r["mi_score"] == pytest.approx(np.log(2))
    assert A.mutual_information(df.limit(3), "y").count() == 0


def test_leakage_reads_text_targets(spark):
    df = spark.range(30).select((F.col("id") * 1.5).alias("x"), F.rand(3).alias("z"), F.col("id").cast("string").alias("t"))
    assert [r["column_name"] for r in A.leakage_correlation(df, "t").collect()] == ["x"]


def test_auc_with_ties(spark):
    rng = np.random.default_rng(5)
    y, s = rng.integers(0, 2, 3000), np.round(rng.random(3000), 2)
    ranks = pd.Series(s).rank().to_numpy()
    pos = y.sum()
    expected = (ranks[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    assert M.roc_auc(df, F.col("y") == 1, "s").first()[0] == pytest.approx(expected)
    assert M.roc_auc(df.where("y = 1"), F.col("y") == 1, "s").first()[0] is None


def test_metrics_with_empty_denominators(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (0, 0)], "y int, p int")
    r = M.binary_metrics(df, "y", "p").first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.0, 0.0, 0.0) and r["accuracy"] == pytest.approx(1 / 3)
    per = {r["class"]: r["f1"] for r in M.class_metrics(df, "y", "p").collect()}
    assert per[1] == 0.0 and per[0] == pytest.approx(0.5)


def test_semantic_type_looks_at_all_values(spark):
    from tablewright.operators.schema import infer_schema

    df = spark.range(1000).selectExpr("id", "CASE WHEN id < 600 THEN concat('u', id, '@ex.com') ELSE concat('shop', id) END AS mail")
    found = {r["column_name"]: r["inferred_type"] for r in infer_schema(df, "id").collect()}
    assert found["mail"] == "high_cardinality"


def _plain_information(x, y, k, classes):
    """The estimators by sorting every row's distances, one row at a time."""
    psi = lambda m: sum(1 / i for i in range(1, m)) - NI.EULER_GAMMA
    if classes:
        keep = [i for i in range(len(x)) if (y == y[i]).sum() > 1]
        x, y = x[keep], y[keep]
    n, parts = len(x), []
    for i in range(n):
        dx = np.abs(x - x[i])
        if classes:
            size = int((y == y[i]).sum())
            near = min(k, size - 1)
            reach = np.sort(dx[y == y[i]])[near]
            parts.append(psi(near) - psi(size) - psi(int((dx < reach).sum())))
        else:
            dy = np.abs(y - y[i])
            reach = np.sort(np.maximum(dx, dy))[k]
            parts.append(psi(k) - psi(int((dx < reach).sum())) - psi(int((dy < reach).sum())))
    return n, psi(n) + float(np.mean(parts))


@pytest.mark.parametrize("n, k", [(40, 3), (600, 3), (300, 7)])
def test_neighbour_information_of_a_block_equals_a_plain_version(n, k):
    rng = np.random.default_rng(n)
    x = rng.normal(size=n)
    y, labels = x + rng.normal(size=n), np.where(rng.random(n) < 0.2, 0, (x > 0) + 1)
    labels[0], labels[1:3] = 99, 98  # a class of one row, and one smaller than k
    for other, classes, found in ((y, False, NI.continuous_information(x, y, k)), (labels, True, NI.class_information(x, labels, k))):
        assert np.allclose(found, _plain_information(x, other, k, classes))


def test_neighbour_information_of_normal_columns_at_any_block_size(spark):
    rng = np.random.default_rng(3)
    x, noise = rng.normal(size=(2, 12_000))
    y = 0.8 * x + 0.6 * noise
    frame = pd.DataFrame({"id": range(12_000), "x": x, "alone": rng.normal(size=12_000), "c": np.where(x > 0, "p", "q"), "y": y})
    frame.loc[:4000, "alone"] = np.nan  # a third of the rows has one value
    df, truth = spark.createDataFrame(frame), -0.5 * np.log(1 - 0.64)
    for rows in (1000, 2048):
        found = {r["column_name"]: r["mi_score"] for r in NI.neighbour_mutual_information(df, "id", "y", block_rows=rows).collect()}
        assert set(found) == {"x", "alone", "c"} and abs(found["x"] - truth) < 0.03 and found["alone"] < 0.03
        assert 0.2 < found["c"] < found["x"]
    again = NI.neighbour_mutual_information(df.repartition(7), "id", "y", block_rows=2048).collect()
    assert {r["column_name"]: round(r["mi_score"], 9) for r in again} == {c: round(v, 9) for c, v in found.items()}


def test_neighbour_information_edges(spark):
    schema = "id long, x double, c string, only double, `a.b` double, y double"
    rows = [(i, None if i % 3 else float("inf"), None, 5.0, float(i), float(i % 40) if i else None) for i in range(100)]
    found = {r["column_name"]: r["mi_score"] for r in NI.neighbour_mutual_information(spark.createDataFrame(rows, schema), "id", "y").collect()}
    assert set(found) == {"x", "c", "only", "a.b"} and found["c"] == 0 and all(np.isfinite(v) and v >= 0 for v in found.values())
    assert NI.neighbour_mutual_information(spark.createDataFrame([], schema), "id", "y").where("mi_score > 0").count() == 0
    by_class = NI.neighbour_mutual_information(spark.createDataFrame(rows, schema).withColumn("y", F.col("y") % 2), "id", "y").collect()
    assert {r["column_name"] for r in by_class} == {"x", "c", "only", "a.b"}


def test_ranks_of_a_column_are_looked_up_once_for_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    frame = pd.DataFrame(np.round(rng.normal(size=(400, 4)), 1), columns=list("abcd"))
    frame.loc[rng.random(400) < 0.2, "b"] = np.nan
    frame.loc[rng.random(400) < 0.3, "d"] = np.nan
    asked = []
    attach = A.attach_lookup
    monkeypatch.setattr(A, "attach_lookup", lambda rows, table, on, *rest: asked.append(on) or attach(rows, table, on, *rest, broadcast_rows=1))
    monkeypatch.setattr(A, "BLOCK_COLUMNS", 4)  # several scans
    found = {(r["col_a"], r["col_b"]): r["correlation"] for r in A.spearman_matrix(spark.createDataFrame(frame)).collect()}
    want = {(a, b): frame[[a, b]].dropna().rank().corr().loc[a, b] for a, b in combinations("abcd", 2)}
    assert len(asked) == 4
    assert set(found) == set(want)
    assert all(abs(found[pair] - want[pair]) < 1e-9 for pair in want)


def test_counting_tasks_hold_a_bounded_number_of_cells(spark, monkeypatch):
    monkeypatch.setattr(S, "COUNTED_CELLS", 100)
    df = spark.range(0, 1000, 1, 1).selectExpr("id", "concat('v', id % 700) AS text")
    counts = S.value_counts(df)
    assert "REPARTITION_BY_NUM" in counts._jdf.queryExecution().toString()
    assert counts.where("column_name = 'text'").count() == 700


def test_first_values_order_only_early_rows_and_keep_ties(spark):
    rows = [(i // 2, None if i < 20 else f"x{i % 2}", f"y{i}") for i in range(2000)] + [(None, "first", None)]
    df = spark.createDataFrame(rows, "k int, late string, y string")
    found = {r["column_name"]: r["values"] for r in S.first_values(df, "k").collect()}
    assert found["late"] == ["first", "x0", "x1"]
    assert found["y"] == ["y0", "y1", "y2"]
    assert found["k"] == ["0", "0", "1"]
    few = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, "b")], "k int, v string")
    assert {r["column_name"]: r["values"] for r in S.first_values(few, "k").collect()} == {"k": ["1", "1", "2"], "v": ["a", "a", "b"]}


def test_large_tables_come_in_bounded_parts(spark):
    one = spark.range(0, 1000, 1, 1)
    assert bounded_parts(one, 1000, 20).rdd.getNumPartitions() == 50
    assert bounded_parts(one, 1000, 1000).rdd.getNumPartitions() == 1
