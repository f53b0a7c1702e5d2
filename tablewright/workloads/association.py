"""Correlations, collinearity, mutual information, neighbours and anomalies."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.numeric import plain_round
from tablewright.operators import anomaly as AN
from tablewright.operators import association as A
from tablewright.operators import neighbour_information as NI
from tablewright.operators import neighbours as N
from tablewright.workloads.registry import Tables, digest_sql, query

_COLUMNS = {
    "l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "l_discount": "nullif(l_discount, 0.05)",
    "net_price": "l_extendedprice * (1 - l_discount)",
}
_SOURCE = "(SELECT l_returnflag, " + ", ".join(f"{e} AS {c}" for c, e in _COLUMNS.items()) + " FROM lineitem)"


def _lines(t: Tables) -> DataFrame:
    return t("lineitem").selectExpr("l_returnflag", *[f"{e} AS {c}" for c, e in _COLUMNS.items()])


def _pair_sql(fn) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, {fn(a, b)} AS correlation" for a, b in combinations(_COLUMNS, 2)
    )


def _rank_corr_sql(a: str, b: str, source: str = _SOURCE) -> str:
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    return (
        f"(SELECT corr(ra, rb) FROM (SELECT {rank(a)} AS ra, {rank(b)} AS rb FROM {source} "
        f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL))"
    )


_PEARSON = _pair_sql(lambda a, b: f"(SELECT corr({a}, {b}) FROM {_SOURCE})")
_SPEARMAN = _pair_sql(_rank_corr_sql)


@query("pearson_pairs", f"SELECT col_a, col_b, round(correlation, 6) + 0.0 AS correlation FROM ({_PEARSON})")
def pearson_pairs(t: Tables) -> DataFrame:
    return A.pearson_matrix(_lines(t)).withColumn("correlation", plain_round(F.col("correlation"), 6))


@query("pearson_high", f"SELECT col_a, col_b, round(abs(correlation), 6) AS correlation FROM ({_PEARSON}) WHERE abs(correlation) >= 0.95")
def pearson_high(t: Tables) -> DataFrame:
    return A.high_pairs(A.pearson_matrix(_lines(t))).withColumn("correlation", F.round("correlation", 6))


@query("spearman_pairs", f"SELECT col_a, col_b, round(correlation, 6) + 0.0 AS correlation FROM ({_SPEARMAN})")
def spearman_pairs(t: Tables) -> DataFrame:
    return A.spearman_matrix(_lines(t)).withColumn("correlation", plain_round(F.col("correlation"), 6))


@query("spearman_high", f"SELECT col_a, col_b, round(abs(correlation), 6) AS correlation FROM ({_SPEARMAN}) WHERE abs(correlation) >= 0.95")
def spearman_high(t: Tables) -> DataFrame:
    return A.high_pairs(A.spearman_matrix(_lines(t))).withColumn("correlation", F.round("correlation", 6))


_VIF = """
WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, net) AS ac, corr(l_extendedprice, net) AS bc
           FROM (SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS net FROM lineitem)),
d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM r),
v AS (SELECT 'l_quantity' AS column_name, (1 - bc * bc) / det AS vif FROM d
      UNION ALL SELECT 'l_extendedprice', (1 - ac * ac) / det FROM d UNION ALL SELECT 'net', (1 - ab * ab) / det FROM d)
"""


def _vif_input(t: Tables) -> DataFrame:
    return t("lineitem").selectExpr("l_quantity", "l_extendedprice", "l_extendedprice * (1 - l_discount) AS net")


@query("variance_inflation", _VIF + "SELECT column_name, round(vif, 3) AS vif FROM v WHERE vif >= 2")
def variance_inflation(t: Tables) -> DataFrame:
    return A.variance_inflation(_vif_input(t)).withColumn("vif", F.round("vif", 3))


def mi_sql(features: dict[str, str], target: str, source: str) -> str:
    parts = []
    for name, expr in features.items():
        parts.append(f"""
SELECT '{name}' AS column_name, round(greatest(sum(c / n * ln(c * n / (cx * cy))), 0), 6) AS mi_score
FROM (SELECT c, sum(c) OVER () AS n, sum(c) OVER (PARTITION BY x) AS cx, sum(c) OVER (PARTITION BY y) AS cy
      FROM (SELECT {expr} AS x, {target} AS y, count(*)::DOUBLE AS c FROM {source} GROUP BY 1, 2))""")
    return " UNION ALL ".join(parts)


@query("mutual_information_discrete", mi_sql(
    {"o_orderpriority": "o_orderpriority", "order_month": "month(o_orderdate)", "order_year": "year(o_orderdate)"},
    "o_orderstatus", "orders"))
def mutual_information_discrete(t: Tables) -> DataFrame:
    df = t("orders").select(
        "o_orderstatus", "o_orderpriority", F.month("o_orderdate").alias("order_month"), F.year("o_orderdate").alias("order_year")
    )
    found = A.discrete_mutual_information(df, ["o_orderpriority", "order_month", "order_year"], "o_orderstatus")
    return found.select("column_name", F.round("mi_score", 6).alias("mi_score"))


def _binned_source(columns: list[str], keep: str, source: str) -> str:
    probs = [i / 10 for i in range(1, 10)]
    cuts = ", ".join(f"quantile_cont({c}, {probs!r}) AS q_{c}" for c in columns)
    bins = ", ".join(
        " + ".join(f"CAST({c} >= q_{c}[{i}] AS INT)" for i in range(1, 10)) + f" AS {c}" for c in columns
    )
    return f"(SELECT {keep}, {bins} FROM {source} AS s, (SELECT {cuts} FROM {source}) AS cuts)"


@query("mutual_information_binned", mi_sql(
    {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "l_linestatus": "l_linestatus"}, "l_returnflag",
    _binned_source(["l_quantity", "l_extendedprice"], "l_returnflag, l_linestatus", "lineitem")))
def mutual_information_binned(t: Tables) -> DataFrame:
    df = t("lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")
    return A.mutual_information(df, "l_returnflag").select("column_name", F.round("mi_score", 6).alias("mi_score"))


@query("mutual_information_regression", mi_sql(
    {"p_size": "p_size", "p_brand": "p_brand", "p_type": "p_type"}, "p_retailprice",
    _binned_source(["p_size", "p_retailprice"], "p_brand, p_type", "part")))
def mutual_information_regression(t: Tables) -> DataFrame:
    """Continuous target: it is binned like the numeric features."""
    df = t("part").select("p_size", "p_brand", "p_type", "p_retailprice")
    return A.mutual_information(df, "p_retailprice").select("column_name", F.round("mi_score", 6).alias("mi_score"))


@query("target_kind", """
SELECT 'l_returnflag' AS target, true AS is_classification FROM lineitem HAVING count(*) > 0
UNION ALL SELECT 'l_linenumber', count(DISTINCT l_linenumber) <= 10 FROM lineitem
UNION ALL SELECT 'l_extendedprice', count(DISTINCT l_extendedprice) <= 10 FROM lineitem""")
def target_kind(t: Tables) -> DataFrame:
    df = t("lineitem")
    return df.limit(1).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("target"), F.lit(A.is_classification_target(df, c)).alias("is_classification"))
                    for c in ("l_returnflag", "l_linenumber", "l_extendedprice")
                ]
            )
        )
    )


@query("target_rank_correlation", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(abs({_rank_corr_sql(c, 'l_extendedprice')}), 6) AS spearman_corr"
    for c in ("l_quantity", "l_discount", "net_price")))
def target_rank_correlation(t: Tables) -> DataFrame:
    found = A.target_rank_correlation(_lines(t), "l_extendedprice", ["l_quantity", "l_discount", "net_price"])
    return found.withColumn("spearman_corr", F.round("spearman_corr", 6))


_LEAK_SOURCE = """(SELECT event_id, user_id, value, value * 3 + 1 AS leak,
CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS target FROM events)"""


@query("leakage_correlation", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(corr({c}, try_cast(target AS DOUBLE)), 6) AS correlation FROM {_LEAK_SOURCE} "
    f"HAVING abs(corr({c}, try_cast(target AS DOUBLE))) >= 0.97" for c in ("event_id", "user_id", "value", "leak")))
def leakage_correlation(t: Tables) -> DataFrame:
    """The target is text with unreadable values; only readable ones count."""
    df = t("events").select(
        "event_id", "user_id", "value", (F.col("value") * 3 + 1).alias("leak"),
        F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string")).alias("target"),
    )
    return A.leakage_correlation(df, "target").withColumn("correlation", F.round("correlation", 6))


@query("median_impute", """
WITH f AS (SELECT c_custkey, nullif(c_nationkey, 7) AS a, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS b FROM customer)
SELECT c_custkey, round(coalesce(a, (SELECT median(a) FROM f)), 4) AS a, round(coalesce(b, (SELECT median(b) FROM f)), 4) AS b FROM f""")
def median_impute(t: Tables) -> DataFrame:
    df = t("customer").select(
        "c_custkey", F.nullif("c_nationkey", F.lit(7)).alias("a"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")).alias("b"),
    )
    filled = AN.median_filled(df, "c_custkey", ["a", "b"])
    return filled.select("c_custkey", F.round(F.col("vec")[0], 4).alias("a"), F.round(F.col("vec")[1], 4).alias("b"))


_DISTANCE = "list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query("nearest_neighbours", f"""
SELECT vec_id, neighbour, rank, round(distance, 6) AS distance FROM (
  SELECT a.vec_id, b.vec_id AS neighbour, {_DISTANCE} AS distance,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DISTANCE}, b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 20""")
def nearest_neighbours(t: Tables) -> DataFrame:
    found = N.nearest_neighbours(t("embeddings"), None, "vec_id", F.col("embedding"), 20)
    return found.select("vec_id", "neighbour", F.col("rank").cast("bigint").alias("rank"), F.round("distance", 6).alias("distance"))


@query("nearest_neighbours_pruned", """
SELECT c_custkey, neighbour, rank, round(distance, 6) AS distance FROM (
  SELECT a.c_custkey, b.c_custkey AS neighbour, sqrt(pow(a.c_nationkey - b.c_nationkey, 2) + pow(a.c_acctbal - b.c_acctbal, 2)) AS distance,
         row_number() OVER (PARTITION BY a.c_custkey ORDER BY
           sqrt(pow(a.c_nationkey - b.c_nationkey, 2) + pow(a.c_acctbal - b.c_acctbal, 2)), b.c_custkey) AS rank
  FROM customer a JOIN customer b ON a.c_custkey <> b.c_custkey) WHERE rank <= 5""")
def nearest_neighbours_pruned(t: Tables) -> DataFrame:
    """The same join by pivots and blocks, the way it runs when no side fits one task."""
    c = t("customer")
    vec = N.vector_of(c, ["c_nationkey", "c_acctbal"])
    found = N.nearest_neighbours(c, None, "c_custkey", vec, 5)
    return found.select("c_custkey", "neighbour", F.col("rank").cast("bigint").alias("rank"), F.round("distance", 6).alias("distance"))


_LOF = """
WITH p AS (SELECT {key} AS id, {x} AS x, {y} AS y FROM {table}),
d AS (SELECT a.id, b.id AS o, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist FROM p a JOIN p b ON a.id <> b.id),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, o) AS rn FROM d)
       WHERE rn <= least(20, (SELECT count(*) - 1 FROM p))),
kd AS (SELECT id, max(dist) AS kdist FROM nn GROUP BY id),
lrd AS (SELECT nn.id, 1 / (avg(greatest(kd.kdist, nn.dist)) + 1e-10) AS lrd FROM nn JOIN kd ON kd.id = nn.o GROUP BY nn.id)
SELECT nn.id AS {key}, round(avg(b.lrd) / max(a.lrd), 5) AS lof, avg(b.lrd) / max(a.lrd) > 1.5 AS is_outlier
FROM nn JOIN lrd a ON a.id = nn.id JOIN lrd b ON b.id = nn.o GROUP BY nn.id"""


@query("local_outlier_factor", _LOF.format(key="s_suppkey", x="s_nationkey", y="s_acctbal", table="supplier"))
def local_outlier_factor(t: Tables) -> DataFrame:
    s = t("supplier")
    found = N.local_outlier_factor(s, "s_suppkey", N.vector_of(s, ["s_nationkey", "s_acctbal"]))
    return found.withColumn("lof", F.round("lof", 5))


@query("local_outlier_factor_customers", _LOF.format(key="c_custkey", x="c_nationkey", y="c_acctbal", table="customer"))
def local_outlier_factor_customers(t: Tables) -> DataFrame:
    c = t("customer")
    found = N.local_outlier_factor(c, "c_custkey", N.vector_of(c, ["c_nationkey", "c_acctbal"]))
    return found.withColumn("lof", F.round("lof", 5))


@query("isolation_forest")
def isolation_forest(t: Tables) -> DataFrame:
    return AN.isolation_forest(t("embeddings"), "vec_id", F.col("embedding"))


@query("isolation_forest_lines")
def isolation_forest_lines(t: Tables) -> DataFrame:
    """Every order scored by its price, date and customer."""
    o = t("orders").withColumn("day", F.unix_date(F.to_date("o_orderdate")))
    return AN.isolation_forest(o, "o_orderkey", N.vector_of(o, ["o_totalprice", "day", "o_custkey"]))


@query("anomaly_consensus")
def anomaly_consensus(t: Tables) -> DataFrame:
    found = AN.detect_anomalies(t("customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_custkey")
    return AN.anomaly_summary(found)


@query("anomaly_flags")
def anomaly_flags(t: Tables) -> DataFrame:
    s = t("supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return AN.apply_anomaly_action(s, "s_suppkey", AN.detect_anomalies(s, "s_suppkey"), "flag").rows


# Digammas of whole numbers, without the constant, which cancels out.
_PSI = "coalesce(list_sum(list_transform(range(1, {n}), lambda i: 1.0 / i)), 0)"


def _near_information_sql(key: str, table: str, columns: dict[str, str], target: str) -> str:
    """The estimators in SQL: every pair of a block, the third distance within a class or in both columns, counts within it.

    ``columns`` are the continuous ones in the order of their noise; ``target`` is one of them or an expression of classes.
    """
    digest = lambda salt: digest_sql([key], salt)
    jitter = 1e-10
    scaled = ", ".join(
        f"({e}) / (SELECT stddev_pop({e}) FROM {table}) + ({digest(1 + i)} / 1152921504606846976.0 - 0.5) * {jitter!r} "
        f"* greatest(1, (SELECT avg(abs({e})) / stddev_pop({e}) FROM {table})) AS v{i}" for i, (c, e) in enumerate(columns.items()))
    place = {c: f"v{i}" for i, c in enumerate(columns)}
    by_class = target not in columns
    label = f", {target} AS label" if by_class else ""
    base = f"(SELECT {digest(0)} % CAST(ceil((SELECT count(*) FROM {table}) / 2048.0) AS BIGINT) AS block, {key} AS id, {scaled}{label} FROM {table})"
    psi = lambda n: _PSI.format(n=n)
    parts = []
    for c in columns:
        if c == target:
            continue
        if by_class:
            size = ", count(*) OVER (PARTITION BY block, label) AS size, count(*) OVER (PARTITION BY block) AS n"
            reach = "max(a.size) AS size, max(a.n) AS n, list_last(min(abs(a.x - b.x), 4) FILTER (WHERE a.label = b.label)) AS reach"
            kept = f"(SELECT block, id, label, {place[c]} AS x{size} FROM {base})"
            counts, terms = ["count(*) FILTER (WHERE abs(a.x - b.x) < r.reach)"], f"{psi('n')} + {psi('least(3, size - 1)')} - {psi('size')}"
        else:
            kept = f"(SELECT block, id, {place[c]} AS x, {place[target]} AS y, count(*) OVER (PARTITION BY block) AS n FROM {base})"
            reach = "max(a.n) AS n, list_last(min(greatest(abs(a.x - b.x), abs(a.y - b.y)), 4)) AS reach"
            counts = [f"count(*) FILTER (WHERE abs(a.{v} - b.{v}) < r.reach)" for v in "xy"]
            terms = f"{psi('n')} + {psi('3')}"
        size = "max(r.size) AS size, " if by_class else ""
        parts.append(f"""
SELECT '{c}' AS column_name, round(greatest(avg({terms} - {" - ".join(psi(f"n{i}") for i in range(len(counts)))}), 0), 4) AS mi_score FROM (
  WITH k AS MATERIALIZED {kept}, r AS MATERIALIZED (SELECT a.block, a.id, {reach} FROM k a JOIN k b ON a.block = b.block GROUP BY a.block, a.id)
  SELECT {size}max(r.n) AS n, {", ".join(f"{e} AS n{i}" for i, e in enumerate(counts))}
  FROM k a JOIN r ON r.block = a.block AND r.id = a.id JOIN k b ON a.block = b.block GROUP BY a.block, a.id)""")
    return " UNION ALL ".join(parts)


_DAYS = {"o_totalprice": "o_totalprice", "day": "date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))"}


_BAND = "CASE WHEN o_totalprice > 200000 THEN 'high' ELSE o_orderstatus END"


@query("neighbour_information_classes", _near_information_sql("o_orderkey", "orders", _DAYS, _BAND))
def neighbour_information_classes(t: Tables) -> DataFrame:
    o = t("orders").select("o_orderkey", "o_totalprice", F.unix_date(F.to_date("o_orderdate")).alias("day"), F.expr(_BAND).alias("band"))
    return NI.neighbour_mutual_information(o, "o_orderkey", "band").withColumn("mi_score", F.round("mi_score", 4))


_SIZES = {"p_size": "p_size", "half": "p_retailprice / 2 + p_size", "p_retailprice": "p_retailprice"}


@query("neighbour_information_numbers", _near_information_sql("p_partkey", "part", _SIZES, "p_retailprice"))
def neighbour_information_numbers(t: Tables) -> DataFrame:
    p = t("part").select("p_partkey", "p_size", (F.col("p_retailprice") / 2 + F.col("p_size")).alias("half"), "p_retailprice")
    return NI.neighbour_mutual_information(p, "p_partkey", "p_retailprice").withColumn("mi_score", F.round("mi_score", 4))
