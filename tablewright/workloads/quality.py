"""Risk rules and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators import anomaly as AN
from tablewright.operators import association as A
from tablewright.operators import clean as C
from tablewright.operators import profile as P
from tablewright.operators import risk as R
from tablewright.operators.schema import infer_schema
from tablewright.workloads.registry import Tables, query

# One table with a column for every rule, made from all events by the same expressions in both engines.
_COLUMNS = {
    "event_id": "event_id", "user_id": "user_id", "value": "value",
    "mostly_missing": "CASE WHEN event_type = 'error' THEN value END",
    "often_missing": "CASE WHEN event_type = 'error' OR event_type = 'click' THEN NULL ELSE value END",
    "constant": "event_id * 0", "cubed": "value * value * value", "doubled": "value * 2 + 1",
    "outcome": "CASE WHEN value > 30 THEN 1 ELSE 0 END",
    "spiky": "CASE WHEN value > 12 THEN value ELSE user_id / 1000000.0 END",
}
_SOURCE = "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in _COLUMNS.items()) + " FROM events)"
_LONG = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS v FROM {_SOURCE}" for c in _COLUMNS)
_STATS = f"""(SELECT l.column_name, any_value(num_rows) AS num_rows, any_value(n) AS n, any_value(std) AS std, any_value(skew) AS skew,
 100.0 * count(*) FILTER (l.v < p25 - 1.5 * (p75 - p25) OR l.v > p75 + 1.5 * (p75 - p25)) / any_value(n) AS iqr_pct,
 count(*) FILTER (l.v < p25 - 1.5 * (p75 - p25) OR l.v > p75 + 1.5 * (p75 - p25)) AS iqr_count,
 any_value(p25) AS p25, any_value(p75) AS p75
 FROM ({_LONG}) l JOIN (SELECT column_name, count(*) AS num_rows, count(v) AS n, stddev_samp(v) AS std,
   CASE WHEN stddev_samp(v) = 0 THEN 0 ELSE skewness(v) END AS skew,
   quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.75) AS p75 FROM ({_LONG}) GROUP BY column_name) s USING (column_name)
 GROUP BY l.column_name)"""


def _events(t: Tables) -> DataFrame:
    return t("events").selectExpr(*[f"{e} AS {c}" for c, e in _COLUMNS.items()])


def _profile(t: Tables) -> DataFrame:
    return P.profile_columns(_events(t), stored=True)


def _short(risks: DataFrame) -> DataFrame:
    return risks.select("severity", "category", "column_name")


def _row(severity: str, category: str, where: str) -> str:
    return f"SELECT {severity} AS severity, '{category}' AS category, column_name FROM {_STATS} WHERE {where}"


_MISSING = _row(
    "CASE WHEN 100.0 * (num_rows - n) / num_rows >= 50 THEN 'CRITICAL' ELSE 'WARNING' END", "Missing Values",
    "100.0 * (num_rows - n) / num_rows >= 20",
)
_FLAT = _row("'WARNING'", "Zero Variance", "std = 0")
_SKEW = _row("'WARNING'", "High Skewness", "abs(skew) > 2")
_OUTLIER = _row("'WARNING'", "Outliers", "n >= 4 AND iqr_pct > 10")


@query("risk_missing", _MISSING)
def risk_missing(t: Tables) -> DataFrame:
    return _short(R.missing_risks(_profile(t)))


@query("risk_zero_variance", _FLAT)
def risk_zero_variance(t: Tables) -> DataFrame:
    return _short(R.zero_variance_risks(_profile(t)))


@query("risk_skew", _SKEW)
def risk_skew(t: Tables) -> DataFrame:
    return _short(R.skew_risks(_profile(t)))


@query("risk_outliers", _OUTLIER)
def risk_outliers(t: Tables) -> DataFrame:
    return _short(R.outlier_risks(_profile(t)))


_DUPLICATES = """SELECT 'WARNING' AS severity, 'Duplicate Rows' AS category, CAST(NULL AS VARCHAR) AS column_name
FROM (SELECT sum(c - 1) AS d, sum(c) AS n FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_quantity, l_discount, l_tax))
WHERE 100.0 * d / n > 5"""


@query("risk_duplicates", _DUPLICATES)
def risk_duplicates(t: Tables) -> DataFrame:
    return _short(R.duplicate_risks(P.duplicate_rows(t("lineitem").select("l_quantity", "l_discount", "l_tax"))))


_CORRELATED = """SELECT 'WARNING' AS severity, 'High Correlation' AS category, 'l_extendedprice ~ net' AS column_name
FROM lineitem HAVING abs(corr(l_extendedprice, l_extendedprice * (1 - l_discount))) >= 0.95"""


def _net(t: Tables) -> DataFrame:
    return t("lineitem").selectExpr("l_quantity", "l_extendedprice", "l_extendedprice * (1 - l_discount) AS net")


@query("risk_correlation", _CORRELATED)
def risk_correlation(t: Tables) -> DataFrame:
    return _short(R.correlation_risks(A.high_pairs(A.pearson_matrix(_net(t)))))


_VIF_ROWS = """(WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, net) AS ac, corr(l_extendedprice, net) AS bc
  FROM (SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS net FROM lineitem)),
 d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM r)
 SELECT 'l_quantity' AS column_name, (1 - bc * bc) / det AS vif FROM d
 UNION ALL SELECT 'l_extendedprice', (1 - ac * ac) / det FROM d UNION ALL SELECT 'net', (1 - ab * ab) / det FROM d)"""


@query("risk_collinearity", f"SELECT 'WARNING' AS severity, 'Multicollinearity' AS category, column_name FROM {_VIF_ROWS} WHERE vif >= 10")
def risk_collinearity(t: Tables) -> DataFrame:
    return _short(R.collinearity_risks(A.variance_inflation(_net(t))))


@query("risk_imbalance", """
SELECT 'WARNING' AS severity, 'Class Imbalance' AS category, 'toxic' AS column_name
FROM (SELECT count(*) AS c FROM labels GROUP BY toxic) HAVING min(c) / max(c) < 0.2""")
def risk_imbalance(t: Tables) -> DataFrame:
    return _short(R.imbalance_risks(P.target_imbalance(t("labels"), "toxic")))


_LEAKS = " UNION ALL ".join(
    f"SELECT 'CRITICAL' AS severity, 'Data Leakage' AS category, '{c}' AS column_name FROM {_SOURCE} HAVING abs(corr({c}, value)) >= 0.97"
    for c in ("event_id", "user_id", "doubled", "cubed", "spiky", "mostly_missing", "often_missing")
)


@query("risk_leakage", _LEAKS)
def risk_leakage(t: Tables) -> DataFrame:
    return _short(R.leakage_risks(A.leakage_correlation(_events(t).drop("constant", "outcome"), "value")))


@query("risk_dependency", """
WITH j AS (SELECT l_linenumber AS x, l_linenumber * 10 AS y, count(*)::DOUBLE AS c FROM lineitem GROUP BY 1, 2),
k AS (SELECT c, sum(c) OVER () AS n, sum(c) OVER (PARTITION BY x) AS cx, sum(c) OVER (PARTITION BY y) AS cy FROM j)
SELECT 'WARNING' AS severity, 'Strong Dependency' AS category, 'l_linenumber' AS column_name FROM k
HAVING sum(c / n * ln(c * n / (cx * cy))) >= 0.85""")
def risk_dependency(t: Tables) -> DataFrame:
    df = t("lineitem").select("l_linenumber", "l_returnflag", (F.col("l_linenumber") * 10).alias("target"))
    return _short(R.dependency_risks(A.discrete_mutual_information(df, ["l_linenumber", "l_returnflag"], "target")))


@query("risk_anomalies")
def risk_anomalies(t: Tables) -> DataFrame:
    found = AN.detect_anomalies(t("customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_custkey")
    return R.anomaly_risks(AN.anomaly_summary(found))


_CARDINALITY = """SELECT 'INFO' AS severity, 'High Cardinality' AS category, 'c_name' AS column_name FROM customer
HAVING count(DISTINCT c_name) / count(*) >= 0.8"""


@query("risk_high_cardinality", _CARDINALITY)
def risk_high_cardinality(t: Tables) -> DataFrame:
    return _short(R.cardinality_risks(infer_schema(t("customer"), "c_custkey")))


@query("risk_patterns", """
SELECT 'INFO' AS severity, 'Semantic Pattern' AS category, 'url' AS column_name
FROM (SELECT url FROM pages ORDER BY page_id LIMIT 30) HAVING bool_and(regexp_matches(url, '^https?://[^\\s/$.?#].[^\\s]*$'))""")
def risk_patterns(t: Tables) -> DataFrame:
    return _short(R.pattern_risks(infer_schema(t("pages"), "page_id")))


_SEVERITY = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END"
_ALL = " UNION ALL ".join([_MISSING, _FLAT, _SKEW, _OUTLIER, _DUPLICATES, _CARDINALITY])


def _all_risks(t: Tables) -> DataFrame:
    profile = _profile(t)
    return R.all_risks([
        R.missing_risks(profile), R.zero_variance_risks(profile), R.skew_risks(profile), R.outlier_risks(profile),
        R.duplicate_risks(P.duplicate_rows(t("lineitem").select("l_quantity", "l_discount", "l_tax"))),
        R.cardinality_risks(infer_schema(t("customer"), "c_custkey")),
    ])


@query("risk_overall", f"SELECT min_by(severity, {_SEVERITY}) AS overall_severity, count(*) AS total_risks FROM ({_ALL})")
def risk_overall(t: Tables) -> DataFrame:
    return R.overall_severity(_all_risks(t))


@query("risk_top", f"SELECT * FROM ({_ALL}) ORDER BY {_SEVERITY}, category, column_name NULLS FIRST LIMIT 10")
def risk_top(t: Tables) -> DataFrame:
    return _short(R.top_risks(_all_risks(t)))


@query("risk_descriptions")
def risk_descriptions(t: Tables) -> DataFrame:
    return _all_risks(t)


@query("clean_drops", f"""
SELECT 'user_id' AS column_name, 'Non-predictive ID Column' AS reason UNION ALL SELECT 'doubled', 'Explicitly Ignored'
UNION ALL SELECT 'event_id', 'Non-predictive ID Column'
UNION ALL SELECT column_name, 'Zero Variance' FROM {_STATS} WHERE std = 0""")
def clean_drops(t: Tables) -> DataFrame:
    df = _events(t)
    records = P.column_statistics(df)
    constant = [r["column_name"] for r in records if r["zero_variance"]]
    drops = C.planned_drops(df.columns, ["doubled"], constant, "outcome")
    return t.spark.createDataFrame(drops, "column_name string, reason string")


@query("clean_collinear", f"SELECT column_name, round(vif, 3) AS vif FROM {_VIF_ROWS} WHERE vif >= 10")
def clean_collinear(t: Tables) -> DataFrame:
    return A.variance_inflation(_net(t), shown_from=C.VIF_LIMIT).withColumn("vif", F.round("vif", 3))


@query("clean_outliers", f"""
SELECT column_name, iqr_count AS outliers, round(iqr_pct, 6) AS pct, round(p25 - 1.5 * (p75 - p25), 6) AS low, round(p75 + 1.5 * (p75 - p25), 6) AS high
FROM {_STATS} WHERE n >= 10 AND p75 <> p25 AND iqr_pct > 0.5 AND column_name <> 'outcome'""")
def clean_outliers(t: Tables) -> DataFrame:
    found = C.outlier_columns(P.column_statistics(_events(t)), "outcome")
    rows = [(r["column_name"], r["iqr_outliers_count"], r["iqr_outliers_pct"], r["iqr_lower"], r["iqr_upper"]) for r in found]
    table = t.spark.createDataFrame(rows, "column_name string, outliers bigint, pct double, low double, high double")
    return table.select("column_name", "outliers", *[F.round(c, 6).alias(c) for c in ("pct", "low", "high")])


@query("winsorize", """
WITH f AS (SELECT *, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v FROM events),
b AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM f)
SELECT event_id, round(CASE WHEN v IS NULL THEN NULL ELSE greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), v)) END, 6) AS value
FROM f, b""")
def winsorize(t: Tables) -> DataFrame:
    df = t("events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    capped = C.winsorize(df, C.outlier_columns(P.column_statistics(df), "event_id"))
    return capped.select("event_id", F.round("value", 6).alias("value"))


@query("clean_summary")
def clean_summary(t: Tables) -> DataFrame:
    df = t("customer").withColumns({"same": F.lit(1), "twice": F.col("c_acctbal") * 2})
    out, report = C.clean_dataset(df, "c_custkey", "c_mktsegment", ["c_name"], "cap", True, "remove")
    return C.clean_summary(out, report)


@query("cleaned_rows")
def cleaned_rows(t: Tables) -> DataFrame:
    out, _ = C.clean_dataset(t("supplier"), "s_suppkey", None, ["s_name"], "cap", False, "flag")
    return out

