"""Schema report, column profile, duplicates and target balance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.text import (
    EMAIL_PATTERN,
    IP_PATTERN,
    PHONE_PATTERN,
    URL_PATTERN,
    UUID_PATTERN,
    has_date_hint,
)
from tablewright.operators import profile as P
from tablewright.operators.association import variance_inflation
from tablewright.operators.schema import column_counts, infer_schema
from tablewright.workloads.registry import Tables, long_sql, query


def schema_sql(source: str, key: str, columns: list[tuple[str, str]]) -> str:
    """The schema report of string, whole and real columns, column by column."""
    parts = []
    for position, (c, dtype) in enumerate(columns):
        text = dtype == "string"
        first = f"(SELECT {c} AS v, row_number() OVER (ORDER BY {key}, {c}) AS rn FROM {source} WHERE {c} IS NOT NULL)"
        samples = f"(SELECT string_agg(CAST(v AS VARCHAR), '; ' ORDER BY rn) FROM {first} WHERE rn <= 3)"
        kind = "'numeric'"
        if dtype == "timestamp":
            kind = "'datetime'"
        if dtype in ("int", "bigint"):
            kind = f"CASE WHEN count(DISTINCT {c}) <= 2 THEN 'boolean' ELSE 'numeric' END"
        if c.lower() in ("lat", "latitude", "lon", "lng", "longitude"):
            limit = 90 if c.lower().startswith("lat") else 180
            kind = f"CASE WHEN min({c}) >= -{limit} AND max({c}) <= {limit} THEN 'spatial_coords' ELSE 'numeric' END"
        if text:
            every = lambda cond: f"(SELECT coalesce(bool_and({cond}), true) FROM {source} WHERE {c} IS NOT NULL)"
            words = (
                f"(SELECT median(len(string_split_regex(trim({c}), '\\s+'))) FROM {source} WHERE {c} IS NOT NULL)"
            )
            kind = "CASE "
            if has_date_hint(c):
                kind += f"WHEN {every(f'try_cast({c} AS TIMESTAMP) IS NOT NULL')} THEN 'datetime' "
            for name, pattern in (
                ("email", EMAIL_PATTERN), ("ip_address", IP_PATTERN), ("url", URL_PATTERN), ("uuid", UUID_PATTERN),
                ("phone_number", PHONE_PATTERN),
            ):
                cond = f"regexp_matches({c}, '" + pattern.replace("'", "''") + "')"
                kind += f"WHEN {every(cond)} THEN '{name}' "
            kind += (
                f"WHEN {words} >= 5 THEN 'text' WHEN count(DISTINCT {c}) / count(*) >= 0.8 THEN 'high_cardinality' "
                "ELSE 'categorical' END"
            )
        parts.append(
            f"SELECT '{c}' AS column_name, {position} AS position, '{dtype}' AS dtype, {kind} AS inferred_type, "
            f"count(*) - count({c}) AS null_count, round(100.0 * (count(*) - count({c})) / count(*), 4) AS null_pct, "
            f"count(DISTINCT {c}) AS unique_count, round(100.0 * count(DISTINCT {c}) / count(*), 4) AS unique_pct, "
            f"{samples} AS samples FROM {source}"
        )
    return " UNION ALL ".join(parts)


def _schema_report(df: DataFrame, key: str) -> DataFrame:
    return infer_schema(df, key).select(
        "column_name", "position", "dtype", "inferred_type", "null_count", F.round("null_pct", 4).alias("null_pct"),
        "unique_count", F.round("unique_pct", 4).alias("unique_pct"), F.array_join("sample_values", "; ").alias("samples"),
    )


@query("schema_customer", schema_sql("customer", "c_custkey", [
    ("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")]))
def schema_customer(t: Tables) -> DataFrame:
    return _schema_report(t("customer"), "c_custkey")


@query("schema_documents", schema_sql("documents", "doc_id", [
    ("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]))
def schema_documents(t: Tables) -> DataFrame:
    return _schema_report(t("documents"), "doc_id")


@query("schema_pages", schema_sql("pages", "page_id", [("page_id", "bigint"), ("url", "string"), ("html", "string")]))
def schema_pages(t: Tables) -> DataFrame:
    return _schema_report(t("pages"), "page_id")


@query("schema_labels", schema_sql("labels", "doc_id", [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")]))
def schema_labels(t: Tables) -> DataFrame:
    return _schema_report(t("labels"), "doc_id")


# Columns of every semantic type, made from each customer row by the same expressions in both engines.
_SEMANTIC = {
    "mail": ("concat('u', c_custkey, '@ex', c_nationkey, '.com')", "string"),
    "host": ("concat('10.0.', c_nationkey, '.', c_nationkey)", "string"),
    "link": ("concat('https://shop.example.com/c/', c_custkey)", "string"),
    "token": (
        "concat(substr(md5(c_name), 1, 8), '-', substr(md5(c_name), 9, 4), '-', substr(md5(c_name), 13, 4), '-', "
        "substr(md5(c_name), 17, 4), '-', substr(md5(c_name), 21, 12))",
        "string",
    ),
    "phone": ("concat('+1 555-', 1000000 + c_custkey)", "string"),
    "birth_date": ("concat('19', 50 + c_nationkey, '-05-17')", "string"),
    "note": ("concat('customer number ', c_custkey, ' of the segment ', c_mktsegment)", "string"),
    "late_change": ("CASE WHEN c_custkey <= 1400 THEN concat('u', c_custkey, '@ex.com') ELSE concat('shop', c_custkey) END", "string"),
    "mixed": ("CASE WHEN c_mktsegment = 'MACHINERY' THEN 'x' ELSE concat('u', c_nationkey, '@ex.com') END", "string"),
    "lat": ("CAST(c_nationkey AS DOUBLE)", "double"),
    "lon": ("c_acctbal", "double"),
    "is_large": ("CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END", "int"),
    "gaps": ("CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END", "string"),
}
_SEMANTIC_SOURCE = "(SELECT c_custkey, " + ", ".join(f"{e} AS {c}" for c, (e, _) in _SEMANTIC.items()) + " FROM customer)"


@query("semantic_types", schema_sql(
    _SEMANTIC_SOURCE, "c_custkey", [("c_custkey", "bigint"), *[(c, d) for c, (_, d) in _SEMANTIC.items()]]))
def semantic_types(t: Tables) -> DataFrame:
    df = t("customer").selectExpr("c_custkey", *[f"{e} AS {c}" for c, (e, _) in _SEMANTIC.items()])
    return _schema_report(df, "c_custkey")


_LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]


@query("column_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS num_rows, count(*) - count({c}) AS null_count, "
    f"count(DISTINCT {c}) AS unique_count FROM lineitem" for c in _LINEITEM))
def column_counts_query(t: Tables) -> DataFrame:
    return column_counts(t("lineitem"))


def profile_sql(columns: dict[str, str], source: str) -> str:
    return f"""
WITH long AS ({long_sql(columns, source)}),
s AS (SELECT column_name, count(*) AS num_rows, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS lo, max(v) AS hi,
      quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS p75, mad(v) AS mad,
      skewness(v) AS skew, kurtosis(v) AS kurt FROM long GROUP BY column_name),
o AS (SELECT l.column_name,
      count(*) FILTER (l.v < p25 - 1.5 * (p75 - p25) OR l.v > p75 + 1.5 * (p75 - p25)) AS iqr,
      count(*) FILTER (std > 0 AND abs((l.v - mean) / std) > 3) AS z,
      count(*) FILTER (mad > 0 AND 0.6745 * abs(l.v - med) / mad > 3.5) AS mz
      FROM long l JOIN s USING (column_name) GROUP BY l.column_name)
SELECT column_name, num_rows - n AS missing_count, round(100.0 * (num_rows - n) / num_rows, 6) AS missing_pct,
       std = 0 AS zero_variance, round(skew, 6) + 0.0 AS skewness, round(kurt, 6) + 0.0 AS kurtosis, round(mean, 7) AS mean,
       round(std, 6) AS std, round(mad, 6) AS mad, round(lo, 6) AS min_value, round(hi, 6) AS max_value, round(p25, 6) AS p25,
       round(p75, 6) AS p75, round(p25 - 1.5 * (p75 - p25), 6) + 0.0 AS iqr_lower, round(p75 + 1.5 * (p75 - p25), 6) AS iqr_upper,
       iqr AS iqr_count, round(100.0 * iqr / n, 6) AS iqr_pct, z AS zscore_count, round(100.0 * z / n, 6) AS zscore_pct,
       mz AS modified_count, round(100.0 * mz / n, 6) AS modified_pct
FROM s JOIN o USING (column_name)"""


def profile_report(df: DataFrame) -> DataFrame:
    r = lambda c, name=None: (F.round(c, 6) + 0.0).alias(name or c)
    return P.profile_columns(df, stored=True).where("is_numeric").select(
        "column_name", "missing_count", r("missing_pct"), "zero_variance", r("skewness"), r("kurtosis"), (F.round("mean", 7) + 0.0).alias("mean"), r("std"),
        r("mad"), r("min", "min_value"), r("max", "max_value"), r("p25"), r("p75"), r("iqr_lower"), r("iqr_upper"),
        F.col("iqr_outliers_count").alias("iqr_count"), r("iqr_outliers_pct", "iqr_pct"),
        F.col("zscore_outliers_count").alias("zscore_count"), r("zscore_outliers_pct", "zscore_pct"),
        F.col("modified_zscore_outliers_count").alias("modified_count"), r("modified_zscore_outliers_pct", "modified_pct"),
    )


@query("profile_lineitem", profile_sql({c: c for c in _LINEITEM[:8]}, "lineitem"))
def profile_lineitem(t: Tables) -> DataFrame:
    return profile_report(t("lineitem"))


@query("profile_with_gaps", profile_sql(
    {"value": "CASE WHEN event_type = 'error' THEN NULL ELSE value END", "user_id": "user_id",
     "squared": "value * value"}, "events"))
def profile_with_gaps(t: Tables) -> DataFrame:
    value = F.col("value")
    return profile_report(
        t("events").select(
            F.when(F.col("event_type") != "error", value).alias("value"), "user_id", (value * value).alias("squared")
        )
    )


SQL_NORMALITY = """
WITH long AS ({long}),
m AS (SELECT column_name, count(v)::DOUBLE AS n, skewness(v) AS gs, kurtosis(v) AS gk FROM long GROUP BY column_name),
g AS (SELECT column_name, n, gs * (n - 2) / sqrt(n * (n - 1)) AS g1, (gk * (n - 2) * (n - 3) / (n - 1) - 6) / (n + 1) AS g2 FROM m),
a AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
      sqrt(2 * (3 * (n*n + 27*n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
      (g2 + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
      6 * (n*n - 5*n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS s FROM g),
b AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, 6 + 8 / s * (2 / s + sqrt(1 + 4 / (s * s))) AS aa FROM a),
c AS (SELECT *, 1 + x * sqrt(2 / (aa - 4)) AS d FROM b)
SELECT column_name, CASE WHEN n >= 20 THEN round(exp(-(z1 * z1 + pow((1 - 2 / (9 * aa) - sign(d) * cbrt((1 - 2 / aa) / abs(d))) / sqrt(2 / (9 * aa)), 2)) / 2), 6) END
       AS normality_p_value FROM c"""


@query("normality_test", SQL_NORMALITY.format(long=" UNION ALL ".join([
    long_sql({"s_acctbal": "s_acctbal", "s_nationkey": "s_nationkey", "log_balance": "ln(abs(s_acctbal) + 1)"}, "supplier"),
])))
def normality_test(t: Tables) -> DataFrame:
    df = t("supplier").select("s_acctbal", "s_nationkey", F.log(F.abs("s_acctbal") + 1).alias("log_balance"))
    return P.profile_columns(df).select("column_name", F.round("normality_p_value", 6).alias("normality_p_value"))


@query("duplicate_rows", """
SELECT CAST(sum(c) AS BIGINT) AS num_rows, CAST(sum(c - 1) AS BIGINT) AS duplicate_rows, round(100.0 * sum(c - 1) / sum(c), 4) AS duplicate_pct
FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_quantity, l_discount, l_tax)""")
def duplicate_rows(t: Tables) -> DataFrame:
    found = P.duplicate_rows(t("lineitem").select("l_quantity", "l_discount", "l_tax"))
    return found.withColumn("duplicate_pct", F.round("duplicate_pct", 4))


@query("duplicate_documents", """
SELECT CAST(sum(c) AS BIGINT) AS num_rows, CAST(sum(c - 1) AS BIGINT) AS duplicate_rows, round(100.0 * sum(c - 1) / sum(c), 4) AS duplicate_pct
FROM (SELECT count(*) AS c FROM documents GROUP BY text, lang)""")
def duplicate_documents(t: Tables) -> DataFrame:
    found = P.duplicate_rows(t("documents").select("text", "lang"))
    return found.withColumn("duplicate_pct", F.round("duplicate_pct", 4))


@query("class_distribution", """
SELECT CAST(quality AS VARCHAR) AS class_label, count(*) AS num_rows, round(100.0 * count(*) / (SELECT count(*) FROM labels), 4) AS pct
FROM labels GROUP BY quality""")
def class_distribution(t: Tables) -> DataFrame:
    return P.class_distribution(t("labels"), "quality").select(
        "class_label", F.col("rows").alias("num_rows"), F.round("pct", 4).alias("pct")
    )


def _imbalance_sql(table: str, target: str) -> str:
    return (
        f"SELECT '{target}' AS column_name, count(*) AS classes, round(min(c) / max(c), 6) AS imbalance_ratio, "
        f"min(c) / max(c) < 0.2 AS is_imbalanced FROM (SELECT count(*) AS c FROM {table} GROUP BY {target})"
    )


@query("target_imbalance", " UNION ALL ".join([
    _imbalance_sql("labels", "quality"), _imbalance_sql("labels", "toxic"), _imbalance_sql("orders", "o_orderstatus")]))
def target_imbalance(t: Tables) -> DataFrame:
    labels = t("labels")
    parts = P.target_imbalance(labels, "quality").unionByName(P.target_imbalance(labels, "toxic")).unionByName(
        P.target_imbalance(t("orders"), "o_orderstatus")
    )
    return parts.withColumn("imbalance_ratio", F.round("imbalance_ratio", 6))


def _gappy(t: Tables) -> DataFrame:
    return t("lineitem").select(
        "l_returnflag", F.nullif("l_discount", F.lit(0.05)).alias("l_discount"),
        F.when(F.col("l_quantity") <= 20, F.col("l_quantity")).alias("l_quantity"), "l_extendedprice",
        (F.col("l_extendedprice") * 2 + 1).alias("doubled"),
    )


_GAPS = """(SELECT avg(CASE WHEN l_discount = 0.05 THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN l_quantity > 20 THEN 1.0 ELSE 0 END) AS b
FROM lineitem)"""


@query("missing_percent", f"""
SELECT 'l_returnflag' AS column_name, 0::BIGINT AS missing_pct FROM {_GAPS}
UNION ALL SELECT 'l_discount', CAST(floor(a * 100 + 0.5) AS BIGINT) FROM {_GAPS}
UNION ALL SELECT 'l_quantity', CAST(floor(b * 100 + 0.5) AS BIGINT) FROM {_GAPS}
UNION ALL SELECT 'l_extendedprice', 0 FROM {_GAPS} UNION ALL SELECT 'doubled', 0 FROM {_GAPS}""")
def missing_percent(t: Tables) -> DataFrame:
    return P.first_missing(_gappy(t))


@query("mean_missing_ratio", f"SELECT round((a + b) / 5, 6) AS mean_missing_ratio FROM {_GAPS}")
def mean_missing_ratio(t: Tables) -> DataFrame:
    return P.mean_missing_ratio(_gappy(t)).select(F.round("mean_missing_ratio", 6).alias("mean_missing_ratio"))


@query("quality_score", f"""
SELECT 5::BIGINT AS columns_seen, CAST((a > 0.2)::INT + (b > 0.2)::INT AS BIGINT) AS gappy_columns,
  CAST(greatest(20, least(100, floor(100 - ((a > 0.2)::INT + (b > 0.2)::INT) / 5.0 * 40 - 2 / 5.0 * 20 + 0.5))) AS BIGINT) AS quality_score
FROM {_GAPS}""")
def quality_score(t: Tables) -> DataFrame:
    df = _gappy(t)
    collinear = variance_inflation(df.select("l_extendedprice", "doubled")).count()
    return P.quality_score(df, collinear).select(
        F.col("columns").alias("columns_seen"), F.col("gappy").alias("gappy_columns"), "quality_score"
    )

