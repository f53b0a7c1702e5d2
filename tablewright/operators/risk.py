"""Quality and leakage rules: each is a filter and projection over a report table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits, severities and the advice given by each rule.
MISSING_CRITICAL_PCT = 50.0
MISSING_WARNING_PCT = 20.0
SKEW_LIMIT = 2.0
DUPLICATE_PCT = 5.0
VIF_LIMIT = 10.0
MI_LIMIT = 0.85
OUTLIER_PCT = 10.0
OUTLIER_MIN_ROWS = 4
FOREST_PCT = 5.0
PATTERN_TYPES = ("email", "url", "ip_address", "phone_number")
SEVERITIES = ("CRITICAL", "WARNING", "INFO")
ADVICE = {
    "Missing Values": "Drop the column or impute it.",
    "Zero Variance": "Drop the column; it carries no information.",
    "High Skewness": "Apply a log or power transform.",
    "Duplicate Rows": "Remove repeated rows before training.",
    "High Correlation": "Drop one of the two columns.",
    "Multicollinearity": "Remove the redundant column or regularise.",
    "Class Imbalance": "Balance class weights or stratify folds.",
    "Data Leakage": "Check whether the column is derived from the target.",
    "Strong Dependency": "Check when the column is collected.",
    "Outliers": "Cap the values or scale robustly.",
    "Multivariate Anomalies": "Inspect the extreme rows.",
    "High Cardinality": "Use target or frequency encoding instead of one-hot.",
    "Semantic Pattern": "Derive sub-features before encoding.",
}


def _number(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c)


def _risks(table: DataFrame, severity: Column | str, category: str, column: Column, text: Column) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return table.select(
        severity.alias("severity"), F.lit(category).alias("category"), column.cast("string").alias("column_name"),
        text.alias("description"), F.lit(ADVICE[category]).alias("recommendation"),
    )


def _col(name: str = "column_name") -> Column:
    return F.col(name)


def missing_risks(profile: DataFrame) -> DataFrame:
    pct = F.col("missing_pct")
    severity = F.when(pct >= MISSING_CRITICAL_PCT, "CRITICAL").otherwise("WARNING")
    text = F.concat(_number(pct, 1), F.lit("% of the values are missing"))
    return _risks(profile.where(pct >= MISSING_WARNING_PCT), severity, "Missing Values", _col(), text)


def zero_variance_risks(profile: DataFrame) -> DataFrame:
    return _risks(profile.where("zero_variance"), "WARNING", "Zero Variance", _col(), F.lit("the column is constant"))


def skew_risks(profile: DataFrame) -> DataFrame:
    text = F.concat(F.lit("skewness "), _number(F.col("skewness"), 2))
    return _risks(profile.where(F.abs("skewness") > SKEW_LIMIT), "WARNING", "High Skewness", _col(), text)


def outlier_risks(profile: DataFrame) -> DataFrame:
    enough = F.col("num_rows") - F.col("missing_count") >= OUTLIER_MIN_ROWS
    text = F.concat(_number(F.col("iqr_outliers_pct"), 1), F.lit("% of the values lie outside the fences"))
    table = profile.where(enough & (F.col("iqr_outliers_pct") > OUTLIER_PCT))
    return _risks(table, "WARNING", "Outliers", _col(), text)


def duplicate_risks(duplicates: DataFrame) -> DataFrame:
    text = F.concat(F.col("duplicate_rows").cast("string"), F.lit(" repeated rows"))
    return _risks(duplicates.where(F.col("duplicate_pct") > DUPLICATE_PCT), "WARNING", "Duplicate Rows", F.lit(None), text)


def correlation_risks(pairs: DataFrame) -> DataFrame:
    text = F.concat(F.lit("correlation "), _number(F.col("correlation"), 4))
    return _risks(pairs, "WARNING", "High Correlation", F.concat_ws(" ~ ", "col_a", "col_b"), text)


def collinearity_risks(vif: DataFrame) -> DataFrame:
    text = F.concat(F.lit("VIF "), _number(F.col("vif"), 1))
    return _risks(vif.where(F.col("vif") >= VIF_LIMIT), "WARNING", "Multicollinearity", _col(), text)


def imbalance_risks(imbalance: DataFrame) -> DataFrame:
    text = F.concat(F.lit("smallest to largest class "), _number(F.col("imbalance_ratio"), 4))
    return _risks(imbalance.where("is_imbalanced"), "WARNING", "Class Imbalance", _col(), text)


def leakage_risks(leaks: DataFrame) -> DataFrame:
    text = F.concat(F.lit("correlation with the target "), _number(F.col("correlation"), 4))
    return _risks(leaks, "CRITICAL", "Data Leakage", _col(), text)


def dependency_risks(mutual_information: DataFrame) -> DataFrame:
    text = F.concat(F.lit("mutual information "), _number(F.col("mi_score"), 3))
    return _risks(
        mutual_information.where(F.col("mi_score") >= MI_LIMIT), "WARNING", "Strong Dependency", _col(), text
    )


def anomaly_risks(summary: DataFrame) -> DataFrame:
    text = F.concat(
        F.col("isolation_forest_count").cast("string"), F.lit(" rows by isolation forest, "),
        F.col("lof_count").cast("string"), F.lit(" by local outlier factor"),
    )
    table = summary.where(F.col("isolation_forest_pct") > FOREST_PCT)
    return _risks(table, "WARNING", "Multivariate Anomalies", F.lit(None), text)


def cardinality_risks(schema: DataFrame) -> DataFrame:
    text = F.concat(F.col("unique_count").cast("string"), F.lit(" distinct values"))
    return _risks(schema.where("inferred_type = 'high_cardinality'"), "INFO", "High Cardinality", _col(), text)


def pattern_risks(schema: DataFrame) -> DataFrame:
    text = F.concat(F.lit("values have the form "), F.col("inferred_type"))
    return _risks(schema.where(F.col("inferred_type").isin(*PATTERN_TYPES)), "INFO", "Semantic Pattern", _col(), text)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "CRITICAL", 0).when(severity == "WARNING", 1).otherwise(2)


def all_risks(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def overall_severity(risks: DataFrame) -> DataFrame:
    """Worst severity and number of risks; INFO when there are none."""
    return risks.agg(
        F.coalesce(F.min_by("severity", severity_rank(F.col("severity"))), F.lit("INFO")).alias("overall_severity"),
        F.count("*").alias("total_risks"),
    )


def top_risks(risks: DataFrame, count: int = 10) -> DataFrame:
    """The most severe risks; the count is the size of the report."""
    return risks.orderBy(severity_rank(F.col("severity")), "category", "column_name").limit(count)
