"""Cleaning: explained column drops, outlier reports or capping, anomaly handling, and a summary."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.numeric import as_number, is_numeric, quoted
from tablewright.functions.text import is_id_name
from tablewright.operators.anomaly import apply_anomaly_action, detect_anomalies
from tablewright.operators.association import variance_inflation
from tablewright.operators.profile import column_statistics

# Fixed values.
OUTLIER_MIN_ROWS = 10
OUTLIER_MIN_PCT = 0.5
VIF_LIMIT = 10.0


@dataclass
class CleanReport:
    original_rows: int = 0
    cleaned_rows: int = 0
    original_cols: int = 0
    cleaned_cols: int = 0
    cols_dropped: list[tuple[str, str]] = field(default_factory=list)
    outlier_diagnostics: list[tuple[str, int, float, float, float]] = field(default_factory=list)
    capped_columns: list[str] = field(default_factory=list)
    vif_diagnostics: list[tuple[str, float]] = field(default_factory=list)
    anomaly_action: str = "report"
    anomaly_rows: int = 0
    consensus_pct: float = 0.0

    @property
    def rows_removed(self) -> int:
        return self.original_rows - self.cleaned_rows


def planned_drops(columns: list[str], ignored: list[str], constant: list[str], target: str | None) -> list[tuple[str, str]]:
    """Columns to drop with their reason: ignored or id columns first, then constant ones; never the target."""
    first = [
        (c, "Explicitly Ignored" if c in ignored else "Non-predictive ID Column")
        for c in columns
        if c != target and (c in ignored or is_id_name(c, target))
    ]
    gone = {c for c, _ in first}
    return first + [(c, "Zero Variance") for c in columns if c in constant and c not in gone and c != target]


def drop_zero_variance(df: DataFrame, target: str | None = None) -> DataFrame:
    flat = [r["column_name"] for r in column_statistics(df) if r["zero_variance"] and r["column_name"] != target]
    return df.drop(*flat)


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a value in every given column are left out; NaN counts as no value."""
    return df.dropna(subset=columns)


def outlier_columns(records: list[dict], target: str | None = None) -> list[dict]:
    """Columns whose share of values outside the quartile fences is above half a percent."""
    return [
        r for r in records
        if r["is_numeric"] and r["column_name"] != target
        and r["num_rows"] - r["missing_count"] >= OUTLIER_MIN_ROWS
        and r["p75"] != r["p25"] and r["iqr_outliers_pct"] > OUTLIER_MIN_PCT
    ]


def clip(x: Column, low: float, high: float) -> Column:
    """Values forced into the bounds; NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def winsorize(df: DataFrame, records: list[dict]) -> DataFrame:
    """Clips the given profiled columns to their quartile fences."""
    return df.withColumns(
        {r["column_name"]: clip(as_number(df, r["column_name"]), r["iqr_lower"], r["iqr_upper"]) for r in records}
    )


def clean_dataset(
    df: DataFrame,
    key: str,
    target: str | None = None,
    ignored: list[str] | None = None,
    outlier_action: str = "report",
    drop_high_vif: bool = False,
    anomaly_action: str = "report",
    records: list[dict] | None = None,
) -> tuple[DataFrame, CleanReport]:
    """The cleaned table and its report. The row key survives, so anomalous rows can be traced and removed.

    ``records`` takes an existing profile, so a table already profiled is not scanned again.
    """
    if outlier_action not in ("report", "cap"):
        raise ValueError(f"unknown outlier action: {outlier_action}")
    records = records if records is not None else column_statistics(df)
    rows = records[0]["num_rows"] if records else df.count()
    report = CleanReport(original_rows=rows, original_cols=len(df.columns), anomaly_action=anomaly_action)

    constant = [r["column_name"] for r in records if r["zero_variance"]]
    report.cols_dropped = planned_drops([c for c in df.columns if c != key], ignored or [], constant, target)
    out = df.drop(*[c for c, _ in report.cols_dropped])

    collinear = variance_inflation(df, shown_from=VIF_LIMIT).collect()
    report.vif_diagnostics = [(r["column_name"], r["vif"]) for r in collinear if r["column_name"] != target]
    if drop_high_vif:
        extra = [c for c, _ in report.vif_diagnostics if c in out.columns and c != key]
        report.cols_dropped += [(c, "High VIF") for c in extra]
        out = out.drop(*extra)

    present = [r for r in outlier_columns(records, target) if r["column_name"] in out.columns and r["column_name"] != key]
    report.outlier_diagnostics = [
        (r["column_name"], r["iqr_outliers_count"], r["iqr_outliers_pct"], r["iqr_lower"], r["iqr_upper"]) for r in present
    ]
    if outlier_action == "cap":
        out = winsorize(out, present)
        report.capped_columns = [r["column_name"] for r in present]

    measured = [c for c in out.columns if c != key and is_numeric(out.schema[c].dataType)]
    found = detect_anomalies(out.select(quoted(key), *[quoted(c) for c in measured]), key, target) if len(measured) > 1 else None
    outcome = apply_anomaly_action(out, key, found, anomaly_action)
    report.anomaly_rows, report.consensus_pct = outcome.affected, outcome.consensus_pct
    removed = outcome.affected if anomaly_action == "remove" else 0
    report.cleaned_rows = rows - removed
    report.cleaned_cols = len(outcome.rows.columns)
    return outcome.rows, report


def clean_summary(df: DataFrame, report: CleanReport) -> DataFrame:
    """The report as a table with one row."""
    return df.sparkSession.createDataFrame(
        [(
            report.original_rows, report.cleaned_rows, report.rows_removed, report.original_cols, report.cleaned_cols,
            [f"{c} ({reason})" for c, reason in report.cols_dropped], [r[0] for r in report.outlier_diagnostics],
            report.capped_columns, [c for c, _ in report.vif_diagnostics], report.anomaly_action, report.anomaly_rows,
        )],
        "original_rows bigint, cleaned_rows bigint, rows_removed bigint, original_cols int, cleaned_cols int, "
        "cols_dropped array<string>, outlier_columns array<string>, capped_columns array<string>, "
        "vif_columns array<string>, anomaly_action string, anomaly_rows bigint",
    )


__all__ = [
    "CleanReport", "clean_dataset", "clean_summary", "clip", "drop_incomplete", "drop_zero_variance",
    "outlier_columns", "planned_drops", "winsorize",
]
