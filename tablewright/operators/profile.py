"""Column profile: moments, quantiles, normality and three univariate outlier rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.hashing import text_key
from tablewright.functions.numeric import (
    adjusted_kurtosis,
    adjusted_skewness,
    as_number,
    is_numeric,
    normality_p,
    numeric_columns,
    present,
    quoted,
)
from tablewright.operators.order_stats import (
    ACCURACY,
    FETCH_ROWS,
    Sketch,
    bracket_scan,
    brackets_of,
    counted_in_packs,
    interpolated,
    quantile_ranks,
    ranked_values,
    resolved,
    sketch_aggs,
    sketch_of,
    sketch_points,
)
from tablewright.runtime import reread

QUARTILES = (0.25, 0.5, 0.75)
COLUMNS_PER_SCAN = 100

# Fixed values.
IQR_MULTIPLIER = 1.5
ZSCORE_LIMIT = 3.0
MODIFIED_ZSCORE_FACTOR = 0.6745
MODIFIED_ZSCORE_LIMIT = 3.5
IMBALANCE_LIMIT = 0.20
HIGH_MISSING_RATIO = 0.2

_REALS = ("skewness", "kurtosis", "mean", "std", "mad", "min", "max", "p25", "median", "p75", "normality_p_value",
          "iqr_lower", "iqr_upper")
_OUTLIERS = ("iqr", "zscore", "modified_zscore")

PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("column_name", T.StringType()),
        T.StructField("is_numeric", T.BooleanType()),
        T.StructField("num_rows", T.LongType()),
        T.StructField("missing_count", T.LongType()),
        T.StructField("missing_pct", T.DoubleType()),
        T.StructField("zero_variance", T.BooleanType()),
        *[T.StructField(name, T.DoubleType()) for name in _REALS],
        *[
            T.StructField(f"{rule}_outliers_{part}", T.LongType() if part == "count" else T.DoubleType())
            for rule in _OUTLIERS
            for part in ("count", "pct")
        ],
    ]
)


def column_statistics(df: DataFrame, stored: bool = False) -> list[dict]:
    """One record per column, by four steps whatever the number of rows: moments and sketches; quantiles; counts beyond their limits and sketches of the
    distances from the median; the median of those. A fifth is needed by columns with values so near the modified z limit that only the exact median tells.

    A step is one scan of every column with map-side aggregation. Of a ``stored`` table, whose columns are read apart at no cost (files, with expressions
    on their columns, or kept rows), a step reads each column up to three times instead: plain numbers are taken a few columns at a time, as Spark compiles few
    aggregates far better than many. Scalars and a bounded number of values per column come back, and go into the next step as literals.
    """
    rows = df.count()
    with reread(df.select(*[_prepared(df, f) for f in df.schema.fields]), rows) as kept:
        return _column_statistics(kept, rows, stored or kept is not df and kept.is_cached)


def _prepared(df: DataFrame, field: T.StructField) -> Column:
    c = quoted(field.name)
    if is_numeric(field.dataType):
        return as_number(df, field.name).alias(field.name)
    # Other columns are only tested for being constant.
    return (F.to_json(c) if isinstance(field.dataType, T.MapType) else c).alias(field.name)


def _column_statistics(df: DataFrame, rows: int, stored: bool = False) -> list[dict]:
    numeric = numeric_columns(df)
    # Prepared columns hold no NaN.
    exprs = {c: quoted(c).cast("double") for c in numeric}
    points = sketch_points(QUARTILES)
    moments = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "g1": F.skewness, "g2": F.kurtosis}
    if stored:
        numbers = counted_in_packs(df, [{f"{k}{i}": f(exprs[c]) for k, f in moments.items()} for i, c in enumerate(numeric)])
        first = {c: {k: numbers[f"{k}{i}"] for k in moments} | {"n": int(numbers[f"n{i}"])} for i, c in enumerate(numeric)}
        sketches = _sketches(df, exprs, {c: (r["n"], r["min"], r["max"]) for c, r in first.items()}, points)
    else:
        # Rows of (column name, value): the moments stay one short code path however wide the table is.
        x, first = F.col("x"), {}
        for start in range(0, len(numeric), COLUMNS_PER_SCAN):
            cells = F.array(*[F.struct(F.lit(c).alias("c"), exprs[c].alias("x")) for c in numeric[start:start + COLUMNS_PER_SCAN]])
            aggs = [*[f(x).alias(k) for k, f in moments.items()], *sketch_aggs(x, points)]
            first |= {r["c"]: r for r in df.select(F.inline(cells)).groupBy("c").agg(*aggs).collect()}
        sketches = {c: sketch_of(r, points) for c, r in first.items()}
    brackets = [b for c, s in sketches.items() for b in brackets_of(c, s, quantile_ranks(s.rows, QUARTILES))]
    others = [f for f in df.schema.fields if f.name not in numeric]
    aggs = []
    for i, f in enumerate(others):
        c = quoted(f.name)
        aggs += [F.count(c).alias(f"n{i}"), F.min(c).eqNullSafe(F.max(c)).alias(f"flat{i}")]
    row = bracket_scan(df, brackets, exprs, others=aggs, stored=stored)
    flat = {f.name: (row[f"n{i}"], row[f"flat{i}"]) for i, f in enumerate(others)}
    found, left = resolved(row, brackets, sketches)
    found = ranked_values(df, exprs, sketches, {}, found, left, stored)
    quantiles = {c: interpolated(c, s.rows, QUARTILES, found) for c, s in sketches.items()}

    records = []
    for field in df.schema.fields:
        stats = first.get(field.name)
        n = flat[field.name][0] if field.name in flat else stats["n"] if stats else 0
        record = {name: None for name in PROFILE_SCHEMA.fieldNames()}
        record.update(
            column_name=field.name, is_numeric=field.name in numeric, num_rows=rows,
            missing_count=rows - n, missing_pct=100.0 * (rows - n) / rows if rows else 0.0,
        )
        for rule in _OUTLIERS:
            record[f"{rule}_outliers_count"], record[f"{rule}_outliers_pct"] = 0, 0.0
        if field.name in flat:
            record["zero_variance"] = bool(flat[field.name][1])
        else:
            record["zero_variance"] = stats["std"] == 0.0 if n > 1 else True
            if n:
                p25, median, p75 = quantiles[field.name]
                span = IQR_MULTIPLIER * (p75 - p25)
                record.update(
                    mean=stats["mean"], std=stats["std"] if n > 1 else None, min=stats["min"], max=stats["max"],
                    skewness=adjusted_skewness(n, stats["g1"]), kurtosis=adjusted_kurtosis(n, stats["g2"]),
                    normality_p_value=normality_p(n, stats["g1"], stats["g2"]),
                    p25=p25, median=median, p75=p75, iqr_lower=p25 - span, iqr_upper=p75 + span,
                )
        records.append(record)

    filled = [r for r in records if r["median"] is not None]
    if not filled:
        return records
    names = [r["column_name"] for r in filled]
    distance = {r["column_name"]: F.abs(exprs[r["column_name"]] - F.lit(r["median"])) for r in filled}
    middle = sketch_points([0.5])
    groups = []
    for i, r in enumerate(filled):
        c = exprs[r["column_name"]]
        groups.append({f"iqr{i}": F.count_if((c < r["iqr_lower"]) | (c > r["iqr_upper"]))})
        if r["std"] and r["num_rows"] - r["missing_count"] > 5:
            groups[-1][f"z{i}"] = F.count_if(F.abs((c - r["mean"]) / r["std"]) > ZSCORE_LIMIT)
        if stored:
            groups[-1] |= {f"near{i}": F.min(distance[r["column_name"]]), f"far{i}": F.max(distance[r["column_name"]])}
    if stored:
        third = counted_in_packs(df, groups)
        ends = {r["column_name"]: (r["num_rows"] - r["missing_count"], third[f"near{i}"], third[f"far{i}"]) for i, r in enumerate(filled)}
        sketches = _sketches(df, distance, ends, middle)
    else:
        counts = [a.alias(k) for g in groups for k, a in g.items()]
        third = df.agg(*counts, *[a for i, c in enumerate(names) for a in sketch_aggs(distance[c], middle, str(i))]).first().asDict()
        sketches = {c: sketch_of(third, middle, str(i)) for i, c in enumerate(names)}
    brackets = [b for c, s in sketches.items() for b in brackets_of(c, s, quantile_ranks(s.rows, [0.5]))]
    # A MAD lies in its brackets, so distances well beyond what the widest allows are over the limit, and those within the narrowest are not.
    reach = {c: (min(b.low for b in brackets if b.name == c), max(b.high for b in brackets if b.name == c)) for c in names}
    scale = MODIFIED_ZSCORE_LIMIT / MODIFIED_ZSCORE_FACTOR
    bands = {c: (low * scale * (1 - 1e-9), high * scale * (1 + 1e-9)) for c, (low, high) in reach.items()}
    beyond = {c: {
        f"over{i}": F.count_if(distance[c] > bands[c][1]), f"near{i}": F.count_if((distance[c] >= bands[c][0]) & (distance[c] <= bands[c][1])),
    } for i, c in enumerate(names)}
    fourth = bracket_scan(df, brackets, distance, beyond, stored=stored)
    found, left = resolved(fourth, brackets, sketches)
    found = ranked_values(df, distance, sketches, {}, found, left, stored)
    modified = lambda d, r: MODIFIED_ZSCORE_FACTOR * d / r["mad"]
    open_columns = []
    for i, r in enumerate(filled):
        c, n = r["column_name"], r["num_rows"] - r["missing_count"]
        r["mad"] = interpolated(c, n, [0.5], found)[0]
        for rule, count in (("iqr", int(third[f"iqr{i}"])), ("zscore", int(third.get(f"z{i}", 0)))):
            r[f"{rule}_outliers_count"], r[f"{rule}_outliers_pct"] = count, 100.0 * count / n
        if not r["mad"] or n <= 5:
            continue
        k = next(k for k, b in enumerate(brackets) if b.name == c)
        if brackets[k].rows == n <= FETCH_ROWS:  # all distances are here
            ends = [(brackets[k].low, fourth[f"low_b{k}"])] + ([(brackets[k].high, fourth[f"high_b{k}"])] if brackets[k].high > brackets[k].low else [])
            held = fourth.get(f"held_b{k}") or []
            r["modified_zscore_outliers_count"] = int(sum(m for d, m in ends if modified(d, r) > MODIFIED_ZSCORE_LIMIT)) + sum(modified(d, r) > MODIFIED_ZSCORE_LIMIT for d in held)
        elif fourth[f"near{i}"]:
            open_columns.append(r)
        else:
            r["modified_zscore_outliers_count"] = int(fourth[f"over{i}"])
    if open_columns:
        fifth = df.agg(*[F.count_if(modified(distance[r["column_name"]], r) > MODIFIED_ZSCORE_LIMIT).alias(f"m{i}") for i, r in enumerate(open_columns)]).first()
        for i, r in enumerate(open_columns):
            r["modified_zscore_outliers_count"] = fifth[f"m{i}"]
    for r in filled:
        r["modified_zscore_outliers_pct"] = 100.0 * r["modified_zscore_outliers_count"] / (r["num_rows"] - r["missing_count"])
    return records


def _sketches(df: DataFrame, exprs: dict[str, Column], ends: dict[str, tuple], points: tuple[float, ...]) -> dict[str, Sketch]:
    """Sketches of columns whose count, least and largest value are known; a column of few rows needs no points."""
    at: dict[str, list[float]] = {}
    large = [c for c in exprs if ends[c][0] > FETCH_ROWS]
    for start in range(0, len(large), COLUMNS_PER_SCAN):
        some = large[start : start + COLUMNS_PER_SCAN]
        at |= zip(some, df.agg(*[F.percentile_approx(exprs[c], F.array(*map(F.lit, points)), F.lit(ACCURACY)) for c in some]).first())
    return {c: Sketch(*ends[c], points, tuple(at.get(c) or ())) for c in exprs}


def profile_columns(df: DataFrame, stored: bool = False) -> DataFrame:
    """The column profile as a table with one row per column of ``df``; ``stored`` as in ``column_statistics``."""
    return profile_table(df, column_statistics(df, stored))


def profile_table(df: DataFrame, records: list[dict]) -> DataFrame:
    rows = [tuple(r[name] for name in PROFILE_SCHEMA.fieldNames()) for r in records]
    return df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)


def missing_summary(df: DataFrame) -> DataFrame:
    """``(column_name, position, missing_ratio)`` from a single aggregate over the table."""
    ratios = df.agg(
        *[F.avg((~present(df, c)).cast("double")).alias(f"m{i}") for i, c in enumerate(df.columns)]
    )
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"),
                     F.coalesce(F.col(f"m{i}"), F.lit(0.0)).alias("missing_ratio"))
            for i, c in enumerate(df.columns)
        ]
    )
    return ratios.select(F.inline(pairs))


def first_missing(df: DataFrame, columns: int = 12) -> DataFrame:
    """Missing percent of the first columns, in table order."""
    return missing_summary(df).orderBy("position").limit(columns).select(
        "column_name", F.round(F.col("missing_ratio") * 100, 0).cast("bigint").alias("missing_pct")
    )


def mean_missing_ratio(df: DataFrame) -> DataFrame:
    return missing_summary(df).agg(F.avg("missing_ratio").alias("mean_missing_ratio"))


def quality_score(df: DataFrame, vif_items: int) -> DataFrame:
    """Score between 20 and 100, lowered by columns with many gaps and by collinear columns."""
    wide = missing_summary(df).agg(
        F.count("*").alias("columns"), F.count_if(F.col("missing_ratio") > HIGH_MISSING_RATIO).alias("gappy")
    )
    raw = 100 - F.col("gappy") / F.col("columns") * 40 - F.lit(vif_items) / F.col("columns") * 20
    score = F.greatest(F.lit(20), F.least(F.lit(100), F.floor(raw + 0.5))).cast("bigint")
    return wide.select("columns", "gappy", score.alias("quality_score"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row; NULLs and NaNs compare equal to themselves."""
    keys = [
        (text_key(quoted(f.name)) if isinstance(f.dataType, T.StringType) else quoted(f.name)).alias(f"c{i}")
        for i, f in enumerate(df.schema.fields)
    ]
    groups = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    return groups.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("num_rows"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"),
    ).withColumn(
        "duplicate_pct",
        F.coalesce(F.try_divide(F.col("duplicate_rows") * F.lit(100.0), F.col("num_rows")), F.lit(0.0)),
    )


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """``(class_label, rows, pct)`` of the rows whose target is present."""
    known = df.where(present(df, target))
    total = known.count()
    return known.groupBy(quoted(target).cast("string").alias("class_label")).agg(
        F.count("*").alias("rows"), (F.count("*") * F.lit(100.0) / F.lit(max(total, 1))).alias("pct")
    )


def target_imbalance(df: DataFrame, target: str) -> DataFrame:
    """Smallest against largest class; below 0.20 the target counts as imbalanced."""
    counts = df.where(present(df, target)).groupBy(quoted(target)).agg(F.count("*").alias("n"))
    ratio = F.when(F.count("*") > 1, F.min("n") / F.max("n")).otherwise(F.lit(1.0))
    return counts.agg(F.count("*").alias("classes"), ratio.alias("imbalance_ratio")).select(
        F.lit(target).alias("column_name"),
        "classes",
        "imbalance_ratio",
        (F.col("imbalance_ratio") < IMBALANCE_LIMIT).alias("is_imbalanced"),
    )


def preview(df: DataFrame, rows: int = 200) -> DataFrame:
    """Type, missing ratio and distinct count of the first rows only; the row limit is the feature."""
    head = df.limit(rows)
    aggs = []
    for i, c in enumerate(df.columns):
        ok = present(df, c)
        aggs += [F.avg((~ok).cast("double")).alias(f"m{i}"), F.count_distinct(F.when(ok, quoted(c))).alias(f"u{i}")]
    cells = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("dtype"),
                F.coalesce(F.col(f"m{i}"), F.lit(0.0)).alias("missing_ratio"), F.col(f"u{i}").alias("unique_count"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
    )
    return head.agg(*aggs).select(F.inline(cells))


__all__ = [
    "class_distribution", "column_statistics", "duplicate_rows", "first_missing",
    "mean_missing_ratio", "missing_summary", "preview", "profile_columns", "profile_table", "quality_score",
    "target_imbalance",
]
