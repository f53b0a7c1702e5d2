"""Feature transforms as ML stages: fitted on training rows only, applied to any rows, savable."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol, HasOutputCols
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.dates import DATE_PARTS, as_timestamp, date_part
from tablewright.functions.hashing import row_digest
from tablewright.functions.numeric import as_number, finite_or_null, is_numeric, present, quoted
from tablewright.functions.text import text_features
from tablewright.operators.order_stats import exact_quantiles
from tablewright.operators.ranking_values import running_totals
from tablewright.runtime import attach_lookup, cut_lineage, spread

# Fixed values.
IQR_MULTIPLIER = 1.5
ZSCORE_LIMIT = 3.0
VOCABULARY = 100
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
INTERACTION_COLUMNS = 4
CODE_RUNS = 512

#: Column that tells target codes which rows a pipeline was fitted on, and the salt of their inner folds.
FITTED, INNER_SALT = "_fitted", 7
#: Categories whose names go into the metadata of a vector.
NAMED_CATEGORIES = 10_000


class _Stage(HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Columns in, columns out; parameters are JSON, so stages save and load with their pipeline."""

    def _pairs(self) -> list[tuple[str, str]]:
        names = self.getInputCols()
        return list(zip(names, self.getOutputCols() if self.isSet("outputCols") else names))


class _Affine(_Stage):
    center = Param(Params._dummy(), "center", "value per column", TypeConverters.toListFloat)
    scale = Param(Params._dummy(), "scale", "value per column", TypeConverters.toListFloat)


class NumericImputer(Estimator, _Stage):
    """Fills gaps by the mean, median or most frequent value (the smallest wins a tie); ``none`` fills nothing and fitting fails on a gap."""

    strategy = Param(Params._dummy(), "strategy", "mean, median, most_frequent or none", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, strategy="median"):
        super().__init__()
        self._setDefault(strategy="median")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "NumericImputerModel":
        names, strategy = self.getInputCols(), self.getOrDefault("strategy")
        exprs = {c: as_number(df, c) for c in names}
        if strategy == "mean":
            row = df.agg(*[F.avg(exprs[c]) for c in names]).first()
            fills = list(row)
        elif strategy == "most_frequent":
            found = most_frequent(df, names)
            fills = [None if found[c] is None else float(found[c]) for c in names]
        elif strategy == "median":
            found = exact_quantiles(df, exprs, [0.5])
            fills = [found[c][0] for c in names]
        elif strategy == "none":
            gaps = df.agg(*[F.count_if(exprs[c].isNull()) for c in names]).first()
            if any(gaps):
                raise ValueError("no strategy for missing values, but values are missing in " + ", ".join(c for c, n in zip(names, gaps) if n))
            fills = [float("nan")] * len(names)
        else:
            raise ValueError(f"unknown imputing strategy: {strategy}")
        model = NumericImputerModel()
        model._set(inputCols=names, outputCols=[o for _, o in self._pairs()], fills=[f if f is not None else 0.0 for f in fills])
        return model


class NumericImputerModel(Model, _Stage):
    fills = Param(Params._dummy(), "fills", "value per column", TypeConverters.toListFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for (c, o), fill in zip(self._pairs(), self.getOrDefault("fills")):
            # Without a fill, a gap in a row to be transformed is an error that names its column.
            gap = F.raise_error(F.lit(f"missing value in {c}, and no strategy for missing values")).cast("double") if fill != fill else F.lit(fill)
            out[o] = F.coalesce(as_number(df, c), gap)
        return df.withColumns(out)


def most_frequent(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """Most frequent present value per column, in two counted steps; ties go to the smallest value."""
    if not columns:
        return {}
    kinds = {c: is_numeric(df.schema[c].dataType) for c in columns}
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"), F.when(present(df, c), quoted(c).cast("string")).alias("value"),
                (as_number(df, c) if kinds[c] else F.lit(None).cast("double")).alias("number"),
            )
            for c in columns
        ]
    )
    counts = df.select(F.inline(cells)).where("value IS NOT NULL").groupBy("column_name", "value").agg(
        F.count("*").alias("n"), F.min("number").alias("number")
    )
    best = counts.groupBy("column_name").agg(F.min_by("value", F.struct(-F.col("n"), "number", "value")).alias("value"))
    found = {r["column_name"]: r["value"] for r in best.collect()}
    return {c: found.get(c) for c in columns}


class CategoryImputer(Estimator, _Stage):
    """Fills gaps of string columns by the most frequent value."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "CategoryImputerModel":
        found = most_frequent(df, self.getInputCols())
        model = CategoryImputerModel()
        model._set(
            inputCols=self.getInputCols(), outputCols=[o for _, o in self._pairs()],
            fills=[found[c] if found[c] is not None else "" for c in self.getInputCols()],
        )
        return model


class CategoryImputerModel(Model, _Stage):
    fills = Param(Params._dummy(), "fills", "value per column", TypeConverters.toListString)

    def _transform(self, df: DataFrame) -> DataFrame:
        fills = self.getOrDefault("fills")
        return df.withColumns(
            {o: F.coalesce(F.when(present(df, c), quoted(c).cast("string")), F.lit(fills[i]))
             for i, (c, o) in enumerate(self._pairs())}
        )


class FenceCapper(Estimator, _Stage):
    """Clips numeric columns to limits learned in fit: quartile fences, or a number of deviations around the mean."""

    multiplier = Param(Params._dummy(), "multiplier", "width in quartile ranges or deviations", TypeConverters.toFloat)
    kind = Param(Params._dummy(), "kind", "iqr or zscore", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, multiplier=IQR_MULTIPLIER, kind="iqr"):
        super().__init__()
        self._setDefault(multiplier=IQR_MULTIPLIER, kind="iqr")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "FenceCapperModel":
        names, width, low, high = self.getInputCols(), self.getOrDefault("multiplier"), [], []
        exprs = {c: as_number(df, c) for c in names}
        if self.getOrDefault("kind") == "zscore":
            found = df.agg(*[f(finite_or_null(exprs[c])) for c in names for f in (F.avg, F.stddev_pop)]).first()
            for mean, deviation in zip(found[::2], found[1::2]):
                low.append(float("-inf") if mean is None else mean - width * deviation)
                high.append(float("inf") if mean is None else mean + width * deviation)
        else:
            found = exact_quantiles(df, exprs, [0.25, 0.75])
            for c in names:
                q1, q3 = found[c]
                low.append(float("-inf") if q1 is None else q1 - width * (q3 - q1))
                high.append(float("inf") if q3 is None else q3 + width * (q3 - q1))
        model = FenceCapperModel()
        model._set(inputCols=names, outputCols=[o for _, o in self._pairs()], lower=low, upper=high)
        return model


class FenceCapperModel(Model, _Stage):
    lower = Param(Params._dummy(), "lower", "value per column", TypeConverters.toListFloat)
    upper = Param(Params._dummy(), "upper", "value per column", TypeConverters.toListFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        low, high = self.getOrDefault("lower"), self.getOrDefault("upper")
        out = {}
        for i, (c, o) in enumerate(self._pairs()):
            x = as_number(df, c)
            out[o] = F.when(x.isNotNull(), F.greatest(F.lit(low[i]), F.least(F.lit(high[i]), x)))
        return df.withColumns(out)


class LogShift(Estimator, _Stage):
    """log1p of the value, shifted first when the training minimum is negative."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "LogShiftModel":
        names = self.getInputCols()
        lows = df.agg(*[F.min(as_number(df, c)) for c in names]).first()
        model = LogShiftModel()
        model._set(
            inputCols=names, outputCols=[o for _, o in self._pairs()],
            shift=[abs(v) + 1.0 if v is not None and v < 0 else 0.0 for v in lows],
        )
        return model


class LogShiftModel(Model, _Stage):
    shift = Param(Params._dummy(), "shift", "value per column", TypeConverters.toListFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        shift = self.getOrDefault("shift")
        # A value below the training minimum can leave the domain of the logarithm; it becomes NULL.
        return df.withColumns(
            {o: F.log1p(F.when(as_number(df, c) + shift[i] > -1, as_number(df, c) + F.lit(shift[i])))
             for i, (c, o) in enumerate(self._pairs())}
        )


class ColumnScaler(Estimator, _Stage):
    """Standard (population deviation), min-max or robust scaling of single columns."""

    kind = Param(Params._dummy(), "kind", "standard, minmax or robust", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, kind="standard"):
        super().__init__()
        self._setDefault(kind="standard")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "ColumnScalerModel":
        names, kind = self.getInputCols(), self.getOrDefault("kind")
        x = {c: as_number(df, c) for c in names}
        if kind == "standard":
            row = df.agg(*[f(x[c]) for c in names for f in (F.avg, F.stddev_pop)]).first()
            pairs = [(row[2 * i], row[2 * i + 1]) for i in range(len(names))]
        elif kind == "minmax":
            row = df.agg(*[f(x[c]) for c in names for f in (F.min, F.max)]).first()
            pairs = [(row[2 * i], None if row[2 * i] is None else row[2 * i + 1] - row[2 * i]) for i in range(len(names))]
        elif kind == "robust":
            found = exact_quantiles(df, x, [0.25, 0.5, 0.75])
            pairs = [(found[c][1], None if found[c][0] is None else found[c][2] - found[c][0]) for c in names]
        else:
            raise ValueError(f"unknown scaling: {kind}")
        model = ColumnScalerModel()
        model._set(
            inputCols=names, outputCols=[o for _, o in self._pairs()],
            center=[p[0] or 0.0 for p in pairs], scale=[p[1] or 1.0 for p in pairs],
        )
        return model


class ColumnScalerModel(Model, _Affine):
    def _transform(self, df: DataFrame) -> DataFrame:
        center, scale = self.getOrDefault("center"), self.getOrDefault("scale")
        return df.withColumns(
            {o: (as_number(df, c) - F.lit(center[i])) / F.lit(scale[i]) for i, (c, o) in enumerate(self._pairs())}
        )


class DateParts(Transformer, _Stage):
    """Calendar parts of date columns, one output column ``<column>_<part>`` each."""

    parts = Param(Params._dummy(), "parts", "calendar parts", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCols=None, parts=None):
        super().__init__()
        self._setDefault(parts=list(DATE_PARTS))
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def names(self) -> list[str]:
        wanted = [p for p in DATE_PARTS if p in self.getOrDefault("parts")]
        return [f"{c}_{p}" for c in self.getInputCols() for p in wanted]

    def _transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c in self.getInputCols():
            ts = as_timestamp(quoted(c), df.schema[c].dataType.simpleString())
            for p in DATE_PARTS:
                if p in self.getOrDefault("parts"):
                    out[f"{c}_{p}"] = date_part(ts, p)
        return df.withColumns(out)


class TextParts(Transformer, _Stage):
    """Structural features of e-mail, url, ip or other strings, named ``<column>_<feature>``."""

    semanticType = Param(Params._dummy(), "semanticType", "semantic type", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, semanticType="text"):
        super().__init__()
        self._setDefault(semanticType="text")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def names(self) -> list[str]:
        kind = self.getOrDefault("semanticType")
        return [f"{c}_{s}" for c in self.getInputCols() for s in text_features(F.lit(""), kind)]

    def _transform(self, df: DataFrame) -> DataFrame:
        kind = self.getOrDefault("semanticType")
        return df.withColumns(
            {f"{c}_{s}": e for c in self.getInputCols() for s, e in text_features(quoted(c), kind).items()}
        )


class Interactions(Transformer, _Stage):
    """Products of all pairs among the first four columns."""

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _products(self) -> list[tuple[str, str]]:
        names = self.getInputCols()[:INTERACTION_COLUMNS]
        return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]

    def names(self) -> list[str]:
        return [f"{a}_x_{b}" for a, b in self._products()]

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"{a}_x_{b}": as_number(df, a) * as_number(df, b) for a, b in self._products()})


class CategoryEncoder(Estimator, _Stage):
    """Frequency (share of present rows, unknown 0), ordinal (place in sorted order, unknown -1) or index (the same, unknown the number of categories) encoding.

    The fitted state is a table per column, so any number of categories works. Indexes of up to ``NAMED_CATEGORIES`` categories carry their names.
    """

    kind = Param(Params._dummy(), "kind", "frequency, ordinal or index", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, kind="frequency"):
        super().__init__()
        self._setDefault(kind="frequency")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "CategoryEncoderModel":
        kind = self.getOrDefault("kind")
        names = self.getInputCols()
        known = df.agg(F.count("*"), *[F.count_if(present(df, c)) for c in names]).first()
        tables = {}
        for c, _ in self._pairs():
            value = F.when(present(df, c), quoted(c).cast("string")).alias("value")
            counts = df.select(value).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))
            if kind == "frequency":
                total = known[1 + names.index(c)]
                tables[c] = cut_lineage(counts.withColumn("code", F.col("n") / F.lit(float(max(total, 1)))))
            else:
                tables[c] = sorted_codes(counts)
        model = CategoryEncoderModel(tables)
        model._set(
            inputCols=self.getInputCols(), outputCols=[o for _, o in self._pairs()],
            unknown=0.0 if kind == "frequency" else -1.0, fittedRows=known[0],
        )
        if kind == "index":
            model.tables = {c: cut_lineage(table) for c, table in tables.items()}
            model._set(sizes=[table.count() for table in model.tables.values()])
        return model


def sorted_codes(counts: DataFrame) -> DataFrame:
    """``(value, n, code)``: the 0-based place of every distinct string in sorted order.

    Strings are cut into runs between strings drawn by hash, so runs are even even when all strings begin alike; each run is
    ordered on its own and starts where the one before ends.
    """
    counts = cut_lineage(counts)
    drawn = counts.select("value").orderBy(F.xxhash64("value"), "value").limit(CODE_RUNS).collect()
    cuts = F.lit(sorted(r["value"] for r in drawn))
    runs = counts.withColumn("__run", F.size(F.filter(cuts, lambda cut: cut <= F.col("value"))))
    before = Window.partitionBy(F.lit(0)).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    # One row per run: at most CODE_RUNS + 1.
    starts = runs.groupBy("__run").agg(F.count("*").alias("__size")).select(
        "__run", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start")
    )
    inside = F.row_number().over(Window.partitionBy("__run").orderBy("value")) - 1
    return runs.join(F.broadcast(starts), "__run").select(
        "value", "n", (F.col("__start") + inside).cast("double").alias("code")
    )


class CategoryEncoderModel(Model, HasInputCols, HasOutputCols, MLReadable, MLWritable):
    unknown = Param(Params._dummy(), "unknown", "code of unseen categories", TypeConverters.toFloat)
    fittedRows = Param(Params._dummy(), "fittedRows", "rows seen in fit", TypeConverters.toInt)
    sizes = Param(Params._dummy(), "sizes", "categories of each column, for indexes", TypeConverters.toListInt)

    def __init__(self, tables: dict[str, DataFrame] | None = None):
        super().__init__()
        self.tables = tables or {}

    def _nominal(self, column: str, size: int) -> dict:
        """ML attributes of an index: how many categories, and their names if they are few enough to list."""
        if not 0 < size <= NAMED_CATEGORIES:
            return {"ml_attr": {"type": "nominal", "num_vals": max(size, 1)}}
        names = [r["value"] for r in self.tables[column].orderBy("code").select("value").collect()]
        return {"ml_attr": {"type": "nominal", "vals": names}}

    def _transform(self, df: DataFrame) -> DataFrame:
        # Shares of the fitted rows tell which categories are heavy, so the rows need no count of their own.
        total = max(self.getOrDefault("fittedRows"), 1)
        sizes = self.getOrDefault("sizes") if self.isSet("sizes") else None
        for i, (c, o) in enumerate(zip(self.getInputCols(), self.getOutputCols())):
            unknown = self.getOrDefault("unknown") if sizes is None else float(sizes[i])
            table = self.tables[c].select(F.col("value").alias("__value"), "n", F.col("code").alias("__code"))
            df = df.withColumn("__value", quoted(c).cast("string"))
            df = attach_lookup(df, table, ["__value"], total, "n")
            df = df.withColumn(o, F.coalesce("__code", F.lit(unknown))).drop("__value", "__code")
            if sizes is not None:
                df = df.withMetadata(o, self._nominal(c, sizes[i]))
        return df

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


class TargetMeans(Estimator, _Stage):
    """Mean of the label, or of each class, per category: one column for a number or for class 1 of two, else one per class.

    Fitting adds up label and rows by category and inner fold, which is a digest of ``foldCols``, so that equal rows share one. Where the column ``FITTED``
    says that a row was fitted, the sums of its own inner fold are left out of its code, its own label with them; other rows get all sums. Codes are drawn to
    the mean of all categories as by ``smoothing`` rows more; unknown categories have that mean.
    """

    labelCol = Param(Params._dummy(), "labelCol", "label", TypeConverters.toString)
    foldCols = Param(Params._dummy(), "foldCols", "columns whose digest is the inner fold", TypeConverters.toListString)
    classes = Param(Params._dummy(), "classes", "classes of the label, 0 for a number", TypeConverters.toInt)
    folds = Param(Params._dummy(), "folds", "inner folds", TypeConverters.toInt)
    smoothing = Param(Params._dummy(), "smoothing", "rows of the mean that are added", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, labelCol="label", foldCols=None, classes=0, folds=5, smoothing=10.0):
        super().__init__()
        self._setDefault(labelCol="label", classes=0, folds=5, smoothing=10.0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def names(self) -> list[str]:
        return [n for _, o in self._pairs() for n in target_names(o, self.getOrDefault("classes"))]

    def _fit(self, df: DataFrame) -> "TargetMeansModel":
        get = self.getOrDefault
        label, classes, folds = F.col(get("labelCol")).cast("double"), get("classes"), get("folds")
        known = df.where(label.isNotNull()).withColumn("__fold", inner_fold(df, get("foldCols"), folds))
        # Rows first, then the label, or class after class.
        cells = [F.lit(1.0), *([label] if not classes else [(label == c).cast("double") for c in target_classes(classes)])]
        tables = {}
        for c in self.getInputCols():
            value = F.when(present(df, c), quoted(c).cast("string")).alias("value")
            cube = known.select("__fold", value, *[x.alias(f"x{k}") for k, x in enumerate(cells)]).groupBy("value", "__fold").agg(*[F.sum(f"x{k}").alias(f"s{k}") for k in range(len(cells))])
            by_fold = F.array(*[F.array(*[F.coalesce(F.sum(F.when(F.col("__fold") == f, F.col(f"s{k}"))), F.lit(0.0)) for k in range(len(cells))]) for f in range(folds)])
            tables[c] = cut_lineage(cube.groupBy("value").agg(F.sum("s0").cast("bigint").alias("n"), by_fold.alias("code")))
        held = {r["__fold"]: list(r)[1:] for r in known.groupBy("__fold").agg(*[F.sum(x).alias(f"s{k}") for k, x in enumerate(cells)]).collect()}
        model = TargetMeansModel(tables)
        model._set(
            inputCols=self.getInputCols(), outputCols=[o for _, o in self._pairs()], labelCol=get("labelCol"), foldCols=get("foldCols"), classes=classes, folds=folds,
            smoothing=get("smoothing"), totals=[x for f in range(folds) for x in held.get(f, [0.0] * len(cells))],
        )
        return model


def target_classes(classes: int) -> list[int]:
    return [1] if classes == 2 else list(range(classes))


def target_names(output: str, classes: int) -> list[str]:
    return [f"{output}_{k}" for k in range(classes)] if classes > 2 else [output]


def inner_fold(df: DataFrame, columns: list[str], folds: int) -> Column:
    return F.pmod(row_digest(df, columns, INNER_SALT), F.lit(folds)).cast("int")


class TargetMeansModel(Model, HasInputCols, HasOutputCols, MLReadable, MLWritable):
    """``tables`` hold, per category, the rows (``n``) and for each inner fold the sums of rows and labels (``code``)."""

    labelCol, foldCols, classes, folds, smoothing = TargetMeans.labelCol, TargetMeans.foldCols, TargetMeans.classes, TargetMeans.folds, TargetMeans.smoothing
    totals = Param(Params._dummy(), "totals", "sums of each inner fold over all categories", TypeConverters.toListFloat)

    def __init__(self, tables: dict[str, DataFrame] | None = None):
        super().__init__()
        self.tables = tables or {}

    def _transform(self, df: DataFrame) -> DataFrame:
        get = self.getOrDefault
        folds, smoothing = get("folds"), get("smoothing")
        width = len(get("totals")) // folds
        all_folds = F.array(*[F.array(*map(F.lit, get("totals")[f * width:(f + 1) * width])) for f in range(folds)])
        marked = FITTED in df.columns
        own = F.when(F.col(FITTED), F.col("__own")) if marked else F.lit(None).cast("int")
        # Without a fitted row's own fold; NULL, and so nothing left out, for other rows.
        kept = lambda sums, k: F.aggregate(sums, F.lit(0.0), lambda a, s: a + s[k]) - F.coalesce(F.get(sums, own)[k], F.lit(0.0))
        names = df.columns
        df = df.withColumn("__own", inner_fold(df, get("foldCols"), folds)) if marked else df
        total = max(int(sum(get("totals")[::width])), 1)
        out = []
        for c, o in zip(self.getInputCols(), self.getOutputCols()):
            table = self.tables[c].select(F.col("value").alias("__value"), "n", F.col("code").alias("__sums"))
            df = attach_lookup(df.withColumn("__value", quoted(c).cast("string")), table, ["__value"], total, "n")
            sums = F.coalesce("__sums", F.array(*[F.array(*[F.lit(0.0)] * width) for _ in range(folds)]))
            for k, name in enumerate(target_names(o, get("classes"))):
                mean = F.coalesce(F.try_divide(kept(all_folds, k + 1), kept(all_folds, 0)), F.lit(0.0))
                code = F.try_divide(kept(sums, k + 1) + F.lit(smoothing) * mean, kept(sums, 0) + F.lit(smoothing))
                df = df.withColumn(name, F.coalesce(code, mean))
                out.append(name)
            df = df.drop("__value", "__sums")
        return df.select(*[quoted(c) for c in names if c not in out], *[quoted(c) for c in out])

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


class _TableWriter(MLWriter):
    def __init__(self, instance: CategoryEncoderModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        for i, c in enumerate(self.instance.getInputCols()):
            self.instance.tables[c].write.mode("overwrite").parquet(f"{path}/tables/{i}")


class _TableReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> CategoryEncoderModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.tables = {
            c: self.sparkSession.read.parquet(f"{path}/tables/{i}") for i, c in enumerate(model.getInputCols())
        }
        return model


# --- text -----------------------------------------------------------------------------------------------------


def tokens(text: Column) -> Column:
    """Lower-case runs of two or more letters, digits or underscores; punctuation and single characters fall away."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN_PATTERN})"), F.lit(1))


def _tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(quoted(key).alias("key"), F.explode(tokens(quoted(text))).alias("term"))


def _top_terms(words: DataFrame, size: int) -> DataFrame:
    return words.groupBy("term").agg(F.count("*").alias("corpus_count")).orderBy(F.desc("corpus_count"), "term").limit(size)


def _kept_counts(words: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The most frequent terms, and how often each document has them.

    Terms are counted over the corpus first; words outside the vocabulary never reach the shuffle by document. Only the
    vocabulary, ``size`` terms, is broadcast; every document is counted whole.
    """
    top = cut_lineage(_top_terms(words, size))
    return top, words.join(F.broadcast(top), "term").groupBy("key", "term").agg(F.count("*").alias("tf"))


def vocabulary(df: DataFrame, key: str, text: str, size: int = VOCABULARY) -> DataFrame:
    """``(term, corpus_count, docs)`` of the most frequent terms; ties in alphabetical order."""
    top, counts = _kept_counts(_tokens(spread(df.select(key, text)), key, text), size)
    return top.join(counts.groupBy("term").agg(F.count("*").alias("docs")), "term").select("term", "corpus_count", "docs")


def smooth_idf(docs: Column, total: int) -> Column:
    return F.log(F.lit(1.0 + total) / (1 + docs)) + 1


def tfidf(df: DataFrame, key: str, text: str, size: int = VOCABULARY) -> DataFrame:
    """``(key, term, weight)``: smoothed tf-idf with unit length per document."""
    total = df.count()
    _, counts = _kept_counts(_tokens(spread(df.select(key, text), total), key, text), size)
    counts = cut_lineage(counts)
    terms = counts.groupBy("term").agg(smooth_idf(F.count("*"), total).alias("idf"))
    raw = counts.join(F.broadcast(terms), "term").select("key", "term", (F.col("tf") * F.col("idf")).alias("raw"))
    norm = raw.groupBy("key").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, "key").select(F.col("key").alias(key), "term", (F.col("raw") / F.col("norm")).alias("weight"))


class TfIdf(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Tf-idf vector of a text column over its most frequent terms."""

    size = Param(Params._dummy(), "size", "terms kept", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, size=VOCABULARY):
        super().__init__()
        self._setDefault(size=VOCABULARY)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "TfIdfModel":
        c = self.getInputCol()
        rows = df.select(F.monotonically_increasing_id().alias("__doc"), quoted(c).alias(c))
        total = rows.count()
        terms = vocabulary(rows, "__doc", c, self.getOrDefault("size")).select(
            "term", smooth_idf(F.col("docs"), total).alias("idf")
        ).orderBy("term").collect()
        model = TfIdfModel()
        model._set(
            inputCol=c, outputCol=self.getOutputCol(), terms=[r["term"] for r in terms], idf=[r["idf"] for r in terms]
        )
        return model


class TfIdfModel(Model, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    terms = Param(Params._dummy(), "terms", "vocabulary", TypeConverters.toListString)
    idf = Param(Params._dummy(), "idf", "weight per term", TypeConverters.toListFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        terms, idf, out = self.getOrDefault("terms"), self.getOrDefault("idf"), self.getOutputCol()
        a, b, c = f"{out}__tokens", f"{out}__counts", f"{out}__raw"
        df = df.withColumn(a, F.coalesce(tokens(quoted(self.getInputCol())), F.array().cast("array<string>")))
        df = CountVectorizerModel.from_vocabulary(terms, inputCol=a, outputCol=b).transform(df)
        df = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol=b, outputCol=c).transform(df)
        return Normalizer(inputCol=c, outputCol=out).transform(df).drop(a, b, c)


# --- label and matrix -----------------------------------------------------------------------------------------


def label_table(df: DataFrame, target: str) -> DataFrame:
    """``(class, n, label)``: sorted classes and their number; numeric classes sort by value."""
    known = df.where(present(df, target))
    numeric = is_numeric(df.schema[target].dataType)
    value = as_number(df, target) if numeric else quoted(target).cast("string")
    counts = known.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    if not numeric:
        coded = sorted_codes(counts)
    else:
        one = counts.withColumn("one", F.lit(1))
        coded = running_totals(one, "value", ["one"]).select(
            "value", "n", F.col("one_before").cast("double").alias("code")
        )
    return coded.select(F.col("value").alias("class"), "n", F.col("code").alias("label"))


def encode_label(df: DataFrame, target: str, table: DataFrame, output: str = "label") -> DataFrame:
    numeric = is_numeric(df.schema[target].dataType)
    value = as_number(df, target) if numeric else quoted(target).cast("string")
    rows = df.withColumn("__class", value)
    lookup = table.select(F.col("class").alias("__class"), "n", F.col("label").alias(output))
    total = lookup.agg(F.sum("n")).first()[0] or 1
    return attach_lookup(rows, lookup, ["__class"], total, "n").drop("__class")


def feature_names(df: DataFrame, column: str = "features") -> list[str]:
    """Readable names of a vector column, from its ML attributes."""
    attrs = df.schema[column].metadata.get("ml_attr", {})
    named = [a for group in attrs.get("attrs", {}).values() for a in group]
    if named:
        return [a.get("name", f"feature_{a['idx']}") for a in sorted(named, key=lambda a: a["idx"])]
    return [f"feature_{i}" for i in range(attrs.get("num_attrs", 0))]


def wide_features(df: DataFrame, keep: list[str], column: str = "features") -> DataFrame:
    """The vector column spread into one DOUBLE column per feature."""
    names = feature_names(df, column)
    values = df.withColumn("__values", vector_to_array(column))
    return values.select(*[quoted(c) for c in keep], *[F.col("__values")[i].alias(n) for i, n in enumerate(names)])


def split_counts(df: DataFrame, column: str = "features", split: str = "split") -> DataFrame:
    """Rows per split and the number of features: the meta record of a feature table."""
    count = lambda s: F.count_if(F.col(split) == s).alias(f"{s}_samples")
    return df.agg(F.count("*").alias("num_samples"), count("train"), count("val"), count("test")).withColumn(
        "num_features", F.lit(len(feature_names(df, column)))
    )
