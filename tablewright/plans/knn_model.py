"""k nearest neighbours as ML stages: fitting keeps the rows, transforming is a join with them."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCols, HasLabelCol, HasOutputCols, HasPredictionCol, HasProbabilityCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.numeric import as_number, finite_or_null
from tablewright.operators.neighbours import nearest_neighbours
from tablewright.operators.order_stats import exact_quantiles
from tablewright.runtime import attach_lookup, cut_lineage


class _NeighbourParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol):
    k = Param(Params._dummy(), "k", "neighbours that vote", TypeConverters.toInt)
    classes = Param(Params._dummy(), "classes", "classes of the label, 0 for a numeric label", TypeConverters.toInt)
    byDistance = Param(Params._dummy(), "byDistance", "whether a vote weighs one over its distance", TypeConverters.toBoolean)


class Neighbours(Estimator, _NeighbourParams):
    """Majority (the smaller class wins a tie) or mean of the ``k`` nearest rows by euclidean distance; equal distances in the order of the fitted rows' keys."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", probabilityCol="probability", k=5, classes=2, byDistance=False):
        super().__init__()
        self._setDefault(k=5, classes=2, byDistance=False)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "NeighboursModel":
        features, label = self.getFeaturesCol(), self.getLabelCol()
        rows = df.where(F.col(features).isNotNull() & F.col(label).isNotNull()).select(vector_to_array(features).alias("vec"), F.col(label).cast("double").alias("label"))
        # Written once, so the numbers stay with their rows.
        keyed = cut_lineage(rows.withColumn("key", F.monotonically_increasing_id()))
        model = NeighboursModel(keyed)
        model._set(**{p.name: v for p, v in self.extractParamMap().items()})
        return model


class NeighboursModel(Model, _NeighbourParams, MLReadable, MLWritable):
    """``members`` are the fitted rows: ``key, vec, label``."""

    def __init__(self, members: DataFrame | None = None):
        super().__init__()
        self.members = members

    def _transform(self, df: DataFrame) -> DataFrame:
        get = lambda name: self.getOrDefault(name)
        rows = cut_lineage(df.withColumn("_knn_row", F.monotonically_increasing_id()))
        queries = rows.select(F.col("_knn_row").alias("key"), vector_to_array(self.getFeaturesCol()).alias("vec"))
        near = nearest_neighbours(queries, self.members, "key", F.col("vec"), get("k"))
        votes = near.join(self.members.select(F.col("key").alias("neighbour"), "label"), "neighbour")
        # A neighbour at no distance outweighs all others, as the limit of one over the distance.
        votes = votes.withColumn("weight", 1 / F.greatest("distance", F.lit(1e-12)) if get("byDistance") else F.lit(1.0))
        share = lambda value: F.sum(value * F.col("weight")) / F.sum("weight")
        if get("classes"):
            chances = F.array(*[share((F.col("label") == c).cast("double")) for c in range(get("classes"))])
            found = votes.groupBy("key").agg(chances.alias("_chances")).select(
                "key", (F.array_position("_chances", F.array_max("_chances")) - 1).cast("double").alias(self.getPredictionCol()), array_to_vector("_chances").alias(self.getProbabilityCol()))
        else:
            found = votes.groupBy("key").agg(share(F.col("label")).alias(self.getPredictionCol()))
        # Written once: every metric reads the scored rows, and none searches again.
        return cut_lineage(rows.join(found.withColumnRenamed("key", "_knn_row"), "_knn_row", "left").drop("_knn_row"))

    def write(self) -> MLWriter:
        return _MembersWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _MembersReader(cls)


class _ImputerParams(HasInputCols, HasOutputCols):
    k = Param(Params._dummy(), "k", "neighbours whose mean fills a gap", TypeConverters.toInt)
    fills = Param(Params._dummy(), "fills", "median of each column", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "deviation of each column", TypeConverters.toListFloat)


class NeighbourImputer(Estimator, _ImputerParams):
    """Fills a gap by the mean of the ``k`` nearest fitted rows that have a value in its column.

    Distances are euclidean over the other columns, each over its deviation, their own gaps at the median; equal distances in the order
    of the fitted rows' keys. A single column, or one without any value, takes the median (0 if there is none). Infinities count as gaps.
    """

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, k=5):
        super().__init__()
        self._setDefault(k=5)
        self._set(**{name: v for name, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "NeighbourImputerModel":
        names = self.getInputCols()
        exprs = {c: finite_or_null(as_number(df, c)) for c in names}
        medians = exact_quantiles(df, exprs, [0.5])
        deviations = df.agg(*[F.stddev_pop(exprs[c]) for c in names]).first()
        rows = df.select(F.array(*[exprs[c] for c in names]).alias("raw"))
        # Written once, so the numbers stay with their rows.
        model = NeighbourImputerModel(cut_lineage(rows.withColumn("key", F.monotonically_increasing_id())))
        model._set(
            inputCols=names, outputCols=self.getOutputCols() if self.isSet("outputCols") else names, k=self.getOrDefault("k"),
            fills=[float(medians[c][0] or 0.0) for c in names], scales=[float(d) if d else 1.0 for d in deviations])
        return model


class NeighbourImputerModel(Model, _ImputerParams, MLReadable, MLWritable):
    """``members`` are the fitted rows: ``key`` and their values, gaps as NULL."""

    def __init__(self, members: DataFrame | None = None):
        super().__init__()
        self.members = members

    def _place(self, raw: Column, column: int) -> Column:
        """Where a row lies by all columns but one."""
        fills, scales = self.getOrDefault("fills"), self.getOrDefault("scales")
        return F.array(*[F.coalesce(raw[j], F.lit(f)) / F.lit(scales[j]) + F.lit(0.0) for j, f in enumerate(fills) if j != column])

    def _means(self, gaps: DataFrame, column: int) -> DataFrame:
        """``(_place, n, _mean)`` for every place where a gap lies; a place is looked up once, however many rows are there."""
        places = cut_lineage(gaps.groupBy("_place").agg(F.count("*").alias("n")).withColumn("_row", F.monotonically_increasing_id()))
        known = self.members.where(F.col("raw")[column].isNotNull())
        queries = places.select(F.col("_row").alias("key"), F.col("_place").alias("vec"))
        near = nearest_neighbours(queries, known.select("key", self._place(F.col("raw"), column).alias("vec")), "key", F.col("vec"), self.getOrDefault("k"))
        values = known.select(F.col("key").alias("neighbour"), F.col("raw")[column].alias("_value"))
        means = near.join(values, "neighbour").groupBy(F.col("key").alias("_row")).agg(F.avg("_value").alias("_mean"))
        return places.join(means, "_row").select("_place", "n", "_mean")

    def _transform(self, df: DataFrame) -> DataFrame:
        names, outputs, fills = self.getInputCols(), self.getOutputCols(), self.getOrDefault("fills")
        exprs = [finite_or_null(as_number(df, c)) for c in names]
        total, *gaps = df.agg(F.count("*"), *[F.count_if(e.isNull()) for e in exprs]).first()
        out = df.withColumn("_raw", F.array(*exprs))
        for i, (output, fill) in enumerate(zip(outputs, fills)):
            value = F.col("_raw")[i]
            if gaps[i] and len(names) > 1:
                # The rows' places stay apart from the loop's joins: every look-up reads the given rows.
                missing = df.select(F.array(*exprs).alias("_raw")).where(value.isNull()).select(self._place(F.col("_raw"), i).alias("_place"))
                out = out.withColumn("_place", F.when(value.isNull(), self._place(F.col("_raw"), i)))
                out = attach_lookup(out, self._means(missing, i), ["_place"], total, "n")
                out = out.withColumn(output, F.coalesce(value, F.col("_mean"), F.lit(fill))).drop("_place", "_mean")
            else:
                out = out.withColumn(output, F.coalesce(value, F.lit(fill)))
        return out.drop("_raw")

    def write(self) -> MLWriter:
        return _MembersWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _MembersReader(cls)


class _MembersWriter(MLWriter):
    def __init__(self, instance: NeighboursModel | NeighbourImputerModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.members.write.mode("overwrite").parquet(f"{path}/members")


class _MembersReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> NeighboursModel | NeighbourImputerModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(self.sparkSession.read.parquet(f"{path}/members"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
