"""Online scoring: a stateless stream from a folder of files through a fitted model."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablewright.sources.readers import conform


def score_stream(
    spark: SparkSession, source: str, contract: T.StructType, model: PipelineModel, keep: list[T.StructField],
    fmt: str = "parquet", files_per_trigger: int = 1000,
) -> DataFrame:
    """Streaming rows with ``prediction``. Rows stand alone, so there is no state and no watermark."""
    schema = T.StructType([*keep, *[f for f in contract.fields if f.name not in {k.name for k in keep}]])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(source)
    rows = conform(stream, contract, [k.name for k in keep])
    return model.transform(rows).select(*[k.name for k in keep], F.col("prediction"))


def start_scoring(scored: DataFrame, sink: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Appends scored rows to files; the checkpoint makes a restart continue where it stopped."""
    return (
        scored.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
        .option("path", sink).trigger(availableNow=True).start()
    )
