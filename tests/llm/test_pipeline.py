"""The pipeline's stages on the smallest tables."""

import re

import corpus_pipeline as pipeline
from pyspark.sql import functions as F


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("_row", F.lit(1))
    items = [re.findall(r"\S+", r["text"].lower()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    columns, before = docs.columns, docs
    for name, stage in pipeline.STAGES[:-1]:
        after = pipeline.stored(stage(spark, before, sf_dir), "stage")
        assert after.columns == columns, name
        if name != "source mix":
            assert 0.3 * before.count() < after.count() <= before.count()
            assert after.subtract(before).count() == 0
        before = after
    texts = [" ".join(re.findall(r"\S+", r["text"].lower())) for r in before.collect()]
    assert not any(" ".join(i) in t for i in items for t in texts)
    last = pipeline.STAGES[-1][1](spark, before, sf_dir)
    assert last.count() == before.count() and "shard" in last.columns
