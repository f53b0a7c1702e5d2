"""Digests of files of any size, read in pieces inside tasks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are read at a time, and schemes of stores that are read so; other stores hand over a file as one value, up to ``WHOLE_BYTES``.
CHUNK_BYTES = 8 << 20
STREAMED = ("file", "hdfs", "s3", "gs", "abfs", "abfss")
WHOLE_BYTES = 2**31 - 1


def opened_by(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, and the path in it; a path without scheme is local. File names may hold any character."""
    scheme, _, rest = uri.partition(":")
    if "/" in scheme or not rest:
        return fs.LocalFileSystem(), uri
    if scheme == "file":
        return fs.LocalFileSystem(), re.sub("^/+", "/", rest)
    return fs.FileSystem.from_uri(uri)


def _streamed(files: DataFrame) -> DataFrame:
    schema = pa.schema([("length", pa.int64()), ("md5", pa.string()), ("sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = opened_by(uri)
                length, digests = 0, (hashlib.md5(), hashlib.sha256())
                with store.open_input_stream(path) as stream:
                    while piece := stream.read(CHUNK_BYTES):
                        length += len(piece)
                        for digest in digests:
                            digest.update(piece)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((length, *[d.hexdigest() for d in digests]), schema)], schema=schema)

    # A file to a task as far as the cluster goes; digests cannot be taken in parts.
    return files.select("path").repartition(files.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "length bigint, md5 string, sha256 string")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``length, md5, sha256`` of each file under ``path``; contents are never a row, whatever the size of a file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    scheme = F.regexp_extract("path", "^([a-z0-9]+):", 1)
    if files.where(~scheme.isin(*STREAMED, "")).isEmpty():
        return _streamed(files)
    largest = files.agg(F.max("length")).first()[0]
    if largest > WHOLE_BYTES:
        raise ValueError(f"this store's files are read whole, up to {WHOLE_BYTES} bytes; use content_fingerprint")
    return files.select("length", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))
