"""Reading tables and fingerprinting them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.hashing import row_digest
from tablewright.functions.numeric import finite_or_null, quoted
from tablewright.sources.digests import file_digests

# Fixed value: formats known by file suffix.
FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".jsonl": "jsonl"}


def format_of(path: str) -> str:
    """Format by suffix; raises ValueError for a suffix that is not supported."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for suffix, fmt in FORMATS.items():
        if name.endswith(suffix):
            return fmt
    raise ValueError(f"unsupported file format '{name}'; supported: {', '.join(sorted(FORMATS))}")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_table(
    spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None, line_breaks: bool = True
) -> DataFrame:
    """A table from CSV, Parquet, JSON or JSON lines, chosen by suffix unless named.

    A given schema avoids the inference pass over text formats. CSV fields may hold line breaks, so a CSV file is read by
    one task; with ``line_breaks=False``, for files where no field holds one, a file is split over many tasks. Of a ``.json`` folder each file is read as JSON lines if
    each of its lines is an object, else as one document. Rows that are not in the format raise an error.
    """
    fmt = fmt or format_of(path)
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    reader = (spark.read.schema(schema) if schema is not None else spark.read).option("mode", "FAILFAST")
    if fmt == "parquet":
        return reader.parquet(path)
    if fmt == "csv":
        return reader.csv(path, header=True, inferSchema=schema is None, escape='"', multiLine=line_breaks, ignoreLeadingWhiteSpace=False,
                          ignoreTrailingWhiteSpace=False, emptyValue="")
    if fmt == "jsonl":
        return reader.json(path)
    if fmt == "json":
        lines, documents = _json_kinds(spark, path)
        if schema is None and lines and documents:
            kinds = [spark.read.json(lines).schema, spark.read.json(documents, multiLine=True).schema]
            fields = {f.name: f for kind in kinds for f in kind.fields}
            reader = reader.schema(T.StructType(list(fields.values())))
        parts = [reader.json(paths, multiLine=whole) for paths, whole in ((lines, False), (documents, True)) if paths]
        if not parts:
            return reader.json(path)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    raise ValueError(f"unsupported format: {fmt}")


def _json_kinds(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The files of a folder whose lines are objects, and those that are one document each; one row per file comes back."""
    text = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    line = F.trim("value").startswith("{") & F.try_parse_json("value").isNotNull()
    # Some whole objects, and no array around them: lines, of which the others are broken and will raise an error.
    broken = F.some(line) & ~F.some(F.trim("value").startswith("["))
    files = text.groupBy("file").agg((F.every(line) | broken).alias("lines")).collect()
    return sorted(r["file"] for r in files if r["lines"]), sorted(r["file"] for r in files if not r["lines"])


def file_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """One row per dataset: files, bytes, MD5 and SHA-256.

    One file gives the digest of its bytes, of any size. Several give the digest of their sorted digests, wherever they lie: file
    contents never leave their task, and digests are brought together in 4096 groups by their first digits.
    """
    each = file_digests(spark, path)
    joined = lambda name: F.array_join(F.sort_array(F.collect_list(name)), "")
    groups = each.groupBy(F.substring("md5", 1, 3).alias("head")).agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("md5").alias("one_md5"),
        F.max("sha256").alias("one_sha256"), F.md5(joined("md5")).alias("md5"), F.sha2(joined("sha256"), 256).alias("sha256"),
    )
    in_order = lambda name: F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("head", name))), lambda s: s[name]), ""
    )
    total = F.coalesce(F.sum("bytes"), F.lit(0))
    single = F.sum("files") == 1
    return groups.agg(
        F.coalesce(F.sum("files"), F.lit(0)).alias("files"), total.alias("bytes"),
        F.round(total / (1024 * 1024), 4).alias("size_mb"),
        F.when(single, F.max("one_md5")).otherwise(F.md5(in_order("md5"))).alias("md5"),
        F.when(single, F.max("one_sha256")).otherwise(F.sha2(in_order("sha256"), 256)).alias("sha256"),
    )


def dataset_metadata(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """File name, format, size, rows, columns and digest of a dataset."""
    fmt = fmt or format_of(path)
    df = read_table(spark, path, fmt)
    return file_fingerprint(spark, path).select(
        F.lit(path.rstrip("/").rsplit("/", 1)[-1]).alias("file_name"), F.lit(fmt.upper()).alias("file_format"),
        F.col("size_mb").alias("file_size_mb"), F.lit(df.count()).cast("bigint").alias("num_rows"),
        F.lit(len(df.columns)).alias("num_cols"), F.col("md5").alias("dataset_hash"),
    )


def fold_digests(df: DataFrame, digest: Column) -> DataFrame:
    """Row count, xor and sum of row digests: independent of row order and file layout.

    The sum keeps repeated rows visible, which cancel in the xor.
    """
    return df.agg(
        F.count("*").alias("num_rows"),
        F.coalesce(F.bit_xor(digest), F.lit(0).cast("bigint")).alias("digest_xor"),
        F.coalesce(F.sum(digest.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest_sum"),
    )


def content_fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Fingerprint of a table's content in one map-side aggregated pass."""
    return fold_digests(df, row_digest(df, columns or df.columns))


def drift_check(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Whether the fingerprint of a dataset is still the stored one, per ``path``."""
    s, c = stored.alias("s"), current.alias("c")
    same = (
        F.col("s.num_rows").eqNullSafe(F.col("c.num_rows"))
        & F.col("s.digest_xor").eqNullSafe(F.col("c.digest_xor"))
        & F.col("s.digest_sum").eqNullSafe(F.col("c.digest_sum"))
    )
    return s.join(c, "path", "left").select(
        "path", F.when(F.col("c.num_rows").isNull(), "missing").when(same, "unchanged").otherwise("changed").alias("status")
    )


def sanitise(df: DataFrame) -> DataFrame:
    """NaN and infinities of all floating columns become NULL."""
    changed = {
        f.name: finite_or_null(quoted(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    }
    return df.withColumns(changed) if changed else df


def scoring_contract(df: DataFrame, target: str | None, ignored: list[str] | None = None) -> T.StructType:
    """The predictor columns a scoring input must have: all but the target, ignored and id columns."""
    from tablewright.functions.text import is_id_name

    skip = {target, *(ignored or [])}
    return T.StructType([f for f in df.schema.fields if f.name not in skip and not is_id_name(f.name, target)])


def conform(df: DataFrame, contract: T.StructType, keep: list[str] | None = None) -> DataFrame:
    """Casts a scoring input to the contract; absent columns and values that do not parse become NULL."""
    cells = [quoted(c) for c in keep or []]
    for f in contract.fields:
        cells.append(
            (quoted(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        )
    return df.select(*cells)
