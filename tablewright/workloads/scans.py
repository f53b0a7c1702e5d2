"""Sources, sinks, projections and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.catalogue import search_runs
from tablewright.operators.clean import drop_incomplete, drop_zero_variance
from tablewright.operators.profile import preview
from tablewright.operators.schema import drop_identifiers, identifier_columns
from tablewright.operators.split import hash_split
from tablewright.runtime import scratch_path
from tablewright.sources import readers, writers
from tablewright.workloads.registry import Tables, digest_sql, query

ORDERS_SQL = """
SELECT o_orderpriority, count(*) AS orders, count(DISTINCT o_custkey) AS customers, min(o_orderkey) AS first_key,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS VARCHAR) AS price
FROM orders GROUP BY o_orderpriority"""


def _orders_report(df: DataFrame) -> DataFrame:
    return df.groupBy("o_orderpriority").agg(
        F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("customers"),
        F.min("o_orderkey").cast("bigint").alias("first_key"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("string").alias("price"),
    )


@query("scan_csv", ORDERS_SQL)
def scan_csv(t: Tables) -> DataFrame:
    path = writers.write_table(t("orders"), scratch_path(t.spark, "orders") + ".csv", "csv")
    return _orders_report(readers.read_table(t.spark, path, schema=t("orders").schema))


@query("scan_csv_split", ORDERS_SQL)
def scan_csv_split(t: Tables) -> DataFrame:
    """No field of the orders holds a line break, so files can be split."""
    path = writers.write_table(t("orders"), scratch_path(t.spark, "orders") + ".csv", "csv")
    return _orders_report(readers.read_table(t.spark, path, schema=t("orders").schema, line_breaks=False))


@query("scan_csv_inferred", ORDERS_SQL)
def scan_csv_inferred(t: Tables) -> DataFrame:
    path = writers.write_table(t("orders"), scratch_path(t.spark, "orders") + ".csv", "csv")
    return _orders_report(readers.read_table(t.spark, path))


@query("scan_parquet", ORDERS_SQL)
def scan_parquet(t: Tables) -> DataFrame:
    return _orders_report(readers.read_table(t.spark, t.path("orders")))


@query("scan_json_document", """
SELECT c_mktsegment, count(*) AS customers, count(DISTINCT c_nationkey) AS nations, CAST(sum(CAST(c_acctbal AS DECIMAL(18, 2))) AS VARCHAR) AS balance
FROM customer GROUP BY c_mktsegment""")
def scan_json_document(t: Tables) -> DataFrame:
    customer = t("customer")
    # One JSON array per file, of about 500 rows each.
    parts = max(1, customer.count() // 500)
    row = F.to_json(F.struct(*customer.columns))
    arrays = customer.groupBy(F.pmod(F.xxhash64("c_custkey"), F.lit(parts)).alias("part")).agg(
        F.concat(F.lit("["), F.concat_ws(",", F.collect_list(row)), F.lit("]")).alias("value")
    )
    path = scratch_path(t.spark, "customer") + ".json"
    arrays.write.partitionBy("part").text(path)
    back = readers.read_table(t.spark, path, schema=customer.schema)
    return back.groupBy("c_mktsegment").agg(
        F.count("*").alias("customers"), F.count_distinct("c_nationkey").alias("nations"),
        F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("string").alias("balance"),
    )


_TEXTS_SQL = """
SELECT count(*) AS num_rows, CAST(sum(length({text})) AS BIGINT) AS chars, CAST(sum(CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT)) AS VARCHAR) AS digests,
       CAST(sum({key}) AS BIGINT) AS keys FROM {table}"""


def _texts_round_trip(t: Tables, table: str, key: str, text: str, fmt: str) -> DataFrame:
    """All texts, line breaks and quotes included, written as text files and read back."""
    df = t(table)
    path = writers.write_table(df, scratch_path(t.spark, table) + "." + fmt, fmt)
    back = readers.read_table(t.spark, path, schema=df.schema)
    number = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(30,0)")
    return back.agg(F.count("*").alias("num_rows"), F.sum(F.length(text)).cast("bigint").alias("chars"), F.sum(number).cast("string").alias("digests"), F.sum(key).alias("keys"))


@query("csv_round_trip_documents", _TEXTS_SQL.format(table="documents", key="doc_id", text="text"))
def csv_round_trip_documents(t: Tables) -> DataFrame:
    return _texts_round_trip(t, "documents", "doc_id", "text", "csv")


@query("csv_round_trip_pages", _TEXTS_SQL.format(table="pages", key="page_id", text="html"))
def csv_round_trip_pages(t: Tables) -> DataFrame:
    return _texts_round_trip(t, "pages", "page_id", "html", "csv")


@query("scan_json_lines", """
SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users, max(length(props)) AS longest_props,
       round(avg(value), 4) AS mean_value
FROM events GROUP BY event_type""")
def scan_json_lines(t: Tables) -> DataFrame:
    events = t("events")
    path = writers.write_table(events, scratch_path(t.spark, "events") + ".jsonl", "jsonl")
    return readers.read_table(t.spark, path, schema=events.schema).groupBy("event_type").agg(
        F.count("*").alias("events"), F.count_distinct("user_id").alias("users"),
        F.max(F.length("props")).cast("bigint").alias("longest_props"), F.round(F.avg("value"), 4).alias("mean_value"),
    )


@query("file_fingerprint")
def file_fingerprint(t: Tables) -> DataFrame:
    return readers.file_fingerprint(t.spark, t.path("lineitem"))


@query("dataset_metadata")
def dataset_metadata(t: Tables) -> DataFrame:
    return readers.dataset_metadata(t.spark, t.path("lineitem"))


_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "cents", "c_mktsegment"]
_CENTS = "(SELECT *, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer)"


def _cents(df: DataFrame) -> DataFrame:
    """The balance in whole cents, which print alike in both engines."""
    return df.withColumn("cents", F.round(F.col("c_acctbal") * 100).cast("bigint"))


@query("content_fingerprint", f"""
SELECT count(*) AS num_rows, bit_xor(h) AS digest_xor, CAST(sum(h) AS VARCHAR) AS digest_sum
FROM (SELECT {digest_sql(_CUSTOMER)} AS h FROM {_CENTS})""")
def content_fingerprint(t: Tables) -> DataFrame:
    return readers.content_fingerprint(_cents(t("customer")), _CUSTOMER)


@query("drift_check", "SELECT 'orders' AS path, 'unchanged' AS status UNION ALL SELECT 'customer', 'changed'")
def drift_check(t: Tables) -> DataFrame:
    """Fingerprints of two tables, one of them changed since it was stored."""
    mark = lambda df, path: readers.content_fingerprint(df).withColumn("path", F.lit(path))
    orders, customer = t("orders"), t("customer")
    changed = customer.withColumn("c_acctbal", F.col("c_acctbal") + 1)
    stored = mark(orders, "orders").unionByName(mark(customer, "customer"))
    return readers.drift_check(stored, mark(orders, "orders").unionByName(mark(changed, "customer")))


@query("preview", """
WITH h AS (SELECT * FROM events ORDER BY event_id LIMIT 200)
SELECT 'event_id' AS column_name, 'bigint' AS dtype, 0.0::DOUBLE AS missing_ratio, count(DISTINCT event_id) AS unique_count FROM h
UNION ALL SELECT 'user_id', 'bigint', 0.0, count(DISTINCT user_id) FROM h
UNION ALL SELECT 'event_type', 'string', 0.0, count(DISTINCT event_type) FROM h
UNION ALL SELECT 'value', 'double', round(avg(CASE WHEN value < 5 THEN 1.0 ELSE 0.0 END), 6),
       count(DISTINCT CASE WHEN value >= 5 THEN value END) FROM h""")
def preview_query(t: Tables) -> DataFrame:
    events = t("events").withColumn("value", F.when(F.col("value") >= 5, F.col("value")))
    return preview(events.select("event_id", "user_id", "event_type", "value").orderBy("event_id")).withColumn(
        "missing_ratio", F.round("missing_ratio", 6)
    )


@query("write_round_trip", ORDERS_SQL)
def write_round_trip(t: Tables) -> DataFrame:
    path = writers.write_table(t("orders"), scratch_path(t.spark, "cleaned"), "parquet")
    return _orders_report(readers.read_table(t.spark, path, "parquet"))


_DRAW = f"{digest_sql(['conv_id'], 42)} / 1152921504606846976.0::DOUBLE"
_SPLIT_SQL = f"CASE WHEN {_DRAW} < 0.2 THEN 'test' WHEN {_DRAW} < 0.36 THEN 'val' ELSE 'train' END"


@query("export_splits", f"""
SELECT split, count(*) AS num_rows, count(DISTINCT conv_id) AS conversations
FROM (SELECT *, {_SPLIT_SQL} AS split FROM conversations) GROUP BY split""")
def export_splits(t: Tables) -> DataFrame:
    """Conversations exported by split, all turns of one together, and read back from their folders."""
    split = hash_split(t("conversations"), ["conv_id"])
    paths = writers.export_tables({"splits": split}, scratch_path(t.spark, "export"), "splits")
    return t.spark.read.parquet(paths["splits"]).groupBy("split").agg(
        F.count("*").alias("num_rows"), F.count_distinct("conv_id").alias("conversations")
    )


@query("sanitise", """
SELECT event_type, count(*) AS num_rows,
       count(CASE WHEN event_type IN ('click', 'error') THEN NULL ELSE value END) AS finite_values
FROM events GROUP BY event_type""")
def sanitise(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    broken = t("events").withColumn(
        "value", F.when(kind == "click", float("nan")).when(kind == "error", float("-inf")).otherwise(F.col("value"))
    )
    return readers.sanitise(broken).groupBy("event_type").agg(
        F.count("*").alias("num_rows"), F.count("value").alias("finite_values")
    )


@query("drop_ignored", """
SELECT o_orderstatus, o_orderpriority, count(*) AS num_rows FROM orders GROUP BY o_orderstatus, o_orderpriority""")
def drop_ignored(t: Tables) -> DataFrame:
    kept = t("orders").drop("o_custkey", "o_totalprice", "o_orderdate", "o_orderkey")
    return kept.groupBy(*kept.columns).agg(F.count("*").alias("num_rows"))


@query("drop_identifiers", """
SELECT event_type, count(*) AS num_rows, 'event_id,user_id' AS dropped FROM events GROUP BY event_type""")
def drop_identifiers_query(t: Tables) -> DataFrame:
    events = t("events")
    gone = F.lit(",".join(identifier_columns(events.columns)))
    return drop_identifiers(events).groupBy("event_type").agg(F.count("*").alias("num_rows"), gone.alias("dropped"))


@query("drop_zero_variance", """
SELECT l_returnflag, l_linestatus, count(*) AS num_rows FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def drop_zero_variance_query(t: Tables) -> DataFrame:
    df = t("lineitem").select(
        "l_returnflag", "l_linestatus", (F.col("l_quantity") * 0).alias("zero"), F.upper(F.lit("x")).alias("same")
    )
    kept = drop_zero_variance(df)
    return kept.groupBy(*kept.columns).agg(F.count("*").alias("num_rows"))


@query("drop_incomplete", """
SELECT l_returnflag, count(*) AS num_rows, round(avg(l_quantity), 4) AS mean_quantity
FROM lineitem WHERE l_discount <> 0.05 AND l_tax <> 0.03 GROUP BY l_returnflag""")
def drop_incomplete_query(t: Tables) -> DataFrame:
    df = t("lineitem").withColumns(
        {"l_discount": F.nullif("l_discount", F.lit(0.05)), "l_tax": F.nullif("l_tax", F.lit(0.03))}
    )
    return drop_incomplete(df, ["l_discount", "l_tax"]).groupBy("l_returnflag").agg(
        F.count("*").alias("num_rows"), F.round(F.avg("l_quantity"), 4).alias("mean_quantity")
    )


@query("scoring_input", """
SELECT event_type, count(*) AS num_rows, count(CASE WHEN value < 10 THEN value END) AS parsed_values,
       0::BIGINT AS absent_values FROM events GROUP BY event_type""")
def scoring_input(t: Tables) -> DataFrame:
    """Rows whose value arrives as text, some unreadable, and that lack a column the model expects."""
    training = t("events").withColumn("weight", F.lit(1.0))
    contract = readers.scoring_contract(training, "target")
    value = F.when(F.col("value") < 10, F.col("value").cast("string")).otherwise("n/a")
    incoming = t("events").withColumn("value", value)
    return readers.conform(incoming, contract).groupBy("event_type").agg(
        F.count("*").alias("num_rows"), F.count("value").alias("parsed_values"), F.count("weight").alias("absent_values")
    )


@query("search_records", """
SELECT p_partkey, p_name, p_brand FROM part
WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')""")
def search_records(t: Tables) -> DataFrame:
    return search_runs(t("part"), " RING ", ["p_name", "p_brand", "p_type"]).select("p_partkey", "p_name", "p_brand")

