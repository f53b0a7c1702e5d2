"""Feature transforms, splits and folds."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.dates import DATE_PARTS
from tablewright.functions.numeric import plain_round
from tablewright.operators import features as X
from tablewright.operators import split as S
from tablewright.operators.schema import infer_schema
from tablewright.plans.knn_model import NeighbourImputer
from tablewright.plans.routing import feature_stages
from tablewright.plans.spec import Candidate, Features, ModelPlan, Preprocessing
from tablewright.runtime import cut_lineage, scratch_path
from tablewright.workloads.registry import Tables, digest_sql, query

# Rows marked as training rows by the year of their date; transforms are fitted on them alone.
_TRAIN = "year(l_shipdate) < 2000"


def _lines(t: Tables) -> DataFrame:
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_linestatus",
        F.nullif("l_quantity", F.lit(10.0)).alias("quantity"), "l_extendedprice",
        (F.col("l_discount") - F.lit(0.04)).alias("margin"),
        F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("flag"),
    )


_LINES = """(SELECT l_orderkey, l_linenumber, l_shipdate, l_linestatus, nullif(l_quantity, 10.0) AS quantity, l_extendedprice,
 l_discount - 0.04::DOUBLE AS margin, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END AS flag FROM lineitem)"""


def _train(df: DataFrame) -> DataFrame:
    return df.where(_TRAIN)


def _summary(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(F.year("l_shipdate").cast("bigint").alias("ship_year")).agg(
        F.count("*").alias("num_rows"), plain_round(F.avg(c), 6).alias("mean_value"),
        plain_round(F.min(c), 6).alias("low"), plain_round(F.max(c), 6).alias("high"),
    )


def _summary_sql(expr: str, source: str = _LINES, extra: str = "") -> str:
    return f"""SELECT year(l_shipdate) AS ship_year, count(*) AS num_rows, round(avg({expr}), 6) + 0.0 AS mean_value,
 round(min({expr}), 6) + 0.0 AS low, round(max({expr}), 6) + 0.0 AS high FROM {source} AS s {extra} GROUP BY 1"""


for _strategy, _fill in (("mean", "avg(quantity)"), ("median", "median(quantity)"), ("most_frequent", "mode_value")):
    _source = f"SELECT {_fill} AS fill FROM {_LINES} WHERE {_TRAIN}"
    if _strategy == "most_frequent":
        _source = f"SELECT quantity AS fill FROM {_LINES} WHERE {_TRAIN} AND quantity IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, quantity LIMIT 1"

    @query(f"impute_{_strategy}", _summary_sql("coalesce(quantity, fill)", extra=f", ({_source}) AS f"))
    def impute(t: Tables, strategy: str = _strategy) -> DataFrame:
        df = _lines(t)
        return _summary(X.NumericImputer(inputCols=["quantity"], strategy=strategy).fit(_train(df)).transform(df), "quantity")


@query("impute_category", f"""
SELECT coalesce(flag, (SELECT flag FROM {_LINES} WHERE {_TRAIN} AND flag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, flag LIMIT 1)) AS flag,
 count(*) AS num_rows FROM {_LINES} GROUP BY 1""")
def impute_category(t: Tables) -> DataFrame:
    df = _lines(t)
    return X.CategoryImputer(inputCols=["flag"]).fit(_train(df)).transform(df).groupBy("flag").agg(F.count("*").alias("num_rows"))


@query("fence_capper", _summary_sql(
    "CASE WHEN quantity IS NULL THEN NULL ELSE greatest(q1 - 0.1 * (q3 - q1), least(q3 + 0.1 * (q3 - q1), quantity)) END",
    extra=f", (SELECT quantile_cont(quantity, 0.25) AS q1, quantile_cont(quantity, 0.75) AS q3 FROM {_LINES} WHERE {_TRAIN}) AS f"))
def fence_capper(t: Tables) -> DataFrame:
    df = _lines(t)
    return _summary(X.FenceCapper(inputCols=["quantity"], multiplier=0.1).fit(_train(df)).transform(df), "quantity")


@query("zscore_capper", _summary_sql(
    "CASE WHEN quantity IS NULL THEN NULL ELSE greatest(mean - 0.5 * dev, least(mean + 0.5 * dev, quantity)) END",
    extra=f", (SELECT avg(quantity) AS mean, stddev_pop(quantity) AS dev FROM {_LINES} WHERE {_TRAIN}) AS f"))
def zscore_capper(t: Tables) -> DataFrame:
    df = _lines(t)
    return _summary(X.FenceCapper(inputCols=["quantity"], multiplier=0.5, kind="zscore").fit(_train(df)).transform(df), "quantity")


@query("log_transform", _summary_sql(
    "ln(1 + margin + CASE WHEN lo < 0 THEN abs(lo) + 1 ELSE 0 END)", extra=f", (SELECT min(margin) AS lo FROM {_LINES} WHERE {_TRAIN}) AS f"))
def log_transform(t: Tables) -> DataFrame:
    df = _lines(t)
    return _summary(X.LogShift(inputCols=["margin"]).fit(_train(df)).transform(df), "margin")


_SCALES = {
    "standard": ("avg(l_extendedprice)", "stddev_pop(l_extendedprice)"),
    "minmax": ("min(l_extendedprice)", "max(l_extendedprice) - min(l_extendedprice)"),
    "robust": ("median(l_extendedprice)", "quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)"),
}
for _kind, (_center, _scale) in _SCALES.items():

    @query(f"scale_{_kind}", _summary_sql(
        "(l_extendedprice - center) / scale", extra=f", (SELECT {_center} AS center, {_scale} AS scale FROM {_LINES} WHERE {_TRAIN}) AS f"))
    def scale(t: Tables, kind: str = _kind) -> DataFrame:
        df = _lines(t)
        model = X.ColumnScaler(inputCols=["l_extendedprice"], kind=kind).fit(_train(df))
        return _summary(model.transform(df), "l_extendedprice")


@query("impute_neighbours", """
WITH f AS (SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS b, c_nationkey AS a, pow(c_custkey, 1.5) AS z FROM customer),
s AS (SELECT stddev_pop(a) AS sa, stddev_pop(z) AS sz FROM f),
n AS (SELECT g.c_custkey, m.b, row_number() OVER (PARTITION BY g.c_custkey ORDER BY pow((g.a - m.a) / sa, 2) + pow((g.z - m.z) / sz, 2), m.c_custkey) AS r
      FROM f g JOIN f m ON g.b IS NULL AND m.b IS NOT NULL, s)
SELECT f.c_custkey, round(coalesce(max(f.b), avg(n.b)), 4) AS b FROM f LEFT JOIN n ON n.c_custkey = f.c_custkey AND n.r <= 5 GROUP BY 1""")
def impute_neighbours(t: Tables) -> DataFrame:
    df = t("customer").selectExpr(
        "c_custkey", "CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS b", "c_nationkey AS a", "pow(c_custkey, 1.5) AS z")
    filled = NeighbourImputer(inputCols=["a", "b", "z"], outputCols=["fa", "fb", "fz"]).fit(df).transform(df)
    return filled.select("c_custkey", F.round("fb", 4).alias("b"))


@query("encode_onehot", "SELECT c_custkey, " + ", ".join(
    f"CAST(c_mktsegment = '{s}' AS DOUBLE) AS \"c_mktsegment__cat_code_{s}\"" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
) + " FROM customer")
def encode_onehot(t: Tables) -> DataFrame:
    df = t("customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    plan = _plan(Features(categorical_strategy="onehot"), target="c_nationkey")
    types = {"c_mktsegment": "categorical"}
    model = Pipeline(stages=feature_stages(df, types, plan)).fit(df.where("c_nationkey < 12"))
    return X.wide_features(model.transform(df), ["c_custkey"])


@query("encode_ordinal", """
WITH k AS (SELECT c_custkey, concat(c_mktsegment, '-', c_nationkey) AS v, c_nationkey < 12 AS train FROM customer),
o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT v FROM k WHERE train))
SELECT c_custkey, CAST(coalesce(code, -1) AS BIGINT) AS code FROM k LEFT JOIN o USING (v)""")
def encode_ordinal(t: Tables) -> DataFrame:
    return _encoded(t, "ordinal").select("c_custkey", F.col("code").cast("bigint").alias("code"))


@query("encode_frequency", """
WITH k AS (SELECT c_custkey, concat(c_mktsegment, '-', c_nationkey) AS v, c_nationkey < 12 AS train FROM customer),
o AS (SELECT v, count(*) / (SELECT count(*) FROM k WHERE train) AS code FROM k WHERE train GROUP BY v)
SELECT c_custkey, round(coalesce(code, 0), 8) AS code FROM k LEFT JOIN o USING (v)""")
def encode_frequency(t: Tables) -> DataFrame:
    return _encoded(t, "frequency").select("c_custkey", F.round("code", 8).alias("code"))


def _encoded(t: Tables, kind: str) -> DataFrame:
    """Codes learned from the customers of some nations and applied to all; the others are unseen."""
    df = t("customer").select("c_custkey", "c_nationkey", F.concat_ws("-", "c_mktsegment", "c_nationkey").alias("v"))
    return X.CategoryEncoder(inputCols=["v"], outputCols=["code"], kind=kind).fit(df.where("c_nationkey < 12")).transform(df)


@query("encode_target", """
WITH m AS (SELECT c_mktsegment, avg(c_acctbal) AS enc FROM customer GROUP BY 1)
SELECT c_custkey, round(enc, 4) AS code FROM customer JOIN m USING (c_mktsegment)""")
def encode_target(t: Tables) -> DataFrame:
    df = t("customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    means = X.TargetMeans(inputCols=["c_mktsegment"], outputCols=["code"], labelCol="c_acctbal", foldCols=["c_mktsegment"], smoothing=0.0)
    return means.fit(df).transform(df).select("c_custkey", F.round("code", 4).alias("code"))


def _out_of_fold_sql(column: str) -> str:
    """Codes of one column: sums over fitted rows, without the row's own inner fold if it was fitted, drawn to the mean by ten rows."""
    own = "CASE WHEN k.fitted THEN coalesce({}, 0) ELSE 0 END"
    codes = []
    for c in range(3):
        rows, label = f"coalesce(a.n, 0) - {own.format('o.n')}", f"coalesce(a.s{c}, 0) - {own.format(f'o.s{c}')}"
        mean = f"(w.s{c} - {own.format(f'g.s{c}')}) / (w.n - {own.format('g.n')})"
        codes.append(f"round(({label} + 10 * {mean}) / ({rows} + 10), 8) AS {column}__cat_code_{c}")
    counts = "count(*) AS n, " + ", ".join(f"count(*) FILTER (y = {c}) AS s{c}" for c in range(3))
    return f"""SELECT k.c_custkey, {', '.join(codes)} FROM k
 LEFT JOIN (SELECT {column} AS v, {counts} FROM k WHERE fitted GROUP BY 1) a ON a.v = k.{column}
 LEFT JOIN (SELECT {column} AS v, f, {counts} FROM k WHERE fitted GROUP BY 1, 2) o ON o.v = k.{column} AND o.f = k.f
 LEFT JOIN (SELECT f, {counts} FROM k WHERE fitted GROUP BY 1) g ON g.f = k.f
 CROSS JOIN (SELECT {counts} FROM k WHERE fitted) w"""


@query("encode_target_out_of_fold", f"""
WITH k AS (SELECT c_custkey, c_mktsegment, c_name, c_nationkey % 3 AS y, c_nationkey < 20 AS fitted, {digest_sql(['c_mktsegment', 'c_name'], X.INNER_SALT)} % 5 AS f FROM customer)
SELECT * FROM ({_out_of_fold_sql('c_mktsegment')}) JOIN ({_out_of_fold_sql('c_name')}) USING (c_custkey)""")
def encode_target_out_of_fold(t: Tables) -> DataFrame:
    """Target codes of three classes as a plan routes them: no row's code has its own label in it."""
    df = t("customer").select("c_custkey", "c_mktsegment", "c_name", (F.col("c_nationkey") % 3).cast("double").alias("label"), (F.col("c_nationkey") < 20).alias(X.FITTED))
    plan = ModelPlan("multiclass_classification", "label", _plan(Features()).candidates, features=Features(categorical_strategy="target_enc"))
    fitted = df.where(X.FITTED)
    model = Pipeline(stages=feature_stages(fitted, {"c_mktsegment": "categorical", "c_name": "high_cardinality"}, plan)).fit(fitted)
    wide = X.wide_features(model.transform(df), ["c_custkey"])
    return wide.select("c_custkey", *[F.round(c, 8).alias(c) for c in wide.columns[1:]])


@query("encode_onehot_wide", """
WITH o AS (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS code FROM (SELECT DISTINCT c_name FROM customer WHERE c_nationkey < 20))
SELECT c_custkey, CAST(code AS BIGINT) AS code, (SELECT count(*) FROM o) AS width FROM customer LEFT JOIN o USING (c_name)""")
def encode_onehot_wide(t: Tables) -> DataFrame:
    """One-hot codes of a column with a category per row: the place of the one in a sparse vector, none for unknown categories."""
    df = t("customer").select("c_custkey", "c_name", "c_nationkey")
    plan = _plan(Features(categorical_strategy="onehot"), target="c_nationkey")
    fitted = df.where("c_nationkey < 20")
    model = Pipeline(stages=feature_stages(fitted, {"c_name": "high_cardinality"}, plan)).fit(fitted)
    shown = F.col("features").cast("string")
    return model.transform(df).select(
        "c_custkey", F.regexp_extract(shown, r"\[(\d+)\]", 1).try_cast("bigint").alias("code"), F.regexp_extract(shown, r"\((\d+),", 1).cast("bigint").alias("width"))


@query("date_parts", """
WITH d AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderdate END AS d FROM orders)
SELECT o_orderkey, CAST(coalesce(year(d), 0) AS BIGINT) AS d_year, CAST(coalesce(month(d), 0) AS BIGINT) AS d_month,
 CAST(coalesce(day(d), 0) AS BIGINT) AS d_day, CAST(coalesce(quarter(d), 0) AS BIGINT) AS d_quarter,
 CAST(coalesce(isodow(d) - 1, 0) AS BIGINT) AS d_dayofweek, CAST(coalesce(isodow(d) >= 6, false) AS BIGINT) AS d_is_weekend FROM d""")
def date_parts(t: Tables) -> DataFrame:
    df = t("orders").select("o_orderkey", F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderdate")).alias("d"))
    stage = X.DateParts(inputCols=["d"], parts=list(DATE_PARTS))
    return stage.transform(df).select("o_orderkey", *[F.col(c).cast("bigint").alias(c) for c in stage.names()])


@query("date_parts_from_text", """
WITH d AS (SELECT event_id, try_cast(CASE WHEN event_type = 'error' THEN 'unknown' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS d FROM events)
SELECT CAST(coalesce(year(d), 0) AS BIGINT) AS y, CAST(coalesce(isodow(d) - 1, 0) AS BIGINT) AS w, count(*) AS num_rows FROM d GROUP BY 1, 2""")
def date_parts_from_text(t: Tables) -> DataFrame:
    text = F.when(F.col("event_type") == "error", "unknown").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    df = X.DateParts(inputCols=["d"], parts=["year", "dayofweek"]).transform(t("events").select(text.alias("d")))
    return df.groupBy(F.col("d_year").cast("bigint").alias("y"), F.col("d_dayofweek").cast("bigint").alias("w")).agg(
        F.count("*").alias("num_rows")
    )


_TOKENS = "regexp_extract_all(lower(text), '([\\p{L}\\p{N}_]{2,})')"
_COUNTS = f"""c AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY 1, 2),
v AS (SELECT term, sum(tf) AS corpus, count(*) AS docs FROM c GROUP BY 1 ORDER BY corpus DESC, term LIMIT 100)"""


@query("tfidf", f"""
WITH {_COUNTS},
w AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1.0 + docs)) + 1) AS raw FROM c JOIN v USING (term))
SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def tfidf(t: Tables) -> DataFrame:
    return X.tfidf(t("documents"), "doc_id", "text").withColumn("weight", F.round("weight", 6))


@query("tfidf_vocabulary", f"WITH {_COUNTS} SELECT term, CAST(corpus AS BIGINT) AS corpus_count, docs FROM v")
def tfidf_vocabulary(t: Tables) -> DataFrame:
    return X.vocabulary(t("documents"), "doc_id", "text")


@query("text_parts_url", """
SELECT page_id, CAST(CASE WHEN contains(url, '://') AND len(string_split(url, '/')) > 2 THEN length(string_split(url, '/')[3]) ELSE length(url) END AS BIGINT) AS host_len,
 length(url) AS total_len FROM pages""")
def text_parts_url(t: Tables) -> DataFrame:
    df = X.TextParts(inputCols=["url"], semanticType="url").transform(t("pages"))
    return df.select("page_id", F.col("url_host_len").cast("bigint").alias("host_len"), F.col("url_total_len").cast("bigint").alias("total_len"))


@query("text_parts_mixed", """
WITH k AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE concat('u', c_custkey, '@ex', c_nationkey, '.com') END AS mail,
 concat(CASE WHEN c_nationkey < 10 THEN '10.' ELSE '81.' END, c_nationkey, '.1.2') AS ip FROM customer)
SELECT c_custkey, CAST(CASE WHEN contains(mail, '@') THEN length(string_split(mail, '@')[1]) ELSE length(mail) END AS BIGINT) AS user_len,
 CAST(CASE WHEN contains(mail, '@') THEN length(string_split(mail, '@')[2]) ELSE 0 END AS BIGINT) AS domain_len,
 CAST(string_split(ip, '.')[1] AS BIGINT) AS first_octet, CAST(starts_with(ip, '10.') AS BIGINT) AS is_private,
 length(mail) AS plain_len FROM k""")
def text_parts_mixed(t: Tables) -> DataFrame:
    mail = F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name")).otherwise(
        F.concat(F.lit("u"), "c_custkey", F.lit("@ex"), "c_nationkey", F.lit(".com"))
    )
    ip = F.concat(F.when(F.col("c_nationkey") < 10, "10.").otherwise("81."), "c_nationkey", F.lit(".1.2"))
    df = t("customer").select("c_custkey", mail.alias("mail"), ip.alias("ip"))
    for c, kind in (("mail", "email"), ("ip", "ip_address"), ("mail", "text")):
        df = X.TextParts(inputCols=[c], semanticType=kind).transform(df)
    whole = lambda c, name: F.col(c).cast("bigint").alias(name)
    return df.select(
        "c_custkey", whole("mail_user_len", "user_len"), whole("mail_domain_len", "domain_len"),
        whole("ip_first_octet", "first_octet"), whole("ip_is_private", "is_private"), whole("mail_len", "plain_len"),
    )


@query("interactions", _summary_sql("quantity * l_extendedprice + quantity * margin + l_extendedprice * margin"))
def interactions(t: Tables) -> DataFrame:
    stage = X.Interactions(inputCols=["quantity", "l_extendedprice", "margin"])
    total = sum((F.col(c) for c in stage.names()[1:]), F.col(stage.names()[0]))
    return _summary(stage.transform(_lines(t)).withColumn("total", total), "total")


@query("label_encode", """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS label FROM orders""")
def label_encode(t: Tables) -> DataFrame:
    o = t("orders").select("o_orderkey", "o_orderpriority")
    return X.encode_label(o, "o_orderpriority", X.label_table(o, "o_orderpriority")).select(
        "o_orderkey", F.col("label").cast("bigint").alias("label")
    )


@query("label_encode_numbers", """
SELECT n AS class, count(*) AS num_rows, CAST(dense_rank() OVER (ORDER BY n) - 1 AS BIGINT) AS label
FROM (SELECT CAST(l_linenumber * 3 AS DOUBLE) AS n FROM lineitem) GROUP BY n""")
def label_encode_numbers(t: Tables) -> DataFrame:
    df = t("lineitem").select((F.col("l_linenumber") * 3).alias("n"))
    return X.label_table(df, "n").select("class", F.col("n").alias("num_rows"), F.col("label").cast("bigint").alias("label"))


def _plan(features: Features, target: str = "l_returnflag", **kw) -> ModelPlan:
    candidates = (Candidate("Trees", "RandomForestClassifier"), Candidate("Linear", "LogisticRegression"))
    return ModelPlan("multiclass_classification", target, candidates, features=features, **kw)


@query("feature_matrix")
def feature_matrix(t: Tables) -> DataFrame:
    """The whole feature job: types inferred, columns routed, fitted on train rows, all rows transformed."""
    df = t("orders")
    types = {r["column_name"]: r["inferred_type"] for r in infer_schema(df, "o_orderkey").select("column_name", "inferred_type").collect()}
    plan = _plan(
        Features(categorical_strategy="onehot", numeric_transforms=("log",)), "o_orderstatus",
        preprocessing=Preprocessing(outlier_strategy="iqr_cap", scale_strategy="standard", drop_columns=("o_orderkey",)),
    )
    split = S.hash_split(df, ["o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"])
    stages = feature_stages(split, types, plan)
    fitted = Pipeline(stages=stages).fit(split.where("split = 'train'"))
    return X.wide_features(fitted.transform(split), ["o_orderkey", "split"])


@query("feature_counts", """
SELECT count(*) AS num_samples, count(*) FILTER (s = 'train') AS train_samples, count(*) FILTER (s = 'val') AS val_samples,
 count(*) FILTER (s = 'test') AS test_samples, 2 AS num_features
FROM (SELECT CASE WHEN year(o_orderdate) < 2000 THEN 'train' WHEN year(o_orderdate) = 2000 THEN 'val' ELSE 'test' END AS s FROM orders)""")
def feature_counts(t: Tables) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    year = F.year("o_orderdate")
    df = t("orders").withColumn("split", F.when(year < 2000, "train").when(year == 2000, "val").otherwise("test"))
    return X.split_counts(VectorAssembler(inputCols=["o_totalprice", "o_custkey"], outputCol="features").transform(df))


@query("saved_transforms", _summary_sql(
    "ln(1 + CASE WHEN quantity IS NULL THEN fill ELSE quantity END)",
    extra=f", (SELECT median(quantity) AS fill FROM {_LINES} WHERE {_TRAIN}) AS f"))
def saved_transforms(t: Tables) -> DataFrame:
    """Fitted transforms saved, loaded again and applied."""
    df = _lines(t)
    path = scratch_path(t.spark, "transforms")
    stages = [X.NumericImputer(inputCols=["quantity"]), X.LogShift(inputCols=["quantity"])]
    Pipeline(stages=stages).fit(_train(df)).write().overwrite().save(path)
    return _summary(PipelineModel.load(path).transform(df), "quantity")


# --- splits and folds -----------------------------------------------------------------------------------------

# Whole numbers and strings print alike in both engines.
_LINE_KEY = ["quantity", "l_returnflag", "l_linenumber"]
_KEYED = "(SELECT *, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem)"
_GROUP = digest_sql(_LINE_KEY)
_DRAW = f"{digest_sql(_LINE_KEY, 42)} / 1152921504606846976.0::DOUBLE"
_NAME = f"CASE WHEN {_DRAW} < 0.2 THEN 'test' WHEN {_DRAW} < 0.36 THEN 'val' ELSE 'train' END"


def _keyed(t: Tables) -> DataFrame:
    return t("lineitem").withColumn("quantity", F.col("l_quantity").cast("bigint"))


@query("feature_groups", f"SELECT {_GROUP} AS group_id, count(*) AS num_rows FROM {_KEYED} GROUP BY 1")
def feature_groups(t: Tables) -> DataFrame:
    grouped = S.with_groups(_keyed(t), _LINE_KEY)
    return grouped.groupBy(F.col(S.GROUP).alias("group_id")).agg(F.count("*").alias("num_rows"))


@query("split_by_hash", f"SELECT l_returnflag, {_NAME} AS split, count(*) AS num_rows FROM {_KEYED} GROUP BY 1, 2")
def split_by_hash(t: Tables) -> DataFrame:
    return S.hash_split(_keyed(t), _LINE_KEY).groupBy("l_returnflag", "split").agg(F.count("*").alias("num_rows"))


_TRIPLE = ["l_quantity", "l_discount", "l_tax"]
# Groups of equal rows with their size and majority class, and a draw per seed.
_MAJORITY = f"""g AS (SELECT {digest_sql(_TRIPLE)} AS g, * FROM lineitem),
p AS (SELECT g, l_returnflag AS class, count(*) AS c FROM g GROUP BY 1, 2),
m AS (SELECT g, CAST(sum(c) AS BIGINT) AS n, arg_min(class, (-c, class)) AS class FROM p GROUP BY 1)"""
_DRAWN = "CAST('0x' || substr(md5('{seed}|' || g), 1, 15) AS BIGINT)"


@query("split_by_quota", f"""
WITH {_MAJORITY},
u AS (SELECT *, {_DRAWN.format(seed=42)} / 1152921504606846976.0::DOUBLE AS u FROM m),
q AS (SELECT class, greatest(1, CAST(round(sum(n) * 0.2::DOUBLE) AS BIGINT)) AS for_test, greatest(1, CAST(round(sum(n) * 0.16000000000000003::DOUBLE) AS BIGINT)) AS for_val, min(n) AS least FROM u GROUP BY 1),
s AS (SELECT g, n, class, for_test, for_val, n <= greatest(for_val, least) AS fits,
             CASE WHEN n <= greatest(for_val, least) THEN coalesce(sum(n) FILTER (n <= greatest(for_val, least)) OVER (PARTITION BY class ORDER BY u, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS start
      FROM u JOIN q USING (class)),
e AS (SELECT class, max(start + n) FILTER (start < for_test) AS test_end FROM s WHERE fits GROUP BY 1),
a AS (SELECT g, CASE WHEN NOT fits THEN 'train' WHEN start < for_test THEN 'test' WHEN start < test_end + for_val THEN 'val' ELSE 'train' END AS split FROM s JOIN e USING (class))
SELECT l_returnflag, split, count(*) AS num_rows FROM g JOIN a USING (g) GROUP BY 1, 2""")
def split_by_quota(t: Tables) -> DataFrame:
    split = S.quota_split(t("lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_returnflag")
    return split.groupBy("l_returnflag", "split").agg(F.count("*").alias("num_rows"))


@query("split_sequential", """
WITH n AS (SELECT count(*) AS n, CAST(floor(count(*) * 0.2) AS BIGINT) AS nt FROM orders),
m AS (SELECT n - nt - CAST(floor((n - nt) * 0.2) AS BIGINT) AS tr, n - nt AS va FROM n),
r AS (SELECT o_orderdate, row_number() OVER (ORDER BY o_orderdate) AS rn FROM orders),
c AS (SELECT max(o_orderdate) FILTER (rn = tr) AS c1, max(o_orderdate) FILTER (rn = va) AS c2 FROM r, m)
SELECT CASE WHEN o_orderdate <= c1 THEN 'train' WHEN o_orderdate <= c2 THEN 'val' ELSE 'test' END AS split, count(*) AS num_rows
FROM orders, c GROUP BY 1""")
def split_sequential(t: Tables) -> DataFrame:
    return S.sequential_split(t("orders"), "o_orderdate").groupBy("split").agg(F.count("*").alias("num_rows"))


@query("folds_forward", """
WITH n AS (SELECT count(*) AS n, count(*) // 6 AS size FROM orders),
r AS (SELECT o_orderdate, row_number() OVER (ORDER BY o_orderdate) AS rn FROM orders),
c AS (SELECT i, max(o_orderdate) AS cut FROM range(5) AS t(i), n, r WHERE rn = n - (5 - i) * size GROUP BY i),
f AS (SELECT o_orderdate, (SELECT count(*) FROM c WHERE cut < o_orderdate) - 1 AS fold FROM orders)
SELECT CAST(fold AS INTEGER) AS fold, count(*) AS num_rows, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date FROM f GROUP BY 1""")
def folds_forward(t: Tables) -> DataFrame:
    """Bounds of the folds of forward chaining; the oldest rows, which are only ever fitted, are fold -1."""
    folds = S.forward_folds(t("orders"), "o_orderdate", 5)
    return folds.groupBy("fold").agg(F.count("*").alias("num_rows"), F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"))


@query("folds_by_group", f"""
SELECT CAST({digest_sql(_LINE_KEY, 42)} % 5 AS INTEGER) AS fold, count(*) AS num_rows, count(DISTINCT {_GROUP}) AS groups FROM {_KEYED} GROUP BY 1""")
def folds_by_group(t: Tables) -> DataFrame:
    folds = S.with_groups(S.assign_folds(_keyed(t), _LINE_KEY, 5), _LINE_KEY)
    return folds.groupBy("fold").agg(F.count("*").alias("num_rows"), F.count_distinct(S.GROUP).alias("groups"))


@query("folds_stratified", f"""
WITH {_MAJORITY},
f AS (SELECT g, CAST((row_number() OVER (PARTITION BY class ORDER BY {_DRAWN.format(seed=43)}, g) - 1) % 5 AS INTEGER) AS fold FROM m)
SELECT fold, l_returnflag, count(*) AS num_rows FROM g JOIN f USING (g) GROUP BY 1, 2""")
def folds_stratified(t: Tables) -> DataFrame:
    folds = S.assign_folds(t("lineitem"), ["l_quantity", "l_discount", "l_tax"], 5, "l_returnflag")
    return folds.groupBy("fold", "l_returnflag").agg(F.count("*").alias("num_rows"))


@query("fold_strategy", """
SELECT CASE WHEN max(c) > 1 THEN 'StratifiedGroupKFold' ELSE 'StratifiedKFold' END AS strategy
FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_quantity, l_discount, l_tax)""")
def fold_strategy(t: Tables) -> DataFrame:
    df = t("lineitem")
    name = S.fold_strategy(df, ["l_quantity", "l_discount", "l_tax"], True)
    return t.spark.createDataFrame([(name,)], "strategy string")


@query("split_overlap", f"""
WITH s AS (SELECT round(l_discount, 8) AS a, round(l_tax * l_quantity, 8) AS b,
  {_NAME} AS split FROM {_KEYED}),
d AS (SELECT a, b, bool_or(split = 'train') AS tr, bool_or(split = 'val') AS va, bool_or(split = 'test') AS te FROM s GROUP BY 1, 2)
SELECT count(*) FILTER (tr AND va) AS train_val, count(*) FILTER (tr AND te) AS train_test, count(*) FILTER (va AND te) AS val_test FROM d""")
def split_overlap(t: Tables) -> DataFrame:
    """A split that does not keep equal rows together on these two columns, so overlaps are found."""
    df = S.hash_split(_keyed(t), _LINE_KEY).select(
        F.col("l_discount").alias("a"), (F.col("l_tax") * F.col("l_quantity")).alias("b"), "split"
    )
    return S.split_overlap(df, ["a", "b"])


@query("split_disjoint")
def split_disjoint(t: Tables) -> DataFrame:
    features = ["l_quantity", "l_discount", "l_tax"]
    return S.split_overlap(cut_lineage(S.quota_split(t("lineitem"), features, "l_returnflag")), features)
