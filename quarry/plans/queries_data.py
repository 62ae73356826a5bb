"""Registered queries for §2.1–2.6: sources, profiling, selection, encoding,
sequences and splits. Each Spark query runs the library operator on whole
tables; the SQL beside it is the DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.columns import round6
from quarry.operators import encode as E
from quarry.operators import profile as P
from quarry.operators import select as S
from quarry.operators import sequence as Q
from quarry.operators import split as SP
from quarry.plans.registry import query
from quarry.session import scratch_path, table
from quarry.sources import readers as R
from quarry.sources import sinks as K

# ----------------------------------------------------------------- 2.1 sources / sinks


@query("read_parquet", "SELECT * FROM orders")
def q_read_parquet(spark, d):
    return R.read_parquet(spark, f"{d}/orders.parquet")


@query("read_csv", "SELECT * FROM customer")
def q_read_csv(spark, d):
    src = table(spark, d, "customer")
    path = scratch_path(spark, "customer_csv")
    src.write.mode("overwrite").option("header", True).csv(path)
    return R.read_csv(spark, path, src.schema)


@query("source_info", "SELECT 'parquet' AS source_type, count(*) AS n_rows, 'lineitem.parquet' AS filename FROM lineitem")
def q_source_info(spark, d):
    df = table(spark, d, "lineitem")
    return R.source_info(df, "parquet", filename="lineitem.parquet").drop("file_path")


RECORD_SCHEMA = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderpriority", T.StringType()),
])


def order_records(spark, d):
    """Stand-in JSON request records (one object per order)."""
    o = table(spark, d, "orders")
    return o.select(F.to_json(F.struct(*RECORD_SCHEMA.fieldNames())).alias("record"))


@query("read_records", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, CAST(NULL AS VARCHAR) AS _corrupt
FROM orders""")
def q_read_records(spark, d):
    return R.read_records(order_records(spark, d), "record", RECORD_SCHEMA)


CHURN = R.DatasetContract(
    target_column="churn_label", feature_columns=["tenure", "monthly_charges", "total_charges"],
    schema={"tenure": "float32", "monthly_charges": "float32", "total_charges": "float32", "churn_label": "int64"},
    # fixed values: the dataset contract's label map
    label_map={"no": 0, "yes": 1},
)


def churn_frame(spark, d):
    """Stand-in rows in the contract's raw schema, from documents ⋈ labels."""
    docs = table(spark, d, "documents")
    lab = table(spark, d, "labels")
    return docs.join(lab, "doc_id").select(
        "doc_id", F.col("n_chars").alias("tenure"), (F.col("n_chars") / 100).alias("monthly_charges"),
        (F.col("n_chars") * F.lit(1.5)).alias("total_charges"),
        F.when(F.col("toxic") == 1, "yes").otherwise("no").alias("churn_label"),
    )


@query("apply_contract", """
SELECT CAST(d.n_chars AS FLOAT) AS tenure, CAST(d.n_chars / 100 AS FLOAT) AS monthly_charges,
       CAST(d.n_chars * 1.5 AS FLOAT) AS total_charges,
       CAST(CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END AS BIGINT) AS churn_label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def q_apply_contract(spark, d):
    return R.apply_contract(churn_frame(spark, d), CHURN)


@query("label_map_contract", """
SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'yes' ELSE 'no' END AS churn_label,
       CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END AS churn_code
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def q_label_map_contract(spark, d):
    c = churn_frame(spark, d)
    return c.select("doc_id", "churn_label", E.map_labels("churn_label", CHURN.label_map).alias("churn_code"))


@query("write_encoders", """
SELECT 'p_brand' AS column, p_brand AS value, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT p_brand FROM part)
UNION ALL
SELECT 'p_type', p_type, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) FROM (SELECT DISTINCT p_type FROM part)""")
def q_write_encoders(spark, d):
    part = table(spark, d, "part")
    dic = E.build_dictionary(part, ["p_brand", "p_type"])
    path = scratch_path(spark, "encoders")
    K.write_encoders(dic, path)
    return spark.read.parquet(path).select("column", "value", "code")


# ----------------------------------------------------------------- 2.2 profiling
LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                    "l_discount", "l_tax"]


@query("profile_shape", "SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns FROM lineitem")
def q_profile_shape(spark, d):
    return P.profile_shape(table(spark, d, "lineitem"))


def docs_left(spark, d):
    """documents LEFT JOIN labels: the unlabelled documents carry nulls."""
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")


@query("profile_nulls", """
SELECT * FROM (
  SELECT 'quality' AS column, count(*) FILTER (WHERE l.quality IS NULL) AS null_count
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL
  SELECT 'toxic', count(*) FILTER (WHERE l.toxic IS NULL) FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL
  SELECT 'n_chars', count(*) FILTER (WHERE n_chars IS NULL) FROM documents
  UNION ALL
  SELECT 'lang', count(*) FILTER (WHERE lang IS NULL) FROM documents
) WHERE null_count > 0""")
def q_profile_nulls(spark, d):
    return P.profile_nulls(docs_left(spark, d), ["quality", "toxic", "n_chars", "lang"])


def _numeric_sql(cols, dtypes, table_name):
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS column, '{dtypes[c]}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) > 0 AS nullable,
  count(*) FILTER (WHERE {c} IS NULL) AS null_count, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
  round(avg(CAST({c} AS DOUBLE)), 6) AS mean, round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS std,
  round(median(CAST({c} AS DOUBLE)), 6) AS median,
  printf('Numeric feature with range [%.2f, %.2f]', CAST(min({c}) AS DOUBLE), CAST(max({c}) AS DOUBLE)) AS description
FROM {table_name}""")
    return "\nUNION ALL\n".join(parts)


LINEITEM_TYPES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
                  "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double"}


@query("profile_numeric", _numeric_sql(LINEITEM_NUMERIC, LINEITEM_TYPES, "lineitem"), headline=True)
def q_profile_numeric(spark, d):
    p = P.profile_numeric(table(spark, d, "lineitem"), LINEITEM_NUMERIC)
    return p.select("column", "dtype", "nullable", "null_count", "min", "max", round6("mean").alias("mean"),
                    round6("std").alias("std"), round6("median").alias("median"), "description")


@query("profile_categorical", """
WITH v AS (
  SELECT 'p_name' AS "column", p_name AS value FROM part UNION ALL
  SELECT 'p_brand', p_brand FROM part UNION ALL
  SELECT 'p_type', p_type FROM part),
c AS (SELECT "column", count(DISTINCT value) + max(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS n_unique,
             max(CASE WHEN value IS NULL THEN 1 ELSE 0 END) = 1 AS has_null FROM v GROUP BY "column"),
f AS (SELECT "column", string_agg(value, '|' ORDER BY value) AS categories FROM (
        SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY value) AS rk
        FROM (SELECT DISTINCT "column", value FROM v WHERE value IS NOT NULL)) WHERE rk <= 100 GROUP BY "column")
SELECT c."column", CAST(n_unique AS BIGINT) AS n_unique, has_null, categories FROM c JOIN f ON c."column" = f."column"
""")
def q_profile_categorical(spark, d):
    p = P.profile_categorical(table(spark, d, "part"), ["p_name", "p_brand", "p_type"])
    return p.select("column", "n_unique", "has_null", F.array_join("categories", "|").alias("categories"))


@query("profile_target", """
SELECT 'o_orderpriority' AS column, 'string' AS dtype, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS n_distinct,
       (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT o_orderpriority AS v FROM orders ORDER BY v LIMIT 10)) AS first_values""")
def q_profile_target(spark, d):
    p = P.profile_target(table(spark, d, "orders"), "o_orderpriority")
    return p.select("column", "dtype", "n_distinct", F.array_join("first_values", "|").alias("first_values"))


@query("profile_encoding", """
WITH dic AS (
  SELECT 'p_brand' AS column, v AS value, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT p_brand AS v FROM part)
  UNION ALL
  SELECT 'p_type', v, dense_rank() OVER (ORDER BY v) - 1 FROM (SELECT DISTINCT p_type AS v FROM part)),
nulls AS (SELECT 'p_brand' AS column, count(*) FILTER (WHERE p_brand IS NULL) AS null_count FROM part
          UNION ALL SELECT 'p_type', count(*) FILTER (WHERE p_type IS NULL) FROM part)
SELECT dic.column, n.null_count, count(*) AS n_unique,
       string_agg(CASE WHEN code < 10 THEN value END, '|' ORDER BY code) AS original_values,
       string_agg(CASE WHEN code < 10 THEN CAST(code AS VARCHAR) END, '|' ORDER BY code) AS encoded_values
FROM dic JOIN nulls n ON dic.column = n.column GROUP BY dic.column, n.null_count""")
def q_profile_encoding(spark, d):
    part = table(spark, d, "part")
    cols = ["p_brand", "p_type"]
    info = E.encoding_info(E.build_dictionary(part, cols))
    nulls = P.profile_nulls(part, cols)
    allc = spark.createDataFrame([(c,) for c in cols], "column string")
    nn = allc.join(nulls, "column", "left").select("column", F.coalesce("null_count", F.lit(0)).alias("null_count"))
    return nn.join(info, "column").select(
        "column", "null_count", "n_unique", F.array_join("original_values", "|").alias("original_values"),
        F.array_join(F.transform("encoded_values", lambda c: c.cast("string")), "|").alias("encoded_values"))


@query("output_schema_classification", """
WITH dic AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT o_orderpriority AS v FROM orders))
SELECT count(*) AS n_classes, string_agg(v, '|' ORDER BY code) AS class_names,
       string_agg(v || ':' || CAST(code AS VARCHAR), '|' ORDER BY code) AS label_mapping, true AS encoded FROM dic""")
def q_output_schema_classification(spark, d):
    s = P.output_schema_classification(table(spark, d, "orders"), "o_orderpriority")
    m = F.map_entries("label_mapping")
    return s.select(
        "n_classes", F.array_join("class_names", "|").alias("class_names"),
        F.array_join(F.transform(F.array_sort(F.transform(m, lambda e: F.struct(e["value"].alias("c"), e["key"].alias("k")))),
                                 lambda e: F.concat(e["k"], F.lit(":"), e["c"].cast("string"))), "|").alias("label_mapping"),
        "encoded")


@query("output_schema_regression", """
SELECT min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(avg(l_extendedprice), 6) AS mean,
       round(stddev_samp(l_extendedprice), 6) AS std,
       printf('Regression output - continuous numeric values in range [%.2f, %.2f]', min(l_extendedprice), max(l_extendedprice)) AS description
FROM lineitem""")
def q_output_schema_regression(spark, d):
    s = P.output_schema_regression(table(spark, d, "lineitem"), "l_extendedprice")
    return s.select("min", "max", round6("mean").alias("mean"), round6("std").alias("std"), "description")


LAG_SQL = """
WITH s AS (
  SELECT user_id, event_id, ts, value,
         row_number() OVER w - 1 AS position, count(*) OVER (PARTITION BY user_id) AS n,
         {cols}
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT {out} FROM s WHERE position >= {L} AND position <= n - {H}"""


def _lag_sql(L, H, out):
    cols = [f"lag(value, {k}) OVER w AS value_lag_{k}" for k in range(L, 0, -1)]
    cols += [f"lead(value, {j}) OVER w AS y_{j + 1}" for j in range(0, H)]
    return LAG_SQL.format(cols=", ".join(cols), out=out, L=L, H=H)


@query("output_schema_timeseries", _lag_sql(10, 3, "min(least(y_1, y_2, y_3)) AS min, max(greatest(y_1, y_2, y_3)) AS max, "
                                            "round((sum(y_1) + sum(y_2) + sum(y_3)) / (3 * count(*)), 6) AS mean, 3 AS forecast_horizon"))
def q_output_schema_timeseries(spark, d):
    ev = table(spark, d, "events")
    s = Q.lag_features(ev, ["value"], "value", "ts", "event_id", "user_id", 10, 3)
    o = P.output_schema_timeseries(s, "y", 3)
    return o.select("min", "max", round6("mean").alias("mean"), "forecast_horizon")


@query("output_schema_clustering", "SELECT count(*) AS n_samples, true AS unsupervised, 3 AS n_clusters FROM customer")
def q_output_schema_clustering(spark, d):
    return P.output_schema_clustering(table(spark, d, "customer"), 3)


@query("contamination_rate", """
SELECT count(*) AS n_rows, CAST(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_anomalies,
       round(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) / count(*), 6) AS contamination FROM labels""")
def q_contamination_rate(spark, d):
    c = P.contamination_rate(table(spark, d, "labels"), "toxic")
    return c.select("n_rows", "n_anomalies", round6("contamination").alias("contamination"))


# ----------------------------------------------------------------- 2.3 selection / validation
@query("select_features", "SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part")
def q_select_features(spark, d):
    part = table(spark, d, "part")
    return part.select(*S.select_features(part, "p_retailprice"))


@query("select_features_ts", "SELECT event_id, user_id, event_type, props FROM events")
def q_select_features_ts(spark, d):
    ev = table(spark, d, "events")
    return ev.select(*S.select_features_ts(ev, "value", "ts"))


@query("select_features_anomaly", "SELECT doc_id, quality FROM labels")
def q_select_features_anomaly(spark, d):
    lab = table(spark, d, "labels")
    return lab.select(*S.select_features_anomaly(lab, "toxic"))


@query("select_features_clustering", "SELECT c_acctbal, c_nationkey FROM customer")
def q_select_features_clustering(spark, d):
    c = table(spark, d, "customer")
    return c.select(*S.select_features_clustering(c, ["c_acctbal", "c_nationkey"]))


@query("align_scoring_schema", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_align_scoring_schema(spark, d):
    c = table(spark, d, "customer")
    return S.align_scoring_schema(c, ["c_nationkey", "c_acctbal", "c_mktsegment"], keep=["c_custkey"])


def customer_records(spark, d):
    """Stand-in request records as key -> value maps; records of customers
    with a negative balance arrive without that key."""
    c = table(spark, d, "customer")
    m = F.create_map(F.lit("c_nationkey"), F.col("c_nationkey").cast("string"), F.lit("c_acctbal"),
                     F.col("c_acctbal").cast("string"), F.lit("c_mktsegment"), F.col("c_mktsegment"),
                     F.lit("c_name"), F.col("c_name"))
    m = F.map_filter(m, lambda k, v: ~((k == "c_acctbal") & (F.col("c_acctbal") < 0)))
    return c.select("c_custkey", m.alias("fields"))


@query("validate_record", """
SELECT c_custkey, 'c_nationkey' AS feature, 'present' AS status FROM customer
UNION ALL SELECT c_custkey, 'c_acctbal', CASE WHEN c_acctbal < 0 THEN 'missing' ELSE 'present' END FROM customer
UNION ALL SELECT c_custkey, 'c_mktsegment', 'present' FROM customer
UNION ALL SELECT c_custkey, 'c_name', 'extra' FROM customer""")
def q_validate_record(spark, d):
    return S.schema_diff(customer_records(spark, d), ["c_nationkey", "c_acctbal", "c_mktsegment"], "c_custkey")


def event_time_strings(spark, d):
    """Stand-in string times: error events carry an unparseable value."""
    ev = table(spark, d, "events")
    s = F.when(F.col("event_type") == "error", F.lit("not a time")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return ev.select("event_id", s.alias("t"))


@query("parse_time", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'not a time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS t,
       CASE WHEN event_type = 'error' THEN NULL ELSE date_trunc('second', ts) END AS t_ts
FROM events""")
def q_parse_time(spark, d):
    out = S.parse_time(event_time_strings(spark, d), "t")
    return out.select("event_id", "t", F.col("t_ts").cast("timestamp_ntz").alias("t_ts"))


# ----------------------------------------------------------------- 2.4 encoding
@query("encode_label", """
SELECT o_orderkey, o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS o_orderpriority_code
FROM orders""")
def q_encode_label(spark, d):
    out, _ = E.encode_label(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")
    return out


@query("encode_features", """
SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS INTEGER) AS p_name,
       CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS p_brand,
       CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS p_type, p_size, p_retailprice
FROM part""", headline=True)
def q_encode_features(spark, d):
    out, _ = E.encode_features(table(spark, d, "part"))
    return out


@query("encoding_info", """
WITH dic AS (
  SELECT 'p_brand' AS column, v AS value, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT p_brand AS v FROM part)
  UNION ALL
  SELECT 'p_type', v, dense_rank() OVER (ORDER BY v) - 1 FROM (SELECT DISTINCT p_type AS v FROM part))
SELECT "column", count(*) AS n_unique,
       string_agg(CASE WHEN code < 10 THEN value END, '|' ORDER BY code) AS original_values,
       string_agg(CASE WHEN code < 10 THEN CAST(code AS VARCHAR) END, '|' ORDER BY code) AS encoded_values
FROM dic GROUP BY "column"
""")
def q_encoding_info(spark, d):
    info = E.encoding_info(E.build_dictionary(table(spark, d, "part"), ["p_brand", "p_type"]))
    return info.select("column", "n_unique", F.array_join("original_values", "|").alias("original_values"),
                       F.array_join(F.transform("encoded_values", lambda c: c.cast("string")), "|").alias("encoded_values"))


def priority_predictions(spark, d):
    """Stand-in predicted codes (a price-band rule); code 5 has no class."""
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.floor(F.col("o_totalprice") / 100000).cast("int").alias("pred_code"))


DECODE_SQL = """
WITH dic AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT o_orderpriority AS v FROM orders)),
p AS (SELECT o_orderkey, CAST(floor(o_totalprice / 100000) AS INTEGER) AS pred_code FROM orders)
SELECT p.o_orderkey, p.pred_code, dic.v AS prediction, (dic.v IS NULL AND p.pred_code IS NOT NULL) AS decoding_failed
FROM p LEFT JOIN dic ON p.pred_code = dic.code"""


@query("decode_label", DECODE_SQL)
def q_decode_label(spark, d):
    dic = E.build_dictionary(table(spark, d, "orders"), ["o_orderpriority"])
    return E.decode_label(priority_predictions(spark, d), dic, "pred_code", "prediction")


@query("write_predictions", DECODE_SQL)
def q_write_predictions(spark, d):
    out = q_decode_label(spark, d)
    path = scratch_path(spark, "predictions")
    K.write_predictions(out, path)
    return spark.read.parquet(path)


# ----------------------------------------------------------------- 2.5 sequences
@query("sort_time", "SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS position FROM events")
def q_sort_time(spark, d):
    return Q.sort_time(table(spark, d, "events").select("event_id", "ts"), "ts", "event_id")


@query("lag_features", _lag_sql(10, 1, "user_id, event_id, ts, position, "
                                + ", ".join(f"value_lag_{k}" for k in range(10, 0, -1)) + ", y_1 AS y"), headline=True)
def q_lag_features(spark, d):
    ev = table(spark, d, "events")
    return Q.lag_features(ev, ["value"], "value", "ts", "event_id", "user_id", 10, 1)


@query("horizon_target", _lag_sql(10, 3, "user_id, event_id, position, y_1, y_2, y_3"))
def q_horizon_target(spark, d):
    ev = table(spark, d, "events")
    s = Q.lag_features(ev, ["value"], "value", "ts", "event_id", "user_id", 10, 3)
    return s.select("user_id", "event_id", "position", *[F.col("y")[j].alias(f"y_{j + 1}") for j in range(3)])


# ----------------------------------------------------------------- 2.6 splits
def _split_sql(src: str, key: str, label: str | None, cols: str) -> str:
    part = f"PARTITION BY {label} " if label else ""
    return f"""
WITH r AS (
  SELECT {cols}, row_number() OVER ({part}ORDER BY md5('42:' || CAST({key} AS VARCHAR)), {key}) AS rn,
         count(*) OVER ({part.strip()}) AS n FROM {src}),
c AS (SELECT *, CAST(ceil(n * 0.2) AS BIGINT) AS k1 FROM r)
SELECT {cols}, CASE WHEN rn <= k1 THEN 'test'
                    WHEN rn <= k1 + CAST(ceil((n - k1) * 0.125) AS BIGINT) THEN 'val' ELSE 'train' END AS split
FROM c"""


@query("split_random", _split_sql("orders", "o_orderkey", None, "o_orderkey"))
def q_split_random(spark, d):
    return SP.split_random(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("split_stratified", _split_sql("orders", "o_orderkey", "o_orderpriority", "o_orderkey, o_orderpriority"),
       headline=True)
def q_split_stratified(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return SP.split_stratified(o, "o_orderkey", "o_orderpriority")


@query("split_anomaly", _split_sql("labels", "doc_id", "toxic", "doc_id, toxic"))
def q_split_anomaly(spark, d):
    return SP.split_anomaly(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "toxic")


@query("split_clustering", _split_sql("customer", "c_custkey", None, "c_custkey"))
def q_split_clustering(spark, d):
    return SP.split_clustering(table(spark, d, "customer").select("c_custkey"), "c_custkey")


@query("split_time", """
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM events),
c AS (SELECT *, CAST(floor(n * 0.8) AS BIGINT) AS t FROM r),
v AS (SELECT *, CAST(floor(t * (1 - 0.125)) AS BIGINT) AS v FROM c)
SELECT event_id, CASE WHEN rn <= v THEN 'train' WHEN rn <= t THEN 'val' ELSE 'test' END AS split FROM v""")
def q_split_time(spark, d):
    return SP.split_time(table(spark, d, "events").select("event_id", "ts"), "ts", "event_id").select("event_id", "split")


@query("kfold", """
SELECT c_custkey, c_mktsegment,
       CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42:' || CAST(c_custkey AS VARCHAR)), c_custkey) - 1) % 5 AS INTEGER) AS fold
FROM customer""")
def q_kfold(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return SP.kfold(c, "c_custkey", 5, "c_mktsegment")
