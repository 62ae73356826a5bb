"""Encoding (§2.4): dictionaries as DataFrames.

build  = distinct values per column, ``dense_rank`` in sorted order (codes
         0..k-1, the sorted order of a label encoder; "10" < "9" < "a").
apply  = equi-join on (value); the dictionary is cached and counted first
         and broadcast only below a row limit (no shuffle of the fact table);
         a high-cardinality dictionary keeps a shuffle join.
decode = the same join in the other direction.
Null values are never encoded: they stay null (not_null_mask).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.columns import bounded_broadcast, categorical_columns


SINGLE_TASK_VALUES = 1_000_000


def build_dictionary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, code) for each listed column; values cast to string.

    Distinct values are counted per column first (a small action). When
    every column has at most ``SINGLE_TASK_VALUES`` values, codes are a
    ``dense_rank`` per column. Otherwise the distinct values are range
    partitioned on (column, value) — balanced, ordered partitions — and a
    code is the column's count in earlier partitions (a small prefix-sum
    table) plus the row number inside the partition, so no task ever sorts a
    whole high-cardinality column."""
    from quarry.functions.columns import materialize

    parts = None
    for c in columns:
        p = df.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")).where(F.col("value").isNotNull())
        parts = p if parts is None else parts.unionByName(p)
    d = parts.distinct()
    sizes = {r["column"]: r["count"] for r in d.groupBy("column").count().collect()}  # one row per column
    if not sizes or max(sizes.values()) <= SINGLE_TASK_VALUES:
        w = Window.partitionBy("column").orderBy("value")
        return d.select("column", "value", (F.dense_rank().over(w) - 1).cast("int").alias("code"))
    d = d.transform(materialize)
    n_parts = max(df.sparkSession.sparkContext.defaultParallelism, 2 * sum(sizes.values()) // SINGLE_TASK_VALUES + 1)
    r = d.repartitionByRange(int(n_parts), "column", "value").withColumn("__p", F.spark_partition_id())
    r = r.transform(materialize)
    cnt = r.groupBy("__p", "column").agg(F.count(F.lit(1)).alias("__c"))
    w_off = Window.partitionBy("column").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    off = cnt.select("__p", "column", F.coalesce(F.sum("__c").over(w_off), F.lit(0)).alias("__before"))
    rn = F.row_number().over(Window.partitionBy("__p", "column").orderBy("value"))
    return r.join(bounded_broadcast(off), ["__p", "column"]).select(
        "column", "value", (F.col("__before") + rn - 1).cast("int").alias("code"))


def apply_dictionary(df: DataFrame, dictionary: DataFrame, columns: list[str], suffix: str = "") -> DataFrame:
    """Replace (or add, with ``suffix``) each column by its code; unknown or
    null values give null."""
    out = df
    dictionary = bounded_broadcast(dictionary)
    for c in columns:
        d = dictionary.where(F.col("column") == c).select(
            F.col("value").alias(f"__v_{c}"), F.col("code").alias(f"__code_{c}")
        )
        out = out.join(d, out[c].cast("string") == d[f"__v_{c}"], "left").drop(f"__v_{c}")
        target = f"{c}{suffix}"
        if suffix:
            out = out.withColumnRenamed(f"__code_{c}", target)
        else:
            out = out.drop(c).withColumnRenamed(f"__code_{c}", c)
    return out


def encode_label(df: DataFrame, target: str, code_col: str | None = None):
    """Encode a target; returns (encoded df, dictionary)."""
    d = build_dictionary(df, [target])
    out = apply_dictionary(df, d, [target], suffix="_code")
    if code_col:
        out = out.withColumnRenamed(f"{target}_code", code_col)
    return out, d


def encode_features(df: DataFrame, columns: list[str] | None = None, exclude: list[str] | tuple = ()):
    """Encode every string column (or the given ones) in place; returns
    (encoded df, dictionary)."""
    cols = columns if columns is not None else categorical_columns(df, exclude)
    if not cols:
        return df, None
    d = build_dictionary(df, cols)
    encoded = apply_dictionary(df, d, cols)
    return encoded.select(*df.columns), d


def encoding_info(dictionary: DataFrame, n_first: int = 10) -> DataFrame:
    """Per encoded column: n_unique and the first ``n_first`` originals with
    their codes. The full class list is the dictionary table itself (one row
    per class); it is never gathered into one array."""
    n = dictionary.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
    first = dictionary.where(F.col("code") < n_first).groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("code", "value"))).alias("_p"))
    return n.join(first, "column").select(
        "column",
        "n_unique",
        F.transform("_p", lambda p: p["value"]).alias("original_values"),
        F.transform("_p", lambda p: p["code"]).alias("encoded_values"),
    )


def decode_label(df: DataFrame, dictionary: DataFrame, code_col: str, out_col: str, column: str | None = None) -> DataFrame:
    """code -> original value; rows whose code has no entry keep the code and
    get ``decoding_failed = true``."""
    d = dictionary
    if column is not None:
        d = d.where(F.col("column") == column)
    d = bounded_broadcast(d.select(F.col("code").alias("__dcode"), F.col("value").alias(out_col)))
    out = df.join(d, df[code_col] == d["__dcode"], "left").drop("__dcode")
    return out.withColumn("decoding_failed", F.col(out_col).isNull() & F.col(code_col).isNotNull())


def map_labels(col: str, mapping: dict[str, int]):
    """Fixed label map (e.g. the contract's {"no": 0, "yes": 1}) as a
    literal map lookup; unknown labels map to null."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return m[F.col(col).cast("string")]
