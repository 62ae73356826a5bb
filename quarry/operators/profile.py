"""Profiling (§2.2): one scan, one wide aggregate, then unpivot.

The reference makes one pass per column per statistic; here every statistic
of every column is a slot of a single ``agg`` (partial aggregation on the
map side, one small exchange), and the wide result row is turned into one
row per column with ``stack``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import categorical_columns, known, missing, numeric_columns


def _stack(wide: DataFrame, names: list[str], fields: list[str]) -> DataFrame:
    """Turn ``wide`` (columns ``{i}__{field}``) into one row per name."""
    parts = []
    for i, n in enumerate(names):
        parts.append(f"'{n}'")
        parts.extend(f"`{i}__{f}`" for f in fields)
    expr = f"stack({len(names)}, {', '.join(parts)}) as (column, {', '.join(fields)})"
    return wide.selectExpr(expr)


def profile_shape(df: DataFrame) -> DataFrame:
    """rows x columns, as one row."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns")
    )


def profile_columns(df: DataFrame) -> DataFrame:
    """Column names and Spark types in schema order (profile_columns)."""
    spark = df.sparkSession
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "position int, column string, dtype string")


def profile_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null count per column (NaN counts as null), only the columns that have any."""
    cols = columns or df.columns
    wide = df.agg(*[F.count_if(missing(df, c)).alias(f"{i}__null_count") for i, c in enumerate(cols)])
    return _stack(wide, cols, ["null_count"]).where(F.col("null_count") > 0)


def profile_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per numeric column: dtype, nullable, null_count, min, max, mean,
    sample std, exact (interpolated) median and the range text.

    Pass 1 is one aggregate with every statistic of every column; the exact
    medians then come from bounded histogram refinement over the same
    columns (:func:`exact_quantiles`). Nothing keeps a per-value map of a
    whole column."""
    from quarry.functions.stats import exact_quantiles

    cols = columns or numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        x = known(df, c).cast("double")  # NaN is a missing value
        aggs += [
            F.count_if(missing(df, c)).alias(f"{i}__null_count"),
            F.min(x).alias(f"{i}__min"),
            F.max(x).alias(f"{i}__max"),
            F.avg(x).alias(f"{i}__mean"),
            F.stddev_samp(x).alias(f"{i}__std"),
            F.count(x).alias(f"{i}__n"),
        ]
    wide_row = df.agg(*aggs).first()  # one row: statistics per column
    ranges = {c: (int(wide_row[f"{i}__n"]), wide_row[f"{i}__min"], wide_row[f"{i}__max"]) for i, c in enumerate(cols)}
    medians = exact_quantiles(df.select(*[known(df, c).alias(c) for c in cols]), cols, 0.5, ranges=ranges)
    spark = df.sparkSession
    fields = ["null_count", "min", "max", "mean", "std"]
    rows = [(c, int(wide_row[f"{i}__null_count"]), *[wide_row[f"{i}__{f}"] for f in fields[1:]], medians[c])
            for i, c in enumerate(cols)]
    long = spark.createDataFrame(rows, "column string, null_count bigint, min double, max double, mean double, "
                                       "std double, median double")
    dtypes = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(df.schema[c].dataType.simpleString()))])
    return long.select(
        "column",
        dtypes[F.col("column")].alias("dtype"),
        (F.col("null_count") > 0).alias("nullable"),
        "null_count", "min", "max", "mean", "std", "median",
        # fixed value: the text of a range description
        F.format_string("Numeric feature with range [%.2f, %.2f]", "min", "max").alias("description"),
    )


def profile_categorical(df: DataFrame, columns: list[str] | None = None, n_categories: int = 100) -> DataFrame:
    """Per string column: distinct count including null, null flag, and the
    first ``n_categories`` categories in sorted order.

    The first-k is a ``row_number() <= k`` filter, which Spark plans as a
    group limit below the exchange, so no column's full dictionary is ever
    gathered in one task."""
    cols = columns or categorical_columns(df)
    long = _stack(df.select(*[F.col(c).cast("string").alias(f"{i}__value") for i, c in enumerate(cols)]), cols, ["value"])
    counts = long.groupBy("column").agg(
        F.count_distinct("value").alias("n_non_null"),
        F.max(F.col("value").isNull().cast("int")).alias("has_null"),
    )
    firsts = (
        long.where(F.col("value").isNotNull()).distinct()
        .withColumn("rk", F.row_number().over(_by_column_value()))
        .where(F.col("rk") <= n_categories)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list("value")).alias("categories"))
    )
    return counts.join(firsts, "column", "left").select(
        "column",
        (F.col("n_non_null") + F.col("has_null")).cast("bigint").alias("n_unique"),
        (F.col("has_null") == 1).alias("has_null"),
        F.coalesce(F.col("categories"), F.array().cast("array<string>")).alias("categories"),
    )


def _by_column_value():
    from pyspark.sql import Window

    return Window.partitionBy("column").orderBy("value")


def profile_target(df: DataFrame, target: str, n_values: int = 10) -> DataFrame:
    """dtype, distinct count (nulls excluded) and the first ``n_values``
    distinct values in sorted order, as one row.

    Both parts read the same ``distinct`` sub-plan; the two branches are
    combined by a union and a final one-row aggregate (no join)."""
    t = F.col(target)
    d = df.select(t.alias("v")).where(F.col("v").isNotNull()).distinct()
    n = d.agg(F.count(F.lit(1)).alias("n_distinct")).select("n_distinct", F.lit(None).cast(df.schema[target].dataType).alias("v"))
    first = d.orderBy("v").limit(n_values).select(F.lit(None).cast("bigint").alias("n_distinct"), "v")
    return n.unionByName(first).agg(
        F.lit(target).alias("column"),
        F.lit(df.schema[target].dataType.simpleString()).alias("dtype"),
        F.max("n_distinct").alias("n_distinct"),
        F.array_sort(F.collect_list(F.col("v"))).alias("first_values"),
    )


def output_schema_classification(df: DataFrame, target: str) -> DataFrame:
    """Classes in sorted order with their codes (the single, sorted
    dictionary; see quirk Q5)."""
    from quarry.operators.encode import build_dictionary

    d = build_dictionary(df, [target])
    return d.groupBy().agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.array_sort(F.collect_list(F.struct("code", "value"))).alias("_pairs"),
    ).select(
        "n_classes",
        F.transform("_pairs", lambda p: p["value"]).alias("class_names"),
        F.map_from_entries(F.transform("_pairs", lambda p: F.struct(p["value"], p["code"]))).alias("label_mapping"),
        F.lit(df.schema[target].dataType.simpleString() == "string").alias("encoded"),
    )


def output_schema_regression(df: DataFrame, target: str) -> DataFrame:
    y = known(df, target).cast("double")
    return df.agg(
        F.min(y).alias("min"), F.max(y).alias("max"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"),
    ).withColumn(
        "description",
        # fixed value: the text of a range description
        F.format_string("Regression output - continuous numeric values in range [%.2f, %.2f]", "min", "max"),
    )


def output_schema_timeseries(samples: DataFrame, target: str, horizon: int) -> DataFrame:
    """min/max/mean over the flattened horizon targets (scalar or array)."""
    is_array = samples.schema[target].dataType.simpleString().startswith("array")
    y = F.explode(F.col(target)) if is_array else F.col(target)
    flat = samples.select(y.alias("y")).select(F.col("y").cast("double").alias("y"))
    return flat.agg(F.min("y").alias("min"), F.max("y").alias("max"), F.avg("y").alias("mean")).withColumn(
        "forecast_horizon", F.lit(horizon)
    )


def output_schema_clustering(df: DataFrame, n_clusters: int = 3) -> DataFrame:
    """The intent of the reference's (broken) clustering branch: sample count,
    unsupervised flag and requested cluster count."""
    return df.agg(F.count(F.lit(1)).alias("n_samples")).select(
        "n_samples", F.lit(True).alias("unsupervised"), F.lit(n_clusters).alias("n_clusters")
    )


def contamination_rate(df: DataFrame, target: str, default: float = 0.1) -> DataFrame:
    """Share of rows with target == 1 (``default`` when there are no rows)."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(F.col(target) == 1, 1).otherwise(0)).alias("n_anomalies"),
    ).select(
        "n_rows", F.coalesce(F.col("n_anomalies"), F.lit(0)).cast("bigint").alias("n_anomalies"),
        F.when(F.col("n_rows") > 0, F.col("n_anomalies") / F.col("n_rows")).otherwise(F.lit(default)).alias("contamination"),
    )
