"""Projections, predicates and validation (§2.3). All are schema-level
decisions on the driver followed by a lazy ``select``; nothing reads data
until an action, so the Parquet scan only reads the chosen columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _require(df: DataFrame, names: list[str], what: str = "feature") -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing {what} columns: {missing}; available: {df.columns}")


def select_features(df: DataFrame, target: str, feature_columns: list[str] | None = None) -> list[str]:
    """Explicit list in the given order, else every column but the target.
    The target is required (require_target)."""
    if not target or target not in df.columns:
        raise ValueError(f"target column {target!r} is required")
    if feature_columns:
        _require(df, feature_columns)
        return list(feature_columns)
    return [c for c in df.columns if c != target]


def select_features_ts(df: DataFrame, target: str, time_col: str | None, feature_columns: list[str] | None = None) -> list[str]:
    """Explicit, else all minus {target, time}; the target's own history is
    not a feature unless listed (require_features on the explicit list)."""
    if not target or target not in df.columns:
        raise ValueError(f"target column {target!r} is required")
    if feature_columns:
        _require(df, feature_columns)
        return list(feature_columns)
    drop = {target} | ({time_col} if time_col and time_col in df.columns else set())
    return [c for c in df.columns if c not in drop]


def select_features_anomaly(df: DataFrame, target: str | None, feature_columns: list[str] | None = None) -> list[str]:
    """Explicit -> all minus target (when present) -> all."""
    if feature_columns:
        _require(df, feature_columns)
        return list(feature_columns)
    if target and target in df.columns:
        return [c for c in df.columns if c != target]
    return list(df.columns)


def select_features_clustering(df: DataFrame, feature_columns: list[str] | None = None) -> list[str]:
    """Explicit, else every column (no target is ever dropped)."""
    if feature_columns:
        _require(df, feature_columns)
        return list(feature_columns)
    return list(df.columns)


def align_scoring_schema(df: DataFrame, feature_names: list[str] | None, keep: list[str] | tuple = ()) -> DataFrame:
    """Missing features -> error with both lists; extras dropped; columns put
    in trained order. No stored schema -> pass everything."""
    if not feature_names:
        return df
    missing = [c for c in feature_names if c not in df.columns]
    if missing:
        raise ValueError(f"missing features {missing}; expected {feature_names}")
    return df.select(*[c for c in keep if c not in feature_names], *feature_names)


def validate_record(spark: SparkSession, record_columns: list[str], feature_names: list[str]) -> DataFrame:
    """Schema diff of a sample record against the trained features: one row
    per name with status present / missing / extra (no prediction)."""
    rows = [(f, "present" if f in record_columns else "missing") for f in feature_names]
    rows += [(c, "extra") for c in record_columns if c not in feature_names]
    return spark.createDataFrame(rows, "feature string, status string")


def schema_diff(records: DataFrame, feature_names: list[str], key: str) -> DataFrame:
    """Per-record validation for JSON-like records held as a map column
    ``fields`` (one row per record and feature): present/missing, plus the
    record's extra keys. Runs fully distributed."""
    names = F.array(*[F.lit(f) for f in feature_names])
    keys = F.map_keys(F.col("fields"))
    expected = records.select(key, F.explode(names).alias("feature"), keys.alias("_k")).select(
        key, "feature", F.when(F.array_contains("_k", F.col("feature")), "present").otherwise("missing").alias("status")
    )
    extra = records.select(key, F.explode(F.array_except(keys, names)).alias("feature")).withColumn("status", F.lit("extra"))
    return expected.unionByName(extra)


def parse_time(df: DataFrame, col: str, fmt: str | None = None) -> DataFrame:
    """String time -> timestamp with ``try_to_timestamp``; values that do not
    parse stay null in ``{col}_ts`` and the raw column is kept."""
    c = F.col(col)
    parsed = F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)
    return df.withColumn(f"{col}_ts", parsed)
