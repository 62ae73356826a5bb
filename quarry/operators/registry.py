"""Run log and model versions as plain tables (§2.10).

``runs``      run_id, experiment, model, algorithm, params map, metrics map,
              duration, flags, status, start/end.
``versions``  model_name, version, run_id, tags map, stage.
Appends go to Parquet under a caller-given folder; stage changes are derived
with a window (newest version -> Production, older -> Archived), so replays
are idempotent.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("experiment", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("model_order", T.IntegerType()),
    T.StructField("task", T.StringType()),
    T.StructField("algorithm", T.StringType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("score", T.DoubleType()),
    T.StructField("hpo_used", T.BooleanType()),
    T.StructField("duration_sec", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("start_time", T.DoubleType()),
    T.StructField("end_time", T.DoubleType()),
])

VERSION_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("version", T.LongType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
])


def new_run_id() -> str:
    return uuid.uuid4().hex


def run_row(experiment: str, model: str, model_order: int, task: str, algorithm: str, params: dict,
            metrics: dict, score: float | None, hpo_used: bool, start: float, status: str = "FINISHED",
            error: str | None = None, run_id: str | None = None) -> tuple:
    end = time.time()
    return (
        run_id or new_run_id(), experiment, model, model_order, task, algorithm,
        {str(k): str(v) for k, v in params.items()},
        {str(k): float(v) for k, v in metrics.items() if isinstance(v, (int, float))},
        None if score is None else float(score), hpo_used, end - start, status, error, start, end,
    )


def runs_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, RUN_SCHEMA)


def log_run(runs: DataFrame, path: str) -> str:
    """Append run rows to the ``runs`` table (log_run / log_tuning)."""
    runs.write.mode("append").parquet(path)
    return path


def register_versions(runs_best: DataFrame, existing: DataFrame | None, model_col: str = "experiment") -> DataFrame:
    """Next version number per model name for each newly registered run."""
    new = runs_best.select(F.col(model_col).alias("model_name"), "run_id", "model", "algorithm", "score")
    base = F.lit(0).cast("bigint")
    if existing is not None:
        last = existing.groupBy("model_name").agg(F.max("version").alias("_last"))
        new = new.join(last, "model_name", "left")
        base = F.coalesce(F.col("_last"), F.lit(0)).cast("bigint")
    w = Window.partitionBy("model_name").orderBy("run_id")
    tags = F.create_map(F.lit("algorithm"), F.col("algorithm"), F.lit("model"), F.col("model"),
                        F.lit("best_metric"), F.col("score").cast("string"))
    out = new.select("model_name", (base + F.row_number().over(w)).alias("version"), "run_id", tags.alias("tags"))
    if existing is not None:
        out = existing.select(*VERSION_SCHEMA.fieldNames()).unionByName(out)
    return out


def promote(versions: DataFrame) -> DataFrame:
    """Newest version of each model -> Production, every other -> Archived."""
    w = Window.partitionBy("model_name").orderBy(F.col("version").desc())
    return versions.withColumn(
        "stage", F.when(F.row_number().over(w) == 1, F.lit("Production")).otherwise(F.lit("Archived"))
    )


def production_version(staged: DataFrame) -> DataFrame:
    """Production version per model (the newest one if several)."""
    return staged.where(F.col("stage") == "Production").groupBy("model_name").agg(
        F.max("version").alias("version"), F.max_by("run_id", "version").alias("run_id")
    )


def require_production(staged: DataFrame, model_name: str) -> DataFrame:
    out = production_version(staged).where(F.col("model_name") == model_name)
    if out.isEmpty():
        raise LookupError(f"no Production version for model {model_name!r}")
    return out


def model_info(staged: DataFrame, runs: DataFrame) -> DataFrame:
    """Production version, stage, run and training details per model."""
    prod = production_version(staged)
    return prod.join(runs, "run_id", "left")
