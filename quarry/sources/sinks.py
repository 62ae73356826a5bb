"""Sinks (§2.1): models, dictionaries and predictions are written only to a
caller-given path (a shared folder on a cluster)."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame


def write_model(model, path: str, example: DataFrame | None = None, n_example: int = 5) -> str:
    """Persist a model, plus a small input example next to it: an MLlib
    pipeline, or a ``ServedModel`` of any class (read back by ``load_model`` and
    ``quarry.models.served.load_model``)."""
    if isinstance(model, PipelineModel):
        model.write().overwrite().save(f"{path}/model")
    else:
        model.save(f"{path}/served_model")
    if example is not None:
        example.limit(n_example).write.mode("overwrite").parquet(f"{path}/input_example")
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_encoders(dictionary: DataFrame, path: str) -> str:
    """Dictionary tables ``(column, value, code)`` partitioned by column."""
    return write_table(dictionary, path, partition_by=["column"])


def write_predictions(predictions: DataFrame, path: str, mode: str = "overwrite") -> str:
    return write_table(predictions, path, mode=mode)


def write_manifest(runs: DataFrame, path: str, extra: dict | None = None) -> str:
    """One JSON document per run (ids, model, params, metrics, flags,
    timing) plus any extra literal fields; written as JSON lines."""
    from pyspark.sql import functions as F

    cols = [F.col(c) for c in runs.columns if c not in ("encoder", "study")]
    lits = [F.lit(str(v)).alias(k) for k, v in (extra or {}).items() if k not in runs.columns]
    runs.select(F.to_json(F.struct(*cols, *lits)).alias("value")).write.mode("overwrite").text(path)
    return path


def write_schema(profile: DataFrame, path: str) -> str:
    """Input/output schema documents (profile rows) as JSON lines."""
    profile.write.mode("overwrite").json(path)
    return path
