"""Flagship: "which model best predicts document quality?" (SURVEY §7.3).

documents ⋈ labels on doc_id -> features n_chars, lang, source and the
letter share of the whole text -> stratified split -> fit the requested
catalogue classifiers -> weighted metrics per split -> leaderboard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.columns import letter_share
from quarry.plans.train import TrainConfig, TrainResult, train_many
from quarry.session import table

FEATURES = ["n_chars", "lang", "source", "letter_share"]


def quality_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels.select("doc_id", "quality"), "doc_id").select(
        "doc_id", "n_chars", "lang", "source", letter_share("text").alias("letter_share"), "quality"
    )


def document_quality(spark: SparkSession, sf_dir: str, models: list[str] | None = None,
                     overrides: dict | None = None) -> TrainResult:
    cfg = TrainConfig(
        task="classification", target="quality", key="doc_id", features=FEATURES,
        models=models or ["logistic_regression", "random_forest"],
        overrides=overrides or {},
        experiment="document_quality",
    )
    return train_many(spark, quality_frame(spark, sf_dir), cfg)


def leaderboard_frame(res: TrainResult) -> DataFrame:
    m = F.col("metrics")
    return res.leaderboard.select(
        "experiment", "model", "rank", F.col("score").alias("test_accuracy"),
        m["test_f1_weighted"].alias("test_f1_weighted"), m["test_precision_weighted"].alias("test_precision_weighted"),
        m["test_recall_weighted"].alias("test_recall_weighted"), m["val_accuracy"].alias("val_accuracy"),
        "duration_sec",
    )
