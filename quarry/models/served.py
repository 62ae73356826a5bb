"""A trained model together with what serving needs: the feature list, the
dictionary of its string features, the label dictionary. It scores raw
records, decodes predicted codes, and can be saved and loaded as one folder,
whatever the class of the fitted model."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.encode import apply_dictionary, decode_label


class ServedModel:
    def __init__(self, fitted, features: list[str], task: str = "", name: str = "", feature_dictionary: DataFrame | None = None,
                 label_dictionary: DataFrame | None = None, categories: dict[str, int] | None = None):
        self.fitted, self.features, self.task, self.name = fitted, list(features), task, name
        self.feature_dictionary, self.label_dictionary = feature_dictionary, label_dictionary
        self.categories = categories or {}  # string feature -> number of known values

    @property
    def model(self):
        """The fitted MLlib pipeline, where there is one."""
        return getattr(self.fitted, "model", self.fitted)

    @property
    def feature_cols(self) -> list[str]:
        return getattr(self.fitted, "feature_cols", self.features)

    def transform(self, df: DataFrame) -> DataFrame:
        """Scores ``df``. String features are encoded on the way in (an
        unknown value gets the code after the last, null stays null) and come
        back as they were."""
        cats = [c for c in self.categories if dict(df.dtypes).get(c) == "string"]
        if not cats:
            return self.fitted.transform(df)
        x = df.select(*df.columns, *[F.col(c).alias(f"__raw_{c}") for c in cats])
        x = apply_dictionary(x, self.feature_dictionary, cats)
        for c in cats:
            x = x.withColumn(c, F.coalesce(F.col(c), F.when(F.col(f"__raw_{c}").isNotNull(), F.lit(self.categories[c]))))
        out = self.fitted.transform(x)
        added = [c for c in out.columns if c not in df.columns and not c.startswith("__raw_")]
        return out.select(*[F.col(f"__raw_{c}").alias(c) if c in cats else F.col(c) for c in df.columns], *added)

    def decode(self, scored: DataFrame) -> DataFrame:
        """Adds ``prediction_label`` where the target was text."""
        if self.label_dictionary is None:
            return scored
        return decode_label(scored.withColumn("prediction_code", F.col("prediction").cast("int")), self.label_dictionary,
                            "prediction_code", "prediction_label")

    def save(self, path: str) -> str:
        self.fitted.save(f"{path}/fitted")
        for name, d in (("features", self.feature_dictionary), ("labels", self.label_dictionary)):
            if d is not None:
                d.write.mode("overwrite").parquet(f"{path}/{name}")
        write_meta(f"{path}/served", {"kind": type(self.fitted).__name__, "features": self.features, "task": self.task, "name": self.name,
                                      "categories": self.categories, "has": [self.feature_dictionary is not None, self.label_dictionary is not None]})
        return path


def write_meta(path: str, meta: dict) -> None:
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(meta, default=float),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/meta").first()[0])


def load_model(spark: SparkSession, path: str) -> ServedModel:
    """What ``ServedModel.save`` wrote."""
    from quarry.models import PipelineFitted, anomaly, arima, clustering, forecast, hierarchical, tree_models

    meta = read_meta(spark, f"{path}/served")
    kinds = {c.__name__: c for c in (PipelineFitted, tree_models.TreeEnsembleModel, hierarchical.HierarchicalModel, arima.ARIMAModel, forecast.MultiHorizonModel, forecast.ARForecastModel, forecast.TrendSeasonalModel,
                                     anomaly.IsolationForestModel, anomaly.EnvelopeModel, anomaly.LOFModel, anomaly.OneClassModel,
                                     clustering.CentroidModel, clustering.MLlibClusterModel, clustering.DBSCANModel)}
    fitted = kinds[meta["kind"]].load(spark, f"{path}/fitted")
    d = [spark.read.parquet(f"{path}/{n}") if has else None for n, has in zip(("features", "labels"), meta["has"])]
    return ServedModel(fitted, meta["features"], meta["task"], meta["name"], d[0], d[1], meta["categories"])
