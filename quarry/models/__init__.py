"""Model dispatch: ``fit_model(task, name, train, features, params)`` returns
an object with ``transform(df)`` that appends ``prediction`` (and
``probability`` where the estimator yields one) and ``save(path)``."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import require_complete
from quarry.models.served import read_meta, write_meta

_INTERNAL = ("features", "rff", "rawPrediction")


class PipelineFitted:
    """A fitted MLlib pipeline with the engine's output contract."""

    def __init__(self, model: PipelineModel, features: list[str], task: str, name: str, curves: list | None = None):
        self.curves = curves  # of a classifier without probabilities
        self.model = model
        self.feature_cols = features
        self.task = task
        self.name = name

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df)
        keep = [c for c in df.columns]
        extra = [F.col("prediction").cast("double").alias("prediction")]
        if "probability" in out.columns:
            extra.append(vector_to_array("probability").alias("probability"))
        elif self.curves:
            from quarry.models.calibration import margins, probability

            extra.append(probability(margins(out, max(2, len(self.curves))), self.curves).alias("probability"))
        return out.select(*keep, *extra)

    def save(self, path: str) -> str:
        self.model.write().overwrite().save(f"{path}/model")
        write_meta(path, {"features": self.feature_cols, "task": self.task, "name": self.name, "curves": self.curves})
        return path

    @classmethod
    def load(cls, spark, path: str) -> "PipelineFitted":
        m = read_meta(spark, path)
        return cls(PipelineModel.load(f"{path}/model"), m["features"], m["task"], m["name"], m.get("curves"))


def fit_model(task: str, name: str, train: DataFrame, features: list[str], params: dict, *, n_classes: int = 2,
              labelled: bool = True, key: str | None = None, series_key: str | None = None,
              time_col: str | None = None, index_col: str = "position", horizon: int = 1,
              contamination: float = 0.1, n_clusters: int = 3):
    """``train`` needs numeric features without missing values (an error names
    the columns that have any). With ``horizon`` above 1 the label column is an
    array and one model is fitted per step."""
    from quarry.models import supervised as S
    from quarry.models import tree_models as T

    if horizon > 1 and task == "timeseries":
        from quarry.models.forecast import MultiHorizonModel

        return MultiHorizonModel([fit_model(task, name, train.withColumn("label", F.col("label")[i].cast("double")), features, params, key=key,
                                            series_key=series_key, time_col=time_col, index_col=index_col) for i in range(horizon)])
    if not (task == "timeseries" and name in ("arima", "prophet")):
        require_complete(train, features)
    if task in ("classification", "regression", "timeseries") and name in T.PARAMETERS:
        fit = T.fit_forest if name == "random_forest" else T.fit_boosting
        return fit(train, features, name, params, task, max(n_classes, 2) if task == "classification" else 0)
    if task == "classification":
        from quarry.models.calibration import calibrated

        k = max(n_classes, 2)
        fit = lambda rows: S.fit_classifier(rows, features, name, params, k)
        m = fit(train)
        curves = None
        if name == "svm" and params.get("probability"):  # three more fits, so only if asked for
            curves = calibrated(train.select(*dict.fromkeys([*features, "label", *([key] if key else [])])), fit, k)
        return PipelineFitted(m, features, task, name, curves)
    if task == "regression":
        return PipelineFitted(S.fit_regressor(train, features, name, params), features, task, name)
    if task == "timeseries":
        if name == "arima":
            order, seasonal = params.get("order", (1, 1, 1)), params.get("seasonal_order")
            if tuple(order) != (1, 1, 1) or any(seasonal or ()):
                from quarry.models.arima import fit_arima

                return fit_arima(train, "label", index_col, series_key, order, seasonal)
            from quarry.models.forecast import fit_forecast_ar

            return fit_forecast_ar(train, "label", index_col, series_key, params)
        if name == "prophet":
            from quarry.models.forecast import fit_forecast_trend_seasonal

            return fit_forecast_trend_seasonal(train, "label", time_col, series_key, params)
        return PipelineFitted(S.fit_regressor(train, features, name, params), features, task, name)
    if task == "anomaly_detection":
        from quarry.models import anomaly as A

        params = dict(params)
        params.setdefault("contamination", contamination)
        if name == "random_forest_supervised":
            w = S.balanced_weights(train)
            return T.fit_forest(w, features, name, params, task, 2, "weight")
        if name == "xgboost_supervised":
            w = S.positive_weights(train, float(params.get("scale_pos_weight", 10)))
            return T.fit_boosting(w, features, name, params, task, 2, "weight")
        return A.fit_anomaly(name, train, features, params, key=key)
    if task == "clustering":
        from quarry.models import clustering as C

        params = dict(params)
        return C.fit_clustering(name, train, features, params, key=key, n_clusters=n_clusters)
    raise ValueError(f"unknown task {task!r}")

