"""Fitted tree ensembles: scoring, saving, and the catalogue's parameters."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.models import boosting, forest
from quarry.models.catalog import SEED
from quarry.models.histograms import CELL_SPACE, MAX_BINS, MISSING, ROWS_PER_NODE, TREE, Cells, Packed, binned, codes_of, tree_columns, unpack
from quarry.models.served import read_meta, write_meta

ROWS_AT_ONCE = 16_384
#: of a model with more bytes of leaf values, and at most so many possible bin vectors, workers get the outputs instead of the trees
LARGE_MODEL, TABLE_SPACE = 16 << 20, 1 << 18


class TreeEnsembleModel:
    """Sum (boosting) or mean (forest) of trees. ``kind`` is regression, logistic, softmax or shares."""

    def __init__(self, features: list[str], edges: list[np.ndarray], trees: list[Packed], kind: str, start: list[float], task: str, name: str):
        self.feature_cols, self.edges, self.trees, self.kind, self.start = list(features), edges, trees, kind, list(start)
        self.task, self.name = task, name
        self._sent = None
        self._table = None  # outputs of all bin vectors, instead of the trees
        self._known = None  # places and outputs of the bin vectors met so far, where few are possible

    def raw(self, x: np.ndarray) -> np.ndarray:
        """rows x outputs from features x rows. Rows with the same bins are alike, so where the features
        have few bins together a worker walks the trees once for each bin vector."""
        bins = np.stack([binned(c, e) for c, e in zip(x, self.edges)])
        sizes = [len(e) + 2 for e in self.edges]
        if math.prod(sizes) > CELL_SPACE:
            return self._walked(bins)
        codes = codes_of(bins, sizes)
        if self._table is not None:
            return self._table[codes]
        place, outputs = self._known or (np.full(math.prod(sizes), -1, np.int32), None)
        new, first = np.unique(codes[place[codes] < 0], return_index=True)
        if len(new) or outputs is None:
            found = self._walked(bins[:, np.flatnonzero(place[codes] < 0)[first]])
            place[new] = np.arange(len(new)) + (0 if outputs is None else len(outputs))
            outputs = found if outputs is None else np.concatenate([outputs, found])
            self._known = place, outputs
        return outputs[place[codes]]

    def _walked(self, bins: np.ndarray) -> np.ndarray:
        missing = bool((bins == MISSING).any())
        values = (t.value[t.walked(bins, missing)] if bins.shape[1] <= ROWS_PER_NODE * len(t.feature) else t.values(bins) for t in self.trees)
        if not self.start:
            return sum(values) / len(self.trees)
        out = np.tile(np.array(self.start), (bins.shape[1], 1))
        for i, v in enumerate(values):
            out[:, i % len(self.start)] += v[:, 0]
        return out

    def outputs(self, x: np.ndarray) -> np.ndarray:
        """The prediction, or the probabilities of the classes."""
        z = self.raw(x)
        if self.kind == "logistic":
            p = 1 / (1 + np.exp(-z[:, 0]))
            return np.column_stack([1 - p, p])
        if self.kind == "softmax":
            e = np.exp(z - z.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)
        return z

    def __getstate__(self):
        return {**self.__dict__, "_sent": None, "_known": None}

    def light(self) -> TreeEnsembleModel:
        """What workers need to score: of a large model over few possible bin vectors their outputs, else the model."""
        sizes = [len(e) + 2 for e in self.edges]
        space = math.prod(sizes)
        if space > TABLE_SPACE or sum(t.value.nbytes for t in self.trees) < LARGE_MODEL:
            return self
        parts = [Cells(np.arange(i, min(space, i + ROWS_AT_ONCE)), sizes).bins() for i in range(0, space, ROWS_AT_ONCE)]
        out = TreeEnsembleModel(self.feature_cols, self.edges, [], self.kind, self.start, self.task, self.name)
        out._table = np.concatenate([self._walked(b) for b in parts])
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        if self._sent is None:  # as large as the model, whatever the data
            self._sent = df.sparkSession.sparkContext.broadcast(self.light())
        sent = self._sent

        @F.pandas_udf("array<double>")
        def score(*cols: pd.Series) -> pd.Series:
            x = np.stack([c.to_numpy(float, na_value=np.nan) for c in cols])
            parts = [sent.value.outputs(x[:, i:i + ROWS_AT_ONCE]) for i in range(0, x.shape[1], ROWS_AT_ONCE)]
            return pd.Series(list(np.concatenate(parts)) if parts else [], dtype=object)

        out = score(*[F.col(f"`{c}`").cast("double") for c in self.feature_cols])
        keep = [F.col(f"`{c}`") for c in df.columns]
        if self.kind == "regression":
            return df.select(*keep, out[0].alias("prediction"))
        p = F.col("probability")
        scored = df.select(*keep, out.alias("probability"))
        return scored.select(*[F.col(f"`{c}`") for c in df.columns], (F.array_position(p, F.array_max(p)) - 1).cast("double").alias("prediction"), "probability")

    def save(self, path: str) -> str:
        spark = SparkSession.getActiveSession()
        rows = [(i, 0, *tree_columns(t).values()) for i, t in enumerate(self.trees)]
        spark.createDataFrame(rows, TREE).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        write_meta(path, {"features": self.feature_cols, "edges": [e.tolist() for e in self.edges], "kind": self.kind, "start": self.start,
                          "task": self.task, "name": self.name})
        return path

    @classmethod
    def load(cls, spark, path: str) -> TreeEnsembleModel:
        m = read_meta(spark, path)
        rows = spark.read.parquet(f"{path}/trees").orderBy("tree").collect()
        return cls(m["features"], [np.array(e, float) for e in m["edges"]], [unpack(r) for r in rows], m["kind"], m["start"], m["task"], m["name"])


# names of the catalogue's parameters -> options; a name that is in no table is reported as ignored
COMMON = {"n_estimators": ("rounds", int), "learning_rate": ("learning_rate", float), "max_depth": ("max_depth", int), "subsample": ("subsample", float),
          "random_state": ("seed", int)}
PARAMETERS = {
    "xgboost": {**COMMON, "colsample_bytree": ("columns", float), "reg_lambda": ("reg_lambda", float), "reg_alpha": ("reg_alpha", float),
                "gamma": ("least_gain", float), "min_child_weight": ("least_hessian", float), "max_bin": ("bins", int)},
    "lightgbm": {**COMMON, "colsample_bytree": ("columns", float), "reg_lambda": ("reg_lambda", float), "reg_alpha": ("reg_alpha", float),
                 "min_split_gain": ("least_gain", float), "min_child_weight": ("least_hessian", float), "min_child_samples": ("least_rows", int),
                 "num_leaves": ("num_leaves", int), "max_bin": ("bins", int), "data_sample_strategy": None, "top_rate": None, "other_rate": None},
    "gradient_boosting": {**COMMON, "min_samples_leaf": ("least_rows", int), "min_samples_split": ("least_rows_split", int), "max_features": None},
    "random_forest": {"n_estimators": ("trees", int), "max_depth": ("max_depth", int), "min_samples_leaf": ("least_rows", int),
                      "min_samples_split": ("least_rows_split", int), "max_features": None, "random_state": ("seed", int)},
}
PARAMETERS["xgboost_supervised"], PARAMETERS["random_forest_supervised"] = PARAMETERS["xgboost"], PARAMETERS["random_forest"]
#: what the models start from where the catalogue says nothing
DEFAULTS = {
    "xgboost": dict(growth="depthwise"),
    "lightgbm": dict(growth="leafwise", reg_lambda=0.0, least_hessian=1e-3, least_rows=20),
    "gradient_boosting": dict(criterion="friedman"),
}
DEFAULTS["xgboost_supervised"] = DEFAULTS["xgboost"]
DEEPEST = 40  # of a forest without max_depth: with half of the rows on each side, 10^12 rows


def _columns(value, d: int) -> int:
    """max_features as a number of features."""
    if value in (None, "all"):
        return d
    if value == "sqrt":
        return max(1, int(np.sqrt(d)))
    if value == "log2":
        return max(1, int(np.log2(d))) if d > 1 else 1
    if isinstance(value, str):
        raise ValueError(f"max_features {value!r} is not known; use sqrt, log2, a number or a share")
    return max(1, min(d, int(value) if value >= 1 and float(value).is_integer() else int(value * d)))


def options(name: str, params: dict) -> dict:
    out = dict(DEFAULTS.get(name, {}))
    for k, v in params.items():
        target = PARAMETERS[name].get(k)
        if target and v is not None:
            out[target[0]] = target[1](v)
    if "bins" in out:
        out["bins"] = min(out["bins"], MAX_BINS)
    return out


def fit_boosting(train: DataFrame, features: list[str], name: str, params: dict, task: str, n_classes: int = 0, weight: str | None = None) -> TreeEnsembleModel:
    """``n_classes`` 0 is regression."""
    out = options(name, params)
    if name == "lightgbm" and params.get("data_sample_strategy") == "goss":
        out["one_side"] = (float(params.get("top_rate", 0.2)), float(params.get("other_rate", 0.1)))
    if name == "gradient_boosting" and params.get("max_features") is not None:
        out["columns"] = _columns(params["max_features"], len(features)) / len(features)
    objective = "squared" if not n_classes else "logistic" if n_classes == 2 else "softmax"
    opt = boosting.BoostOptions(objective=objective, outputs=n_classes if n_classes > 2 else 1, **out)
    start, edges, rounds = boosting.fit(train, features, "label", opt, weight)
    kind = {"squared": "regression", "logistic": "logistic", "softmax": "softmax"}[objective]
    return TreeEnsembleModel(features, edges, [t for r in rounds for t in r], kind, start, task, name)


def fit_forest(train: DataFrame, features: list[str], name: str, params: dict, task: str, n_classes: int = 0, weight: str | None = None) -> TreeEnsembleModel:
    out = {"seed": SEED, "max_depth": DEEPEST, **options(name, params)}
    columns = _columns(params.get("max_features", "sqrt" if n_classes else None), len(features))
    edges, trees = forest.fit(train, features, "label", forest.ForestOptions(classes=n_classes, columns=columns, **out), weight)
    return TreeEnsembleModel(features, edges, trees, "shares" if n_classes else "regression", [], task, name)
