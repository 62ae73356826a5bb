"""Linear and kernel estimators as MLlib pipelines (§2.7, classification /
regression / lag-based time series); tree ensembles are in ``tree_models``.

Pipeline = VectorAssembler over numeric features (text is encoded to ordinal
codes before, by one dictionary for training and serving) -> [kernel
features] -> estimator. Penalties follow the probed mapping
onto MLlib's averaged loss: logistic ``regParam = 1/(C n)``, ridge
``alpha * std_pop(y) / n`` with the normal solver, lasso ``alpha``, all with
``standardization=False``.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.columns import complete
from quarry.functions.stats import moments
from quarry.models.catalog import SEED

FEATURES = "features"
LABEL = "label"


def feature_stages(df: DataFrame, features: list[str], handle_invalid: str = "keep") -> list:
    """Assembler of numeric features. Text is encoded before (training and
    serving share one dictionary, see ``quarry.models.served``)."""
    from quarry.functions.columns import categorical_columns

    if cats := categorical_columns(df.select(*features)):
        raise ValueError(f"encode the string features {cats} first (quarry.operators.encode)")
    return [VectorAssembler(inputCols=list(features), outputCol=FEATURES, handleInvalid=handle_invalid)]


class PolynomialKernelFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The explicit map of the kernel (gamma x.y)^degree: all monomials of
    that degree, weighted by the root of their multinomial coefficient."""

    gamma = Param(Params._dummy(), "gamma", "kernel width")
    degree = Param(Params._dummy(), "degree", "degree of the kernel")
    dim = Param(Params._dummy(), "dim", "number of input features")

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, gamma=None, degree=None, dim=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df):
        g, k, d = (self.getOrDefault(p) for p in (self.gamma, self.degree, self.dim))
        x = vector_to_array(F.col(self.getInputCol()))
        out = []
        for idx in itertools.combinations_with_replacement(range(d), k):
            ways = math.factorial(k)
            for i in set(idx):
                ways //= math.factorial(idx.count(i))
            e = F.lit(math.sqrt(ways) * g ** (k / 2))
            for i in idx:
                e = e * x[i]
            out.append(e)
        return df.withColumn(self.getOutputCol(), array_to_vector(F.array(*out)))


#: more monomials than this are sketched
MOST_MONOMIALS = 512
#: standard error of a sketched kernel value, as a share of (gamma |x| |y|)^degree
KERNEL_ERROR = 0.15


def sketch_size(degree: int, error: float = KERNEL_ERROR) -> int:
    """Columns for the error: the variance of a tensor sketch is at most (2 + 3^degree) / size (Avron et al. 2014)."""
    return 1 << math.ceil(math.log2((2 + 3**degree) / error**2))


def tensor_sketch(x: np.ndarray, gamma: float, degree: int, size: int, seed: int) -> np.ndarray:
    """Rows whose inner products estimate (gamma x.y)^degree: the circular convolution of
    ``degree`` count sketches, by FFT (Pham & Pagh 2013)."""
    rng = np.random.default_rng(seed)
    out = np.ones((len(x), size // 2 + 1), complex)
    for _ in range(degree):
        cell, sign = rng.integers(0, size, x.shape[1]), rng.choice([-1.0, 1.0], x.shape[1])
        sketch = np.zeros((len(x), size))
        for j in range(x.shape[1]):
            sketch[:, cell[j]] += sign[j] * x[:, j]
        out *= np.fft.rfft(sketch * math.sqrt(gamma), axis=1)
    return np.fft.irfft(out, size, axis=1)


class TensorSketchFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """An approximate map of the kernel (gamma x.y)^degree whose size depends on the
    error asked for and not on the number of monomials."""

    gamma = Param(Params._dummy(), "gamma", "kernel width")
    degree = Param(Params._dummy(), "degree", "degree of the kernel")
    size = Param(Params._dummy(), "size", "number of columns")
    seed = Param(Params._dummy(), "seed", "of hashes and signs")

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, gamma=None, degree=None, size=None, seed=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df):
        g, k, n, seed = (self.getOrDefault(p) for p in (self.gamma, self.degree, self.size, self.seed))

        @F.pandas_udf("array<double>")
        def sketched(x: pd.Series) -> pd.Series:
            parts = [tensor_sketch(np.stack(x.iloc[i:i + 1024].to_list()), g, k, n, seed) for i in range(0, len(x), 1024)]
            return pd.Series([r for p in parts for r in p], dtype=object)

        return df.withColumn(self.getOutputCol(), array_to_vector(sketched(vector_to_array(F.col(self.getInputCol())))))


class RandomFourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """z(x) = sqrt(2/D) cos(Wx + b), W ~ N(0, 2 gamma) (Rahimi & Recht 2007).

    A persistable pipeline stage whose transform is built-in higher-order
    column functions over the vector's array form (JVM side, no Python in
    the hot path); W and b are stored as stage params."""

    weights = Param(Params._dummy(), "weights", "projection matrix W (D x d)")
    offsets = Param(Params._dummy(), "offsets", "phase offsets b (D)")

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, weights=None, offsets=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df):
        W = self.getOrDefault(self.weights)
        b = self.getOrDefault(self.offsets)
        scale = math.sqrt(2.0 / len(b))
        x = vector_to_array(F.col(self.getInputCol()))
        rows = F.array(*[F.struct(F.array(*[F.lit(float(v)) for v in w]).alias("w"), F.lit(float(o)).alias("b"))
                         for w, o in zip(W, b)])
        z = F.transform(rows, lambda r: F.lit(scale) * F.cos(
            F.aggregate(F.zip_with(r["w"], x, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v) + r["b"]))
        return df.withColumn(self.getOutputCol(), array_to_vector(z))


def rff_stage(d: int, n_components: int, gamma: float, seed: int = SEED, in_col: str = FEATURES,
              out_col: str = "rff") -> RandomFourierFeatures:
    """Seeded random Fourier feature stage for an RBF kernel of width gamma."""
    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(n_components, d))
    b = rng.uniform(0.0, 2 * math.pi, size=n_components)
    return RandomFourierFeatures(inputCol=in_col, outputCol=out_col, weights=W.tolist(), offsets=b.tolist())


def feature_variance(df: DataFrame, features: list[str]) -> float:
    """Variance of all feature values pooled (for gamma='scale')."""
    stacked = F.explode(F.array(*[F.col(c).cast("double") for c in features]))
    row = df.select(stacked.alias("v")).agg(F.var_pop("v").alias("v")).first()
    return float(row["v"] or 0.0)


def classifier_estimator(name: str, params: dict, n_train: int, n_classes: int, d: int):
    """The MLlib estimator(s) for a catalogue classifier; returns
    (extra_stages, estimator, record of dropped params)."""
    p = dict(params)
    dropped = {}
    if name == "logistic_regression":
        C = float(p.pop("C", 1.0))
        est = LogisticRegression(maxIter=int(p.pop("max_iter", 1000)), regParam=1.0 / (C * max(n_train, 1)),
                                 elasticNetParam=0.0, standardization=False, featuresCol=FEATURES, labelCol=LABEL)
        dropped = p
        extra = []
    elif name == "svm":
        C = float(p.pop("C", 1.0))
        kernel = p.pop("kernel", "rbf")
        gamma = p.pop("gamma", "scale")
        extra = []
        fcol = FEATURES
        if kernel != "linear":
            g = float(gamma) if not isinstance(gamma, str) else None
            if g is None:
                var = float(p.pop("_feature_var", 1.0)) or 1.0
                g = 1.0 / (d * var) if gamma == "scale" else 1.0 / d
            if kernel == "poly":
                k, error = int(p.pop("degree", 3)), float(p.pop("kernel_error", KERNEL_ERROR))
                if math.comb(d + k - 1, k) <= MOST_MONOMIALS:
                    extra = [PolynomialKernelFeatures(inputCol=FEATURES, outputCol="rff", gamma=g, degree=k, dim=d)]
                else:
                    extra = [TensorSketchFeatures(inputCol=FEATURES, outputCol="rff", gamma=g, degree=k, size=sketch_size(k, error), seed=SEED)]
            elif kernel == "rbf":
                extra = [rff_stage(d, int(p.pop("n_components", 128)), g)]
            else:
                raise ValueError(f"kernel {kernel!r} is not supported; use rbf, poly or linear")
            fcol = "rff"
        # the columns of a sketch are alike; their penalty is per standard deviation
        sketched = bool(extra) and isinstance(extra[0], TensorSketchFeatures)
        base = LinearSVC(regParam=1.0 / (C * max(n_train, 1)), maxIter=int(p.pop("max_iter", 100)),
                         featuresCol=fcol, labelCol=LABEL, standardization=sketched)
        est = base if n_classes <= 2 else OneVsRest(classifier=base, featuresCol=fcol, labelCol=LABEL)
        dropped = p
    else:
        raise ValueError(f"unknown classifier {name!r}")
    return extra, est, dropped


def regressor_estimator(name: str, params: dict, n_train: int, y_std_pop: float):
    p = dict(params)
    if name == "linear_regression":
        return LinearRegression(regParam=0.0, solver="normal", featuresCol=FEATURES, labelCol=LABEL), p
    if name == "ridge":
        alpha = float(p.pop("alpha", 1.0))
        reg = alpha * y_std_pop / max(n_train, 1)
        return LinearRegression(regParam=reg, elasticNetParam=0.0, standardization=False, solver="normal",
                                featuresCol=FEATURES, labelCol=LABEL), p
    if name == "lasso":
        alpha = float(p.pop("alpha", 0.001))
        return LinearRegression(regParam=alpha, elasticNetParam=1.0, standardization=False,
                                maxIter=int(p.pop("max_iter", 5000)), tol=1e-8,
                                featuresCol=FEATURES, labelCol=LABEL), p
    raise ValueError(f"unknown regressor {name!r}")


#: rows of a partition while a classifier is fitted
ROWS_PER_PART = 4_000_000


def few_parts(train: DataFrame, n: int, rows: int = ROWS_PER_PART) -> DataFrame:
    """In no more partitions than can work at once, or than ``n`` rows need: every iteration of a solver sends the driver
    a result from each partition."""
    return train.coalesce(max(train.sparkSession.sparkContext.defaultParallelism, -(-n // rows)))


def fit_classifier(train: DataFrame, features: list[str], name: str, params: dict, n_classes: int, handle_invalid: str = "keep") -> PipelineModel:
    """Fit a catalogue classifier on ``train`` (needs a double ``label``)."""
    n = train.count()
    p = dict(params)
    if name == "svm" and p.get("kernel", "rbf") != "linear" and p.get("gamma", "scale") == "scale":
        p["_feature_var"] = feature_variance(train, features)
    extra, est, _ = classifier_estimator(name, p, n, n_classes, len(features))
    return Pipeline(stages=feature_stages(train, features, handle_invalid) + extra + [est]).fit(few_parts(train, n))


def fit_regressor(train: DataFrame, features: list[str], name: str, params: dict, handle_invalid: str = "keep") -> PipelineModel:
    stats = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(LABEL).alias("s")).first()
    est, _ = regressor_estimator(name, params, int(stats["n"]), float(stats["s"] or 0.0))
    return Pipeline(stages=feature_stages(train, features, handle_invalid) + [est]).fit(train)


@dataclass
class Moments:
    """Count, means and covariances (divided by the count) of features and label."""

    n: int
    mean: np.ndarray
    cov: np.ndarray

    @staticmethod
    def of(df: DataFrame, features: list[str]) -> Moments | None:
        """One pass for the moments; None for no rows or missing values."""
        cols = [*features, LABEL]
        r = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(~complete(df, cols)).alias("bad")).first()
        return Moments(*moments(df, cols)) if r["n"] and not r["bad"] else None

    @staticmethod
    def together(parts: list[Moments]) -> Moments:
        n = sum(p.n for p in parts)
        mean = sum(p.n * p.mean for p in parts) / n
        return Moments(n, mean, sum(p.n * (p.cov + np.outer(p.mean - mean, p.mean - mean)) for p in parts) / n)

    def rows(self) -> list[list[float]]:
        """A few rows with the same means and covariances: the means, plus and minus the principal axes."""
        varies = np.flatnonzero(np.diag(self.cov) > 0)
        size, axes = np.linalg.eigh(self.cov[np.ix_(varies, varies)])
        out = np.tile(self.mean, (max(1, 2 * len(varies)), 1))
        if len(varies):
            step = (axes * np.sqrt(np.maximum(size, 0.0) * len(varies))).T
            out[:, varies] += np.concatenate([step, -step])
        return out.tolist()


#: whose fit knows a table by its moments only
BY_MOMENTS = ("ridge", "lasso")


def fit_regressor_from(spark: SparkSession, m: Moments, features: list[str], name: str, params: dict, handle_invalid: str = "keep") -> PipelineModel:
    """What :func:`fit_regressor` finds on a table of these moments. Its solver reduces the table to
    them in a pass for every fit; many fits on one table share a pass so."""
    est, _ = regressor_estimator(name, params, m.n, float(np.sqrt(m.cov[-1, -1])))
    train = spark.createDataFrame(m.rows(), ", ".join(f"`{c}` double" for c in [*features, LABEL])).coalesce(1)
    return Pipeline(stages=feature_stages(train, features, handle_invalid) + [est]).fit(train)


def balanced_weights(df: DataFrame, label: str = LABEL, out: str = "weight") -> DataFrame:
    """class_weight='balanced': w = n / (k * n_c), from a small per-class
    count table joined back (AQE broadcasts it)."""
    from pyspark.sql import Window

    # the per-class table has k rows, so the un-partitioned window is tiny
    allw = Window.partitionBy()
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    counts = counts.withColumn("_n", F.sum("_nc").over(allw)).withColumn("_k", F.count(F.lit(1)).over(allw))
    return df.join(counts.select(label, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias(out)), label)


def positive_weights(df: DataFrame, factor: float, label: str = LABEL, out: str = "weight") -> DataFrame:
    """scale_pos_weight: positives weigh ``factor``, negatives 1."""
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(float(factor))).otherwise(F.lit(1.0)))
