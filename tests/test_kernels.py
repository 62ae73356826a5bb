"""Sketched polynomial kernel."""
import math

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from quarry.models import fit_model
from quarry.models.served import ServedModel, load_model
from quarry.models.supervised import TensorSketchFeatures, sketch_size, tensor_sketch


def test_kernel_error_is_as_stated(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 50))
    for degree, error in ((2, 0.1), (3, 0.15)):
        z = tensor_sketch(x, 0.02, degree, sketch_size(degree, error), 1)
        norm = np.linalg.norm(x, axis=1)
        off = np.abs(z @ z.T - (0.02 * x @ x.T) ** degree) / (0.02 * np.outer(norm, norm)) ** degree
        assert np.sqrt((off**2).mean()) < error and z.shape[1] < math.comb(52, 3)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:5]], ", ".join(f"f{i} double" for i in range(50)))
    v = VectorAssembler(inputCols=df.columns, outputCol="features").transform(df)
    stage = TensorSketchFeatures(inputCol="features", outputCol="rff", gamma=0.02, degree=2, size=64, seed=1)
    got = np.array([r["rff"].toArray() for r in stage.transform(v).collect()])
    assert np.allclose(got, tensor_sketch(x[:5], 0.02, 2, 64, 1))


def test_fifty_features_fit(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 50))
    x[:, 0] *= 12
    x[:, 1] *= 12
    y = (x[:, 0] * x[:, 1] > 0).astype(float)  # a line cannot tell them apart
    cols = [f"f{i}" for i in range(50)]
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, " + ", ".join(f"{c} double" for c in cols) + ", label double")
    m = fit_model("classification", "svm", df, cols, {"kernel": "poly", "degree": 2, "C": 10.0, "max_iter": 20}, n_classes=2, key="id")
    out = m.transform(df)
    assert out.filter(F.col("prediction") == F.col("label")).count() > 340
    ServedModel(m, cols).save(str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m")).transform(df)
    assert {r["id"]: r["prediction"] for r in again.collect()} == {r["id"]: r["prediction"] for r in out.collect()}
