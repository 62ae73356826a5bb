"""Exact quantiles by histogram refinement, and the range-partitioned
dictionary path, against direct computations."""
import numpy as np
import pytest

from quarry.functions.stats import exact_quantiles
from quarry.operators import encode as E


@pytest.mark.parametrize("q", [0.5, 0.1, 0.9, 0.37])
def test_exact_quantiles_skewed_and_repeated(spark, q):
    rng = np.random.default_rng(3)
    heavy = np.concatenate([rng.lognormal(0, 3, 4000), np.full(3000, 7.25), rng.normal(0, 1e-9, 500)])
    ties = np.repeat(np.arange(5, dtype=float), 700)
    rows = [(float(a), float(b), 1.0) for a, b in zip(heavy, np.resize(ties, len(heavy)))]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = exact_quantiles(df, ["a", "b", "c"], q, slice_max=50)  # force several refinement levels
    assert got["a"] == pytest.approx(np.percentile(heavy, q * 100), rel=1e-12)
    assert got["b"] == pytest.approx(np.percentile(np.resize(ties, len(heavy)), q * 100), rel=1e-12)
    assert got["c"] == 1.0


def test_dictionary_range_path_equals_single_sort(spark, monkeypatch):
    df = spark.range(0, 3000).selectExpr("cast(id * 7919 % 3001 as string) AS k", "cast(id % 3 as string) AS p")
    a = {tuple(r) for r in E.build_dictionary(df, ["k", "p"]).collect()}
    monkeypatch.setattr(E, "SINGLE_TASK_VALUES", 100)
    b = {tuple(r) for r in E.build_dictionary(df, ["k", "p"]).collect()}
    assert a == b and len(a) == 3003
