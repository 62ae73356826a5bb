"""Nearest rows by boxes, against brute force."""
import math

import numpy as np
import pytest

from quarry.models import anomaly as A
from quarry.operators import boxes as B


def square(x, y):
    out = 0.0
    for a, b in zip(x, y):  # sum() would round otherwise
        out += (a - b) * (a - b)
    return out


def brute(queries, members, k, exclude):
    out = {}
    for key in {q for q, _ in queries}:
        pairs = [(square(x, y), n) for q, x in queries if q == key for n, y in members if not (exclude and n == key)]
        out[key] = [(n, math.sqrt(d)) for d, n in sorted(pairs)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["dist"], r["n"])):
        out.setdefault(r["q"], []).extend([(r["n"], r["dist"])] * r["t"])
    return out


@pytest.mark.parametrize("d", [1, 2, 3])
def test_nearest_rows_with_ties_copies_and_repeated_keys(spark, monkeypatch, d):
    monkeypatch.setattr(B, "BOX_ROWS", 16)
    rng = np.random.default_rng(d)
    x = np.vstack([rng.integers(0, 6, (150, d)).astype(float), rng.normal(20, 0.1, (80, d)), rng.uniform(-50, 50, (10, d)), np.full((30, d), 3.0)])
    rows = [(int(i), tuple(map(float, v))) for i, v in zip(rng.permutation(len(x)), x)]
    rows += rows[:20] + [(rows[30][0], rows[90][1])]  # rows that come twice, a key at two places
    cols = [f"f{i}" for i in range(d)]
    df = spark.createDataFrame([(i, *v) for i, v in rows] + [(10_000, *[None] * d)], "id long, " + ", ".join(f"{c} double" for c in cols))
    e = B.entries(df, "id", cols).cache()
    assert found(B.nearest_rows(e, e, d, 5, True)) == brute(rows, rows, 5, True)
    new = [(i, tuple(map(float, v))) for i, v in enumerate(np.vstack([rng.uniform(-70, 70, (15, d)), np.full((3, d), 3.0)]))]
    asked = spark.createDataFrame([(i, *v) for i, v in new], "id long, " + ", ".join(f"{c} double" for c in cols))
    assert found(B.nearest_rows(B.entries(asked, "id", cols), e, d, 5, False)) == brute(new, rows, 5, False)


def test_many_equal_rows_are_few_candidates_and_portions_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(B, "PORTION", 64)
    rng = np.random.default_rng(4)
    rows = [(f"k{i:05d}", (1.0, 2.0)) for i in range(2000)] + [(f"m{i:03d}", tuple(map(float, v))) for i, v in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame([(i, *v) for i, v in rows], "id string, a double, b double")
    e = B.entries(df, "id", ["a", "b"]).cache()
    got = found(B.nearest_rows(e, e, 2, 4, True))
    assert got == brute(rows, rows, 4, True)


def test_lof_of_copies_and_of_new_rows(spark):
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(0, 1, (100, 2)), rng.normal(9, 0.2, (60, 2))])
    x = np.vstack([x, x[:30], x[:30]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    k = 6
    nn = brute([(i, tuple(v)) for i, v in enumerate(x)], [(i, tuple(v)) for i, v in enumerate(x)], k, True)
    kd = {i: v[-1][1] for i, v in nn.items()}
    lrd = {i: 1 / (np.mean([max(kd[n], dist) for n, dist in v]) + 1e-10) for i, v in nn.items()}
    lof = {i: np.mean([lrd[n] for n, _ in v]) / lrd[i] for i, v in nn.items()}
    got = {r["id"]: r["lof"] for r in A.local_outlier_factor(df, "id", ["a", "b"], k).collect()}
    assert got == pytest.approx(lof, rel=1e-9)
    m = A.fit_lof(df, ["a", "b"], "id", k)
    new = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0), (3, None, 1.0), (None, 1.0, 1.0)], "id long, a double, b double")
    out = {r["id"]: r["score"] for r in m.transform(new).collect()}
    at = brute([(1, (0.0, 0.0)), (2, (100.0, 0.0))], [(i, tuple(v)) for i, v in enumerate(x)], k, False)
    for q, v in at.items():
        own = 1 / (np.mean([max(kd[n], dist) for n, dist in v]) + 1e-10)
        assert out[q] == pytest.approx(np.mean([lrd[n] for n, _ in v]) / own, rel=1e-9)
    assert out[3] is None and out[None] is None
