"""Pivot partitioned neighbours, Ward merging, DBSCAN and LOF beyond three features: brute force."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.models import anomaly as A
from quarry.models import clustering as C
from quarry.models import fit_model
from quarry.models import hierarchical as H
from quarry.operators import neighbours as N
from quarry.session import saved
from tests.test_models import _dbscan_brute


def frame(spark, x):
    cols = [f"f{i}" for i in range(x.shape[1])]
    rows = [(int(i) * 2 + 5, *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in cols)), cols


def cloud(n, d, seed=1):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(c, s, size=(n // 3, d)) for c, s in ((0, 0.3), (2, 0.6), (7, 0.2))] + [rng.uniform(-3, 9, size=(n - 3 * (n // 3), d))])


@pytest.mark.parametrize("d,k,ward", [(8, 5, False), (2, 1, True)])
def test_nearest_is_exact(spark, monkeypatch, d, k, ward):
    monkeypatch.setattr(N, "BLOCK", 40)  # several blocks and portions a cell
    x = np.unique(cloud(400, d).round(2), axis=0)
    df, cols = frame(spark, x)
    w = np.arange(len(x)) % 4 + 1.0
    pts = N.packed(df, "id", cols).withColumn("w", ((F.col("id") - 5) / 2 % 4 + 1).cast("double"))
    got: dict = {}
    for r in sorted(N.nearest(saved(pts, "points"), d, k, ward).collect(), key=lambda r: (r["id"], r["cost"], r["nid"])):
        got.setdefault(r["id"], []).append((r["nid"], r["cost"]))
    cost = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    if ward:
        cost = N.merge_cost(w[:, None], w[None], cost)
    np.fill_diagonal(cost, np.inf)
    for i, row in enumerate(cost):
        order = np.argsort(row, kind="stable")[:k]
        assert [n for n, _ in got[2 * i + 5]] == [2 * j + 5 for j in order]
        assert np.allclose([c for _, c in got[2 * i + 5]], row[order])


def plain_ward(x, k):
    """Lance-Williams updates on the whole matrix."""
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(-1) / 2
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n), np.arange(n)
    for _ in range(n - k):
        i, j = np.unravel_index(d.argmin(), d.shape)
        i, j = min(i, j), max(i, j)
        t = size[i] + size[j] + size
        new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / t
        new[[i, j]] = np.inf
        new[np.isinf(d[i]) & np.isinf(d[j])] = np.inf
        d[i, :] = d[:, i] = new
        d[j, :] = d[:, j] = np.inf
        size[i] += size[j]
        label[label == j] = i
    return label


@pytest.mark.parametrize("local", [2048, 60])
def test_ward_equals_lance_williams(spark, local):
    x = cloud(300, 3, 4)
    df, cols = frame(spark, x)
    for k in (1, 4) if local == 60 else (7,):
        got = H.ward_labels(df, "id", cols, k, local)
        label = {r["id"]: r["label"] for r in got.collect()}
        want = plain_ward(x, k)
        assert len(label) == 300 and [label[2 * i + 5] for i in range(300)] == [2 * min(np.flatnonzero(want == want[i])) + 5 for i in range(300)]


def test_ward_on_five_thousand_points_and_copies(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(c, 0.5, size=(1250, 2)) for c in ((0, 0), (4, 0), (0, 5), (6, 6))])
    df, cols = frame(spark, np.vstack([x, np.repeat(x[:1], 800, axis=0)]))
    m = fit_model("clustering", "hierarchical", df, cols, {"n_clusters": 4, "linkage": "ward"})
    out = {r["id"]: r["prediction"] for r in m.transform(df.withColumn("place", F.lit(1))).collect()}
    a = np.vstack([x, np.repeat(x[:1], 800, axis=0)])
    ids, places, sizes = np.arange(5000), x, np.ones(5000)
    sizes[0] = 801
    # the same rule in memory, every merge, cut at four clusters
    merges = sorted(H.merge_all(ids, places, sizes), key=lambda t: -t[2])[3:]
    root = list(range(5000))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j, _ in merges:
        root[top(j)] = top(i)
    want = [top(i) for i in range(5000)] + [top(0)] * 800
    pairs = {(out[2 * i + 5], want[i]) for i in range(len(a))}
    assert len(pairs) == 4 and len({p for p, _ in pairs}) == 4
    with pytest.raises(ValueError):
        fit_model("clustering", "hierarchical", df, cols, {"linkage": "average"})
    with pytest.raises(ValueError):
        fit_model("clustering", "gaussian_mixture", df, cols, {"covariance_type": "diag"})


@pytest.mark.parametrize("d", [4, 8])
def test_dbscan_beyond_three_features(spark, monkeypatch, d):
    monkeypatch.setattr(N, "BLOCK", 50)
    x = np.vstack([cloud(260, d, 2), np.full((30, d), 5.0), np.full((3, d), -9.0)])
    df, cols = frame(spark, x)
    labels, core = C.dbscan(df, "id", cols, eps=1.2, min_samples=5)
    got = {r["id"]: r["cluster"] for r in labels.collect()}
    ids = np.arange(len(x)) * 2 + 5
    assert got == _dbscan_brute(ids, x, 1.2, 5) and len(set(got.values())) > 3
    m = C.fit_dbscan(df, cols, "id", 1.2, 5)
    near = m.transform(df.filter("id < 100")).collect()
    assert all(r["prediction"] == got[r["id"]] for r in near if got[r["id"]] >= 0)


def test_lof_beyond_three_features(spark):
    x = np.vstack([cloud(240, 8, 3), np.full((25, 8), 4.0)])
    df, cols = frame(spark, x)
    k = 10
    got = {r["id"]: r["lof"] for r in A.local_outlier_factor(df, "id", cols, k).collect()}
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(dist, np.inf)
    nn = np.argsort(dist, axis=1, kind="stable")[:, :k]
    far = np.take_along_axis(dist, nn, 1)
    kd = far.max(1)
    lrd = 1 / (np.maximum(kd[nn], far).mean(1) + 1e-10)
    lof = lrd[nn].mean(1) / lrd
    assert len(got) == len(x)
    for i in range(len(x)):
        assert got[2 * i + 5] == pytest.approx(lof[i], rel=1e-9)
