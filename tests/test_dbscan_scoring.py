"""Scoring new rows with DBSCAN: the label of the nearest core point."""
import numpy as np

from quarry.models import clustering as C


def test_labels_are_those_of_the_nearest_core_point_and_few_points_are_compared(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.uniform((0, 0), (3, 0.4), (400, 2)), rng.uniform((0, 0.95), (3, 1.4), (400, 2)), rng.uniform(5, 9, (60, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    m = C.fit_dbscan(df, ["a", "b"], "id", 0.5, 8)
    core = np.array([(r["p0"], r["p1"], r["label"]) for r in m.core.collect()])
    assert len(set(core[:, 2])) > 1
    new = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-1, 10, (400, 2)))]
    new += [(1000 + i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(2000 + i, float(a), 0.675) for i, a in enumerate(rng.uniform(0, 3, 50))]
    new += [(2000, 1.0, 0.1), (2000, 1.0, 1.3), (3000, None, 1.0), (None, 1.0, 0.2)]  # a key more than once, missing values
    compared = []
    real = C.DBSCANModel._by_points
    monkeypatch.setattr(C.DBSCANModel, "_by_points", lambda self, q: compared.append(q.count()) or real(self, q))
    got = {r["id"]: r["prediction"] for r in m.transform(spark.createDataFrame(new, "id long, a double, b double")).collect()}
    expected = {}
    for i in {i for i, *_ in new}:
        d2 = [((a - p) ** 2 + (b - q) ** 2, label) for j, a, b in new if j == i and i is not None and a is not None for p, q, label in core]
        d2 = [v for v in d2 if v[0] <= 0.25]
        expected[i] = min(d2)[1] if d2 else -1
    assert got == expected and compared[0] < 500  # of 1,314 rows
