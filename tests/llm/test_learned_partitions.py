"""Learned partitions: recall against brute force, exact scores, odd rows."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import learned_partitions as lp


def brute(ids, x, queries, k):
    out = {}
    for i, q in queries:
        s = (x * q).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def recall(got, want):
    return np.mean([len({v for v, _ in got[q]} & {v for v, _ in w}) / len(w) for q, w in want.items()])


def collect(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("scaled", [False, True])
def test_recall(spark, scaled):
    pdf = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x = np.stack(pdf["embedding"]).astype(float)
    if scaled:
        x = x * np.random.default_rng(1).uniform(0.5, 2, (len(x), 1))
    ids = pdf["vec_id"].to_numpy()
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = collect(lp.search(df, F.col("vec_id") % 20 == 0, rows_per_partition=100))
    want = brute(ids, x, [(i, v) for i, v in zip(ids, x) if i % 20 == 0], 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.9
    for q, rows in got.items():
        exact = dict(zip(ids.tolist(), (x * x[np.flatnonzero(ids == q)[0]]).sum(axis=1)))
        assert all(abs(exact[v] - s) < 1e-12 for v, s in rows)
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))


def test_partitions_are_balanced():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 16))
    part = lp.balanced_partition(x, lp.nearest(x, 8), 20, rng)
    assert np.bincount(part, minlength=20).max() <= 110 and (part >= 0).all()


def test_rows(spark):
    rng = np.random.default_rng(3)
    base = [1.0, 2.0, 0.5]
    rows = [(i, base) for i in range(0, 300)] + [(1000 + i, rng.normal(size=3).tolist()) for i in range(40)]
    rows += [(2000, None), (2020, [0.0, 0.0, 0.0]), (2040, [1.0, None, 2.0]), (2060, [float("nan"), 1.0, 1.0]),
             (2080, [float("inf"), 1.0, 1.0]), (2100, [1.0, 2.0]), (2120, []), (None, base), (7, base), (20, base)]
    df = spark.createDataFrame([(k, v, "x") for k, v in rows], "vec_id long, embedding array<double>, rank string")
    got = collect(lp.search(df, F.col("vec_id") % 20 == 0, rows_per_partition=50))
    ok = {k: np.array(v) for k, v in rows if k is not None and k < 2000}
    ids = np.array(sorted(ok))
    want = brute(ids, np.stack([ok[i] for i in ids]), [(i, ok[i]) for i in ids if i % 20 == 0], 20)
    assert got.keys() == want.keys()
    same = [q for q in got if q < 300]
    assert all([v for v, _ in got[q]] == [v for v, _ in want[q]] for q in same)
    assert lp.search(df.limit(0), F.lit(True)).count() == 0
    few = collect(lp.search(df.filter("vec_id between 1000 and 1004"), F.lit(True)))
    assert len(few) == 5 and all(len(v) == 4 for v in few.values())
