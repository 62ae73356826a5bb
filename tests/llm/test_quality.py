"""Quality classifier: held-out accuracy, isotonic map, odd rows."""
import numpy as np

from quarry.llm import quality as q
from quarry.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    y = np.asarray(y)
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_held_out(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = QUERIES["op5_quality"](spark, SF).collect()
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [(labels[r["doc_id"]], r["score"], r["predicted"]) for r in got if r["held_out"] and labels.get(r["doc_id"]) is not None]
    y, s, p = map(np.array, zip(*held))
    assert len(held) > 50 and auc(y, s) > 0.97 and (y == p).mean() > 0.93
    assert (p[y == 1] == 1).mean() > 0.95


def test_isotonic_equals_brute_force():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 9, 30).astype(float)
    p = np.minimum(n, rng.integers(0, 9, 30)).astype(float)
    at, to = q.isotonic(np.arange(30.0), p, n)
    mean = [max(min(p[i:j + 1].sum() / n[i:j + 1].sum() for j in range(k, 30)) for i in range(k + 1)) for k in range(30)]
    assert np.allclose(np.unique(np.round(mean, 9)), np.unique(np.round(to, 9))) and (np.diff(to) > 0).all()


def test_partition_sums_equal_one_matrix(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, len(q.NAMES)))
    y = rng.integers(0, 2, 500).astype(float)
    model = q.QualityModel(x.mean(0), x.std(0), 32)
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, y double").repartition(7)
    z = model.fourier(x)
    assert np.allclose(q._sums(df, model), z.T @ np.hstack([z, y[:, None]]))


def test_rows(spark):
    rows = [(1, ""), (2, None), (None, "no id"), (3, "w " * 60_000), (3, "again"), (4, "a\n\nb"), (5, "\x00 🙂")]
    df = spark.createDataFrame([(k, t, "c") for k, t in rows], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = q.score_documents(df, none).collect()
    assert len(got) == len(rows) and all(abs(r["score"] - 0.5) < 1e-3 for r in got)
    some = spark.createDataFrame([(1, 0, 0), (2, None, 0), (3, 1, 0), (3, 1, 0), (None, 1, 1), (4, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    got = q.score_documents(df, some).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert q.score_documents(df.limit(0), some).count() == 0
    kept = q.keep(df, none)
    assert kept.columns == df.columns and kept.count() == len(rows)


def test_keep_equals_scores(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    good = {r["doc_id"] for r in q.score_documents(docs, labels).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in q.keep(docs, labels).collect()} == good
