"""ProbMinHash near duplicates against brute force over all pairs."""
import random

import numpy as np

from quarry.llm import prob_minhash as pm

SF = "/root/testdata/sf0.001"


def brute(rows):
    """Classes by exact measure over all pairs of distinct word sequences."""
    sh = pm.Shingler()
    first, up = {}, {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    def join(a, b):
        a, b = sorted((find(a), find(b)))
        up[b] = a

    for k, t in sorted(rows):
        key = tuple(pm.words(t))
        first.setdefault(key, k)
        join(k, first[key])
    items = [(k, sh(list(w))) for w, k in first.items() if w]
    for i, (a, x) in enumerate(items):
        for b, y in items[:i]:
            if pm.probability_jaccard(x, y) >= pm.LEAST:
                join(a, b)
    return {k: find(k) for k, _ in rows}


def test_measure_and_estimate():
    rnd = random.Random(1)
    sh, err = pm.Shingler(), []
    for _ in range(60):
        w = [rnd.choice("abcdefghijkl") for _ in range(rnd.randrange(20, 300))]
        v = w[:]
        for _ in range(rnd.randrange(1, 20)):
            v[rnd.randrange(len(v))] = "z%d" % rnd.randrange(9)
        a, b = sh(w, 2), sh(v, 2)
        x, y = dict(zip(a[0].tolist(), a[1])), dict(zip(b[0].tolist(), b[1]))
        exact = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in {*x, *y}) for d in {*x} & {*y})
        assert abs(exact - pm.probability_jaccard(a, b)) < 1e-9
        err.append((pm.signature(*a) == pm.signature(*b)).mean() - exact)
    assert abs(np.mean(err)) < 0.02 and np.std(err) < 0.06


def test_real_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: r["class_id"] for r in pm.near_duplicates(docs).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_chains_and_hot_groups(spark):
    rnd = random.Random(7)
    base = [f"w{rnd.randrange(5000)}" for _ in range(200)]
    rows, k = [], 0
    for _ in range(150):  # many copies of one text, each with an edit of its own
        v = base[:]
        v[rnd.randrange(200)] = f"e{k}"
        rows.append((k, " ".join(v)))
        k += 1
    chain = [f"c{rnd.randrange(5000)}" for _ in range(200)]
    for i in range(25):  # a drifting text: only neighbours are alike
        chain = chain[4:] + [f"n{i}{j}" for j in range(4)]
        rows.append((k, " ".join(chain)))
        k += 1
    rows += [(k + i, rows[0][1].upper()) for i in range(60)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in pm.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_rows(spark):
    rows = [(1, ""), (2, None), (3, "..."), (None, "a b c d e f"), (4, "a b c d e f"), (5, "A, b c d e f!"), (6, "one two"), (7, "one two"),
            (8, "one three"), (9, "w " * 50_000), (10, "w " * 49_999), (11, "x y z u v w t s"), (11, "a b c d e f")]
    df = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, class_id int")
    got = pm.near_duplicates(df).collect()
    assert len(got) == len(rows)
    c = {r["doc_id"]: r["class_id"] for r in got}
    assert c[None] is None and c[1] == c[2] == c[3] == 1 and c[4] == c[5] == c[11] == 4 and c[6] == c[7] == 6 and c[8] == 8 and c[9] == c[10] == 9
    kept = pm.distinct_documents(df)
    assert kept.columns == df.columns and sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 4, 6, 8, 9]
    assert pm.near_duplicates(df.limit(0)).count() == 0 and pm.distinct_documents(df.limit(0)).count() == 0


def test_pairs_among_many_alike_texts(spark, monkeypatch):
    """One bucket of texts 0.7 alike, pairs of 0.85 among them, and smallest and largest ids like nobody."""
    rnd = random.Random(11)
    base = [f"w{i}" for i in range(400)]

    def text(own):
        return " ".join(base[:330] + [f"o{own}_{i}" for i in range(70)])

    rows = [(k, text(k)) for k in range(150)]
    for i in range(20):
        w = rows[30 + 2 * i][1].split()
        rows.append((100_000 - i if i % 2 else 500 + i, " ".join(w[:-30] + [f"p{i}_{j}" for j in range(30)])))
    rows += [(200_000 + k, text(200_000 + k)) for k in range(5)]
    rnd.shuffle(rows)
    monkeypatch.setattr(pm, "band_hashes", lambda sig: [7])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    got = {r["doc_id"]: r["class_id"] for r in pm.near_duplicates(df).collect()}
    assert got == want and len(set(want.values())) == len(rows) - 20
