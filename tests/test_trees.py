"""Histogram boosting and forests against plain single-process versions."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.models import boosting, fit_model, forest, histograms, tree_models
from quarry.models.catalog import ignored_params
from quarry.models.histograms import uniforms
from quarry.models.served import ServedModel, load_model
from quarry.models.tree_models import TreeEnsembleModel

FEATURES = ["a", "b", "c"]


def data(spark, n=400, classes=0, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 6, n), rng.uniform(0, 100, n).round(0)])
    z = np.sin(2 * x[:, 0]) + 0.5 * x[:, 1] + 0.02 * x[:, 2] + 0.3 * rng.normal(size=n)
    y = z if not classes else np.digitize(z, np.quantile(z, np.arange(1, classes) / classes)).astype(float)
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label double"), x, y


def plain_tree(x, g, h, edges, opt):
    """One tree on raw values, grown node by node (depthwise) or leaf by leaf."""
    def stats(rows):
        return g[rows].sum(), h[rows].sum(), len(rows)

    def soft(v):
        return np.sign(v) * max(abs(v) - opt.reg_alpha, 0)

    def score(s):
        if opt.criterion == "friedman":
            return s[0] ** 2 / s[2]
        return soft(s[0]) ** 2 / (s[1] + opt.reg_lambda) / 2

    def best(rows):
        out = (boosting.LEAST_GAIN, None)
        if len(rows) < opt.least_rows_split:
            return out
        for f in range(x.shape[1]):
            for e in edges[f]:
                left, right = rows[x[rows, f] <= e], rows[x[rows, f] > e]
                a, b = stats(left), stats(right)
                if min(len(left), len(right)) < opt.least_rows or (opt.criterion == "second" and min(a[1], b[1]) < opt.least_hessian):
                    continue
                if not len(left) or not len(right):
                    continue
                gain = score(a) + score(b) - score(stats(rows)) - opt.least_gain
                if gain > out[0] + 1e-12:
                    out = (gain, (f, e, left, right))
        return out

    out = np.zeros(len(x))
    leaves = [(0, np.arange(len(x)), *best(np.arange(len(x))))]
    done, count = [], 1
    while leaves:
        i = max(range(len(leaves)), key=lambda i: leaves[i][2]) if opt.growth == "leafwise" else 0
        depth, rows, gain, split = leaves.pop(i)
        if split is None or (opt.max_depth > 0 and depth >= opt.max_depth) or (opt.growth == "leafwise" and count >= opt.num_leaves):
            done.append(rows)
            continue
        count += 1
        for part in split[2:]:
            leaves.append((depth + 1, part, *(best(part) if opt.max_depth <= 0 or depth + 1 < opt.max_depth else (0, None))))
    for rows in done:
        s = stats(rows)
        if opt.criterion == "friedman":
            v = -s[0] / (s[2] if opt.objective == "squared" else s[1])
        else:
            v = -soft(s[0]) / (s[1] + opt.reg_lambda)
        out[rows] = v * opt.learning_rate
    return out


def plain_boost(x, y, edges, opt, start, uid):
    margin = np.tile(np.array(start), (len(y), 1))
    for turn in range(opt.rounds):
        g, h = boosting.gradients(opt.objective, margin, y)
        use = uniforms(uid, opt.seed, turn) < opt.subsample if opt.subsample < 1 else np.ones(len(y), bool)
        add = np.zeros_like(margin)
        for k in range(opt.outputs):
            # rows outside the sample get the value of their leaf, too: grown on the sample, read by a lookup
            values = plain_tree(x[use], g[use, k], h[use, k], edges, opt)
            if use.all():
                add[:, k] = values
            else:
                return None
        margin += add
    return margin


CASES = [
    dict(objective="squared", max_depth=3, reg_lambda=2.0, reg_alpha=0.5, least_gain=0.1),
    dict(objective="logistic", max_depth=3, least_hessian=2.0),
    dict(objective="softmax", outputs=3, max_depth=2),
    dict(objective="squared", max_depth=3, criterion="friedman", least_rows=5, least_rows_split=20),
    dict(objective="logistic", max_depth=3, criterion="friedman"),
    dict(objective="squared", max_depth=0, growth="leafwise", num_leaves=9, reg_lambda=0.0, least_rows=8),
    dict(objective="logistic", max_depth=4, growth="leafwise", num_leaves=7, reg_lambda=0.0, least_hessian=1e-3, least_rows=8),
]


@pytest.mark.parametrize("case", CASES, ids=str)
def test_equals_a_plain_booster(spark, case):
    opt = boosting.BoostOptions(rounds=5, learning_rate=0.3, **case)
    df, x, y = data(spark, classes={"squared": 0, "logistic": 2, "softmax": 3}[opt.objective])
    start, edges, rounds = boosting.fit(df, FEATURES, "label", opt)
    kind = {"squared": "regression"}.get(opt.objective, opt.objective)
    got = TreeEnsembleModel(FEATURES, edges, [t for r in rounds for t in r], kind, start, "", "").raw(x.T)
    assert np.allclose(got, plain_boost(x, y, edges, opt, start, None), atol=1e-8)
    if opt.growth == "leafwise":
        assert max((t.feature < 0).sum() for r in rounds for t in r) == opt.num_leaves


@pytest.mark.parametrize("more", [dict(subsample=0.7, columns=0.67), dict(one_side=(0.2, 0.3)), dict(growth="leafwise", num_leaves=8, max_depth=0)], ids=str)
def test_one_task_and_many_passes_agree(spark, monkeypatch, more):
    monkeypatch.setattr(boosting, "ROUNDS_PER_WRITE", 2)
    df, x, y = data(spark)
    opt = boosting.BoostOptions(rounds=5, **{"max_depth": 3, **more})
    a = boosting.fit(df, FEATURES, "label", opt)
    b = boosting.fit(df.repartition(5), FEATURES, "label", opt, rows_per_task=120)
    raw = [TreeEnsembleModel(FEATURES, e, [t for r in rounds for t in r], "regression", s, "", "").raw(x.T) for s, e, rounds in (a, b)]
    assert np.allclose(raw[0], raw[1], atol=1e-9)
    assert np.corrcoef(raw[0][:, 0], y)[0, 1] > 0.7


def test_weights_are_copies(spark):
    df, x, _ = data(spark, 200)
    opt = boosting.BoostOptions(rounds=3, max_depth=2, least_hessian=0.0)
    double = df.unionByName(df.filter("id % 3 = 0"))
    weighted = df.withColumn("w", F.when(F.col("id") % 3 == 0, 2.0).otherwise(1.0))
    a, b = boosting.fit(double, FEATURES, "label", opt), boosting.fit(weighted, FEATURES, "label", opt, weight="w")
    raw = [TreeEnsembleModel(FEATURES, e, [t for r in rounds for t in r], "regression", s, "", "").raw(x.T) for s, e, rounds in (a, b)]
    # the cuts of the two differ where the copies move a quantile
    assert np.abs(raw[0] - raw[1]).mean() < 0.02


@pytest.mark.parametrize("classes", [0, 3])
def test_forest_in_tasks_equals_forest_by_passes(spark, classes):
    df, x, y = data(spark, 500, classes)
    opt = dict(trees=6, max_depth=5, classes=classes, columns=2)
    edges, a = forest.fit(df, FEATURES, "label", forest.ForestOptions(**opt))
    _, b = forest.fit(df.repartition(3), FEATURES, "label", forest.ForestOptions(**opt, local_rows=60), rows_per_task=200)
    _, c = forest.fit(df, FEATURES, "label", forest.ForestOptions(**opt, local_rows=0))
    kind = "shares" if classes else "regression"
    raw = [TreeEnsembleModel(FEATURES, edges, t, kind, [], "", "").raw(x.T) for t in (a, b, c)]
    assert np.allclose(raw[0], raw[1], atol=1e-9) and np.allclose(raw[0], raw[2], atol=1e-9)
    if classes:
        assert np.allclose(raw[0].sum(axis=1), 1) and (raw[0].argmax(axis=1) == y).mean() > 0.8
    else:
        assert np.corrcoef(raw[0][:, 0], y)[0, 1] > 0.85


def test_a_tree_splits_like_a_plain_one(spark):
    """One tree without bootstrap choice left: the plain best first split."""
    df, x, y = data(spark, 300)
    edges, (tree,) = forest.fit(df, FEATURES, "label", forest.ForestOptions(trees=1, max_depth=1, seed=5))
    uid = np.array([r[0] for r in df.orderBy("id").select(F.xxhash64(*df.columns)).collect()], np.int64)
    w = forest.copies(uid, 5, 0).astype(float)
    best = max(((f, b) for f in range(3) for b in range(len(edges[f]))), key=lambda p: sum(
        (w[m] * y[m]).sum() ** 2 / max(w[m].sum(), 1e-9) for m in (x[:, p[0]] <= edges[p[0]][p[1]], x[:, p[0]] > edges[p[0]][p[1]])))
    assert (tree.feature[0], tree.bin[0]) == best


def test_deep_and_odd_requests(spark, tmp_path):
    df, x, y = data(spark, 120, 2)
    for name, params in (("random_forest", {"n_estimators": 4, "max_depth": 31, "min_samples_split": 5, "max_features": None}),
                         ("lightgbm", {"n_estimators": 4, "data_sample_strategy": "goss", "min_child_samples": 3}),
                         ("xgboost", {"n_estimators": 4, "reg_alpha": 0.1, "reg_lambda": 3.0, "gamma": 0.01})):
        assert ignored_params(name, params) == []
        m = fit_model("classification", name, df, FEATURES, params, n_classes=2)
        out = m.transform(df.withColumn("probability_2", F.lit(1)))
        rows = out.collect()
        assert all(abs(sum(r["probability"]) - 1) < 1e-9 and r["prediction"] == float(np.argmax(r["probability"])) for r in rows)
        assert np.mean([r["prediction"] == r["label"] for r in rows]) > 0.75
        ServedModel(m, FEATURES).save(str(tmp_path / name))
        again = load_model(spark, str(tmp_path / name)).transform(df)
        assert {r["id"]: r["prediction"] for r in again.collect()} == {r["id"]: r["prediction"] for r in rows}
    # a missing value goes with the heavier side and rows come back
    holes = df.withColumn("a", F.when(F.col("id") % 2 == 0, F.col("a")))
    assert m.transform(holes).filter("prediction is not null").count() == 120
    assert m.transform(df.limit(0)).count() == 0
    constant = df.withColumn("a", F.lit(1.0)).withColumn("b", F.lit(2.0)).withColumn("c", F.lit(3.0))
    m = fit_model("regression", "xgboost", constant, FEATURES, {"n_estimators": 2})
    assert abs(m.transform(constant).first()["prediction"] - y.mean()) < 1e-6


def few_valued(spark, n=3000, seed=4):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 9, n), rng.integers(0, 5, n), rng.integers(0, 3, n)]).astype(float)
    y = np.sin(x[:, 0]) + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=n)
    rows = [(i, *map(float, r), float(t), 1.0 + i % 3) for i, (r, t) in enumerate(zip(x, y))]
    rows[5] = (5, None, *rows[5][2:])
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label double, w double"), x


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("more", [dict(growth="leafwise", num_leaves=8, max_depth=0, least_rows=20), dict(criterion="friedman"),
                                  dict(subsample=0.7, columns=0.67)], ids=str)
def test_rounds_over_cells_equal_rounds_by_passes(spark, monkeypatch, more):
    df, x = few_valued(spark)
    opt = boosting.BoostOptions(rounds=25, **{"max_depth": 3, **more})
    a, jobs = jobs_of(spark, f"cells {more}", lambda: boosting.fit(df, FEATURES, "label", opt, "w", rows_per_task=1000))
    monkeypatch.setattr(histograms, "MOST_CELLS", 0)
    b = boosting.fit(df, FEATURES, "label", opt, "w", rows_per_task=1000)
    raw = [TreeEnsembleModel(FEATURES, e, [t for r in rounds for t in r], "regression", s, "", "").raw(x.T) for s, e, rounds in (a, b)]
    assert np.allclose(raw[0], raw[1], atol=1e-9)
    assert jobs < opt.rounds  # not a job per level and round


def test_forest_over_cells_equals_forest_by_passes(spark, monkeypatch):
    df, x = few_valued(spark)
    df, x = df.filter("a is not null"), x[np.arange(len(x)) != 5]  # models refuse missing values
    opt = forest.ForestOptions(trees=3, max_depth=4, columns=2, least_rows=5, local_rows=800)
    got = []
    for most in (histograms.MOST_CELLS, 0):
        monkeypatch.setattr(histograms, "MOST_CELLS", most)
        dealt = []
        monkeypatch.setattr(forest, "_portion", lambda *a, run=forest._portion: dealt.append(1) or run(*a))
        edges, trees = forest.fit(df, FEATURES, "label", opt, "w", rows_per_task=1000)
        assert bool(dealt) == (most == 0)  # rows are dealt out only where there are many cells
        got.append(TreeEnsembleModel(FEATURES, edges, trees, "regression", [], "", "").raw(x.T))
    assert np.allclose(got[0], got[1], atol=1e-9)


def test_scoring_walks_the_trees_once_for_each_bin_vector(spark, monkeypatch):
    df, x = few_valued(spark, 500)
    edges, trees = forest.fit(df, FEATURES, "label", forest.ForestOptions(trees=3, max_depth=4))
    m = TreeEnsembleModel(FEATURES, edges, trees, "regression", [], "", "")
    walked = []
    monkeypatch.setattr(TreeEnsembleModel, "_walked", lambda self, bins, run=TreeEnsembleModel._walked: walked.append(bins.shape[1]) or run(self, bins))
    first, again = m.raw(x[:200].T), m.raw(x.T)
    assert sum(walked) == len(np.unique(x, axis=0))
    monkeypatch.setattr(tree_models, "CELL_SPACE", 0)
    plain = m.raw(x.T)
    assert walked[-1] == len(x) and (first == plain[:200]).all() and (again == plain).all()


def test_a_round_makes_its_margins_once_in_as_many_tasks_as_work_at_once(spark, monkeypatch):
    df = spark.range(400).selectExpr("id", "cast(id % 37 as double) as a", "cast(id * id % 101 as double) as b", "sin(id) as label")
    made, tasks = [], []
    monkeypatch.setattr(histograms.Data, "replaced", lambda self, *x, run=histograms.Data.replaced, **more: made.append(1) or run(self, *x, **more))
    monkeypatch.setattr(histograms.Data, "sums", lambda self, *x, run=histograms.Data.sums: tasks.append((self.tasks, self.chunks.rdd.getNumPartitions())) or run(self, *x))
    monkeypatch.setattr(boosting, "cells_of", lambda data: None)
    opt = boosting.BoostOptions(rounds=4, max_depth=2)
    _, _, a = boosting.fit(df, ["a", "b"], "label", opt, rows_per_task=10)
    assert len(made) == 3  # none before the first
    assert {n for t in tasks for n in t} == {spark.sparkContext.defaultParallelism}
    _, _, b = boosting.fit(df, ["a", "b"], "label", opt)
    for x, y in zip([t for r in a for t in r], [t for r in b for t in r]):
        assert x.feature.tolist() == y.feature.tolist() and np.allclose(x.value, y.value)


@pytest.mark.parametrize("classes", [0, 3])
def test_trees_in_tasks_equal_trees_by_passes_of_all(spark, monkeypatch, classes):
    """A tree's rows are never dealt out again while a task may read all of them."""
    df, x, y = data(spark, 900, classes)
    df = df.withColumn("w", 1.0 + F.col("id") % 2 / 2)
    kind, raw = "shares" if classes else "regression", []
    monkeypatch.setattr(histograms, "MOST_CELLS", 0)
    for most, w in ((forest.WHOLE_ROWS, None), (0, None), (forest.WHOLE_ROWS, "w"), (0, "w")):
        monkeypatch.setattr(forest, "WHOLE_ROWS", most)
        passes = []
        monkeypatch.setattr(forest, "_level", lambda *a, run=forest._level: passes.append(1) or run(*a))
        opt = forest.ForestOptions(trees=7, max_depth=6, classes=classes, columns=2, least_rows=2, local_rows=160)
        edges, trees = forest.fit(df, FEATURES, "label", opt, w, rows_per_task=300)
        assert bool(passes) == (most == 0)
        raw.append(TreeEnsembleModel(FEATURES, edges, trees, kind, [], "", "").raw(x.T))
    assert np.allclose(raw[0], raw[1], atol=1e-9) and np.allclose(raw[2], raw[3], atol=1e-9) and not np.allclose(raw[0], raw[2], atol=1e-9)


@pytest.mark.parametrize("classes, weighted", [(0, False), (2, False), (0, True), (3, True)])
def test_a_tree_from_blocks_in_a_file_equals_one_from_memory(monkeypatch, classes, weighted):
    rng = np.random.default_rng(8)
    n, widths, found = 6000, [254, 9, 40], []
    bins = np.stack([rng.integers(0, k + 1, n) for k in widths]).astype(np.uint8)
    y = rng.integers(0, classes, n).astype(float) * (bins[0] > 99) if classes else ((rng.normal(size=n) + bins[0] / 50 + bins[1] * (bins[2] > 9)) * 64).round(0)  # sums without rounding
    w, uid = 1.0 + weighted * rng.integers(0, 2, n) / 2, rng.integers(-2**62, 2**62, n)
    for held, block, local in ((1 << 30, 1 << 20, 1 << 20), (1 << 30, 700, 300), (9_000, 700, 300), (9_000, 700, 16)):
        monkeypatch.setattr(forest, "HELD_BYTES", held)
        monkeypatch.setattr(forest, "BLOCK_ROWS", block)
        blocks = forest._Blocks(((uid[i:i + 500], bins[:, i:i + 500], y[i:i + 500], w[i:i + 500], None) for i in range(0, n, 500)), 3)
        assert (blocks.file is not None) == (held < 1 << 20)
        tree = forest._tree(blocks, 2, widths, forest.ForestOptions(max_depth=8, classes=classes, columns=2, least_rows=3, local_rows=local))
        found.append(tree.values(bins))
    assert len(tree.feature) > 100
    assert all(np.allclose(found[0], f, atol=1e-9) for f in found[1:])


def test_draws_are_poisson_of_the_uniforms():
    uid = np.random.default_rng(1).integers(-2**62, 2**62, 200_000)
    for tree in (0, 7):
        assert (forest.copies(uid, 42, tree) == np.searchsorted(forest.POISSON, uniforms(uid, 42, tree), side="right")).all()


@pytest.mark.parametrize("classes, n", [(0, 3000), (2, 3000), (0, 90)])
def test_small_nodes_split_like_dense_ones(monkeypatch, classes, n):
    """Nodes of few rows are summed over the bins that they have."""
    rng = np.random.default_rng(n)
    bins = rng.integers(0, 255, (4, n)).astype(np.uint8)
    bins[1] //= 60
    y = (rng.random(n) < bins[0] / 255).astype(float) if classes else rng.normal(size=n) + bins[2] / 50
    w = rng.integers(1, 4, n).astype(float)
    opt, found = forest.ForestOptions(max_depth=20, classes=classes, columns=2, least_rows=2), []
    for start in (0, 1 << 40):
        monkeypatch.setattr(forest, "SPARSE_FROM", start)
        found.append(forest.grow(bins, y, w, 3, 1, 0, [254, 4, 254, 254], opt))
    a, b = found
    assert len(a.feature) > n / 5
    for name in ("feature", "bin", "left", "missing_left", "value"):
        assert (getattr(a, name) == getattr(b, name)).all()
    bins[0, ::7] = histograms.MISSING
    assert (a.walked(bins, True) == a.nodes(np.tile(bins, 300)).reshape(300, -1)).all()


def test_workers_get_the_outputs_of_a_large_model_over_few_bins(spark, monkeypatch):
    df, x = few_valued(spark, 500)
    df = df.filter("a is not null")
    edges, trees = forest.fit(df, FEATURES, "label", forest.ForestOptions(trees=3, max_depth=4))
    m = TreeEnsembleModel(FEATURES, edges, trees, "regression", [], "", "")
    odd = df.unionByName(df.limit(20).withColumn("b", F.lit(None).cast("double"))).unionByName(df.limit(20).withColumn("a", F.lit(77.5)))
    assert m.light() is m
    plain = sorted((r["id"], r["prediction"]) for r in m.transform(odd).collect())
    monkeypatch.setattr(tree_models, "LARGE_MODEL", 0)
    m._sent = None
    assert m.light().trees == [] and sorted((r["id"], r["prediction"]) for r in m.transform(odd).collect()) == plain


def test_sums_per_cell_are_made_by_few_tasks_without_the_rows(spark, monkeypatch):
    """What a draw adds up is not handed on for every few rows, and the chunks are not kept for it."""
    df, x = few_valued(spark)
    df = df.filter("a is not null")
    got, kept = [], lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    before = kept()
    for size in (1 << 20, 1):  # all draws in a task, one draw in a task
        monkeypatch.setattr(histograms, "SUM_BYTES", size)
        d = histograms.prepare(df, FEATURES, "label", "w", rows_per_task=500, keep=False)
        sums = histograms.drawn_sums(d, histograms.cells_of(d), 5, forest.drawn, lambda uid: forest.seeded(uid, 42))
        got.append({r["tree"]: np.frombuffer(r["sums"]).reshape(3, -1) for r in sums.collect()})
        assert kept() <= before
    uid = np.array([r[0] for r in df.select(F.xxhash64(*df.columns)).collect()], np.int64)
    for t in range(5):
        assert np.allclose(got[0][t], got[1][t]) and got[0][t][2].sum() == (forest.copies(uid, 42, t) > 0).sum()
