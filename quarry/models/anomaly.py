"""Unsupervised anomaly detectors (§2.7). Output contract: ``score`` (higher
= more anomalous) and ``prediction`` (1 = anomaly, 0 = normal; the -1/+1
convention is mapped here, quirk Q4).

* isolation_forest  (Liu, Ting & Zhou 2008)
* elliptic_envelope (classical or C-step robust Mahalanobis; Rousseeuw &
  Van Driessen 1999)
* local_outlier_factor (Breunig et al. 2000) on exact nearest rows by boxes
* one_class_svm     (random Fourier features + linear one-class objective)
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.columns import hash_unit, materialize, require_complete
from quarry.functions.stats import moments, quadratic_form, quantile
from quarry.models.served import read_meta, write_meta
from quarry.operators import boxes as B
from quarry.operators import neighbours as N
from quarry.session import saved

SEED = 42
EULER_GAMMA = 0.5772156649


def spread(df: DataFrame) -> DataFrame:
    """Python-heavy stages need every core: the rows are dealt round-robin
    over the shuffle partitions, whatever the input's own partitioning."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def c_factor(m):
    """Average path length of an unsuccessful BST search over m points."""
    m = np.asarray(m, dtype=float)
    out = np.zeros_like(m)
    big = m > 2
    out[big] = 2.0 * (np.log(m[big] - 1.0) + EULER_GAMMA) - 2.0 * (m[big] - 1.0) / m[big]
    out[m == 2] = 1.0
    return out


# ----------------------------------------------------------------- isolation forest
NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("size", T.IntegerType()), T.StructField("depth", T.IntegerType()),
])


def _build_itree(X: np.ndarray, rng: np.random.Generator, height_limit: int):
    """Iterative isolation tree; returns node arrays."""
    feats, thr, left, right, size, depth = [], [], [], [], [], []

    def new(n, d):
        feats.append(-1); thr.append(0.0); left.append(-1); right.append(-1); size.append(n); depth.append(d)
        return len(feats) - 1

    root = new(len(X), 0)
    stack = [(root, np.arange(len(X)), 0)]
    while stack:
        node, idx, d = stack.pop()
        if d >= height_limit or len(idx) <= 1:
            continue
        sub = X[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if cand.size == 0:
            continue
        f = int(rng.choice(cand))
        t = float(rng.uniform(lo[f], hi[f]))
        mask = sub[:, f] < t
        li, ri = idx[mask], idx[~mask]
        ln, rn = new(len(li), d + 1), new(len(ri), d + 1)
        feats[node], thr[node], left[node], right[node] = f, t, ln, rn
        stack.append((ln, li, d + 1))
        stack.append((rn, ri, d + 1))
    return feats, thr, left, right, size, depth


class IsolationForestModel:
    def __init__(self, features: list[str], nodes: pd.DataFrame, psi: int, threshold: float | None, n_trees: int):
        self.feature_cols = features
        self.psi = psi
        self.threshold = threshold
        self.n_trees = n_trees
        self.nodes = nodes
        width = int(nodes.groupby("tree")["node"].max().max()) + 1
        shape = (n_trees, width)
        self._arr = {k: np.full(shape, -1 if k != "threshold" else 0.0, dtype=float if k == "threshold" else np.int64)
                     for k in ("feature", "threshold", "left", "right", "size", "depth")}
        t = nodes["tree"].to_numpy()
        n = nodes["node"].to_numpy()
        for k in self._arr:
            self._arr[k][t, n] = nodes[k].to_numpy()

    def _score_fn(self):
        # trees are bounded (n_trees x (2 psi - 1) nodes); ship them once per
        # executor as a broadcast variable instead of inside every task
        if getattr(self, "_bc", None) is None:
            self._bc = _active().sparkContext.broadcast(self._arr)
        bc = self._bc
        feats = self.feature_cols
        cpsi = float(c_factor([self.psi])[0]) or 1.0
        n_trees = self.n_trees

        def score(batches):
            A = bc.value
            for pdf in batches:
                X = pdf[feats].to_numpy(dtype=float)
                m = len(X)
                total = np.zeros(m)
                rows = np.arange(m)
                for t in range(n_trees):
                    f_t, th_t, l_t, r_t = A["feature"][t], A["threshold"][t], A["left"][t], A["right"][t]
                    node = np.zeros(m, dtype=np.int64)
                    active = rows
                    # descend only the rows that are still at inner nodes
                    while active.size:
                        f = f_t[node[active]]
                        inner = f >= 0
                        active, f = active[inner], f[inner]
                        if not active.size:
                            break
                        cur = node[active]
                        node[active] = np.where(X[active, f] < th_t[cur], l_t[cur], r_t[cur])
                    total += A["depth"][t][node] + c_factor(A["size"][t][node])
                out = pdf.copy()
                out["score"] = np.power(2.0, -(total / n_trees) / cpsi)
                yield out

        return score

    def score(self, df: DataFrame) -> DataFrame:
        schema = T.StructType(df.schema.fields + [T.StructField("score", T.DoubleType())])
        return spread(df).mapInPandas(self._score_fn(), schema)

    def transform(self, df: DataFrame) -> DataFrame:
        s = self.score(df)
        return s.withColumn("prediction", (F.col("score") > F.lit(self.threshold)).cast("double"))

    def save(self, path: str) -> str:
        spark = _active()
        spark.createDataFrame(self.nodes, NODE_SCHEMA).write.mode("overwrite").parquet(f"{path}/trees")
        write_meta(path, {"features": self.feature_cols, "psi": self.psi, "threshold": self.threshold,
                           "n_trees": self.n_trees})
        return path

    @classmethod
    def load(cls, spark, path: str) -> "IsolationForestModel":
        m = read_meta(spark, path)
        return cls(m["features"], spark.read.parquet(f"{path}/trees").toPandas(), m["psi"], m["threshold"], m["n_trees"])


def isolation_samples(df: DataFrame, key: str, features: list[str], n: int, n_trees: int, psi: int, seed: int) -> DataFrame:
    """Rows tagged with tree ids: each tree gets ~1.5 psi hash-chosen
    candidates (rows are replicated only when n is too small to fill every
    tree without repeats); the psi with the smallest hash are kept later."""
    cols = [key, *features]
    if n <= psi:
        return df.select(*cols).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1)))) \
                 .withColumn("u", hash_unit(seed, key, "tree"))
    copies = max(1, math.ceil(1.5 * n_trees * psi / n))
    slots = max(n_trees, int(n * copies / (1.5 * psi)))
    x = df.select(*cols)
    if copies > 1:
        x = x.withColumn("__c", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    else:
        x = x.withColumn("__c", F.lit(0))
    u = hash_unit(seed, key, "__c")
    x = x.withColumn("__u", u).where(F.col("__u") < F.lit(n_trees / slots))
    return x.select(*cols, F.floor(F.col("__u") * slots).cast("int").alias("tree"),
                    hash_unit(seed + 1, key, "__c").alias("u"))


def fit_isolation_forest(train: DataFrame, features: list[str], key: str, n_estimators: int = 200,
                         max_samples: int = 256, contamination: float = 0.1, seed: int = SEED) -> IsolationForestModel:
    n = train.count()
    psi = int(min(max_samples, n))
    height = max(1, math.ceil(math.log2(max(psi, 2))))
    samples = isolation_samples(train, key, features, n, n_estimators, psi, seed)
    feats = list(features)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", key]).head(psi)
        t = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, t])
        f, th, l, r, s, d = _build_itree(pdf[feats].to_numpy(dtype=float), rng, height)
        k = len(f)
        return pd.DataFrame({"tree": np.full(k, t, dtype=np.int32), "node": np.arange(k, dtype=np.int32),
                             "feature": np.array(f, dtype=np.int32), "threshold": np.array(th, dtype=float),
                             "left": np.array(l, dtype=np.int32), "right": np.array(r, dtype=np.int32),
                             "size": np.array(s, dtype=np.int32), "depth": np.array(d, dtype=np.int32)})

    # bounded: n_trees * (2 psi - 1) node rows
    nodes = samples.groupBy("tree").applyInPandas(build, NODE_SCHEMA).toPandas()
    model = IsolationForestModel(feats, nodes, psi, None, n_estimators)
    # score the training rows once; the exact quantile reads them a few times
    scored = model.score(train.select(*feats)).select("score").transform(materialize)
    model.threshold = quantile(scored, "score", 1.0 - contamination)
    return model


# ----------------------------------------------------------------- elliptic envelope
class EnvelopeModel:
    def __init__(self, features, mu, P, threshold):
        self.feature_cols, self.mu, self.P, self.threshold = features, mu, P, threshold

    def score(self, df: DataFrame) -> DataFrame:
        return df.withColumn("score", quadratic_form(self.feature_cols, self.mu, self.P))

    def transform(self, df: DataFrame) -> DataFrame:
        return self.score(df).withColumn("prediction", (F.col("score") > F.lit(self.threshold)).cast("double"))

    def save(self, path: str) -> str:
        write_meta(path, {"features": self.feature_cols, "mu": self.mu.tolist(), "precision": self.P.tolist(),
                           "threshold": self.threshold})
        return path

    @classmethod
    def load(cls, spark, path: str) -> "EnvelopeModel":
        m = read_meta(spark, path)
        return cls(m["features"], np.array(m["mu"]), np.array(m["precision"]), m["threshold"])


def fit_elliptic_envelope(train: DataFrame, features: list[str], contamination: float = 0.1, robust: bool = True,
                          max_steps: int = 500, exact_quantile: bool = True) -> EnvelopeModel:
    """Classical: mean/covariance in one pass. Robust: C-steps — keep the
    h = floor((n+d+1)/2) rows of smallest distance (cut by a quantile of the
    distance), re-estimate, stop when det(cov) stops falling."""
    x = train.select(*features)
    n, mu, S = moments(x, features)
    d = len(features)
    if robust and n > d + 1:
        h = (n + d + 1) // 2
        best = np.linalg.det(S)
        for _ in range(max_steps):
            P = np.linalg.pinv(S)
            dist = x.withColumn("__d2", quadratic_form(features, mu, P))
            cut = quantile(dist, "__d2", h / n, exact_quantile)
            sub = dist.where(F.col("__d2") <= F.lit(cut)).select(*features)
            _, mu2, S2 = moments(sub, features)
            det2 = np.linalg.det(S2)
            if not det2 < best * (1 - 1e-9):
                break
            mu, S, best = mu2, S2, det2
        else:
            raise RuntimeError(f"the robust covariance has not settled after {max_steps} steps")
    P = np.linalg.pinv(S)
    m = EnvelopeModel(features, mu, P, 0.0)
    m.threshold = quantile(m.score(x), "score", 1.0 - contamination, exact_quantile)
    return m


# ----------------------------------------------------------------- LOF
class LOFModel:
    def __init__(self, features, key, train_stats: DataFrame, train_points: DataFrame, k, threshold):
        self.feature_cols, self.key, self.train_stats, self.train_points = features, key, train_stats, train_points
        self.k, self.threshold = k, threshold

    def score(self, df: DataFrame) -> DataFrame:
        """Novelty scoring: LOF of new rows against the training points."""
        asked = B.entries(df.where(F.col(self.key).isNotNull()), self.key, self.feature_cols)
        nn = B.nearest_rows(asked, B.entries(self.train_points, self.key, self.feature_cols), len(self.feature_cols), self.k, False)
        lof = _lof_from_knn(nn, self.train_stats)
        return df.join(lof.withColumnRenamed("q", self.key), self.key, "left")

    def transform(self, df: DataFrame) -> DataFrame:
        return self.score(df).withColumn("prediction", (F.col("score") > F.lit(self.threshold)).cast("double"))

    def save(self, path: str) -> str:
        self.train_stats.write.mode("overwrite").parquet(f"{path}/lrd")
        self.train_points.write.mode("overwrite").parquet(f"{path}/points")
        write_meta(path, {"features": self.feature_cols, "key": self.key, "k": self.k, "threshold": self.threshold})
        return path

    @classmethod
    def load(cls, spark, path: str) -> "LOFModel":
        m = read_meta(spark, path)
        return cls(m["features"], m["key"], spark.read.parquet(f"{path}/lrd"), spark.read.parquet(f"{path}/points"), m["k"], m["threshold"])


def _mean(value: Column) -> Column:
    """Over the neighbours, each as often as it counts."""
    return F.sum(F.col("t") * value) / F.sum("t")


def _lof_from_knn(nn: DataFrame, stats: DataFrame) -> DataFrame:
    """nn (q, n, dist, t) + training (n, kdist, lrd) -> (q, lrd, score=LOF)."""
    j = nn.join(stats.select(F.col("id").alias("n"), "kdist", F.col("lrd").alias("lrd_n")), "n")
    agg = j.groupBy("q").agg(_mean(F.greatest(F.col("kdist"), F.col("dist"))).alias("__reach"), _mean(F.col("lrd_n")).alias("__lrd_nb"))
    lrd = F.lit(1.0) / (F.col("__reach") + F.lit(1e-10))
    return agg.select("q", lrd.alias("lrd"), (F.col("__lrd_nb") / lrd).alias("score"))


def local_outlier_factor(df: DataFrame, key: str, features: list[str], k: int = 20) -> DataFrame:
    """Training-set LOF: (key, kdist, lrd, lof) for every row. Up to three features the neighbours come from
    boxes of near rows, beyond from a pivot partitioned join."""
    if len(features) > 3:
        return _pivot_lof(df, key, features, k)
    rows = saved(B.entries(df.where(F.col(key).isNotNull()), key, features), "entries")
    nn = saved(B.nearest_rows(rows, rows, len(features), k, True), "neighbours")
    kd = saved(nn.groupBy("q").agg(F.max("dist").alias("kdist")), "kdist")
    j = nn.join(kd.select(F.col("q").alias("n"), F.col("kdist").alias("kdist_n")), "n")
    reach = j.groupBy("q").agg(_mean(F.greatest("kdist_n", "dist")).alias("__reach"))
    lrd = saved(reach.select("q", (F.lit(1.0) / (F.col("__reach") + F.lit(1e-10))).alias("lrd")), "lrd")
    lrd_nb = nn.join(lrd.select(F.col("q").alias("n"), F.col("lrd").alias("lrd_n")), "n").groupBy("q").agg(
        _mean(F.col("lrd_n")).alias("__nb"))
    out = kd.join(lrd, "q").join(lrd_nb, "q")
    return out.select(F.col("q").alias(key), "kdist", "lrd", (F.col("__nb") / F.col("lrd")).alias("lof"))


def _pivot_lof(df: DataFrame, key: str, features: list[str], k: int) -> DataFrame:
    """LOF in any number of dimensions. Rows at one place are one point of w rows: w - 1
    neighbours at distance 0, and of a neighbour place as many rows as the k still lack."""
    rows = saved(N.packed(df, key, features), "points")
    places = saved(N.distinct_points(rows), "places")
    nn = saved(N.nearest(places, len(features), k).join(places.select("id", "w"), "id"), "neighbours")
    before = F.sum("nw").over(Window.partitionBy("id").orderBy("cost", "nid").rowsBetween(Window.unboundedPreceding, -1))
    own = F.least(F.col("w") - 1, F.lit(float(k)))
    taken = F.least(F.col("nw"), F.greatest(F.lit(float(k)) - own - F.coalesce(before, F.lit(0.0)), F.lit(0.0)))
    nn = saved(nn.select("id", "nid", "cost", taken.alias("t")).filter("t > 0"), "taken")
    kd = nn.groupBy("id").agg(F.max("cost").alias("kdist"), F.sum("t").alias("n"))
    kd = places.join(kd, "id", "left").select("id", "x", own.alias("own"), F.coalesce("kdist", F.lit(0.0)).alias("kdist"), F.coalesce("n", F.lit(0.0)).alias("n"))
    kd = saved(kd, "kdist")

    def mean_of(value: Column, own_value: Column, table: DataFrame) -> DataFrame:
        sums = nn.join(table.withColumnRenamed("id", "nid"), "nid").groupBy("id").agg(F.sum(F.col("t") * value).alias("s"))
        return kd.join(sums, "id", "left").withColumn("mean", F.try_divide(F.coalesce("s", F.lit(0.0)) + F.col("own") * own_value, F.col("own") + F.col("n")))

    reach = mean_of(F.greatest("far", "cost"), F.col("kdist"), kd.select("id", F.col("kdist").alias("far")))
    lrd = saved(reach.select("id", (F.lit(1.0) / (F.col("mean") + F.lit(1e-10))).alias("lrd")), "lrd")
    around = mean_of(F.col("lrd"), F.lit(0.0), lrd).join(lrd, "id")
    around = around.withColumn("mean", F.col("mean") + F.try_divide(F.col("own") * F.col("lrd"), F.col("own") + F.col("n")))
    out = saved(around.select("x", "kdist", "lrd", (F.col("mean") / F.col("lrd")).alias("lof")), "lof")
    return rows.join(out, "x").select(F.col("id").alias(key), "kdist", "lrd", "lof")


def fit_lof(train: DataFrame, features: list[str], key: str, n_neighbors: int = 20, contamination: float = 0.1,
            **_) -> LOFModel:
    k = int(n_neighbors)
    pts = train.select(key, *features).transform(materialize)
    lof = local_outlier_factor(pts, key, features, k).transform(materialize)
    stats = lof.select(F.col(key).alias("id"), "kdist", "lrd")
    thr = quantile(lof, "lof", 1.0 - contamination)
    return LOFModel(features, key, stats, pts, k, thr)


# ----------------------------------------------------------------- one-class SVM
#: rows whose random features a task holds at once
ROWS_AT_ONCE = 4096
#: rows of a task of a pass, at least where there are more tasks than can work at once
ROWS_PER_TASK = 4_000_000
#: rows whose features a pass holds at once: they stay in the processor's cache
ROWS_IN_CACHE = 512
#: bytes of rows that are kept as one value, and how many of these are joined at once
BLOCK_BYTES, BLOCKS_AT_ONCE = 2048, 256
#: a cosine in single precision of an angle reduced in double precision is less than this off, up to so many turns
SINGLE, MOST_TURNS = 1e-6, 1e6
#: cells of the histogram of margins
MARGIN_CELLS = 16_384
#: the quantile of the margins within a step may be this share of the rows off
RANK_ERROR = 1e-4


def fourier(x: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The random features of ``RandomFourierFeatures``, rows x components."""
    return math.sqrt(2.0 / len(offsets)) * np.cos(x @ weights.T + offsets)


class OneClassModel:
    def __init__(self, features, rff_stage, w, rho):
        self.feature_cols, self.rff, self.w, self.rho = features, rff_stage, w, rho

    def score(self, df: DataFrame) -> DataFrame:
        """A row with a missing feature has the score NaN."""
        W, b = (np.array(self.rff.getOrDefault(p)) for p in (self.rff.weights, self.rff.offsets))
        w, rho = np.array(self.w, float), float(self.rho)

        @F.pandas_udf("double")
        def margin(*cols: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(float, na_value=np.nan) for c in cols])
            parts = [fourier(x[i:i + ROWS_AT_ONCE], W, b) @ w for i in range(0, len(x), ROWS_AT_ONCE)]
            return pd.Series(rho - np.concatenate(parts) if parts else [], dtype=float)

        nan = F.lit(float("nan"))
        return df.withColumn("score", F.coalesce(margin(*[F.coalesce(F.col(c).cast("double"), nan) for c in self.feature_cols]), nan))

    def transform(self, df: DataFrame) -> DataFrame:
        return self.score(df).withColumn("prediction", (F.col("score") > 0).cast("double"))

    def save(self, path: str) -> str:
        self.rff.write().overwrite().save(f"{path}/rff")
        write_meta(path, {"features": self.feature_cols, "w": list(map(float, self.w)), "rho": self.rho})
        return path

    @classmethod
    def load(cls, spark, path: str) -> "OneClassModel":
        from quarry.models.supervised import RandomFourierFeatures

        m = read_meta(spark, path)
        return cls(m["features"], RandomFourierFeatures.load(f"{path}/rff"), m["w"], m["rho"])


@dataclass
class FourierRows:
    """The training rows, packed and written to the shared folder; every pass makes their random features anew, so no more than
    the rows themselves is kept. Cosines in single precision tell all margins up to ``slack``; exact features are made only for the
    rows that this leaves open and for those that are summed."""

    rows: DataFrame
    weights: np.ndarray
    offsets: np.ndarray

    @staticmethod
    def build(x: DataFrame, weights: np.ndarray, offsets: np.ndarray) -> FourierRows:
        """``x``: the features as doubles."""
        width = max(1, len(x.columns))
        many = max(1, BLOCK_BYTES // (8 * width))

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                a = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                yield pa.RecordBatch.from_pydict({"x": pa.array([a[i:i + many].tobytes() for i in range(0, len(a), many)], pa.binary())})

        return FourierRows(saved(x.mapInArrow(run, "x binary"), "rows"), weights, offsets)

    @property
    def components(self) -> int:
        return len(self.offsets)

    def slack(self, w: np.ndarray) -> float:
        return SINGLE * math.sqrt(2.0 / self.components) * float(np.abs(w).sum())

    def near(self, w: np.ndarray) -> Callable:
        """Function from rows to their margins, at most ``slack(w)`` off."""
        W, b, scale = self.weights, self.offsets, math.sqrt(2.0 / self.components)
        turns, start = W.T / (2 * math.pi), b / (2 * math.pi)

        def margins(x):
            t = x @ turns + start
            if not np.abs(t).max(initial=0.0) < MOST_TURNS:
                return fourier(x, W, b) @ w
            t -= np.rint(t)
            c = t.astype(np.float32)
            c *= np.float32(2 * math.pi)
            np.cos(c, out=c)
            t[:] = c
            return scale * (t @ w)

        return margins

    def map(self, run: Callable, schema: str) -> DataFrame:
        """``run`` gets the rows of a task, some at a time, and yields dicts of lists."""
        d = self.weights.shape[1]

        def task(batches):
            import pyarrow as pa

            def parts():
                for batch in batches:
                    for i in range(0, batch.num_rows, BLOCKS_AT_ONCE):
                        x = np.frombuffer(b"".join(v.as_buffer() for v in batch.column(0).slice(i, BLOCKS_AT_ONCE))).reshape(-1, d)
                        yield from (x[j:j + ROWS_IN_CACHE] for j in range(0, len(x), ROWS_IN_CACHE))

            for cols in run(parts()):
                yield pa.RecordBatch.from_pydict(cols)

        return self.rows.mapInArrow(task, schema)

    def sums(self, of: Callable, size: int) -> np.ndarray:
        """``of(rows)``, ``size`` numbers, added up: one row per task reaches the driver."""
        def run(parts):
            out = np.zeros(size)
            for x in parts:
                out += of(x)
            yield {"s": [out.tobytes()]}

        return np.sum([np.frombuffer(r["s"]) for r in self.map(run, "s binary").collect()], axis=0)

    def mean(self, w: np.ndarray | None = None, cut: float = 0.0) -> np.ndarray:
        """The mean of all feature vectors, or of those with a margin of at most ``cut``."""
        W, b = self.weights, self.offsets
        near, slack = (self.near(w), self.slack(w)) if w is not None else (None, 0.0)

        def of(x):
            if near is not None:
                x = x[near(x) <= cut + slack]
            z = fourier(x, W, b)
            if near is not None:
                z = z[z @ w <= cut]
            return np.append(z.sum(axis=0), len(z))

        s = self.sums(of, self.components + 1)
        return s[:-1] / s[-1]

    def cut(self, w: np.ndarray, rank: int, allowed: int) -> float:
        """A number with ``rank`` margins or at most ``allowed`` - 1 more at or below it (equal ones besides): histograms, each
        over the cell of the one before that holds the rank."""
        lo = -math.sqrt(2.0) * float(np.linalg.norm(w)) * (1 + 1e-9)  # no feature vector is longer than sqrt(2)
        hi, below = -lo, 0
        least = 1e-12 * (hi - lo)  # well above the rounding of a margin, so equal rows stay together
        W, b, near, slack = self.weights, self.offsets, self.near(w), self.slack(w)
        while True:
            def of(x, lo=lo, hi=hi):
                def cell(m):
                    return np.ceil((m - lo) * (MARGIN_CELLS / (hi - lo))) - 1

                m = near(x)
                may = np.flatnonzero((m > lo - slack) & (m <= hi + slack))
                first, last = cell(m[may] - slack), cell(m[may] + slack)
                sure = (first == last) & (first >= 0) & (last < MARGIN_CELLS)
                out = np.bincount(first[sure].astype(int), minlength=MARGIN_CELLS)
                m = fourier(x[may[~sure]], W, b) @ w
                m = m[(m > lo) & (m <= hi)]
                return out + np.bincount(np.clip(cell(m), 0, MARGIN_CELLS - 1).astype(int), minlength=MARGIN_CELLS)

            counts = self.sums(of, MARGIN_CELLS)
            at = int(np.searchsorted(below + counts.cumsum(), rank))
            if at == MARGIN_CELLS:  # the last margins are rounded across the upper end
                return hi
            step = (hi - lo) / MARGIN_CELLS
            below += int(counts[:at].sum())
            lo, hi = lo + at * step, lo + (at + 1) * step
            if counts[at] <= allowed or hi - lo <= least:
                return hi


def fit_one_class_svm(train: DataFrame, features: list[str], nu: float = 0.1, gamma="auto", n_components: int = 100,
                      steps: int = 500, tol: float = 0.03, seed: int = SEED, **_) -> OneClassModel:
    """min 1/2|w|^2 - rho + mean(max(0, rho - w.z))/nu over random features.

    For a given rho the optimum is a fixed point: w is the mean feature vector
    of the violating rows (those below rho), and rho the nu-quantile of w.z.
    Steps move w towards that mean by averaging (weights 2/(step + 2)) until
    it moves less than ``tol`` of the larger length of the two; then rho is the exact
    nu-quantile, so the share of flagged training rows is nu. A step is a
    histogram of the margins and a pass with sums, both inside the tasks: one row per task reaches the driver. No
    convergence within ``steps`` is an error."""
    from quarry.models.supervised import feature_variance, rff_stage

    d = len(features)
    if isinstance(gamma, str):
        g = 1.0 / d if gamma == "auto" else 1.0 / (d * (feature_variance(train, features) or 1.0))
    else:
        g = float(gamma)
    require_complete(train, features)
    stage = rff_stage(d, n_components, g, seed)
    x = train.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    n = x.count()
    parts = max(train.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_PER_TASK))  # a pass is short, so tasks are few
    W, b = (np.array(stage.getOrDefault(p)) for p in (stage.weights, stage.offsets))
    rows = FourierRows.build(x.repartition(parts), W, b)

    def margins(parts):
        for each in parts:
            yield {"m": fourier(each, W, b) @ w}

    rank, allowed = max(1, math.ceil(nu * n)), max(1, int(RANK_ERROR * n))
    w = rows.mean()
    for step in range(steps):
        target = rows.mean(w, rows.cut(w, rank, allowed))
        new = w + (target - w) * 2.0 / (step + 3.0)
        moved = float(np.linalg.norm(new - w)) / max(1e-12, float(np.linalg.norm(w)), float(np.linalg.norm(target)))
        w = new
        if moved < tol:
            break
    else:
        raise RuntimeError(f"the one-class objective has not settled after {steps} steps (last move {moved:.2g}, tolerance {tol:g})")
    rho = quantile(saved(rows.map(margins, "m double"), "margins"), "m", nu, exact=True)
    return OneClassModel(features, stage, w, float(rho))


# ----------------------------------------------------------------- dispatch
def fit_anomaly(name: str, train: DataFrame, features: list[str], params: dict, key: str | None = None):
    p = dict(params)
    c = float(p.pop("contamination", 0.1))
    if name == "isolation_forest":
        return fit_isolation_forest(train, features, key, int(p.get("n_estimators", 200)),
                                    int(p.get("max_samples", 256)), c)
    if name == "elliptic_envelope":
        return fit_elliptic_envelope(train, features, c, robust=bool(p.get("robust", True)))
    if name == "local_outlier_factor":
        return fit_lof(train, features, key, int(p.get("n_neighbors", 20)), c)
    if name == "one_class_svm":
        if p.get("kernel", "rbf") != "rbf":
            raise ValueError(f"kernel {p['kernel']!r} is not supported for one_class_svm; only rbf is")
        return fit_one_class_svm(train, features, float(p.get("nu", 0.1)), p.get("gamma", "auto"))
    raise ValueError(f"unknown anomaly model {name!r}")


def _active():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()
