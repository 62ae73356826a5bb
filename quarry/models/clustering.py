"""Clustering (§2.7) and the silhouette score (§2.9).

* kmeans           MLlib KMeans, best of ``n_init`` seeds by training cost
* gaussian_mixture MLlib GaussianMixture
* hierarchical     Ward, exact, in rounds (``models.hierarchical``)
* dbscan           epsilon-grid cells, neighbour-cell equi-joins, connected
                   components by star contraction until nothing changes
* meanshift        bin seeds, flat-kernel mean shift through cell joins
Every model exposes ``transform`` -> ``prediction`` (cluster id, -1 = noise)
and ``feature_cols``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.columns import complete, hash_unit, materialize
from quarry.functions.components import connected_components
from quarry.functions.stats import sq_dist_literal
from quarry.models.hierarchical import fit_hierarchical
from quarry.models.served import read_meta, write_meta
from quarry.operators import neighbours as N
from quarry.session import saved

SEED = 42


def nearest_center(cols: list[str], centers: np.ndarray) -> Column:
    """Index of the nearest centre (first on ties), JVM side."""
    dists = F.array(*[sq_dist_literal(cols, c) for c in centers])
    return (F.array_position(dists, F.array_min(dists)) - 1).cast("int")


class CentroidModel:
    def __init__(self, features, centers, labels=None, name="centroid"):
        self.feature_cols = features
        self.centers = np.asarray(centers, dtype=float)
        self.labels = labels
        self.name = name

    def transform(self, df: DataFrame) -> DataFrame:
        idx = nearest_center(self.feature_cols, self.centers)
        if self.labels is not None:
            lab = F.array(*[F.lit(int(v)) for v in self.labels])[idx]
            return df.withColumn("prediction", lab.cast("double"))
        return df.withColumn("prediction", idx.cast("double"))

    def save(self, path: str) -> str:
        write_meta(path, {"features": self.feature_cols, "centers": self.centers.tolist(),
                           "labels": None if self.labels is None else list(map(int, self.labels)), "name": self.name})
        return path

    @classmethod
    def load(cls, spark, path: str) -> "CentroidModel":
        m = read_meta(spark, path)
        return cls(m["features"], m["centers"], m["labels"], m["name"])


class MLlibClusterModel:
    def __init__(self, model, features, name):
        self.model, self.feature_cols, self.name = model, features, name

    def transform(self, df: DataFrame) -> DataFrame:
        """Every row comes back; a row with a null or NaN feature belongs to
        no cluster (null prediction)."""
        whole = complete(df, self.feature_cols)
        out = self.model.transform(df.where(whole))
        extra = [F.col("prediction").cast("double").alias("prediction")]
        rest = [F.lit(None).cast("double").alias("prediction")]
        if "probability" in out.columns:
            extra.append(vector_to_array("probability").alias("probability"))
            rest.append(F.lit(None).cast("array<double>").alias("probability"))
        return out.select(*df.columns, *extra).unionByName(df.where(~whole).select(*df.columns, *rest))

    def save(self, path: str) -> str:
        self.model.write().overwrite().save(f"{path}/model")
        write_meta(path, {"features": self.feature_cols, "name": self.name})
        return path

    @classmethod
    def load(cls, spark, path: str) -> "MLlibClusterModel":
        from pyspark.ml import PipelineModel

        m = read_meta(spark, path)
        return cls(PipelineModel.load(f"{path}/model"), m["features"], m["name"])


def _assembler(features):
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")


def fit_kmeans(train: DataFrame, features: list[str], n_clusters: int = 3, n_init: int = 10, max_iter: int = 300,
               seed: int = SEED, **_) -> MLlibClusterModel:
    best, cost = None, None
    for i in range(max(1, int(n_init))):
        m = Pipeline(stages=[_assembler(features), KMeans(k=int(n_clusters), maxIter=int(max_iter), seed=seed + i,
                                                          featuresCol="features")]).fit(train)
        c = m.stages[-1].summary.trainingCost
        if cost is None or c < cost:
            best, cost = m, c
    return MLlibClusterModel(best, features, "kmeans")


def fit_gmm(train: DataFrame, features: list[str], n_components: int = 3, seed: int = SEED, max_iter: int = 100,
            **_) -> MLlibClusterModel:
    m = Pipeline(stages=[_assembler(features), GaussianMixture(k=int(n_components), seed=seed, maxIter=int(max_iter),
                                                               featuresCol="features")]).fit(train)
    return MLlibClusterModel(m, features, "gaussian_mixture")


def kmeans_steps(df: DataFrame, features: list[str], init_centers: np.ndarray, steps: int) -> tuple[np.ndarray, DataFrame]:
    """Lloyd iterations from fixed centres: assign (nearest centre, JVM
    expression) then average per cluster — one aggregate per step."""
    centers = np.asarray(init_centers, dtype=float)
    for _ in range(steps):
        a = df.withColumn("__c", nearest_center(features, centers))
        rows = a.groupBy("__c").agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(features)]).collect()
        new = centers.copy()
        for r in rows:
            new[r["__c"]] = [r[f"m{i}"] for i in range(len(features))]
        centers = new
    return centers, df.withColumn("cluster", nearest_center(features, centers))


# ----------------------------------------------------------------- DBSCAN
def _cells(features: list[str], side: float, gd: int) -> list[Column]:
    return [F.floor(F.col(c).cast("double") / F.lit(side)).cast("bigint") for c in features[:gd]]


def _explode_ring(df: DataFrame, cell_cols: list[str], ring: int, out: str = "ncell") -> DataFrame:
    x = df
    for i, _ in enumerate(cell_cols):
        x = x.withColumn(f"__o{i}", F.explode(F.sequence(F.lit(-ring), F.lit(ring))))
    x = x.withColumn(out, F.array(*[F.col(c) + F.col(f"__o{i}") for i, c in enumerate(cell_cols)]))
    return x.drop(*[f"__o{i}" for i in range(len(cell_cols))])


def _sqdist(a: str, b: str, d: int) -> Column:
    e = None
    for i in range(d):
        t = (F.col(f"{a}{i}") - F.col(f"{b}{i}")) * (F.col(f"{a}{i}") - F.col(f"{b}{i}"))
        e = t if e is None else e + t
    return e


def components_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label) for every node: the smallest id of its component (its own
    id without edges). Contraction runs until nothing changes."""
    comp = connected_components(edges, "src", "dst")
    return nodes.join(comp.withColumnRenamed("node", "id"), "id", "left").select(
        "id", F.coalesce("component", "id").alias("label"))


class DBSCANModel:
    def __init__(self, features, key, core: DataFrame, eps: float, side: float, gd: int):
        self.feature_cols, self.key, self.core, self.eps, self.side, self.gd = features, key, core, eps, side, gd

    def transform(self, df: DataFrame) -> DataFrame:
        """New rows take the label of the nearest core point within eps
        (quirk Q16), else -1."""
        d = len(self.feature_cols)
        q = df.select(self.key, *[F.col(c).cast("double").alias(f"q{i}") for i, c in enumerate(self.feature_cols)],
                      F.array(*_cells(self.feature_cols, self.side, self.gd)).alias("qcell"))
        best = self._by_points(q) if self.gd < d else self._by_boxes(q)
        return df.join(best, self.key, "left").withColumn(
            "prediction", F.coalesce(F.col("__l"), F.lit(-1)).cast("double")).drop("__l")

    def _by_points(self, q: DataFrame) -> DataFrame:
        """(key, label) of the nearest core point within eps, from all points of the cells around."""
        d = len(self.feature_cols)
        ring = int(math.ceil(self.eps / self.side))
        q = q.select(self.key, *[f"q{i}" for i in range(d)], *[F.col("qcell")[i].alias(f"qc{i}") for i in range(self.gd)])
        q = _explode_ring(q, [f"qc{i}" for i in range(self.gd)], ring)
        pairs = q.join(self.core.withColumnRenamed("cell", "ncell"), "ncell").where(
            _sqdist("q", "p", d) <= F.lit(self.eps ** 2))
        return pairs.groupBy(self.key).agg(F.min_by("label", F.struct(_sqdist("q", "p", d), F.col("label"))).alias("__l"))

    def _by_boxes(self, q: DataFrame) -> DataFrame:
        """As ``_by_points``, where a cell has few labels (a dense cell has one, another less than min_samples points). A
        row meets the bounding boxes of the labels around its cell, not their points: with one label in reach
        and a box that is within eps as a whole, that is the label. Points are compared for the other rows only."""
        d = len(self.feature_cols)
        ring = int(math.ceil(self.eps / self.side))
        q = q.where(F.col(self.key).isNotNull())
        boxes = self.core.groupBy(F.col("cell").alias("ncell"), "label").agg(
            *[f.alias(f"{n}{i}") for i in range(d) for n, f in (("lo", F.min(f"p{i}")), ("hi", F.max(f"p{i}")))])
        cells = q.select("qcell").distinct()
        cells = _explode_ring(cells.select("qcell", *[F.col("qcell")[i].alias(f"c{i}") for i in range(self.gd)]), [f"c{i}" for i in range(self.gd)], ring)
        box = F.struct("label", *[f"{n}{i}" for i in range(d) for n in ("lo", "hi")])
        around = cells.join(boxes, "ncell").groupBy("qcell").agg(F.collect_list(box).alias("around"))
        eps2 = F.lit(self.eps ** 2)

        def least(b: Column) -> Column:
            gaps = [F.greatest(F.lit(0.0), b[f"lo{i}"] - F.col(f"q{i}"), F.col(f"q{i}") - b[f"hi{i}"]) for i in range(d)]
            return sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])

        def most(b: Column) -> Column:
            ends = [F.greatest(F.abs(F.col(f"q{i}") - b[f"lo{i}"]), F.abs(b[f"hi{i}"] - F.col(f"q{i}"))) for i in range(d)]
            return sum((g * g for g in ends[1:]), ends[0] * ends[0])

        met = q.join(around, "qcell").withColumn("near", F.filter("around", lambda b: least(b) <= eps2)).where(F.size("near") > 0)
        met = met.withColumn("labels", F.array_distinct(F.transform("near", lambda b: b["label"])))
        met = met.withColumn("sure", (F.size("labels") == 1) & F.exists("near", lambda b: most(b) <= eps2))
        met = saved(met.select(self.key, *[f"q{i}" for i in range(d)], "qcell", F.col("labels")[0].alias("label"), "sure"), "met")
        # a key that comes more than once takes the label of its nearest row
        unsure = met.where(~F.col("sure")).select(self.key).distinct()
        several = met.groupBy(self.key).agg(F.countDistinct("label").alias("n"), F.count(F.lit(1)).alias("rows")).where("rows > 1 and n > 1").select(self.key)
        open_keys = saved(unsure.unionByName(several).distinct(), "open-keys")
        known = met.join(open_keys, self.key, "left_anti").groupBy(self.key).agg(F.min("label").alias("__l"))
        rest = met.join(open_keys, self.key, "left_semi").select(self.key, *[f"q{i}" for i in range(d)], "qcell")
        return known.unionByName(self._by_points(rest))

    def save(self, path: str) -> str:
        self.core.write.mode("overwrite").parquet(f"{path}/core")
        write_meta(path, {"features": self.feature_cols, "key": self.key, "eps": self.eps, "side": self.side,
                           "gd": self.gd})
        return path

    @classmethod
    def load(cls, spark, path: str) -> "DBSCANModel":
        m = read_meta(spark, path)
        return cls(m["features"], m["key"], spark.read.parquet(f"{path}/core"), m["eps"], m["side"], m["gd"])


def _dense_links(dense_pts: DataFrame, d: int, gd: int, side: float, ring: int, eps: float, m: int = 4) -> DataFrame:
    """Links (src, dst) between adjacent dense cells (all their points are
    core). Each dense cell is cut into m^g sub-cells with the bounding box of
    their points; for every pair of sub-boxes across neighbouring cells,
    max box distance <= eps links the cells without looking at points, min
    box distance > eps rules the pair out, and only the remaining pairs of
    cells that are not yet linked compare the points of those sub-boxes.
    Box pairs per cell are bounded by (m^g)^2 (2 ring + 1)^g, whatever the
    number of points in the cell."""
    sub = side / m
    pcols = [f"p{i}" for i in range(d)]
    x = dense_pts.select(F.col("cell_min").alias("node"), "cell", *pcols,
                         F.array(*[F.floor(F.col(f"p{i}") / F.lit(sub)).cast("bigint") for i in range(gd)]).alias("sub"))
    x = x.transform(materialize)
    boxes = x.groupBy("node", "cell", "sub").agg(*[F.min(f"p{i}").alias(f"lo{i}") for i in range(d)],
                                                *[F.max(f"p{i}").alias(f"hi{i}") for i in range(d)])
    q = boxes.select(F.col("node").alias("qnode"), F.col("sub").alias("qsub"),
                     *[F.col(f"lo{i}").alias(f"qlo{i}") for i in range(d)], *[F.col(f"hi{i}").alias(f"qhi{i}") for i in range(d)],
                     *[F.col("cell")[i].alias(f"qc{i}") for i in range(gd)])
    q = _explode_ring(q, [f"qc{i}" for i in range(gd)], ring)
    n = boxes.select(F.col("node").alias("nnode"), F.col("sub").alias("nsub"), F.col("cell").alias("ncell"),
                     *[F.col(f"lo{i}").alias(f"nlo{i}") for i in range(d)], *[F.col(f"hi{i}").alias(f"nhi{i}") for i in range(d)])
    pairs = q.join(n, "ncell").where(F.col("qnode") < F.col("nnode"))
    mind = sum(F.pow(F.greatest(F.lit(0.0), F.col(f"qlo{i}") - F.col(f"nhi{i}"), F.col(f"nlo{i}") - F.col(f"qhi{i}")), 2)
               for i in range(d))
    maxd = sum(F.pow(F.greatest(F.abs(F.col(f"qhi{i}") - F.col(f"nlo{i}")), F.abs(F.col(f"nhi{i}") - F.col(f"qlo{i}"))), 2)
               for i in range(d))
    e2 = F.lit(eps * eps)
    pairs = pairs.select("qnode", "qsub", "nnode", "nsub", (maxd <= e2).alias("sure"), (mind <= e2).alias("maybe"))
    pairs = pairs.where("maybe").transform(materialize)
    sure = pairs.where("sure").select(F.col("qnode").alias("src"), F.col("nnode").alias("dst")).distinct()
    check = pairs.where(~F.col("sure")).join(sure.select(F.col("src").alias("qnode"), F.col("dst").alias("nnode")),
                                             ["qnode", "nnode"], "left_anti")
    xq = x.select(F.col("node").alias("qnode"), F.col("sub").alias("qsub"), *[F.col(f"p{i}").alias(f"q{i}") for i in range(d)])
    xn = x.select(F.col("node").alias("nnode"), F.col("sub").alias("nsub"), *[F.col(f"p{i}").alias(f"n{i}") for i in range(d)])
    found = check.select("qnode", "qsub", "nnode", "nsub").join(xq, ["qnode", "qsub"]).join(xn, ["nnode", "nsub"]) \
        .where(_sqdist("q", "n", d) <= e2).select(F.col("qnode").alias("src"), F.col("nnode").alias("dst")).distinct()
    return sure.unionByName(found).distinct()


def dbscan(df: DataFrame, key: str, features: list[str], eps: float = 0.5, min_samples: int = 5,
           grid_dims: int = 3) -> tuple[DataFrame, DataFrame]:
    """Exact DBSCAN labels for every row; returns (labels(key, cluster,
    is_core), core points table used for scoring new rows).

    Cells of side eps/sqrt(d) (when every feature is a grid axis) have a
    diagonal of eps, so a cell holding >= min_samples points is entirely core
    and internally connected: its points are never paired with each other.
    Only points of sparse cells are paired with the points of the cells
    around them (ring ceil(eps/side)); links between two dense cells are
    found by one pass over their pairs. Beyond ``grid_dims`` features the
    neighbours come from a pivot partitioned join."""
    d = len(features)
    if d > grid_dims:
        return _pivot_dbscan(df, key, features, eps, min_samples, grid_dims)
    gd = min(grid_dims, d)
    side = eps / math.sqrt(d) if gd == d else eps
    ring = int(math.ceil(eps / side))
    pts = df.select(F.col(key).alias("id"), *[F.col(c).cast("double").alias(f"p{i}") for i, c in enumerate(features)],
                    *[c.alias(f"c{i}") for i, c in enumerate(_cells(features, side, gd))])
    pts = pts.withColumn("cell", F.array(*[F.col(f"c{i}") for i in range(gd)]))
    cnt = pts.groupBy("cell").agg(F.count(F.lit(1)).alias("cell_n"), F.min("id").alias("cell_min"))
    dense_ok = gd == d
    pts = pts.join(cnt, "cell").withColumn("dense", F.lit(dense_ok) & (F.col("cell_n") >= min_samples)).transform(materialize)
    qcols = [f"c{i}" for i in range(gd)]
    eps2 = F.lit(eps * eps)
    # neighbour counts (self included) for points of sparse cells
    sparse_q = pts.where(~F.col("dense")).select(F.col("id").alias("qid"), *[F.col(f"p{i}").alias(f"q{i}") for i in range(d)], *qcols)
    sparse_q = _explode_ring(sparse_q, qcols, ring)
    cand = pts.select(F.col("id").alias("nid"), *[F.col(f"p{i}").alias(f"n{i}") for i in range(d)],
                      F.col("cell").alias("ncell"), F.col("dense").alias("ndense"))
    near = sparse_q.join(cand, "ncell").where(_sqdist("q", "n", d) <= eps2).select("qid", "nid", "ndense").transform(materialize)
    ncount = near.groupBy("qid").agg(F.count(F.lit(1)).alias("nn"))
    core_flag = pts.select("id", "dense", "cell", "cell_min").join(ncount.withColumnRenamed("qid", "id"), "id", "left") \
        .withColumn("is_core", F.col("dense") | (F.coalesce(F.col("nn"), F.lit(0)) >= min_samples))
    # graph nodes: a dense cell is one node (its min id); a sparse core point is its own node
    node_of = core_flag.where("is_core").select("id", F.when(F.col("dense"), F.col("cell_min")).otherwise(F.col("id")).alias("node"))
    # edges among core points: sparse core queries vs any core neighbour
    core_ids = node_of.select(F.col("id").alias("nid"), F.col("node").alias("nnode"))
    e1 = near.join(core_ids, "nid").join(node_of.select(F.col("id").alias("qid"), F.col("node").alias("qnode")), "qid") \
        .select(F.col("qnode").alias("src"), F.col("nnode").alias("dst")).where(F.col("src") != F.col("dst"))
    # dense cell to dense cell: decided on sub-cell bounding boxes first
    e2 = _dense_links(pts.where("dense"), d, gd, side, ring, eps)
    nodes = node_of.select(F.col("node").alias("id")).distinct()
    comp = components_of(nodes, e1.unionByName(e2))
    # cluster id = smallest core-point id of the component (node ids are min ids)
    core_lab = node_of.join(comp.select(F.col("id").alias("node"), F.col("label")), "node").select("id", "label")
    # border points: smallest label among core neighbours
    border = near.join(core_lab.select(F.col("id").alias("nid"), "label"), "nid").groupBy("qid").agg(
        F.min("label").alias("blabel"))
    labels = core_flag.select("id", "is_core").join(core_lab, "id", "left").join(
        border.withColumnRenamed("qid", "id"), "id", "left").select(
        F.col("id").alias(key), F.coalesce(F.col("label"), F.when(~F.col("is_core"), F.col("blabel")), F.lit(-1)).alias("cluster"),
        "is_core")
    core_tbl = pts.join(core_lab, "id").select(*[F.col(f"p{i}") for i in range(d)], "cell", "label")
    return labels, core_tbl


def _pivot_dbscan(df: DataFrame, key: str, features: list[str], eps: float, min_samples: int, gd: int) -> tuple[DataFrame, DataFrame]:
    """DBSCAN in any number of dimensions. Blocks of points that can be
    neighbours meet in a task; counts, links that connect what is linked there, and the smallest label
    a border point sees leave it, never pairs. Rows at one place are one point with a size."""
    d = len(features)
    rows = saved(N.packed(df, key, features), "points")
    index = N.Index.build(saved(N.distinct_points(rows), "places"), d)
    kind = index.id_type
    places = index.rows.select("id", "x", "w", "cell")

    def counts(members, queries, near):
        yield {"id": queries[0].tolist(), "n": (near * members[2]).sum(axis=1).tolist()}

    n = N.within(index, places, places, eps, counts, f"id {kind}, n double").groupBy("id").agg(F.sum("n").alias("n"))
    flagged = saved(places.join(n, "id").withColumn("is_core", F.col("n") >= min_samples), "flagged")
    core, other = (flagged.filter(c).select("id", "x", "w", "cell") for c in ("is_core", "not is_core"))

    def links(members, queries, near):
        first: dict = {}

        def root(i):
            while first.setdefault(i, i) != i:
                first[i] = first[first[i]]
                i = first[i]
            return i

        out = []
        for q, row in zip(queries[0], near):
            for m in members[0][row]:
                a, b = root(q), root(m)
                if a != b:
                    first[max(a, b)] = min(a, b)
                    out.append((q, m))
        yield {"src": [a for a, _ in out], "dst": [b for _, b in out]}

    edges = saved(N.within(index, core, core, eps, links, f"src {kind}, dst {kind}"), "links")
    labels = saved(components_of(core.select("id"), edges), "labels")

    def seen(members, queries, near):
        hit = near.any(axis=1)
        yield {"id": queries[0][hit].tolist(), "label": [min(v for v, ok in zip(members[3], row) if ok) for row in near[hit]]}

    # labels travel as the position of their id, a double would not hold every key
    order = saved(labels.select("label").distinct().withColumn("v", F.row_number().over(Window.orderBy("label")).cast("double")), "label-order")
    marked = core.join(labels.join(order, "label").select("id", "v"), "id")
    border = N.within(index, marked, other.withColumn("v", F.lit(0.0)), eps, seen, f"id {kind}, label double").groupBy("id").agg(F.min("label").alias("v"))
    border = border.join(order, "v").select("id", "label")
    found = saved(flagged.select("id", "x", "is_core").join(labels.unionByName(border), "id", "left").select("x", "is_core", "label"), "places")
    out = saved(rows.join(found, "x").select(F.col("id").alias(key), F.coalesce("label", F.lit(-1)).alias("cluster"), "is_core"), "dbscan")
    side = eps
    cells = F.array(*[c for c in _cells(features, side, gd)])
    pts = df.select(F.col(key).alias("id"), *[F.col(c).cast("double").alias(f"p{i}") for i, c in enumerate(features)], cells.alias("cell"))
    core_rows = out.filter("is_core").select(F.col(key).alias("id"), F.col("cluster").alias("label"))
    return out, pts.join(core_rows, "id").select(*[f"p{i}" for i in range(d)], "cell", "label")


def fit_dbscan(train: DataFrame, features: list[str], key: str, eps: float = 0.5, min_samples: int = 5, **_):
    labels, core = dbscan(train, key, features, float(eps), int(min_samples))
    d = len(features)
    gd = min(3, d)
    side = float(eps) / math.sqrt(d) if gd == d else float(eps)
    m = DBSCANModel(features, key, core.transform(materialize), float(eps), side, gd)
    m.train_labels = labels
    return m


# ----------------------------------------------------------------- mean shift
def estimate_bandwidth(df: DataFrame, key: str, features: list[str], quantile: float = 0.3, n_samples: int = 500,
                       seed: int = SEED) -> float:
    """Mean distance to the (quantile * m)-th neighbour over a hash sample of
    at most ``n_samples`` rows (a bounded group)."""
    n = df.count()
    frac = min(1.0, 2.0 * n_samples / max(n, 1))
    s = df.select(*features, hash_unit(seed, key).alias("u")).where(F.col("u") < F.lit(frac)).orderBy("u").limit(n_samples)
    X = np.array(s.select(*features).collect(), dtype=float)
    if len(X) < 2:
        return 1.0
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    k = max(1, int(len(X) * quantile))
    kth = np.sort(D, axis=1)[:, min(k, len(X) - 1)]
    return float(kth.mean()) or 1.0


def fit_meanshift(train: DataFrame, features: list[str], key: str, bandwidth: float | None = None,
                  max_iter: int = 300, **_) -> CentroidModel:
    """Flat-kernel mean shift from bin seeds; every iteration is one join of
    the seeds (exploded to neighbour cells) with the points in those cells
    and one aggregate; converged modes are merged on the (small) mode table
    by support, strongest first."""
    bw = float(bandwidth) if bandwidth else estimate_bandwidth(train, key, features)
    d = len(features)
    gd = min(3, d)
    pts = train.select(*[F.col(c).cast("double").alias(f"p{i}") for i, c in enumerate(features)])
    pts = pts.withColumn("cell", F.array(*[F.floor(F.col(f"p{i}") / F.lit(bw)).cast("bigint") for i in range(gd)])).transform(materialize)
    seeds = pts.select(*[(F.round(F.col(f"p{i}") / F.lit(bw)) * F.lit(bw)).alias(f"s{i}") for i in range(d)]).distinct()
    seeds = seeds.withColumn("sid", F.monotonically_increasing_id()).transform(materialize)
    bw2 = F.lit(bw * bw)
    for _ in range(max_iter):
        sc = seeds.withColumn("__c", F.array(*[F.floor(F.col(f"s{i}") / F.lit(bw)).cast("bigint") for i in range(gd)]))
        sc = sc.select("sid", *[f"s{i}" for i in range(d)], *[F.col("__c")[i].alias(f"sc{i}") for i in range(gd)])
        sc = _explode_ring(sc, [f"sc{i}" for i in range(gd)], 1, "cell")
        j = sc.join(pts, "cell").where(_sqdist("s", "p", d) <= bw2)
        new = j.groupBy("sid").agg(*[F.avg(f"p{i}").alias(f"s{i}") for i in range(d)], F.count(F.lit(1)).alias("support"))
        shift = new.join(seeds.select("sid", *[F.col(f"s{i}").alias(f"o{i}") for i in range(d)]), "sid") \
            .agg(F.max(_sqdist("s", "o", d)).alias("m")).first()["m"]
        seeds = new.transform(materialize)
        if shift is None or math.sqrt(shift) < 1e-3 * bw:
            break
    else:
        raise RuntimeError(f"mean shift has not settled after {max_iter} iterations")
    # converged seeds sit on a few modes: collapse them on a fine grid
    # (bw / 1000) before anything reaches the driver
    snap = [F.round(F.col(f"s{i}") / F.lit(bw / 1000.0)) for i in range(d)]
    modes_df = seeds.groupBy(*[c.alias(f"g{i}") for i, c in enumerate(snap)]).agg(
        F.max("support").alias("support"), F.min("sid").alias("sid"), *[F.avg(f"s{i}").alias(f"s{i}") for i in range(d)])
    modes = np.array(modes_df.orderBy(F.col("support").desc(), "sid").select(*[f"s{i}" for i in range(d)]).collect(),
                     dtype=float)
    kept: list[np.ndarray] = []
    for m in modes:
        if all(np.linalg.norm(m - k) >= bw for k in kept):
            kept.append(m)
    return CentroidModel(features, np.array(kept), None, "meanshift")


# ----------------------------------------------------------------- silhouette
def silhouette_score(scored: DataFrame, features: list[str], label: str = "prediction",
                     group_cols: list[str] = ()) -> DataFrame:
    """Mean silhouette (squared Euclidean, as MLlib's evaluator) per group
    from per-cluster sums: the mean distance of x to cluster C is
    (n_C |x|^2 - 2 x.S_C + Q_C) / n_C (n_C - 1 for x's own cluster).
    Cluster sums (groups x clusters rows) are attached to each row as one
    array per group, so there is no point-to-point pairing."""
    g = list(group_cols) or ["__all"]
    if "__all" in g:
        scored = scored.withColumn("__all", F.lit(0))
    x = F.array(*[F.col(c).cast("double") for c in features])
    base = scored.select(*g, F.col(label).alias("__k"), x.alias("__x"))
    base = base.withColumn("__xx", F.aggregate("__x", F.lit(0.0), lambda a, v: a + v * v))
    d = len(features)
    stats = base.groupBy(*g, "__k").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(F.col("__x")[i]) for i in range(d)]).alias("S"),
        F.sum("__xx").alias("Q"),
    )
    packed = stats.groupBy(*g).agg(F.collect_list(F.struct("__k", "n", "S", "Q")).alias("__cl"))
    j = base.join(packed, g)

    def mean_d(c):
        dot = F.aggregate(F.zip_with(F.col("__x"), c["S"], lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        return c["n"] * F.col("__xx") - 2 * dot + c["Q"]

    own = F.filter("__cl", lambda c: c["__k"] == F.col("__k"))[0]
    a = F.try_divide(mean_d(own), (own["n"] - 1).cast("double"))
    others = F.transform(F.filter("__cl", lambda c: c["__k"] != F.col("__k")), lambda c: mean_d(c) / c["n"])
    b = F.array_min(others)
    s = F.when((own["n"] <= 1) | b.isNull(), F.lit(0.0)).otherwise((b - a) / F.greatest(a, b))
    out = j.withColumn("__s", s).groupBy(*g).agg(F.avg("__s").alias("silhouette_score"))
    return out.drop("__all")


# ----------------------------------------------------------------- dispatch
def fit_clustering(name: str, train: DataFrame, features: list[str], params: dict, key: str | None = None,
                   n_clusters: int = 3):
    p = dict(params)
    if name == "kmeans":
        return fit_kmeans(train, features, int(p.get("n_clusters", n_clusters)), int(p.get("n_init", 10)),
                          int(p.get("max_iter", 300)))
    if name == "gaussian_mixture":
        if (kind := p.get("covariance_type", "full")) != "full":
            raise ValueError(f"covariance_type {kind!r} is not supported; mixtures have full covariances")
        return fit_gmm(train, features, int(p.get("n_components", n_clusters)))
    if name == "hierarchical":
        return fit_hierarchical(train, features, int(p.get("n_clusters", n_clusters)), p.get("linkage", "ward"))
    if name == "dbscan":
        return fit_dbscan(train, features, key, float(p.get("eps", 0.5)), int(p.get("min_samples", 5)))
    if name == "meanshift":
        return fit_meanshift(train, features, key, p.get("bandwidth"), int(p.get("max_iter", 300)))
    raise ValueError(f"unknown clustering model {name!r}")

