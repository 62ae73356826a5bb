"""Ward clustering (§2.7 hierarchical) by reciprocal nearest neighbours.

Every round finds each cluster's cheapest partner (``operators.neighbours``, exact) and merges the
pairs that choose each other. Ward's cost never makes a merged cluster cheaper for a
third one than both parts were, so these merges are those of the full hierarchy whatever the
order, and heights rise along it: the k clusters are what remains when the
k - 1 highest merges are undone. Rows at one place are one point with a size from the start. At most
``LOCAL_CLUSTERS`` remaining clusters finish in one task by the same rule.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.components import connected_components
from quarry.functions.stats import sq_dist_literal
from quarry.models.served import read_meta, write_meta
from quarry.operators.neighbours import distinct_points, matrix, merge_cost, nearest, packed
from quarry.session import saved

LOCAL_CLUSTERS = 2048
MERGE = "a long, b long, height double"


def merge_all(ids: np.ndarray, x: np.ndarray, w: np.ndarray) -> list[tuple[int, int, float]]:
    """(a, b, height) of all merges, a the smaller id, which the merged cluster keeps."""
    order = np.argsort(ids)
    ids, x, w = ids[order].copy(), x[order].copy(), w[order].copy()
    out = []
    with np.errstate(invalid="ignore"):
        cost = merge_cost(w[:, None], w[None], np.sqrt(((x[:, None, :] - x[None]) ** 2).sum(axis=-1)))
    np.fill_diagonal(cost, np.inf)
    alive = np.ones(len(ids), bool)
    left = len(ids)
    while left > 1:
        partner = cost.argmin(axis=1)
        mutual = np.flatnonzero(alive & (partner[partner] == np.arange(len(ids))) & (np.arange(len(ids)) < partner))
        for i in mutual:
            j = partner[i]
            out.append((int(ids[i]), int(ids[j]), float(cost[i, j])))
            x[i] = (x[i] * w[i] + x[j] * w[j]) / (w[i] + w[j])
            w[i] += w[j]
            alive[j] = False
            cost[j, :] = cost[:, j] = np.inf
        for i in mutual:
            c = merge_cost(w[i], w, np.sqrt(((x - x[i]) ** 2).sum(axis=1)))
            c[~alive] = np.inf
            c[i] = np.inf
            cost[i, :] = cost[:, i] = c
        left -= len(mutual)
    return out


def merges_of(points: DataFrame, d: int, local: int = LOCAL_CLUSTERS) -> DataFrame:
    """``a, b, height`` of the whole hierarchy over ``points`` (id, x, w; x distinct)."""
    clusters, found = saved(points, "clusters"), None
    while clusters.count() > local:
        best = saved(nearest(clusters, d, 1, ward=True), "partners")
        back = best.select(F.col("id").alias("nid"), F.col("nid").alias("id"))
        pairs = saved(best.join(back, ["id", "nid"]).filter("id < nid").select(F.col("id").alias("a"), F.col("nid").alias("b"), F.col("cost").alias("height")), "merges")
        found = pairs if found is None else found.unionByName(pairs)
        inside = clusters.join(pairs.select(F.col("a").alias("id"), "b"), "id").join(
            clusters.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("w").alias("bw")), "b")

        @F.pandas_udf("binary")
        def centre(x: pd.Series, bx: pd.Series, w: pd.Series, bw: pd.Series) -> pd.Series:
            a, b, wa, wb = matrix(list(x), d), matrix(list(bx), d), w.to_numpy()[:, None], bw.to_numpy()[:, None]
            return pd.Series([r.tobytes() for r in (a * wa + b * wb) / (wa + wb)])

        merged = inside.select("id", centre("x", "bx", "w", "bw").alias("x"), (F.col("w") + F.col("bw")).alias("w"))
        ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
        clusters = saved(clusters.join(ends, "id", "left_anti").select("id", "x", "w").unionByName(merged), "clusters")

    def finish(batches):
        parts = [p for p in batches if len(p)]
        if parts:
            p = pd.concat(parts)
            yield pd.DataFrame(merge_all(p["id"].to_numpy(np.int64), matrix(list(p["x"]), d), p["w"].to_numpy(float)), columns=["a", "b", "height"])

    last = saved(clusters.coalesce(1).mapInPandas(finish, MERGE), "last-merges")  # at most LOCAL_CLUSTERS rows
    return last if found is None else last.unionByName(found)


def ward_labels(df: DataFrame, key: str, features: list[str], k: int, local: int = LOCAL_CLUSTERS) -> DataFrame:
    """``id, x, label`` for every place of ``df``: the smallest key of its cluster. Keys are whole numbers."""
    points = saved(distinct_points(packed(df, key, features)), "points")
    merges = merges_of(points, len(features), local)
    highest = merges.orderBy(F.col("height").desc(), F.col("a").desc(), F.col("b").desc()).limit(max(k - 1, 0))
    keep = merges.join(F.broadcast(highest.select("a", "b")), ["a", "b"], "left_anti")  # k - 1 rows
    parts = connected_components(keep.select("a", "b")).withColumnRenamed("node", "id")
    return saved(points.join(parts, "id", "left").select("id", "x", "w", F.coalesce("component", "id").alias("label")), "ward")


class HierarchicalModel:
    """Rows at a place of the training data have its cluster; another row has the one that it
    could join at the least Ward cost."""

    def __init__(self, features: list[str], places: DataFrame, centers: np.ndarray, sizes: np.ndarray):
        self.feature_cols, self.places = list(features), places
        self.centers, self.sizes = np.asarray(centers, float), np.asarray(sizes, float)

    def transform(self, df: DataFrame) -> DataFrame:
        costs = F.array(*[sq_dist_literal(self.feature_cols, c) * F.lit(float(n / (n + 1))) for c, n in zip(self.centers, self.sizes)])
        near = (F.array_position(costs, F.array_min(costs)) - 1).cast("double")
        # a key that neither side has as a column
        names = {c.lower() for c in df.columns}
        place = next(n for n in (f"place{'_' * i}" for i in range(len(names) + 1)) if n not in names)
        cells = F.array(*[F.col(f"`{c}`").cast("double") + F.lit(0.0) for c in self.feature_cols])
        known = self.places.select(F.col("place").alias(place), F.col("cluster").alias(f"{place}c"))
        out = df.withColumn(place, cells).join(known, place, "left")
        whole = F.lit(True)
        for c in self.feature_cols:
            whole = whole & F.col(f"`{c}`").isNotNull()
        label = F.coalesce(F.col(f"{place}c"), F.when(whole, near))
        return out.select(*[F.col(f"`{c}`") for c in df.columns], label.alias("prediction"))

    def save(self, path: str) -> str:
        self.places.write.mode("overwrite").parquet(f"{path}/places")
        write_meta(path, {"features": self.feature_cols, "centers": self.centers.tolist(), "sizes": self.sizes.tolist()})
        return path

    @classmethod
    def load(cls, spark, path: str) -> HierarchicalModel:
        m = read_meta(spark, path)
        return cls(m["features"], spark.read.parquet(f"{path}/places"), m["centers"], m["sizes"])


def fit_hierarchical(train: DataFrame, features: list[str], n_clusters: int = 3, linkage: str = "ward", local: int = LOCAL_CLUSTERS) -> HierarchicalModel:
    if linkage != "ward":
        raise ValueError(f"linkage {linkage!r} is not supported; only ward merges are reciprocal here")
    row = "row"
    while row in features:
        row += "_"
    rows = saved(train.select(*features).withColumn(row, F.monotonically_increasing_id()), "rows")
    labels = ward_labels(rows, row, features, int(n_clusters), local)
    d = len(features)

    @F.pandas_udf("array<double>")
    def opened(x: pd.Series) -> pd.Series:
        return pd.Series(list(matrix(list(x), d)) if len(x) else [], dtype=object)

    places = saved(labels.select(opened("x").alias("place"), "w", "label"), "places")
    means = [(F.sum(F.col("place")[i] * F.col("w")) / F.sum("w")).alias(f"m{i}") for i in range(d)]
    stats = places.groupBy("label").agg(F.sum("w").alias("size"), *means).orderBy("label").collect()  # k rows
    number = F.array_position(F.array(*[F.lit(r["label"]) for r in stats]), F.col("label")) - 1
    return HierarchicalModel(features, saved(places.select("place", number.cast("double").alias("cluster")), "places"),
                             np.array([[r[f"m{i}"] for i in range(d)] for r in stats]), np.array([r["size"] for r in stats]))
