"""Exact neighbours in any number of dimensions: a pivot (Voronoi) partitioned join.

About sqrt(n) pivots, at most ``MOST_PIVOTS``, are chosen by hash; every point belongs to the cell of
its nearest pivot. A cell is described by its radius, so the triangle
inequality says which cells can hold a neighbour of a point, and a point meets only
these: |q - p| - radius, and half the difference of the squared distances to two pivots over the
pivots' distance, are lower bounds. Cells are cut into blocks of ``BLOCK`` points, and the queries
of a cell into portions, so that a task holds one block and one portion however full a cell is.

``nearest``     the k nearest others, by distance or by Ward's cost of merging
``within``      a function of every point's neighbours within a radius, block by block
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.session import saved

MOST_PIVOTS = 2048
BLOCK = 2048
ROWS_AT_ONCE = 256
SLACK = 1e-9


def _arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` over column lists; the function yields dicts of lists."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    st = StructType.fromDDL(schema)
    names = st.fieldNames()

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(st)

        def lists():
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    yield [c.to_pylist() for c in batch.slice(at, 4096).columns]

        for cols in function(lists()):
            yield pa.RecordBatch.from_arrays([pa.array(cols[n], arrow.field(n).type) for n in names], schema=arrow)

    return df.mapInArrow(run, schema)


def matrix(xs: list[bytes], d: int) -> np.ndarray:
    return np.frombuffer(b"".join(xs)).reshape(len(xs), d)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, from differences (no cancellation)."""
    out = np.empty((len(a), len(b)))
    for i in range(0, len(a), ROWS_AT_ONCE):
        out[i:i + ROWS_AT_ONCE] = np.sqrt(((a[i:i + ROWS_AT_ONCE, None, :] - b[None]) ** 2).sum(axis=-1))
    return out


def packed(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """``id, x``: the features as packed doubles (-0.0 as 0.0)."""
    cols = [F.col(f"`{c}`").cast("double") + F.lit(0.0) for c in features]

    def run(lists):
        for ids, xs in lists:
            yield {"id": ids, "x": [np.array(x, float).tobytes() for x in xs]}

    return _arrow(df.select(F.col(f"`{key}`").alias("id"), F.array(*cols).alias("x")), run, f"id {dict(df.dtypes)[key]}, x binary")


def distinct_points(points: DataFrame) -> DataFrame:
    """``id, x, w``: one row per place, with its smallest id and how many rows it stands for."""
    return points.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).cast("double").alias("w")).select("id", "x", "w")


@dataclass
class Index:
    """Points (id, x, w, cell) and what is known of the cells."""

    rows: DataFrame
    d: int
    pivots: np.ndarray
    count: np.ndarray
    radius: np.ndarray
    least: np.ndarray  # smallest and largest weight in a cell
    most: np.ndarray
    id_type: str

    def __getstate__(self):
        return {**self.__dict__, "rows": None}  # tasks need the cells only

    @staticmethod
    def build(points: DataFrame, d: int) -> Index:
        """``points``: id, x, w; written before, as they are read several times."""
        n = points.count()
        many = min(MOST_PIVOTS, max(1, int(np.ceil(np.sqrt(n)))))
        pivots = matrix([r["x"] for r in points.select("x").orderBy(F.xxhash64("x"), "x").limit(many).collect()], d)
        id_type = dict(points.dtypes)["id"]

        def run(lists):
            for ids, xs, ws in lists:
                if not ids:
                    continue
                far = distances(matrix(xs, d), pivots)
                cell = far.argmin(axis=1)
                yield {"id": ids, "x": xs, "w": ws, "cell": cell.tolist(), "far": far[np.arange(len(ids)), cell].tolist()}

        rows = saved(_arrow(points.select("id", "x", "w"), run, f"id {id_type}, x binary, w double, cell int, far double"), "cells")
        stats = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("r"), F.min("w").alias("a"), F.max("w").alias("b")).collect()
        out = Index(rows, d, pivots, np.zeros(len(pivots)), np.zeros(len(pivots)), np.ones(len(pivots)), np.ones(len(pivots)), id_type)
        for s in stats:  # one row per pivot
            out.count[s["cell"]], out.radius[s["cell"]], out.least[s["cell"]], out.most[s["cell"]] = s["n"], s["r"], s["a"], s["b"]
        return out

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest distance from each point to the members of each cell."""
        far = distances(x, self.pivots)
        own = far.argmin(axis=1)
        near = far[np.arange(len(x)), own]
        between = distances(self.pivots, self.pivots)[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(between > 0, (far**2 - near[:, None] ** 2) / (2 * between), 0.0)
        low = np.maximum(np.maximum(far - self.radius, plane), 0.0)
        low[:, self.count == 0] = np.inf
        return low, far + self.radius

    def targets(self, queries: DataFrame, reach: Callable, skip_own: bool = False) -> DataFrame:
        """``queries`` (id, x, w, cell, more doubles) -> one row per cell that ``reach(low, high, w, more)``
        (points x cells) lets them meet."""
        more = [c for c in queries.columns if c not in ("id", "x", "w", "cell")]
        bounds, d, many = self.bounds, self.d, len(self.pivots)

        def run(lists):
            for ids, xs, ws, cells, *rest in lists:
                for i in range(0, len(ids), ROWS_AT_ONCE):
                    s = slice(i, i + ROWS_AT_ONCE)
                    low, high = bounds(matrix(xs[s], d))
                    meets = reach(low, high, np.array(ws[s], float), [np.array(c[s], float) for c in rest])
                    if skip_own:
                        meets &= np.arange(many) != np.array([-1 if c is None else c for c in cells[s]])[:, None]
                    row, cell = np.nonzero(meets)
                    row = row + i
                    yield {"id": [ids[r] for r in row], "x": [xs[r] for r in row], "w": [ws[r] for r in row], "cell": cell.tolist(),
                           **{c: [v[r] for r in row] for c, v in zip(more, rest)}}

        extra = "".join(f", {c} double" for c in more)
        return _arrow(queries.select("id", "x", "w", "cell", *more), run, f"id {self.id_type}, x binary, w double, cell int{extra}")

    def meet(self, members: DataFrame, queries: DataFrame, function: Callable, schema: str) -> DataFrame:
        """``function(members, queries)`` for every block of a cell's members (id, x, w, v) with every portion
        of the queries dealt to the cell (same columns); both as (ids, matrix, weights, v)."""
        d = self.d
        members, queries = (x.select("id", "x", "w", "cell", *(["v"] if "v" in x.columns else [F.lit(None).cast("double").alias("v")])) for x in (members, queries))
        queries = saved(queries, "queries")
        sizes = members.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        sizes = sizes.join(queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")), "cell")
        sizes = F.broadcast(saved(sizes, "cell-sizes"))  # one row per pivot
        block, part = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        a = members.join(sizes, "cell").withColumn("block", block).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        b = queries.join(sizes, "cell").withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        group = ["cell", "block", "part"]
        dealt = a.select(*group, F.lit(0).alias("side"), "id", "x", "w", "v").unionByName(b.select(*group, F.lit(1).alias("side"), "id", "x", "w", "v"))
        dealt = dealt.repartition(*group).sortWithinPartitions(*group, "side", "id")

        def run(lists):
            def done(held):
                sides = [[r[1:] for r in held if r[0] == s] for s in (0, 1)]
                if sides[0] and sides[1]:
                    yield from function(*[(np.array([r[0] for r in s], dtype=object), matrix([r[1] for r in s], d), np.array([r[2] for r in s], float),
                                           [r[3] for r in s]) for s in sides])

            now, held = None, []
            for *keys, side, ids, xs, ws, vs in lists:
                for *key, s, i, x, w, v in zip(*keys, side, ids, xs, ws, vs):
                    if key != now:
                        yield from done(held)
                        now, held = key, []
                    held.append((s, i, x, w, v))
            yield from done(held)

        return _arrow(dealt, run, schema)


def merge_cost(na, nb, dist):
    """Ward's cost of merging two clusters."""
    return na * nb / (na + nb) * dist**2


def nearest(points: DataFrame, d: int, k: int = 1, ward: bool = False) -> DataFrame:
    """``id, nid, cost, nw`` of the ``k`` nearest others of every point (id, x, w; x distinct),
    ties to the smaller id. ``cost`` is the distance, or Ward's cost with sizes ``w``; ``nw`` the
    neighbour's w."""
    index = Index.build(points, d)

    def best(members, queries):
        mi, mx, mw, _ = members
        qi, qx, qw, _ = queries
        cost = distances(qx, mx)
        if ward:
            cost = merge_cost(qw[:, None], mw[None], cost)
        cost[qi[:, None] == mi[None]] = np.inf  # members are in the order of their ids, so ties are too
        order = np.argsort(cost, axis=1, kind="stable")[:, :k]
        row = np.repeat(np.arange(len(qi)), order.shape[1])
        col = order.ravel()
        ok = np.isfinite(cost[row, col])
        row, col = row[ok], col[ok]
        yield {"id": qi[row].tolist(), "nid": mi[col].tolist(), "cost": cost[row, col].tolist(), "nw": mw[col].tolist()}

    schema = f"id {index.id_type}, nid {index.id_type}, cost double, nw double"

    def top(found):
        rank = F.row_number().over(W.partitionBy("id").orderBy("cost", "nid"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")

    own = saved(top(index.meet(index.rows, index.rows, best, schema)), "own-cell")
    limit = own.groupBy("id").agg(F.max("cost").alias("limit"), F.count(F.lit(1)).alias("n"))
    limit = limit.select("id", F.when(F.col("n") >= k, F.col("limit")).alias("limit"))
    queries = index.rows.join(limit, "id", "left").select("id", "x", "w", "cell", F.coalesce("limit", F.lit(float("inf"))).alias("limit"))
    count, least, most = index.count, index.least, index.most

    def reach(low, high, w, more):
        # without looking at points: so many members are at most so far
        if ward:
            low, high = merge_cost(w[:, None], least, low), merge_cost(w[:, None], most, high)
        order = np.argsort(np.where(count > 0, high, np.inf), axis=1)
        rows = np.arange(len(low))[:, None]
        enough = (count[order].cumsum(axis=1) >= k + 1).argmax(axis=1)  # with the point itself
        known = np.where(count.sum() > k, high[rows[:, 0], order[rows[:, 0], enough]], np.inf)
        return low <= (np.minimum(more[0], known) * (1 + SLACK) + 1e-300)[:, None]

    others = index.meet(index.rows, index.targets(queries, reach, skip_own=True), best, schema)
    return top(own.unionByName(others))


def within(index: Index, members: DataFrame, queries: DataFrame, radius: float, function: Callable, schema: str) -> DataFrame:
    """``function(members, queries, near)`` (near: boolean matrix queries x members) for all blocks that can hold
    neighbours within ``radius``; ``queries`` (id, x, w, cell, v) need not be members."""
    limit = radius * (1 + SLACK)
    value = queries.columns.count("v") and queries.select("id", "v")
    reached = index.targets(queries.select("id", "x", "w", "cell"), lambda low, *_: low <= limit)
    if value:
        reached = reached.join(value, "id", "left")

    def run(a, b):
        # the square decides, as in a comparison of squared distances
        near = np.stack([((q - a[1]) ** 2).sum(axis=1) <= radius * radius for q in b[1]])
        if near.any():
            yield from function(a, b, near)

    return index.meet(members, reached, run, schema)
