"""Exact nearest rows by a k-d partition of space: boxes of about ``BOX_ROWS`` rows.

Cuts come from a sample of at most ``SAMPLE_ROWS`` rows, so boxes follow the density; what a box covers is
the smallest and largest value of all its rows. Every query meets the rows of its own box first.
Their k-th distance says which other boxes can hold a nearer row, and it meets these. A task
holds the rows of one box and a portion of the queries dealt to it; only the nearest rows of a query leave it.

Of the rows at one place no query takes more than the ``k`` with the smallest keys (one more stands in for the
query itself), so only these are candidates and many equal rows never meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import saved

BOX_ROWS = 2048
SAMPLE_ROWS = 200_000
#: queries of a box that one task takes
PORTION = 65_536
ROWS_AT_ONCE = 256


class Boxes:
    """A binary tree of cuts; its leaves are numbered."""

    def __init__(self, sample: np.ndarray, rows: int):
        self.axis, self.at, self.left, self.leaf, self.leaves = [], [], [], [], 0
        fewest = max(1.0, len(sample) * BOX_ROWS / max(rows, 1))  # sampled rows of a box
        todo = [(self._node(), sample)]
        while todo:
            node, x = todo.pop()
            axis, at = self._cut(x) if len(x) > fewest else (-1, 0.0)
            if axis < 0:
                self.leaf[node], self.leaves = self.leaves, self.leaves + 1
                continue
            goes = x[:, axis] <= at
            self.axis[node], self.at[node], self.left[node] = axis, at, self._node()
            todo += [(self.left[node], x[goes]), (self._node(), x[~goes])]
        self.axis, self.at, self.left, self.leaf = (np.array(v) for v in (self.axis, self.at, self.left, self.leaf))

    def _node(self) -> int:
        for v, empty in ((self.axis, -1), (self.at, 0.0), (self.left, -1), (self.leaf, -1)):
            v.append(empty)
        return len(self.axis) - 1

    @staticmethod
    def _cut(x: np.ndarray) -> tuple[int, float]:
        """The value next to the middle of the widest axis; rows above it exist."""
        lo, hi = x.min(axis=0), x.max(axis=0)
        axis = int(np.argmax(hi - lo))
        if not hi[axis] > lo[axis]:
            return -1, 0.0
        v = np.sort(x[:, axis])
        at = v[(len(v) - 1) // 2]
        return axis, float(at if at < hi[axis] else v[np.searchsorted(v, at) - 1])

    def of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x)) if self.axis[0] >= 0 else np.zeros(0, int)
        while len(rows):
            at = node[rows]
            node[rows] = self.left[at] + (x[rows, self.axis[at]] > self.at[at])
            rows = rows[self.axis[node[rows]] >= 0]
        return self.leaf[node]


def entries(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """``id, m, x0, ...``: a key at a place, and how many rows they are. Rows with a missing value are left out."""
    x = df.select(F.col(f"`{key}`").alias("id"), *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    cols = [f"x{i}" for i in range(len(features))]
    for c in cols:
        x = x.where(F.col(c).isNotNull() & ~F.isnan(c))
    return x.groupBy("id", *cols).agg(F.count(F.lit(1)).alias("m"))


def _ids(column) -> np.ndarray:
    return column.to_numpy() if pa.types.is_integer(column.type) and not column.null_count else np.array(column.to_pylist() + [None], object)[:-1]


def _columns(batch, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.stack([batch.column(f"x{i}").to_numpy() for i in range(d)], axis=1) if batch.num_rows else np.zeros((0, d))
    return _ids(batch.column("id")), batch.column("m").to_numpy(), x


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, added axis by axis as a sum of columns is."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        t = a[:, i, None] - b[None, :, i]
        out += t * t
    return out


def _nearest(queries, members, k: int, exclude: bool, limit: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """(query, member, squared distance, rows) of each query's first ``k`` rows; members are in the order of
    their keys. A query's entry of several rows sees every member as often."""
    (qi, qm, qx), (mi, mm, mx) = queries, members
    found = []
    for s in range(0, len(qi), ROWS_AT_ONCE):
        part = slice(s, s + ROWS_AT_ONCE)
        d2 = _squares(qx[part], mx)
        if exclude:
            d2[qi[part, None] == mi[None, :]] = np.inf
        if limit is not None:
            d2[d2 > limit[part, None]] = np.inf
        kth = np.partition(d2, k - 1, axis=1)[:, k - 1] if d2.shape[1] > k else np.full(len(d2), np.inf)
        row, col = np.nonzero((d2 <= kth[:, None]) & (d2 < np.inf))
        v = d2[row, col]
        order = np.lexsort((v, row))  # stable: equal distances stay in the order of the keys
        row, col, v = row[order], col[order], v[order]
        times = qm[part][row] * mm[col]
        before = np.cumsum(times) - times
        first = np.searchsorted(row, row)  # where the query's members begin
        take = np.clip(k - (before - before[first]), 0, times) if len(row) else times
        ok = take > 0
        found.append((row[ok] + s, col[ok], v[ok], take[ok]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _groups(batches, keys: tuple[str, ...]) -> Iterator[tuple[bool, int, pa.RecordBatch]]:
    """(a group begins, side, rows): the batches cut where the group or the side changes."""
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in (*keys, "side")]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            key = tuple(c[a] for c in cols[:-1])
            yield key != now, int(cols[-1][a]), batch.slice(a, b - a)
            now = key


def nearest_rows(queries: DataFrame, members: DataFrame, d: int, k: int, exclude: bool) -> DataFrame:
    """``q, n, dist, t``: the first ``k`` rows of ``members`` by (distance, key) for every entry of ``queries`` (both as
    ``entries`` gives them), ``t`` rows of the entry n. ``exclude`` leaves out entries with the query's own key."""
    cols = [f"x{i}" for i in range(d)]
    nth = F.row_number().over(Window.partitionBy(*cols).orderBy("id"))
    few = saved(members.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth"), "candidates")
    rows = few.count()
    if not rows:
        return queries.select(F.col("id").alias("q"), F.col("id").alias("n"), F.lit(0.0).alias("dist"), F.col("m").alias("t")).limit(0)
    share = min(1.0, SAMPLE_ROWS / rows)
    sample = few.select(*cols)
    if share < 1:  # a hash of the place and key, so reruns agree
        sample = few.where(F.pmod(F.xxhash64(F.lit(29), "id", *cols), F.lit(1 << 30)) < int(share * (1 << 30))).select(*cols)
    tree = Boxes(np.array(sample.collect(), float).reshape(-1, d), rows)
    kind = dict(few.dtypes)["id"]

    def dealt(df: DataFrame, side: int) -> DataFrame:
        @F.pandas_udf("int")
        def box(*x: pd.Series) -> pd.Series:
            return pd.Series(tree.of(np.column_stack([c.to_numpy(float) for c in x])) if len(x[0]) else [], dtype="int32")

        return df.select(box(*cols).alias("box"), F.lit(side).alias("side"), "id", "m", *cols)

    few = saved(dealt(few, 0), "boxes")
    ends = few.groupBy("box").agg(*[f.alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("lo", F.min(c)), ("hi", F.max(c)))]).collect()
    number = np.array([r["box"] for r in ends])  # one row per box
    low, high = (np.array([[r[f"{n}{i}"] for i in range(d)] for r in ends], float) for n in ("lo", "hi"))
    tasks = max(few.sparkSession.sparkContext.defaultParallelism, int(few.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def together(asked: DataFrame, more: list[str]) -> DataFrame:
        """Candidates and queries by box and portion, candidates first and in the order of their keys."""
        parts = asked.groupBy("box").agg(F.ceil(F.count(F.lit(1)) / PORTION).cast("int").alias("parts"))
        parts = F.broadcast(saved(parts, "portions"))  # one row per box
        q = asked.join(parts, "box").withColumn("part", F.pmod(F.xxhash64("id", *cols), F.col("parts")).cast("int"))
        c = few.join(parts, "box").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        for name in more:
            c = c.withColumn(name, F.lit(float("inf")))
        out = ["box", "part", "side", "id", "m", *cols, *more]
        return c.select(*out).unionByName(q.select(*out)).repartition(tasks, "box", "part").sortWithinPartitions("box", "part", "side", "id")

    def pairs(batches, more: bool):
        members, mi, held = None, None, []
        for new, side, batch in _groups(batches, ("box", "part")):
            if new:
                members, held = None, []
            if side == 0:
                held.append(_columns(batch, d))
                continue
            if members is None:
                if not held:  # a box of queries only
                    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, d)))]
                members = tuple(np.concatenate(c) for c in zip(*held))
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                q = _columns(piece, d)
                limit = piece.column("far").to_numpy() if more else None
                yield piece, q, members, _nearest(q, members, k, exclude, limit)

    def listed(rows: np.ndarray, many: int, values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(many + 1)).astype(np.int32)), values)

    def own(batches):
        for piece, (qi, qm, qx), (mi, *_), (row, col, v, take) in pairs(batches, False):
            full = np.bincount(row, take, len(qi)) >= k
            far = np.full(len(qi), -np.inf)
            np.maximum.at(far, row, v)
            far = np.where(full, far, np.inf)
            # other boxes: first those that may be met by any of these queries
            def least(lo, hi):
                return (np.maximum(np.maximum(low[None] - hi[:, None], lo[:, None] - high[None]), 0.0) ** 2).sum(axis=2)

            near = np.flatnonzero((least(qx.min(axis=0)[None], qx.max(axis=0)[None])[0] <= far.max() * (1 + 1e-9)) & (number != piece.column("box")[0].as_py()))
            to_row, to_box = [np.zeros(0, int)], [np.zeros(0, int)]
            for s in range(0, len(qi), ROWS_AT_ONCE):
                x = qx[s:s + ROWS_AT_ONCE]
                gap = np.zeros((len(x), len(near)))
                for i in range(d):  # added axis by axis as distances are, so rounding never hides a box
                    t = np.maximum(np.maximum(low[near, i] - x[:, i, None], x[:, i, None] - high[near, i]), 0.0)
                    gap += t * t
                r, b = np.nonzero(gap <= far[s:s + ROWS_AT_ONCE, None])
                to_row.append(r + s)
                to_box.append(number[near[b]])
            n = pa.array(mi[col].tolist() if mi.dtype == object else mi[col], piece.column("id").type)
            yield pa.RecordBatch.from_arrays([
                piece.column("id"), piece.column("m"), *[piece.column(c) for c in cols], pa.array(far),
                listed(np.concatenate(to_row), len(qi), pa.array(np.concatenate(to_box).astype(np.int32))),
                listed(row, len(qi), n), listed(row, len(qi), pa.array(v)), listed(row, len(qi), pa.array(take.astype(np.int64)))],
                ["id", "m", *cols, "far", "boxes", "n", "d2", "t"])

    def others(batches):
        for piece, (qi, _, _), (mi, *_), (row, col, v, take) in pairs(batches, True):
            q = piece.column("id").take(pa.array(row))
            n = pa.array(mi[col].tolist() if mi.dtype == object else mi[col], piece.column("id").type)
            x = [piece.column(c).take(pa.array(row)) for c in cols]
            yield pa.RecordBatch.from_arrays([q, *x, n, pa.array(v), pa.array(take.astype(np.int64))], ["id", *cols, "n", "d2", "t"])

    at = ", ".join(f"{c} double" for c in cols)
    first = saved(together(dealt(queries, 1), []).mapInArrow(
        own, f"id {kind}, m bigint, {at}, far double, boxes array<int>, n array<{kind}>, d2 array<double>, t array<bigint>"), "own-boxes")
    asked = first.where(F.size("boxes") > 0).select(F.explode("boxes").alias("box"), F.lit(1).alias("side"), "id", "m", *cols, "far")
    second = together(asked, ["far"]).mapInArrow(others, f"id {kind}, {at}, n {kind}, d2 double, t bigint")
    each = F.inline(F.arrays_zip("n", "d2", "t"))
    merged = first.where(F.size("boxes") > 0).select("id", *cols, each).unionByName(second)
    alone = first.where(F.size("boxes") == 0)
    out = ["id", "n", "d2", "t"]
    several = queries.groupBy("id").agg(F.count(F.lit(1)).alias("places")).where("places > 1").limit(1).count() > 0
    if several:  # keys at more than one place are one query
        found = _first(alone.select("id", *cols, each).unionByName(merged), ["id"], k)
    else:
        found = alone.select("id", each).select(*out).unionByName(_first(merged, ["id"], k).select(*out))
    return found.select(F.col("id").alias("q"), "n", F.sqrt("d2").alias("dist"), "t")


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each query by (distance, key)."""
    before = F.coalesce(F.sum("t").over(Window.partitionBy(*by).orderBy("d2", "n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    take: Column = F.least(F.col("t"), F.lit(k) - before)
    return found.withColumn("t", take).where("t > 0")
