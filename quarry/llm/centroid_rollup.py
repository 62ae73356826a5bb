"""Subtree totals over a parent-edge forest by centroid decomposition.

``rollup`` gives every node the sum of the values in its subtree. A component
is split at its centroid (the deepest node whose subtree holds half of the
component): the subtree's total, aggregated from the parts below, goes to the
centroid and to every node on the path from there to the component's top; the
centroid leaves, its children become tops of components of their own, and the
rest goes on without the subtree. Components at least halve at every level,
so a path of n nodes takes about log2(n) levels and not n steps.

Components of more than ``local_nodes`` nodes are split by Spark: subtree sizes by
pointer doubling (jump tables of 1, 2, 4, ... edges), paths by the same tables,
labels of the parts by doubling over the edges that remain. Smaller components are
dealt to tasks in portions of about ``local_nodes`` nodes, and each is
decomposed to the end there by the same rule. Both give the same sums.

Skew: a hub with very many children is a hot key of the pointer joins; the
number of rows per pointer is aggregated first, and such keys are broadcast (fewer
than 1024 by count), the rest shuffled. Every round is written to the shared folder.

Rows: nodes are unique and not null; a null parent, and a parent that is no node, makes
a top; null values count as 0. A cycle raises an error. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarry.llm.common import lookup, saved

LOCAL_NODES = 4096


def decompose(parent: list[int], values: list[list[int]]) -> list[list[int]]:
    """Subtree totals of a forest in memory: ``parent`` holds indices (-1 at
    tops), ``values`` one list per value."""
    n = len(parent)
    up = list(parent)
    below: list[list[int]] = [[] for _ in range(n)]
    for v, p in enumerate(up):
        if p >= 0:
            below[p].append(v)
    totals = [[0] * n for _ in values]
    work = []
    for top in range(n):
        if up[top] < 0:
            order = [top]
            for v in order:  # parents before children
                order.extend(below[v])
            work.append(order)
    if sum(map(len, work)) < n:
        raise ValueError("the parent edges have a cycle")
    size, label = [0] * n, [0] * n
    while work:
        nodes = work.pop()
        if len(nodes) == 1:
            for value, total in zip(values, totals):
                total[nodes[0]] += value[nodes[0]]
            continue
        for v in nodes:
            size[v] = 1
        for v in reversed(nodes):
            if up[v] >= 0:
                size[up[v]] += size[v]
        centre = max((v for v in nodes if 2 * size[v] >= len(nodes)), key=lambda v: -size[v])
        parts: dict[int, list[int]] = {}
        for v in nodes:
            if v == centre or up[v] == centre or up[v] < 0:
                label[v] = v
            else:
                label[v] = label[up[v]]
            parts.setdefault(label[v], []).append(v)
        lower = [p for top, p in parts.items() if top == centre or up[top] == centre]
        sums = [sum(value[v] for p in lower for v in p) for value in values]
        v = centre
        while v >= 0:
            for total, s in zip(totals, sums):
                total[v] += s
            v = up[v]
        for v in below[centre]:
            up[v] = -1
        up[centre] = -1
        work += [p for top, p in parts.items() if top != centre]
    return totals


def _jump(steps: DataFrame, total: int) -> DataFrame:
    """(node, anc) with the ancestor of twice the distance; pointers that leave the
    component are not in the table."""
    used = steps.groupBy("anc").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("anc", "at")
    # unique on both sides
    nexts = saved(used.join(steps, F.col("at") == F.col("node")).select(F.col("at").alias("anc"), "n", F.col("anc").alias("far")), "jump-next")
    return saved(lookup(steps, nexts, ["anc"], "n", total, "inner").select("node", F.col("far").alias("anc")), "jump")


def tops(edges: DataFrame) -> DataFrame:
    """(node, top) for every row (node, parent); a null parent is a top."""
    total = edges.count()
    roots = edges.filter("parent is null").select("node", F.col("node").alias("top"))
    done = [saved(roots, "tops")]
    # pointers that have not met a top yet
    open_ = saved(edges.filter("parent is not null").select("node", F.col("parent").alias("anc")), "open")
    left, rounds = open_.count(), 0
    known = done[0]
    while left:
        # pointers to nodes whose top is known end, the others double
        used = open_.groupBy("anc").agg(F.count(F.lit(1)).alias("n"))
        ends = saved(used.join(known.withColumnRenamed("node", "anc"), "anc"), "ends")
        found = saved(lookup(open_, ends, ["anc"], "n", total, "inner").select("node", "top"), "tops")
        done.append(found)
        known = saved(known.unionByName(found), "known")
        rest = saved(open_.join(found.select("node"), "node", "left_anti"), "open")
        nexts = rest.groupBy("anc").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("anc", "at")
        nexts = saved(nexts.join(rest, F.col("at") == F.col("node")).select(F.col("at").alias("anc"), "n", F.col("anc").alias("far")), "nexts")
        open_ = saved(lookup(rest, nexts, ["anc"], "n", total).select("node", F.coalesce("far", "anc").alias("anc")), "open")
        left, rounds = open_.count(), rounds + 1
        if left and rounds > total.bit_length() + 1:  # pointers span more than all nodes
            raise ValueError("the parent edges have a cycle")
    return known


def _split(nodes: DataFrame, sizes: DataFrame, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """One level: ``nodes`` (node, parent, top, values, sums so far) of large
    components -> (the nodes that go on with new parents and tops, centroids)."""
    total = nodes.count()
    sums = [f"{v}_sum" for v in values]
    # jump tables and subtree sizes by doubling
    steps = saved(nodes.filter("parent is not null").select("node", F.col("parent").alias("anc")), "steps")
    jumps, size = [], saved(nodes.select("node", F.lit(1).cast("long").alias("size")), "size")
    while not steps.isEmpty():
        jumps.append(steps)
        # a pointer's rows are unique in node, so is the size table
        add = steps.join(size, "node").groupBy("anc").agg(F.sum("size").alias("more")).withColumnRenamed("anc", "node")
        size = saved(size.join(add, "node", "left").select("node", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "size")
        steps = _jump(steps, total)
    sized = saved(nodes.join(size, "node"), "sized")
    sized = lookup(sized, sizes, ["top"], "n", total, "inner")
    centre = sized.filter(2 * F.col("size") >= F.col("n")).groupBy("top").agg(F.min(F.struct("size", "node"))["node"].alias("centre"), F.max("n").alias("n"))
    centre = saved(centre, "centre")
    path = saved(centre.select(F.col("centre").alias("node"), "centre"), "path")
    for steps in jumps:
        path = saved(path.unionByName(path.join(steps, "node").select(F.col("anc").alias("node"), "centre")), "path")
    # the edges around the centroid go
    cut = lookup(nodes, centre.select("top", "centre", "n"), ["top"], "n", total, "inner").drop("n")
    below = F.col("parent") == F.col("centre")
    cut = saved(cut.withColumn("under", F.coalesce(below, F.lit(False)) | (F.col("node") == F.col("centre")))
                .withColumn("parent", F.when(~F.coalesce(below, F.lit(False)) & (F.col("node") != F.col("centre")), F.col("parent"))), "cut")
    label = tops(cut.select("node", "parent"))
    cut = saved(cut.drop("top").join(label, "node"), "labelled")
    # totals of the parts below the centroid (its own part is itself)
    parts = cut.groupBy("top", "centre").agg(*[F.sum(v).alias(v) for v in values])
    lower = cut.filter("under").select(F.col("node").alias("top"))
    parts = parts.join(lower, "top").groupBy("centre").agg(*[F.sum(v).alias(f"{v}_add") for v in values])
    adds = path.join(saved(parts, "parts"), "centre").drop("centre")
    done = cut.join(adds, "node", "left").select(
        "node", "parent", "top", "centre", *values, *[(F.col(s) + F.coalesce(f"{v}_add", F.lit(0))).alias(s) for v, s in zip(values, sums)])
    done = saved(done, "level")
    return done.filter("node != centre").drop("centre"), done.filter("node = centre").drop("centre")


def _local(nodes: DataFrame, values: list[str], local_nodes: int) -> DataFrame:
    sums = [f"{v}_sum" for v in values]
    portions = max(1, -(-2 * nodes.count() // local_nodes))
    schema = StructType([StructField("node", LongType())] + [StructField(v, LongType()) for v in values])

    def run(pdf):
        import pandas as pd

        ids = pdf["node"].tolist()
        index = {v: i for i, v in enumerate(ids)}
        parent = [-1 if pd.isna(p) else index[int(p)] for p in pdf["parent"]]
        totals = decompose(parent, [pdf[v].tolist() for v in values])
        return pd.DataFrame({"node": ids, **{v: [a + b for a, b in zip(t, pdf[s].tolist())] for v, s, t in zip(values, sums, totals)}})

    # whole numbers beyond 2^53 and nulls do not mix in pandas: parents as text
    rows = nodes.select("node", F.col("parent").cast("string").alias("parent"), *values, *sums, F.pmod(F.xxhash64("top"), F.lit(portions)).alias("portion"))
    return rows.groupBy("portion").applyInPandas(run, schema)


def rollup(forest: DataFrame, values: list[str], local_nodes: int = LOCAL_NODES) -> DataFrame:
    """``node`` and the subtree sums of ``values`` for every row (node, parent, values)."""
    forest = forest.select(F.col("node").cast("long"), F.col("parent").cast("long"), *[F.coalesce(F.col(v).cast("long"), F.lit(0)).alias(v) for v in values])
    forest = saved(forest, "forest")
    total = forest.count()
    # parents that are no nodes are none; counted first, so that a hub is one row
    used = forest.filter("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
    used = saved(used.join(forest.select(F.col("node").alias("parent")), "parent", "left_semi").withColumn("known", F.col("parent")), "parents")
    forest = saved(lookup(forest, used, ["parent"], "n", total).withColumn("parent", F.col("known")).drop("known", "n"), "forest")
    nodes = forest.join(tops(forest.select("node", "parent")), "node")
    nodes = saved(nodes.select("*", *[F.lit(0).cast("long").alias(f"{v}_sum") for v in values]), "nodes")
    small, finished = [], []
    while True:
        sizes = saved(nodes.groupBy("top").agg(F.count(F.lit(1)).alias("n")), "sizes")
        large = saved(sizes.filter(F.col("n") > local_nodes), "large")
        if large.isEmpty():
            small.append(nodes)
            break
        marked = saved(lookup(nodes, large, ["top"], "n", nodes.count()), "marked")
        small.append(marked.filter("n is null").drop("n"))
        nodes, centres = _split(marked.filter("n is not null").drop("n"), large, values)
        finished.append(centres)
    rest = small[0]
    for part in small[1:]:
        rest = rest.unionByName(part)
    out = _local(rest, values, local_nodes)
    for part in finished:
        out = out.unionByName(part.select("node", *[F.col(f"{v}_sum").alias(v) for v in values]))
    return out
