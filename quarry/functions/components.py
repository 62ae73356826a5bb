"""Connected components by alternating large-star / small-star contraction.

Edges are rows of two comparable node ids. Every round rewrites the edge
list so that nodes point at smaller neighbours: the large star hangs all
larger neighbours of a node below the smallest node it knows, the small
star does the same for its smaller neighbours. Paths shrink by a factor per
round (O(log^2 n) rounds), whatever the order of the ids; the loop ends only
when a round leaves the edge list unchanged, so there is no round limit.

Each round is two aggregates with map-side combine and one join, checkpointed
in the session's checkpoint folder. A hub is never gathered: its minimum is an
aggregate and the join side can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import saved


def _fingerprint(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


#: Edges of one task; rounds over few edges so take few tasks.
EDGES_PER_TASK = 50_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge to another node;
    ``component`` is the smallest node id of the component. Rows with a null
    end are ignored (a null id links nothing), self loops and repeated edges
    change nothing."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    cur = saved(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
                .select(hi.alias("child"), lo.alias("parent")).distinct(), "cc")
    seen = _fingerprint(cur)
    while seen[0]:
        tasks = max(8, 2 * seen[0] // EDGES_PER_TASK)  # a round has at most twice as many edges as the last
        both = cur.select(F.col("parent").alias("u"), F.col("child").alias("v")).unionByName(
            cur.select(F.col("child").alias("u"), F.col("parent").alias("v")))
        # minima are written before the joins: a join straight on an aggregate by
        # its key cannot be split, and a hub's edges would be one task's
        low = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks), "cc-low")
        # below every node u: its larger neighbours, now hung under the minimum u knows
        large = cur.select(F.col("parent").alias("u"), F.col("child").alias("v")).join(low, "u").select(
            F.col("v").alias("child"), F.col("m").alias("parent")).coalesce(tasks).distinct()
        large = saved(large.coalesce(tasks), "cc-large")
        least = saved(large.groupBy("child").agg(F.min("parent").alias("m")).coalesce(tasks), "cc-least")
        joined = large.join(least, "child").coalesce(tasks)
        # the child and its other parents hang under its least parent
        small = joined.select(F.explode(F.array(
            F.struct(F.col("child"), F.col("m").alias("parent")),
            F.struct(F.when(F.col("parent") != F.col("m"), F.col("parent")).alias("child"), F.col("m").alias("parent")))).alias("e"))
        small = small.select("e.child", "e.parent").filter(F.col("child").isNotNull()).distinct()
        cur = saved(small.coalesce(tasks), "cc")
        now = _fingerprint(cur)
        if now == seen:
            break
        seen = now
    roots = cur.select(F.col("parent").alias("node"), F.col("parent").alias("component")).distinct()
    return cur.select(F.col("child").alias("node"), F.col("parent").alias("component")).unionByName(roots)
