"""Positions in a total order without sorting everything in one task.

Rows are range partitioned on the order once, sorted inside their partition,
numbered there, and written to the shared folder; the number of rows in
earlier partitions (a running sum with one row per partition) turns the local
number into a global one. The cut points follow the data, so neither many
rows at one time nor a lone far key makes a large task; rows that are equal
in the leading columns are cut by the columns that follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import saved


def ordered_positions(df: DataFrame, order: list[Column], out: str = "position", group: Column | None = None,
                      size: str | None = None) -> DataFrame:
    """``df`` with ``out``: the 0-based position in ``order`` (within
    ``group``, a string column, if given); with ``size`` also the number of
    rows of the group. Ties beyond ``order`` are numbered arbitrarily."""
    keys = ["__og"] if group is not None else []
    x = df.withColumn("__og", group) if group is not None else df
    by = [*keys, *order]
    x = x.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__om", F.monotonically_increasing_id())
    x = saved(x, "positions")
    part, local = F.shiftright("__om", 33), F.col("__om").bitwiseAND(F.lit((1 << 33) - 1))
    # one row per partition: small whatever the number of rows
    counts = x.groupBy(part.alias("__op")).agg(F.count(F.lit(1)).alias("__oc"))
    before = counts.select("__op", (F.sum("__oc").over(Window.orderBy("__op")) - F.col("__oc")).alias("__ob"))
    x = x.withColumn("__op", part).join(F.broadcast(before), "__op").withColumn(out, (F.col("__ob") + local).cast("bigint"))
    x = x.drop("__op", "__ob", "__om")
    if group is not None:
        first = x.groupBy("__og").agg(F.min(out).alias("__of"), F.count(F.lit(1)).alias("__on"))
        x = x.join(first, "__og").withColumn(out, F.col(out) - F.col("__of"))
        if size:
            x = x.withColumn(size, F.col("__on"))
        x = x.drop("__og", "__of", "__on")
    elif size:
        x = x.withColumn(size, F.lit(x.count()).cast("bigint"))
    return x
