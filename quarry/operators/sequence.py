"""Lag windows and horizon targets (§2.5).

For row t (0-based position within its series in (time, key) order) the
features are the values at t-L ... t-1 (named ``{col}_lag_{k}``, k = L..1,
lag-major then column) and the target is y[t] (horizon 1) or
[y[t], ..., y[t+h-1]]. Only rows with full history and full future are kept:
n - L - h + 1 rows per series.

A plain ``lag`` window partitioned by series puts a whole series in one task
(and one global series in a single partition). Here the series is cut into
blocks of ``block`` consecutive positions; each row is copied into every
block that needs it (its own, the next ones for lags, the previous one for
leads — the "halo"), the window runs per (series, block), and only home rows
are kept. Positions come from :func:`quarry.operators.split.dense_index`
(one range partitioning), so no step ever sorts a whole series in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.split import dense_index

DEFAULT_BLOCK = 50_000


def lag_names(features: list[str], lookback: int) -> list[str]:
    return [f"{c}_lag_{k}" for k in range(lookback, 0, -1) for c in features]


def lag_features(
    df: DataFrame,
    features: list[str],
    target: str,
    time_col: str,
    key: str,
    series: str | None = None,
    lookback: int = 10,
    horizon: int = 1,
    block: int = DEFAULT_BLOCK,
    target_col: str = "y",
) -> DataFrame:
    """Lagged feature rows with their horizon target; see module doc."""
    if block <= 0:
        raise ValueError("block must be positive")
    x = dense_index(df, time_col, key, series, "__i")
    lo = F.floor(F.greatest(F.col("__i") - (horizon - 1), F.lit(0)) / block)
    hi = F.floor((F.col("__i") + lookback) / block)
    x = x.withColumn("__blk", F.floor(F.col("__i") / block)).withColumn(
        "__gb", F.explode(F.sequence(lo.cast("bigint"), hi.cast("bigint")))
    )
    w = Window.partitionBy("__g", "__gb").orderBy("__i")
    lag_cols = [F.lag(F.col(c), k).over(w).alias(f"{c}_lag_{k}") for k in range(lookback, 0, -1) for c in features]
    if horizon == 1:
        y = F.col(target).alias(target_col)
    else:
        y = F.array(F.col(target), *[F.lead(F.col(target), j).over(w) for j in range(1, horizon)]).alias(target_col)
    keep = [c for c in ([series] if series else []) + [key, time_col]]
    out = x.select(*keep, "__i", "__n", "__blk", "__gb", *lag_cols, y)
    out = out.where(
        (F.col("__gb") == F.col("__blk")) & (F.col("__i") >= lookback) & (F.col("__i") <= F.col("__n") - horizon)
    )
    return out.drop("__n", "__blk", "__gb").withColumnRenamed("__i", "position")


def indexed_window(df: DataFrame, index_col: str, series: str | None, specs: dict[str, tuple[str, int]],
                   block: int = DEFAULT_BLOCK) -> DataFrame:
    """``lag``/``lead`` columns over a contiguous integer index per series
    with the block-halo scheme. ``specs[out] = (col, k)``: k > 0 is a lag of
    k rows, k < 0 a lead of -k rows (null where the row does not exist)."""
    lags = [k for _, k in specs.values() if k > 0]
    leads = [-k for _, k in specs.values() if k < 0]
    L, H = max(lags, default=0), max(leads, default=0)
    i = F.col(index_col)
    g = F.coalesce(F.col(series).cast("string"), F.lit("\u0000null")) if series else F.lit("")
    x = df.withColumn("__g2", g).withColumn("__blk2", F.floor(i / block)).withColumn(
        "__gb2", F.explode(F.sequence(F.floor((i - H) / block).cast("bigint"), F.floor((i + L) / block).cast("bigint"))))
    w = Window.partitionBy("__g2", "__gb2").orderBy(index_col)
    cols = []
    for out, (c, k) in specs.items():
        e = F.lag(F.col(c), k).over(w) if k > 0 else F.lead(F.col(c), -k).over(w)
        # a neighbour row only counts if its index is exactly i -/+ k
        idx = F.lag(i, k).over(w) if k > 0 else F.lead(i, -k).over(w)
        cols.append(F.when(idx == i - k, e).alias(out))
    out = x.select(*df.columns, "__blk2", "__gb2", *cols).where(F.col("__gb2") == F.col("__blk2"))
    return out.drop("__blk2", "__gb2")


def sort_time(df: DataFrame, time_col: str, key: str, series: str | None = None) -> DataFrame:
    """Ascending time order as an explicit 0-based ``position`` column (file
    order has no meaning in Spark, so a key breaks ties)."""
    return dense_index(df, time_col, key, series, "position").drop("__g", "__n")


def series_kind(features: list[str]) -> str:
    return "univariate" if len(features) == 1 else "multivariate"
