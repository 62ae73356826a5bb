"""Splits and folds (§2.6) with exact sizes and no global sort.

Membership is defined by a total order per group: ``md5("seed:key"), key``
for shuffled splits (time splits: :func:`split_time`). A row's segment only
depends on its 1-based rank r in that order and the cut points
(test: r <= k1, val: r <= k2, train: rest — or train/val/test for time).

Computing every rank would need one task per group (or a full shuffle).
Instead :func:`rank_segments` works in levels of buckets that follow the same
order (hash prefixes):

1. count rows per (group, bucket) — a small aggregate with map-side combine;
2. a running sum over that small table gives each bucket's rank range;
   a bucket whose whole range lies in one segment decides all its rows,
   which then pass through a join with that small table (broadcast after a
   size check) — no shuffle of the data itself;
3. only rows of *edge* buckets (at most one per cut and group) go on to the
   next, finer level; they are checkpointed to the shared checkpoint folder
   so the last level does not rescan the input;
4. at the last level the few remaining rows get an exact ``row_number``
   within (group, bucket...).

A group holding a third of all rows costs the same as any other: its rows
are spread over 4,096 x 4,096 buckets.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.columns import bounded_broadcast, hash_hex, materialize
from quarry.functions.positions import ordered_positions

TEST_SIZE = 0.2
VAL_SIZE = 0.1
SEED = 42


def _dec(x: float) -> Column:
    """Exact decimal literal, so ``ceil``/``floor`` never flip on 1e-16."""
    d = Decimal(str(x)).normalize()
    return F.lit(d)


def _ratio(val: float, test: float) -> Decimal:
    return (Decimal(str(val)) / (Decimal(1) - Decimal(str(test)))).quantize(Decimal("1.000000000000"))


def _segment(r: Column, cuts: list[Column], names: list[str]) -> Column:
    e = None
    for c, nm in zip(cuts, names):
        e = F.when(r <= c, F.lit(nm)) if e is None else e.when(r <= c, F.lit(nm))
    return e.otherwise(F.lit(names[-1]))


def rank_segments(
    df: DataFrame,
    group: Column | None,
    levels: list[Column],
    order_cols: list[Column],
    cut_fn,
    names: list[str],
    out_col: str = "split",
    checkpoint_edges: bool = True,
) -> DataFrame:
    """Assign ``out_col`` by rank within ``group`` against the cut points
    ``cut_fn(n)`` (ascending, one fewer than ``names``)."""
    cols = df.columns
    g = F.coalesce(group.cast("string"), F.lit("\u0000null")) if group is not None else F.lit("")
    rows = df.withColumn("__g", g)
    parts = ["__g"]
    decided: list[DataFrame] = []
    n_cuts = len(names) - 1
    cut_names = [f"__cut{j}" for j in range(n_cuts)]
    for i, b in enumerate(levels):
        bname = f"__b{i}"
        rows = rows.withColumn(bname, b)
        keyset = parts + [bname]
        w_run = Window.partitionBy(*parts).orderBy(bname).rowsBetween(Window.unboundedPreceding, -1)
        if i == 0:
            cnt = rows.groupBy(*keyset).agg(F.count(F.lit(1)).alias("__cnt"))
            cnt = cnt.withColumn("__n", F.sum("__cnt").over(Window.partitionBy(*parts)))
            cnt = cnt.withColumn("__before", F.coalesce(F.sum("__cnt").over(w_run), F.lit(0)).cast("bigint"))
            for j, c in enumerate(cut_fn(F.col("__n"))):
                cnt = cnt.withColumn(cut_names[j], c.cast("bigint"))
        else:
            cnt = rows.groupBy(*keyset).agg(
                F.count(F.lit(1)).alias("__cnt"),
                F.first("__before").alias("__before0"),
                *[F.first(c).alias(c) for c in cut_names],
            )
            cnt = cnt.withColumn(
                "__before", (F.col("__before0") + F.coalesce(F.sum("__cnt").over(w_run), F.lit(0))).cast("bigint")
            )
            rows = rows.drop("__before", *cut_names)
        cuts = [F.col(c) for c in cut_names]
        lo = _segment(F.col("__before") + 1, cuts, names)
        hi = _segment(F.col("__before") + F.col("__cnt"), cuts, names)
        cnt = cnt.withColumn("__kind", F.when(lo == hi, lo))
        rows = rows.join(bounded_broadcast(cnt.select(*keyset, "__before", *cut_names, "__kind")), keyset)
        decided.append(rows.where(F.col("__kind").isNotNull()).select(*cols, F.col("__kind").alias(out_col)))
        rows = rows.where(F.col("__kind").isNull()).drop("__kind")
        if i == 0 and checkpoint_edges:
            rows = rows.transform(materialize)
        parts = keyset
    w = Window.partitionBy(*parts).orderBy(*order_cols)
    r = F.row_number().over(w) + F.col("__before")
    last = rows.select(*cols, _segment(r, [F.col(c) for c in cut_names], names).alias(out_col))
    out = decided[0]
    for d in decided[1:] + [last]:
        out = out.unionByName(d)
    return out


def _hash_levels(h: Column) -> list[Column]:
    return [F.substring(h, 1, 3), F.substring(h, 1, 6)]


def _standard_cuts(test: float, val: float):
    ratio = _ratio(val, test)

    def cuts(n: Column) -> list[Column]:
        k1 = F.ceil(n * _dec(test)).cast("bigint")
        if val <= 0:
            return [k1, k1]
        k2 = k1 + F.ceil((n - k1) * F.lit(ratio)).cast("bigint")
        return [k1, k2]

    return cuts


def split_standard(
    df: DataFrame, key: str, label: str | None = None, test: float = TEST_SIZE, val: float = VAL_SIZE,
    seed: int = SEED, out_col: str = "split",
) -> DataFrame:
    """Random (label=None) or stratified split with exact sizes:
    test = ceil(n*test), validation = ceil((n-test)*val/(1-test)) per group."""
    h = hash_hex(seed, F.coalesce(F.col(key).cast("string"), F.lit("")))
    tmp = df.withColumn("__h", h)
    group = F.col(label) if label else None
    out = rank_segments(
        tmp, group, _hash_levels(F.col("__h")), [F.col("__h"), F.col(key)],
        _standard_cuts(test, val), ["test", "val", "train"], out_col,
    )
    return out.drop("__h")


def split_random(df: DataFrame, key: str, **kw) -> DataFrame:
    return split_standard(df, key, None, **kw)


def split_stratified(df: DataFrame, key: str, label: str, **kw) -> DataFrame:
    return split_standard(df, key, label, **kw)


def split_anomaly(df: DataFrame, key: str, label: str | None = None, **kw) -> DataFrame:
    """Stratified when labelled, else random."""
    return split_standard(df, key, label if label and label in df.columns else None, **kw)


def split_clustering(df: DataFrame, key: str, **kw) -> DataFrame:
    return split_standard(df, key, None, **kw)


def split_time(
    df: DataFrame, time_col: str, key: str, test: float = TEST_SIZE, val: float = VAL_SIZE, out_col: str = "split",
    series: str | None = None,
) -> DataFrame:
    """No shuffle: order by (time, key); t = floor(n*(1-test)),
    v = floor(t*(1-val/(1-test))); train r <= v, val r <= t, test rest."""
    ratio = _ratio(val, test)

    def cuts(n: Column) -> list[Column]:
        t = F.floor(n * _one_minus(test)).cast("bigint")
        if val <= 0:
            return [t, t]
        v = F.floor(t * (F.lit(Decimal(1)) - F.lit(ratio))).cast("bigint")
        return [v, t]

    cols = df.columns
    group = F.coalesce(F.col(series).cast("string"), F.lit("\u0000null")) if series else F.lit("")
    x = ordered_positions(df, [F.col(time_col).asc_nulls_first(), F.col(key)], "__r", group, "__n")
    v, t = cuts(F.col("__n"))
    return x.select(*cols, _segment(F.col("__r") + 1, [v, t], ["train", "val", "test"]).alias(out_col))


def _one_minus(x: float) -> Column:
    return F.lit((Decimal(1) - Decimal(str(x))).normalize())


def kfold(df: DataFrame, key: str, k: int = 5, label: str | None = None, seed: int = SEED, out_col: str = "fold") -> DataFrame:
    """Fold = (rank - 1) mod k within the label (stratified) in hash order.

    Every row needs its exact rank, so ranks are computed as bucket offset
    (running sum over a count table of up to 16^5 hash-prefix buckets, only
    occupied ones present) + ``row_number`` inside (label, bucket): one
    shuffle, and no window partition larger than a bucket (~10^6 rows per
    bucket at 10^12 rows)."""
    h = hash_hex(seed, F.coalesce(F.col(key).cast("string"), F.lit("")))
    g = F.coalesce(F.col(label).cast("string"), F.lit("\u0000null")) if label else F.lit("")
    tmp = df.withColumn("__h", h).withColumn("__g", g).withColumn("__b", F.substring("__h", 1, 5))
    cnt = tmp.groupBy("__g", "__b").agg(F.count(F.lit(1)).alias("__cnt"))
    w_run = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    cnt = cnt.select("__g", "__b", F.coalesce(F.sum("__cnt").over(w_run), F.lit(0)).alias("__before"))
    j = tmp.join(bounded_broadcast(cnt), ["__g", "__b"])
    r = F.row_number().over(Window.partitionBy("__g", "__b").orderBy("__h", key)) + F.col("__before")
    return j.withColumn(out_col, ((r - 1) % k).cast("int")).drop("__h", "__g", "__b", "__before")


def dense_index(df: DataFrame, time_col: str, key: str, series: str | None = None, out_col: str = "__i") -> DataFrame:
    """0-based position of each row in (time, key) order within its series,
    from one range partitioning (:func:`ordered_positions`); null times come
    first. Adds ``__g`` (series key) and ``__n`` (series length)."""
    g = F.coalesce(F.col(series).cast("string"), F.lit("\u0000null")) if series else F.lit("")
    return ordered_positions(df.withColumn("__g", g), [F.col(time_col).asc_nulls_first(), F.col(key)], out_col, F.col("__g"), "__n")
