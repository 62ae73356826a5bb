"""Column-level helpers. All are built from ``pyspark.sql.functions`` so they
stay inside whole-stage codegen; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType,
)


def round6(c: Column | str) -> Column:
    """Doubles are compared after rounding to 6 places (oracle contract)."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6).cast("double")


def hash_hex(seed: int, key: Column | str) -> Column:
    """Deterministic, order-free row ordering key: md5 of ``"seed:key"``.
    md5 is chosen because DuckDB computes the identical hex string, so the
    oracle SQL reproduces the same membership."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def hash_unit(seed: int | str, *cols: Column | str) -> Column:
    """Uniform double in [0, 1) from xxhash64 of (seed, cols) — cheap, JVM
    side, independent of partitioning."""
    exprs = [F.col(c) if isinstance(c, str) else c for c in cols]
    h = F.xxhash64(F.lit(str(seed)), *exprs)
    return (F.abs(h % F.lit(1 << 52)).cast("double")) / F.lit(float(1 << 52))


def safe_div(num: Column, den: Column, default: float = 0.0) -> Column:
    """ANSI-safe division: ``default`` where the denominator is 0 or null."""
    return F.coalesce(F.try_divide(num, den), F.lit(default))


def numeric_columns(df: DataFrame, exclude: list[str] | tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude: list[str] | tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NUMERIC_TYPES)


def letter_share(text: Column | str) -> Column:
    """Share of ASCII letters in a text (whole text, built-in regex)."""
    t = F.col(text) if isinstance(text, str) else text
    letters = F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
    return safe_div(letters.cast("double"), F.length(t).cast("double"))


def missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating column."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def known(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into null."""
    return F.when(~missing(df, name), F.col(name))


def complete(df: DataFrame, names: list[str]) -> Column:
    """All named columns have a value. Vector columns count by null only."""
    out = F.lit(True)
    for n in names:
        out = out & ~missing(df, n)
    return out


def require_complete(df: DataFrame, names: list[str]) -> None:
    """Raise with the columns that have nulls or NaNs (one aggregate)."""
    r = df.agg(*[F.count_if(missing(df, n)).alias(f"m{i}") for i, n in enumerate(names)]).first()
    bad = {n: r[f"m{i}"] for i, n in enumerate(names) if r[f"m{i}"]}
    if bad:
        raise ValueError(f"features with missing values: {bad}; fill or drop them before training")


BROADCAST_ROW_LIMIT = 500_000


def bounded_broadcast(small: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast a lookup table only after checking its size: it is cached,
    counted, and hinted for broadcast when it has at most ``limit`` rows;
    otherwise it is returned as is and the join stays a shuffle join."""
    small = small.cache()
    n = small.count()
    return F.broadcast(small) if n <= limit else small


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in ``spark.checkpoint.dir``.

    The frame is persisted first: a reliable checkpoint otherwise computes
    its plan twice (once for the eager count, once to write the files). The
    persisted copy is released once the checkpoint files exist; the result
    reads from those files, so a lost executor never replays the lineage."""
    from pyspark import StorageLevel

    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out
