"""Distributed statistics helpers shared by models: moments, quantiles and
literal-coefficient expressions. All data work is aggregation on Spark; only
fixed-size results (d x d moments, a few quantiles) reach the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments(df: DataFrame, cols: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean vector, MLE covariance) in one aggregate of d + d(d+1)/2 sums."""
    d = len(cols)
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]
    for i in range(d):
        for j in range(i, d):
            aggs.append(F.sum(F.col(cols[i]).cast("double") * F.col(cols[j]).cast("double")).alias(f"p{i}_{j}"))
    r = df.agg(*aggs).first()
    n = int(r["n"])
    if n == 0:
        raise ValueError("no rows")
    mu = np.array([r[f"s{i}"] for i in range(d)], dtype=float) / n
    S = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            S[i, j] = S[j, i] = r[f"p{i}_{j}"] / n - mu[i] * mu[j]
    return n, mu, S


def quadratic_form(cols: list[str], mu: np.ndarray, P: np.ndarray) -> Column:
    """(x - mu)^T P (x - mu) as a JVM expression with literal coefficients."""
    diffs = [F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(cols, mu)]
    expr = None
    d = len(cols)
    for i in range(d):
        for j in range(i, d):
            coef = P[i, j] if i == j else 2 * P[i, j]
            if coef == 0:
                continue
            term = F.lit(float(coef)) * diffs[i] * diffs[j]
            expr = term if expr is None else expr + term
    return expr if expr is not None else F.lit(0.0)


def _long(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column index, x) rows for the listed columns in one scan (``stack``)."""
    parts = ", ".join(f"{i}, CAST(`{c}` AS DOUBLE)" for i, c in enumerate(cols))
    return df.selectExpr(f"stack({len(cols)}, {parts}) AS (column, x)")


def _by_column(st: dict, key: str) -> Column:
    e = None
    for s in st.values():
        i = s["idx"]
        e = F.when(F.col("column") == i, s[key]) if e is None else e.when(F.col("column") == i, s[key])
    return e


def exact_quantiles(df: DataFrame, cols: list[str], q: float, ranges: dict | None = None, buckets: int = 4096,
                    slice_max: int = 50_000, max_levels: int = 6) -> dict:
    """Exact quantile (linear interpolation at position (n-1)q, as numpy and
    DuckDB's quantile_cont) of each column, without a per-value map of the
    whole column.

    ``ranges[c] = (n, min, max)`` (from any earlier aggregate, else one is
    run). Each refinement level is one scan of the columns in long form that
    counts every column's candidate values in ``buckets`` equal-width
    buckets (a table of at most ``buckets`` rows per column reaches the
    driver) and keeps the bucket(s) holding the target ranks. Once a
    column's candidates number at most ``slice_max`` (or buckets stop
    splitting them) a final scan counts the candidates per distinct value and
    a running count over that small table picks the two order statistics."""
    from pyspark.sql import Window

    if ranges is None:
        aggs = []
        for i, c in enumerate(cols):
            x = F.col(c).cast("double")
            aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
        r = df.agg(*aggs).first()
        ranges = {c: (int(r[f"n{i}"]), r[f"a{i}"], r[f"b{i}"]) for i, c in enumerate(cols)}
    out: dict = {c: None for c in cols}
    st = {}
    x = F.col("x")
    for c in cols:
        n, lo, hi = ranges[c]
        if not n:
            continue
        pos = (n - 1) * q
        k1, k2 = int(np.floor(pos)), int(np.ceil(pos))
        if lo == hi:
            out[c] = float(lo)
            continue
        st[c] = {"k1": k1, "k2": k2, "frac": pos - k1, "lo": float(lo), "hi": float(hi), "below": 0, "count": n,
                 "pred": x.isNotNull(), "idx": len(st)}
    if not st:
        return out
    name_of = {s["idx"]: c for c, s in st.items()}
    long = _long(df, list(st))
    for _ in range(max_levels):
        pend = {c: s for c, s in st.items() if s["count"] > slice_max and s["hi"] > s["lo"]}
        if not pend:
            break
        for c, s in pend.items():
            s["w"] = (s["hi"] - s["lo"]) / buckets
            s["bexpr"] = F.least(F.greatest(F.floor((x - F.lit(s["lo"])) / F.lit(s["w"])), F.lit(0)),
                                 F.lit(buckets - 1)).cast("int")
        hist: dict = {}
        rows = long.where(_by_column(pend, "pred")).groupBy("column", _by_column(pend, "bexpr").alias("b")).agg(
            F.count(F.lit(1)).alias("c")).collect()  # <= buckets rows per column
        for r in rows:
            hist.setdefault(name_of[r["column"]], []).append((r["b"], r["c"]))
        for c, s in pend.items():
            acc, b1, b2, before1 = s["below"], None, None, None
            for b, cnt in sorted(hist.get(c, [])):
                if b1 is None and acc + cnt > s["k1"]:
                    b1, before1 = b, acc
                if b2 is None and acc + cnt > s["k2"]:
                    b2 = b
                acc += cnt
            if b1 is None or b2 is None:
                raise RuntimeError(f"quantile of {c}: target rank outside the histogram")
            inside = sum(cnt for b, cnt in hist[c] if b1 <= b <= b2)
            lo = s["lo"]
            s["pred"] = s["pred"] & s["bexpr"].between(b1, b2)
            s["lo"], s["hi"] = lo + b1 * s["w"], lo + (b2 + 1) * s["w"]
            if inside >= s["count"]:  # buckets no longer split the candidates (a repeated value)
                s["hi"] = s["lo"]
            s["below"], s["count"] = before1, inside
    sl = long.where(_by_column(st, "pred")).groupBy("column", x.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("column").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    below = F.create_map(*[e for s in st.values() for e in (F.lit(s["idx"]), F.lit(s["below"]))])
    ks = F.create_map(*[e for s in st.values() for e in (F.lit(s["idx"]), F.array(F.lit(s["k1"]), F.lit(s["k2"])))])
    sl = sl.withColumn("cum", F.sum("c").over(w) + below[F.col("column")]).withColumn("before", F.col("cum") - F.col("c"))
    kk = ks[F.col("column")]
    hit = ((F.col("before") <= kk[0]) & (kk[0] < F.col("cum"))) | ((F.col("before") <= kk[1]) & (kk[1] < F.col("cum")))
    picked: dict = {}
    for r in sl.where(hit).select("column", "v", "before", "cum").collect():  # <= 2 rows per column
        picked.setdefault(name_of[r["column"]], []).append((r["v"], r["before"], r["cum"]))
    for c, s in st.items():
        vals = picked.get(c, [])
        v1 = next((v for v, b, e in vals if b <= s["k1"] < e), None)
        v2 = next((v for v, b, e in vals if b <= s["k2"] < e), None)
        if v1 is None or v2 is None:
            raise RuntimeError(f"quantile of {c} not resolved")
        out[c] = v1 + (v2 - v1) * s["frac"]
    return out


def quantile(df: DataFrame, col: str, q: float, exact: bool = True, accuracy: int = 10_000) -> float:
    """One quantile of a column: exact (bounded refinement passes, see
    :func:`exact_quantiles`) or ``percentile_approx``."""
    if exact:
        v = exact_quantiles(df, [col], q)[col]
    else:
        v = df.agg(F.percentile_approx(F.col(col), F.lit(q), accuracy).alias("q")).first()["q"]
    return float(v) if v is not None else float("nan")


def dot_literal(cols: list[str], coefs, intercept: float = 0.0) -> Column:
    expr = F.lit(float(intercept))
    for c, w in zip(cols, coefs):
        expr = expr + F.lit(float(w)) * F.col(c).cast("double")
    return expr


def sq_dist_literal(cols: list[str], center) -> Column:
    expr = None
    for c, m in zip(cols, center):
        t = (F.col(c).cast("double") - F.lit(float(m))) * (F.col(c).cast("double") - F.lit(float(m)))
        expr = t if expr is None else expr + t
    return expr
