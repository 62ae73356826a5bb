"""Run registered queries on Spark and their oracle SQL on DuckDB; compare
row counts, column names and values (order-insensitive, exact after
normalising numeric types). Usage: python tools/oracle_check.py [ids...]"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from quarry.plans.registry import ORACLE, QUERIES, load_all  # noqa: E402
from quarry.session import TABLES, get_spark  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    try:
        from decimal import Decimal

        if isinstance(v, Decimal):
            return round(float(v), 9)
    except Exception:
        pass
    return v


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "smallint": "SMALLINT"}


def key(row):
    return tuple((0, "") if x is None else (1, str(x)) for x in row)


def main(ids):
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    load_all()
    spark = get_spark()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    names = ids or list(QUERIES)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            sdf = QUERIES[name](spark, sf)
            cols = sdf.columns
            srows = [tuple(norm(v) for v in r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in ORACLE:
            print(f"rows  {name}: {len(srows)} rows ({ts:.1f}s)")
            continue
        try:
            res = con.execute(ORACLE[name])
            ocols = [c[0] for c in res.description]
            orows = [tuple(norm(v) for v in r) for r in res.fetchall()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(cols) != sorted(ocols):
            print(f"FAIL  {name}: columns {cols} vs {ocols}")
            bad += 1
            continue
        otypes = {d[0]: str(d[1]) for d in res.description}
        stypes = dict(sdf.dtypes)
        tdiff = [(c, stypes[c], otypes[c]) for c in cols if SPARK_TO_DUCK.get(stypes[c], stypes[c]).upper() != otypes[c].upper()]
        if tdiff:
            print(f"TYPE  {name}: {tdiff}")
        idx = [ocols.index(c) for c in cols]
        orows = [tuple(r[i] for i in idx) for r in orows]
        if len(srows) != len(orows):
            print(f"FAIL  {name}: rows {len(srows)} vs {len(orows)}")
            bad += 1
            continue
        a, b = sorted(srows, key=key), sorted(orows, key=key)
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        if diff:
            print(f"FAIL  {name}: {len(diff)} differing rows, e.g. {diff[:2]}")
            bad += 1
        else:
            print(f"ok    {name}: {len(srows)} rows ({ts:.1f}s)")
    print(f"{bad} failing of {len(names)}")


if __name__ == "__main__":
    main(sys.argv[1:])
