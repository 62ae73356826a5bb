"""Every SQL-expressible query equals its DuckDB oracle (sf0.001)."""
import datetime as dt
import math

import pytest

from quarry.plans.registry import ORACLE, QUERIES, load_all

load_all()
SF = "/root/testdata/sf0.001"


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def _key(r):
    return tuple((0, "") if x is None else (1, str(x)) for x in r)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF)
    cols = sdf.columns
    got = sorted((tuple(_norm(v) for v in r) for r in sdf.collect()), key=_key)
    res = duck.execute(ORACLE[name])
    ocols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(ocols)
    otypes = {d[0]: str(d[1]).upper() for d in res.description}
    for c, t in sdf.dtypes:
        assert SPARK_TO_DUCK.get(t, t).upper() == otypes[c], (c, t, otypes[c])
    idx = [ocols.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=_key)
    assert got == want
