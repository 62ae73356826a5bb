"""License scan: against plain Python and the SQL, odd rows."""
import re

from quarry.llm import license_scan as ls
from quarry.llm.queries import ORACLE, QUERIES


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = {p: [i for i in range(len(w)) if w[i:i + len(p.split())] == p.split()] for p in ls.phrases_of(ls.TEMPLATES)}
    base = sorted(i for p in ls.BASE.values() for i in places[p])
    share = max(sum(len(p.split()) for p in ps if places[p]) / sum(len(p.split()) for p in ps) for ps in ls.TEMPLATES.values())
    return (len(w), len(base), base[0] if base else None, base[-1] if base else None,
            ",".join(sorted(k for k, p in ls.BASE.items() if places[p])),
            ",".join(sorted(k for k, ps in ls.TEMPLATES.items() if all(places[p] for p in ps))), round(share, 9))


TEXTS = ["", None, "MIT License", "the GNU  General-Public\nLICENSE, version 3; Apache License. cc BY-NC 4.0", "mit mit license mit license",
         "Éapache license", "apache licensé", "worK MIT \x00License K", "gnu general public licenses", "license " * 20000 + "cc by",
         "Redistribution and use in source and binary forms, with or without modification, are permitted", "x" * 50000, "All rights reserved."]


def test_odd_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], "y"), (3, TEXTS[3], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = ls.scan(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == plain(TEXTS[3] if r["doc_id"] is None else TEXTS[r["doc_id"]]), r["doc_id"]
    assert ls.scan(df.limit(0)).count() == 0


def test_query_equals_sql(spark, duck):
    got = sorted(tuple(r) for r in QUERIES["op2_license_scan"](spark, "/root/testdata/sf0.001").collect())
    assert got == sorted(duck.execute(ORACLE["op2_license_scan"]).fetchall())
    assert sum(r[2] for r in got) > 0


def test_no_python_in_the_plan(spark):
    plan = ls.scan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
