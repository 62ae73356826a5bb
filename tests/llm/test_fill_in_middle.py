"""Fill-in-middle: SQL, a plain version, the learned index, odd rows."""
import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import fill_in_middle as fim
from quarry.llm.queries import ORACLE, QUERIES

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)
TEXTS = ["", None, "word", "two words", "é à ü <b> x", "a<S>b", "<P", "x<M>", "S> <", "日本語のテキスト", "a" * 5000, " " * 5000, "\n\nA1b2\n", "🙂🙃 ok",
         "w " * 60_000, "a" * 3000 + " b" * 3000 + "c" * 3000 + "1" * 9000, "<<S", "ends <P", "> starts", "M>"]


def plain(key, text):
    units = UNIT.findall(text or "")
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text or ""
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_query_equals_sql(spark, duck):
    got = QUERIES["op12_fill_in_middle"](spark, "/root/testdata/sf0.001")
    res = duck.execute(ORACLE["op12_fill_in_middle"])
    assert got.columns == [c[0] for c in res.description]
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(res.fetchall())
    assert {r[2] for r in rows} == {"plain", "psm", "spm"}


def test_rows(spark):
    rows = [(k * 31 + i, t) for k in range(12) for i, t in enumerate(TEXTS)] + [(None, "no key here"), (5, "same"), (5, "same")]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, n int, form string")
    got = sorted((tuple(r) for r in fim.report(df).collect()), key=str)
    want = []
    for k, t in rows:
        n, form, a, m, out = plain(k, t)
        want.append((k, n, form, a, m, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    made = fim.transform(df)
    assert made.columns == [*df.columns, "_form"]
    for r in made.collect():
        assert r["form"] == "x" and r["n"] == 7
    want = sorted(((k, t if plain(k, t)[1] == "plain" else plain(k, t)[4], plain(k, t)[1]) for k, t in rows), key=str)
    assert sorted(((r["doc_id"], r["text"], r["_form"]) for r in made.collect()), key=str) == want
    assert fim.report(df.limit(0)).count() == 0 and fim.transform(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abZ <>PSM\n\té日🙂", max_size=400), st.integers(-5, 10**6))
def test_cuts_and_restoring(text, key):
    n, form, a, b = fim.cut(text, key, fim.Options())
    want = plain(key, text)
    made = fim.output(text, form, a, b)
    assert (n, form, a, None if a is None else b - a, made) == want
    assert fim.restore(made, form) == text


@pytest.mark.parametrize("error", [1, 2, 8, 127])
def test_index_is_exact_and_bounded(error):
    rng = np.random.default_rng(1)
    for steps in (rng.integers(1, 12, 20_000), np.r_[np.ones(3000, int), np.full(3000, 40), rng.integers(1, 5000, 500)], [10**7], []):
        offsets = np.concatenate([[0], np.cumsum(steps)]).astype(np.int64)
        index = fim.RankIndex.fit(offsets, error)
        ranks = np.arange(len(offsets))
        assert (index.predict(ranks) + index.residual == offsets).all()
        assert np.abs(index.residual.astype(int)).max(initial=0) <= error
        assert len(index) == len(offsets) - 1
    text = "some words of various length " * 4000
    index = fim.RankIndex.fit(fim.boundaries(text))
    assert len(index.first) == 1  # an even text is one segment


def test_index_table(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in fim.rank_index(df).collect():
        text = TEXTS[r["doc_id"]] or ""
        index = fim.RankIndex(*(np.array(r[c]) for c in ("first", "base", "slope")), np.frombuffer(r["residual"], np.int8))
        ends = np.concatenate([[0], np.cumsum([len(u) for u in UNIT.findall(text)])]).astype(int)
        assert [index.offset(i) for i in range(0, len(ends), 1 + len(ends) // 50)] == ends[::1 + len(ends) // 50].tolist()
