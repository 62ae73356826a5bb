"""Toxicity: held-out accuracy, deobfuscation, odd rows."""
import numpy as np
import pytest

from quarry.llm import toxicity as t
from quarry.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def counts(spark):
    return t.trigram_counts(spark.read.parquet(f"{SF}/documents.parquet"))


def test_trigram_counts_equal_plain(spark):
    texts = ["Ab é, x1", "", None, "zz\nz"]
    got = t.trigram_counts(spark.createDataFrame([(x,) for x in texts], "text string").repartition(1))
    code = lambda c: 0 if not c.isalpha() else 5 if c == "é" else ord(c.lower()) - 96
    want = np.zeros(t.CODES**3)
    c = [code(x) for x in "\n\n".join(["\n", *[x or "" for x in texts], "\n"])]
    for a, b, d in zip(c, c[1:], c[2:]):
        want[(a * t.CODES + b) * t.CODES + d] += 1
    want[0] = 0
    assert (got == want).all()


@pytest.mark.parametrize("hidden", ["1d10t", "id!ot", "IDIOT!!", "iiiidiot", "idiooooot", "i d i o t", "i.d.i.o.t", "I-D-I-O-T", "1 d 1 0 t"])
def test_restores(counts, hidden):
    r = t.Reader(counts)
    assert "idiot" in r.restore(f"you {hidden} there").split(), r.restore(f"you {hidden} there")


HIDDEN = ["id.iot", "id-iot", "st upid", "idiiot", "a s s", "i  d  i  o  t", "i/d/i/o/t", "i\nd\ni\no\nt"]


@pytest.mark.parametrize("hidden", HIDDEN)
def test_second_readings(spark, counts, hidden):
    known = {"idiot": 3.0, "stupid": 3.0, "ass": 3.0}
    r = t.Reader(counts)
    assert known.keys() & set(r.restore(f"you {hidden} there", known).split()), r.restore(f"you {hidden} there", known)
    clean = "well-known good books, and/or e.g. the pass of an assembly; a big cat sat st. john"
    assert not known.keys() & set(r.restore(clean, known).split())
    df = spark.createDataFrame([(1, f"you {hidden} there"), (2, clean)], "doc_id long, text string")
    got = {x["doc_id"]: x["strongest"] for x in t.evidence_of(df, counts, known).collect()}
    # three letters are too short for a second reading, but not for letters spaced out
    assert got[1] == 3.0 and got[2] == 0.0


def test_viterbi_is_the_cheapest_path(counts):
    ch = t.Channel(counts)
    best = ch.decode("m0r1n")
    seen = {}
    for a in [("o", t.COST["leet"]), (" ", t.COST["break"])]:
        for b in [("i", t.COST["leet"]), ("l", t.COST["leet"]), (" ", t.COST["break"])]:
            s, price = f"m{a[0]}r{b[0]}n ", a[1] + b[1]
            x = y = 0
            for c in s:
                z = 0 if c == " " else ch.code(c)
                if z or y:
                    price += ch.cost[x][y][z]
                x, y = (0, 0) if not z else (y, z)
            seen[" ".join(s.split())] = min(price, seen.get(" ".join(s.split()), 1e9))
    assert best == min(seen, key=seen.get)


def test_clean_words_stay(counts):
    r = t.Reader(counts)
    s = "the quick (brown) fox, 2019 and 555-3733 were 3.14 a b c"
    assert {"the", "quick", "brown", "fox", "and", "were"} <= r.distinct(s)


def test_held_out(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = QUERIES["op6_toxicity"](spark, SF).collect()
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and labels.get(r["doc_id"]) is not None]
    y, p = map(np.array, zip(*held))
    assert len(held) > 50 and (p[y == 1] == 1).mean() > 0.6 and (p[y == 0] == 1).mean() < 0.03


def test_rows(spark, counts):
    rows = [(1, ""), (2, None), (None, "no id"), (3, "bad w0rd " * 30_000), (3, "again"), (4, "x" * 100_000), (5, "\x00 🙂 1 2 3 4")]
    df = spark.createDataFrame([(k, x, "c") for k, x in rows], "doc_id long, text string, evidence string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = t.score_documents(df, none).collect()
    assert len(got) == len(rows) and all(r["score"] < 0.3 for r in got)
    some = spark.createDataFrame([(1, 0, 0), (2, None, None), (3, 1, 1), (3, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert t.score_documents(df, some).count() == len(rows)
    assert t.score_documents(df.limit(0), some).count() == 0
    assert t.restore(df, counts).count() == len(rows)
