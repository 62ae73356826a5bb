"""Prefix trie: SQL, a plain trie, centroid rollups, odd rows."""
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from quarry.llm import centroid_rollup, prefix_trie
from quarry.llm.queries import ORACLE, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def plain(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    convs = {c: [x[3:] for x in sorted(t)] for c, t in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = convs.get(base, [])[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    out = []
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        totals[node] = (sum(totals[k][0] for k in kids[node]) if kids[node] else 1, own + sum(totals[k][1] for k in kids[node]))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids[node]), *totals[node],
                    hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n=160):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-60, 400), n):
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            # few different turns, so that prefixes meet
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(["a b", "c", "d e f"])))
    return rows


def test_query_equals_sql(spark, duck):
    got = QUERIES["op11_prefix_trie"](spark, "/root/testdata/sf0.001")
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == sorted(duck.execute(ORACLE["op11_prefix_trie"]).fetchall(), key=str)


@pytest.mark.parametrize("seed,local", [(1, 4096), (2, 6)])
def test_against_a_plain_trie(spark, seed, local):
    rows = conversations(seed)
    # a long conversation, identical ones, and chains that hang on chains
    rows += [(1000, t, "user", f"x{t % 3}") for t in range(300)] + [(2000 + i, t, "user", "same words") for i in range(90) for t in range(3)]
    rows += [(5000 + 20 * i, t, "user", f"s{t}" if t < i else f"e{i}") for i in range(40) for t in range(i + 1)]
    got = prefix_trie.rebuilt_trie(spark.createDataFrame(rows, SCHEMA), local)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)  # several blocks a conversation
    rows = [(0, None, None, None), (0, 1, "user", "a"), (0, 1, "user", "a"), (0, 0, "", ""), (3, 5, None, "tail"), (None, 0, "user", "nobody"),
            (7, 0, "user", "only"), (20, 0, "u", "long " * 50_000)] + [(40, t % 7, "r", f"t{t}") for t in range(30)] + [(41, t, "r", "z") for t in range(9)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", p long, c string")
    got = prefix_trie.rebuilt_trie(df)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)
    assert prefix_trie.rebuilt_trie(df.limit(0)).count() == 0
    # one conversation that has no turn left
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    got = prefix_trie.rebuilt_trie(spark.createDataFrame([(lone, 0, "u", "t")], SCHEMA))
    assert sorted(map(tuple, got.collect()), key=str) == plain([(lone, 0, "u", "t")])


def test_portions_of_identifiers(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_PER_PART", 3)
    rows = [(i % 3, 0, i) for i in range(-20, 200)]
    got = prefix_trie.ends_digest(spark.createDataFrame(rows, "k1 long, k2 long, c long").repartition(5), ["k1", "k2"], "c")
    want = {k: hashlib.sha256(",".join(str(c) for a, _, c in rows if a == k).encode()).hexdigest() for k in range(3)}
    assert {r["k1"]: r["ends_sha256"] for r in got.collect()} == want


def forest(kind, n=300):
    rng = random.Random(kind)
    if kind == "path":
        return [i - 1 for i in range(n)]
    if kind == "star":
        return [-1] + [0] * (n - 1)
    if kind == "broom":
        return [i - 1 if i < n // 2 else n // 2 - 1 for i in range(n)]
    return [-1 if rng.random() < 0.02 else rng.randrange(max(0, i - 40), i) if i else -1 for i in range(n)]


def sums(parent, value):
    out = list(value)
    for v in reversed(range(len(parent))):  # parents come first in these forests
        if parent[v] >= 0:
            out[parent[v]] += out[v]
    return out


@pytest.mark.parametrize("kind", ["path", "star", "broom", "random"])
def test_local_decomposition(kind):
    parent = forest(kind)
    values = [list(range(len(parent))), [v % 7 for v in range(len(parent))]]
    assert centroid_rollup.decompose(parent, values) == [sums(parent, x) for x in values]


@pytest.mark.parametrize("kind", ["path", "random"])
def test_spark_decomposition(spark, kind):
    parent = forest(kind, 70)
    rows = [(10 + v, None if p < 0 else 10 + p, v, None if v % 5 == 0 else 2) for v, p in enumerate(parent)]
    df = spark.createDataFrame(rows, "node long, parent long, a long, b long")
    got = {r["node"] - 10: (r["a"], r["b"]) for r in centroid_rollup.rollup(df, ["a", "b"], local_nodes=24).collect()}
    want = zip(sums(parent, range(len(parent))), sums(parent, [0 if v % 5 == 0 else 2 for v in range(len(parent))]))
    assert got == dict(enumerate(want))


def test_cycles_and_unknown_parents(spark):
    with pytest.raises(ValueError):
        centroid_rollup.decompose([1, 0], [[1, 1]])
    schema = "node long, parent long, a long"
    with pytest.raises(ValueError):
        centroid_rollup.rollup(spark.createDataFrame([(1, 2, 1), (2, 1, 1)], schema), ["a"])
    got = centroid_rollup.rollup(spark.createDataFrame([(1, 99, 5), (2, 1, 7)], schema), ["a"])
    assert sorted(map(tuple, got.collect())) == [(1, 12), (2, 7)]
