"""Mixing: targets against a plain water filling, SQL, odd rows."""
import pytest

from quarry.llm import mixing
from quarry.llm.queries import ORACLE, QUERIES


def fill(sizes, weights, cap=3):
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in capped]
        if not free:
            return {s: cap * sizes[s] for s in sizes}
        level = (total - sum(cap * sizes[s] for s in capped)) / sum(weights[s] for s in free)
        above = [s for s in free if weights[s] * level > cap * sizes[s]]
        if not above:
            return {s: cap * sizes[s] if s in capped else weights[s] * level for s in sizes}
        capped |= set(above)


@pytest.mark.parametrize("sizes", [{"a": 5, "b": 1000, "c": 3, "d": 10, "e": 400, None: 77, "f": 0},
                                   {"a": 1, "b": 2, "c": 4, "d": 8, "e": 16, "f": 32, "g": 6400}, {"a": 10}])
def test_targets(spark, sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: i % 3 + 1 for i, s in enumerate(order)}
    rows = [(s, n // 2) for s, n in sizes.items()] + [(s, n - n // 2) for s, n in sizes.items()]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = fill(sizes, weights)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_query_equals_sql(spark, duck):
    got = sorted(tuple(r) for r in QUERIES["op3_mix_sources"](spark, "/root/testdata/sf0.001").collect())
    want = sorted(duck.execute(ORACLE["op3_mix_sources"]).fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:3] == b[:3] and a[4] == b[4] and abs(a[3] - b[3]) < 1e-6


def test_rows_and_reruns(spark):
    rows = [(i, None if i % 7 == 0 else " ".join(["w"] * (i % 40)), ["a", "b", None][i % 3], i) for i in range(600)]
    rows += [(5, "same row", "a", 1)] * 3 + [(None, "no key", "b", 2), (9000, "word " * 30_000, "a", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    a = mixing.mix_plan(df)
    first, again = sorted(map(str, a.collect())), sorted(map(str, mixing.mix_plan(df.repartition(7)).collect()))
    assert first == again and len(first) == len(rows)
    for r in a.collect():
        assert 0 <= r["taken"] <= 3 * r["size"]
    out = mixing.mix(df)
    assert out.columns == df.columns
    assert out.count() == a.agg({"copies": "sum"}).first()[0]
    assert mixing.mix_plan(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0
