"""Components: exact on long chains in bad id order, stars, odd rows."""
import random

from quarry.functions.components import connected_components


def test_chain_in_bad_order_is_one_component(spark):
    rnd = random.Random(3)
    for n in (300, 5000):
        ids = list(range(n))
        rnd.shuffle(ids)
        df = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
        got = connected_components(df).collect()
        assert len(got) == n and {r["component"] for r in got} == {0}


def test_matches_union_find_with_nulls_loops_repeats(spark):
    rnd = random.Random(5)
    pairs = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)]
    rows = pairs + pairs[:20] + [(7, 7), (None, 3), (4, None)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    want = {(x, find(x)) for x in up}
    got = {(r["node"], r["component"]) for r in connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
