"""Syncmer fingerprints against plain Python; order of the next document."""
import hashlib
import random
import re

import xxhash

from quarry.llm import syncmers as sy


def h64(*longs):
    seed = 42
    for x in longs:
        seed = xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), seed)
    return signed(seed)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain(text):
    w = [x for x in re.split("[ \t\n\x0b\f\r]+", text or "") if x]
    h = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in w] + [0] * (sy.K - 1)
    g = [h64(a, b) for a, b in zip(h, h[1:])]
    out, last = [], sy.K - sy.S
    for i in range(len(w)):
        inner = g[i:i + last + 1]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, (h64(*[g[i + j] for j in range(0, sy.K - sy.S + 1, sy.S)]) & (1 << 64) - 1) >> 32))
    return out


def smallest(text):
    return sorted({h for _, h in plain(text)})[:sy.SKETCH]


def near(a, b):
    if not a or not b:
        return float(not a and not b)
    both = sorted({*a, *b})[:sy.SKETCH]
    return len([x for x in both if x in a and x in b]) / len(both)


def texts():
    rnd = random.Random(4)
    vocab = ["the", "a", "größe", "x1", "—", "🙂", "of", "tion", "end."]
    return ["", None, "one", "  lead and trail \n", "same same same same same same same", " ".join(str(i) for i in range(4000))] + [
        " ".join(rnd.choice(vocab) + str(rnd.randrange(30)) for _ in range(rnd.randrange(1, 150))) for _ in range(60)]


def test_against_plain(spark):
    xs = texts()
    df = spark.createDataFrame([(i * 7 - 50, t, 1) for i, t in enumerate(xs)], "doc_id long, text string, n_chars int")
    got = {r["doc_id"]: r for r in sy.fingerprints(df).collect()}
    assert len(got) == len(xs)
    for i, t in enumerate(xs):
        t, nxt, r = t or "", xs[i - 1] or "", got[i * 7 - 50]
        half = len(t) // 2
        e = t[:len(t) - half] + nxt[:half]
        a, b, c = smallest(t), smallest(e), smallest(nxt)
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["fingerprint"] == "".join(f"{x:08X}" for x in a) and r["edited_fingerprint"] == "".join(f"{x:08X}" for x in b)
        assert r["near_edited"] == near(a, b) and r["near_next"] == near(a, c)
    row = df.select("doc_id", sy.anchors(df["text"]).alias("a")).filter("doc_id = -15").first()
    assert [(x["position"], x["hash"]) for x in row["a"]] == plain(xs[5])


def test_unchanged_passage_keeps_its_anchors():
    rnd = random.Random(9)
    w = [str(rnd.randrange(10**6)) for _ in range(300)]
    a = {h for _, h in plain(" ".join(w))}
    b = {h for _, h in plain(" ".join(["new"] * 7 + w))}
    assert len(a & b) >= len(a) - sy.K


def test_rows_and_order(spark):
    rows = [(3, "c"), (None, "n"), (3, "c2"), (9, "z"), (9, "z"), (10**15, "top")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "t")
    got = sy.with_next(df, ["t"]).collect()
    assert len(got) == len(rows)
    nxt = {(r["doc_id"], r["t"]): r["next_t"] for r in got}
    assert nxt[(10**15, "top")] == "z" and nxt[(None, "n")] == "top" and sorted(r["next_t"] for r in got) == sorted(t for _, t in rows)
    one = sy.with_next(df.filter("t = 'top'"), ["t"]).collect()
    assert [r["next_t"] for r in one] == ["top"]
    assert sy.with_next(df.limit(0), ["t"]).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    ids = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want = {a[0]: ids[i - 1][1] for i, a in enumerate(ids)}
    assert all(want[r["doc_id"]] == r["next_text"] for r in sy.with_next(docs, ["text"]).collect())
