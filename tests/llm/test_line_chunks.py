"""Line chunks against a plain version; planted passages; odd rows."""
import hashlib
import random

from quarry.llm import line_chunks as lc


def hashed(x):
    return int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")


def plain(rows):
    """Line dedup with dictionaries over the texts of the chunks; ``rows`` (doc_id, text), doc_ids unique."""
    key = lambda r: (r[0] is None, r[0] or 0)
    docs, places = {}, {}
    for k, t in sorted(rows, key=key):
        lines = t.split("\n") if t else []
        full = [i for i, x in enumerate(lines) if x.strip()]
        roll = [(hashed(lines[i]) * 0x9E3779B97F4A7C15 + hashed(lines[j])) % 2**64 for i, j in zip(full, full[1:])]
        mine = []
        for n, (i, j) in enumerate(zip(full, full[1:])):
            near = roll[max(0, n - 1):n] + roll[n + 1:n + 2]
            words = lines[i].split() + lines[j].split()
            if not near or roll[n] <= max(near) or (len(words) >= 50):
                mine.append((i, j + 1, full[n - 1] if n else None, full[n + 2] + 1 if n + 2 < len(full) else None))
        mine += [(i, i + 1, None, None) for i in full if len(lines[i].split()) >= 50]
        docs[k] = (t, lines, mine)
        for c in mine:
            places.setdefault((c[1] - c[0] == 1, tuple(lines[c[0]:c[1]])), []).append((k, c))
    stay, gone = {k: set() for k in docs}, {k: set() for k in docs}
    firsts = {p[0]: p for p in places.values()}
    covered = {k: set() for k in docs}
    for p in places.values():
        for k, c in p[1:]:
            covered[k].update(range(c[0], c[1]))
    for (k0, c0), p in firsts.items():
        first = docs[k0][1]
        if len(p) > 1:
            stay[k0].update(range(c0[0], c0[1]))
        for k, c in p[1:]:
            lines = docs[k][1]
            gone[k].update(range(c[0], c[1]))
            if c[2] is not None and c0[2] is not None and lines[c[2]:c[0]] == first[c0[2]:c0[0]]:
                stay[k0].update(range(c0[2], c0[0]))
                if not covered[k].issuperset(range(c[2], c[0])):
                    gone[k].update(range(c[2], c[0]))
            if c[3] is not None and c0[3] is not None and lines[c[1]:c[3]] == first[c0[1]:c0[3]]:
                stay[k0].update(range(c0[1], c0[3]))
                if not covered[k].issuperset(range(c[1], c[3])):
                    gone[k].update(range(c[1], c[3]))
    return {k: "\n".join(x for i, x in enumerate(lines) if i not in gone[k] - stay[k]) if t else t or "" for k, (t, lines, _) in docs.items()}


def stands_whole(rows, after):
    """Every removed line is in a passage of two lines or more (or a line of 50
    words) of its document that some document still has as it was."""
    kept = ["\n" + (t or "") + "\n" for t in after.values()]
    for k, t in rows:
        lines, left = (t or "").split("\n"), (after[k] or "").split("\n")
        full = [i for i, x in enumerate(lines) if x.strip()]
        if lines == left:
            continue
        # a line that may have gone: not all of its copies in the document remain
        for n, i in enumerate(full):
            if left.count(lines[i]) >= lines.count(lines[i]):
                continue
            pairs = [lines[full[m]:full[m + 1] + 1] for m in (n - 1, n) if 0 <= m < len(full) - 1]
            if len(lines[i].split()) >= 50:
                pairs.append([lines[i]])
            # a copy elsewhere in the document may be the one that went
            for j in full:
                if lines[j] == lines[i] and j != i:
                    m = full.index(j)
                    pairs += [lines[full[q]:full[q + 1] + 1] for q in (m - 1, m) if 0 <= q < len(full) - 1]
            assert any("\n" + "\n".join(p) + "\n" in x for p in pairs for x in kept), (k, i)


def line(rnd, n=8):
    return " ".join(f"w{rnd.randrange(3000)}" for _ in range(n))


def test_boundaries_depend_on_lines_only():
    rnd = random.Random(3)
    a = [line(rnd) for _ in range(60)]
    cut = lambda ls: {tuple(ls[c.start:c.stop]) for c in lc.chunks(ls)}
    whole = cut(a)
    assert len(whole) < 59 and {x for c in whole for x in c} >= set(a[1:-1])  # not every place, but nearly every line
    assert len(whole & cut(["new", *a])) >= len(whole) - 1
    assert len(whole & cut(a[:20] + ["new"] + a[20:])) >= len(whole) - 3
    starts = sorted(c.start for c in lc.chunks(a))
    assert max(y - x for x, y in zip(starts, starts[1:])) <= 2


def test_a_kept_passage_stays_whole(spark):
    rows = [(1, "A\nB"), (2, "A\nB\nC"), (3, "B\nC"), (4, "B\nC\nD"), (5, "C\nD")]
    got = {r["doc_id"]: r["text"] for r in lc.dedup(spark.createDataFrame(rows, "doc_id long, text string"), drop_emptied=False).collect()}
    assert got == plain(rows) and any("B\nC" in t for t in got.values()) and any("A\nB" in t for t in got.values())
    stands_whole(rows, got)
    assert sum(t.count("B") for t in got.values()) < 4


def test_removed_passages_stand_somewhere(spark):
    """Few different lines, so that runs overlap in every way."""
    for seed in range(4):
        rnd = random.Random(seed)
        rows = [(k, "\n".join(rnd.choice(["a", "b", "c", "d e", "f", "", "g", "h i j"]) for _ in range(rnd.randrange(1, 9)))) for k in range(120)]
        got = {r["doc_id"]: r["text"] for r in lc.dedup(spark.createDataFrame(rows, "doc_id long, text string"), drop_emptied=False).collect()}
        assert got == plain(rows)
        stands_whole(rows, got)


def test_planted_passages(spark):
    rnd = random.Random(5)
    block = [line(rnd) for _ in range(12)]
    wide = line(rnd, 60)
    rows = []
    for k in range(200):
        ls = [line(rnd) for _ in range(rnd.randrange(1, 9))]
        if k % 3 == 0:
            ls[1:1] = block
        if k % 4 == 0:
            ls.append(wide)
        ls.insert(0, "All rights reserved.")
        rows.append((k, "\n".join(ls)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows)
    got = {r["doc_id"]: r for r in lc.report(df).collect()}
    assert len(got) == 200
    for k, t in rows:
        assert got[k]["clean_sha256"] == hashlib.sha256(want[k].encode()).hexdigest() and got[k]["n_lines"] == t.count("\n") + 1
    assert sum(r["n_removed"] for r in got.values()) > 66 * 6
    assert sum(wide in t for t in want.values()) == 1 and all("All rights reserved." in t for t in want.values())
    texts = {r["doc_id"]: r["text"] for r in lc.dedup(df, drop_emptied=False).collect()}
    assert texts == want


def test_equal_hashes_of_different_bytes_stay(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(k, "\n".join(line(rnd) for _ in range(6))) for k in range(20)] + [(99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(lc, "chunk_hash", lambda parts: b"same")
    assert {r["doc_id"]: r["text"] for r in lc.dedup(df).collect()} == dict(rows)


def test_real_documents_and_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = plain(rows)
    got = {r["doc_id"]: r["text"] for r in lc.dedup(docs, drop_emptied=False).collect()}
    assert got == want and any(want[k] != t for k, t in rows)
    stands_whole(rows, got)
    two = "a b\nc d\ne f\ng h"
    rows = [(1, ""), (2, None), (3, two), (3, two), (None, two), (5, "\n\n\n"), (6, "\n\n\n"), (7, "long " * 40_000), (8, "x\n" * 20_000)]
    df = spark.createDataFrame([(k, t, "c") for k, t in rows], "doc_id long, text string, repeated string")
    out = lc.dedup(df, drop_emptied=False)
    assert out.columns == df.columns and out.count() == len(rows) and lc.report(df).count() == len(rows)
    texts = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert texts.count((3, two)) == 2 and (5, "\n\n\n") in texts and (6, "\n\n\n") in texts and (2, None) in texts
    assert lc.report(df.limit(0)).count() == 0 and lc.dedup(df.limit(0)).count() == 0


def test_short_passages_go_whole(spark):
    rnd = random.Random(8)
    rows, passages = [], []
    for n in range(3, 9):  # passages of 3 to 8 lines and over 50 words between lines of the document's own
        for _ in range(5):
            p = [line(rnd, 18) for _ in range(n)]
            if n % 2:
                p.insert(2, "")
            passages.append(p)
            for _ in range(2):
                rows.append((len(rows), "\n".join([line(rnd), line(rnd), *p, line(rnd), line(rnd)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"].split("\n") for r in lc.dedup(df).collect()}
    for i, p in enumerate(passages):
        first, second = rows[2 * i][1].split("\n"), rows[2 * i + 1][1].split("\n")
        assert got[2 * i] == first and got[2 * i + 1] == second[:2] + second[-2:]
