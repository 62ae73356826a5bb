"""Exact dedup: SQL, plain groups, weak digests, later files, odd rows."""
import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import stream_dedup
from quarry.llm.queries import ORACLE, QUERIES

ROWS = [(1, "a b"), (2, "a b"), (3, "A b"), (4, None), (5, ""), (6, "a b "), (7, "x\ny"), (7, "x\ny"), (None, "x\ny"), (None, "only"),
        (None, "only"), (8, "long " * 200_000), (9, "long " * 200_000), (10, "long " * 200_000 + "z")] + [(100 + i, "hot") for i in range(400)]


def plain(rows):
    groups = defaultdict(list)
    for k, t in rows:
        groups[t or ""].append(k)
    low = -10**9
    out = []
    for t, ks in groups.items():
        keep = max(ks, key=lambda k: low if k is None else k)
        out += [(k, keep, len(ks), hashlib.sha256(t.encode()).hexdigest()) for k in ks]
    return sorted(out, key=str)


def written(df, path, files=3):
    df.repartition(files).write.parquet(path)
    return path


def result(found):
    return found.select("doc_id", F.col("kept.doc_id").alias("keep_id"), "n", stream_dedup.stays().alias("stays"),
                        F.lower(F.hex("digest")).alias("h")).collect()


def test_query_equals_sql(spark, duck):
    got = QUERIES["op13_stream_dedup"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(duck.execute(ORACLE["op13_stream_dedup"]).fetchall())


@pytest.mark.parametrize("options", [None, {"maxFilesPerTrigger": "1"}])
def test_rows(spark, tmp_path, options):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = result(stream_dedup.duplicates(spark, written(df, str(tmp_path / "in")), options=options))
    assert sorted(((r[0], r[1], r[2], r[4]) for r in got), key=str) == plain(ROWS)
    # one row of each group stays, and it is one with the kept identifier
    assert sum(r["stays"] for r in got) == len({t or "" for _, t in ROWS})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["stays"])


def test_equal_digests_of_different_texts(spark, tmp_path):
    """A digest of two values: the full texts decide."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    weak = lambda t: F.unhex(F.lpad((F.length(t) % 2).cast("string"), 2, "0"))
    got = result(stream_dedup.duplicates(spark, written(df, str(tmp_path / "in")), digest=weak))
    assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == sorted((r[:3] for r in plain(ROWS)), key=str)
    assert sum(r["stays"] for r in got) == len({t or "" for _, t in ROWS})


def test_later_files_meet_the_state(spark, tmp_path):
    path, state = str(tmp_path / "in"), str(tmp_path / "state")
    spark.createDataFrame(ROWS[:5], "doc_id long, text string").write.parquet(path)
    assert stream_dedup.duplicates(spark, path, state).count() == 5
    spark.createDataFrame(ROWS[5:] + [(50, "a b")], "doc_id long, text string").write.mode("append").parquet(path)
    got = result(stream_dedup.duplicates(spark, path, state))
    assert sorted(((r[0], r[1], r[2], r[4]) for r in got), key=str) == plain(ROWS + [(50, "a b")])
    assert {r["n"] for r in stream_dedup.seen(spark, state).filter(F.col("kept.doc_id") == 50).collect()} == {3}


def test_dedup_keeps_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(k, t, i, f"f{i}", "d") for i, (k, t) in enumerate(ROWS)],
                               "doc_id long, text string, row int, file string, digest string")
    got = stream_dedup.dedup(df)
    assert got.columns == df.columns
    assert sorted(t or "" for t, in got.select("text").collect()) == sorted({t or "" for _, t in ROWS})
    assert stream_dedup.dedup(df.limit(0)).count() == 0
