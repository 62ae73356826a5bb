"""The pipeline stage by stage against the plain versions of the operators."""
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline as cp
from quarry.llm import mixing, quality
from quarry.llm.common import saved
from tests.llm.test_line_chunks import plain as plain_lines
from tests.llm.test_mixing import fill
from tests.llm.test_prob_minhash import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(saved(stage(spark, out[-1], SF), name))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(steps):
    for df in steps[1:-1]:
        assert df.dtypes == steps[0].dtypes


def test_quality(spark, steps):
    score = {r["doc_id"]: r["predicted"] for r in quality.score_documents(steps[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert set(rows(steps[1])) == {k for k, v in score.items() if v == 1} and len(rows(steps[1])) < steps[0].count()


def test_lines(steps):
    before, after = rows(steps[1]), rows(steps[2])
    want = plain_lines([(k, r["text"]) for k, r in before.items()])
    assert {k: r["text"] for k, r in after.items()} == {k: t for k, t in want.items() if t or not before[k]["text"]}
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())


def test_near(steps):
    before, after = rows(steps[2]), rows(steps[3])
    classes = brute([(k, r["text"]) for k, r in before.items()])
    assert set(after) == set(classes.values()) and all(after[k] == before[k] for k in after)


def test_mix(steps):
    before = rows(steps[3])
    copies = Counter(r["doc_id"] for r in steps[4].collect())
    size = {k: len(r["text"].split()) for k, r in before.items()}
    per: dict = {}
    for k, r in before.items():
        per[r["source"]] = per.get(r["source"], 0) + size[k]
    order = sorted(per, key=lambda s: (s is None, s or ""))
    target = fill(per, {s: i % 3 + 1 for i, s in enumerate(order)})
    for k, r in before.items():
        rate = target[r["source"]] / per[r["source"]]
        u = int(hashlib.md5(f"{mixing.SEED}:{k}".encode()).hexdigest()[:13], 16) / 2**52
        assert copies[k] == int(rate) + (u < rate - int(rate)), k


def test_bpe(steps):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = rows(steps[4])
    out = steps[5].collect()
    assert len(out) == steps[4].count()
    for r in out:
        ids = t.encode(texts[r["doc_id"]]["text"], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_run_and_registration(spark, steps):
    q = __spark_entry__.queries()
    assert {int(k[2:].split("_")[0]) for k in q if k.startswith("op")} == set(range(1, 14)) and "pipeline" in q
    got = sorted(tuple(r) for r in q["pipeline"](spark, SF).collect())
    assert got == sorted(tuple(r) for r in steps[5].collect())


def test_other_columns_and_empty_tables(spark, steps):
    docs = steps[0].limit(30).withColumn("ids", F.lit("x")).withColumn("class_id", F.lit(1)).withColumn("__gone2", F.lit(2))
    for df in (docs, docs.limit(0)):
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == df.columns, name
        assert cp.STAGES[-1][1](spark, df, SF).count() == df.count()
