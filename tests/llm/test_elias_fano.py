"""Elias-Fano select, file round trip against the tokenizers library."""
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import elias_fano as ef

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_select_equals_the_values():
    rnd = random.Random(2)
    for n, top in ((1, 0), (1, 10**12), (5, 3), (1000, 100), (1000, 10**9), (300, 0)):
        v = sorted(rnd.randrange(top + 1) for _ in range(n))
        e = ef.EliasFano.from_bytes(ef.EliasFano.encode(v).to_bytes())
        assert [e.select(i) for i in range(n)] == v
    assert ef.EliasFano.encode([]).n == 0
    v = np.cumsum([400] * 10_000)
    assert len(ef.EliasFano.encode(v).to_bytes()) < 10_000 * 2  # 64-bit offsets: 80,000 bytes


def want(rows):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    out, at = [], 0
    for k, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        out.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("small", [False, True])
def test_documents_and_small_blocks(spark, monkeypatch, tmp_path, small):
    if small:  # several blocks a file and several files a task
        monkeypatch.setattr(ef, "BLOCK_IDS", 2000)
        monkeypatch.setattr(ef, "FILE_BLOCKS", 2)
        docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
        ef.write_token_files(docs.coalesce(1), str(tmp_path / "ids"), PATH)
        files = [f for f in os.listdir(tmp_path / "ids") if f.startswith("part-")]
        assert len(files) > 8  # more than tasks
        assert max(sum(1 for _ in ef.blocks_in((tmp_path / "ids" / f).read_bytes())) for f in files) == 2
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = sorted(tuple(r) for r in ef.token_files(docs, PATH).collect())
    assert got == want(rows)


def test_select_keeps_nothing_but_its_sections():
    rng = np.random.default_rng(1)
    for steps in (rng.integers(0, 5000, 10_000), np.r_[np.zeros(3000, int), [10**9], np.ones(3000, int)], [7], []):
        v = np.cumsum(np.concatenate([[0], steps])).astype(np.uint64)
        x = ef.EliasFano.from_bytes(ef.EliasFano.encode(v).to_bytes())
        assert [x.select(i) for i in range(len(v))] == v.tolist()
        held = sum(len(bytes(a)) if isinstance(a, bytes) else a.nbytes for a in vars(x).values() if isinstance(a, (bytes, np.ndarray)))
        assert held <= len(x.to_bytes())


def test_odd_rows(spark):
    texts = ["", None, "a\nb\tc  d", "<|endoftext|> x<|startoftext|>y", "É é ŉ ÀÉ İ K ſ", " ̃a", "日本 語🙂", "don't WE'VE 12 3.5", "w " * 50_000, "x\x1cy\x85z\xa0q"]
    rows = [(i * 10**12 - 5, x, i) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = sorted(tuple(r) for r in ef.token_files(df, PATH).collect())
    assert got == want([(k, x) for k, x, _ in rows])
    assert ef.token_files(df.limit(0), PATH).count() == 0
    ties = spark.createDataFrame([(3, "a b"), (None, "c"), (3, "a b"), (None, None), (-1, "q r s")], "doc_id long, text string")
    got = sorted(ef.token_files(ties, PATH).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, -1, 3, 3]
    assert sum(r["n_tokens"] for r in got) == got[-1]["start"] + got[-1]["n_tokens"] == 13
