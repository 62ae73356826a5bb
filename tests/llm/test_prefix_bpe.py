"""Trie BPE equals the tokenizers library, and decodes to the same text."""
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm.prefix_bpe import PrefixBpe, decode, encode, round_trip

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "\n\n  \t x", "a b　c\x1cd\x85e", "I'll we've don't 'S", "<|endoftext|>", "x<|endoftext|> y<|endoftext|>",
       "日本語のテキスト 🙂🙂 é ﻿", "1234567 3.14 a1b2", "!!! ... ***&&&", "x" * 5000, "ab " * 3000, "   leading", "trailing   ", "Éçouç été größe ñandú"]


def texts():
    rnd = random.Random(1)
    syl = ["th", "er", "ing", "é", "ß", "on", "qu", "9", "'", ".", " ", "  ", "\n", "A", "token", "ization", "\U0001f600"]
    return ODD + ["".join(rnd.choice(syl) for _ in range(rnd.randrange(1, 120))) for _ in range(400)]


def test_codec_equals_library():
    t = Tokenizer.from_file(PATH)
    c = PrefixBpe(open(PATH, encoding="utf-8").read())
    xs = [x or "" for x in texts()]
    for x, ids in zip(xs, c.encode_many(xs)):
        want = t.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, x[:80]
        assert c.decode(ids).decode() == t.decode(want, skip_special_tokens=False)


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    t = Tokenizer.from_file(PATH)
    got = {r["doc_id"]: r for r in round_trip(docs, PATH).collect()}
    for r in docs.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        g = got[r["doc_id"]]
        assert g["n_tokens"] == len(ids)
        assert g["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_rows(spark):
    rows = [(i, x, "kept") for i, x in enumerate(ODD)] + [(None, "no key", None), (3, ODD[3], "kept")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `n tokens` string")
    out = decode(encode(df, PATH), PATH).collect()
    assert len(out) == len(rows) and all(r["decoded"] == (r["text"] or "") for r in out)
    assert encode(df.limit(0), PATH).count() == 0 and round_trip(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        encode(df, PATH, ids="text")
