"""Token-id files whose document boundaries are Elias-Fano coded.

A file is a sequence of blocks. A block holds the ids of consecutive
documents (ascending doc_id) as one concatenated array, and two Elias-Fano
sequences: the document boundaries in that array, and the doc_ids. Boundary
``i`` is read back by ``select``: the position of the i-th one in the unary
coded upper halves, found from a sampled position, plus the packed lower
half; about 2 + log2(mean length) bits a document instead of 64.

Writing: documents are range partitioned by doc_id (equal ids are spread by a
hash of their text), each task encodes its documents and emits blocks of at
most ``BLOCK_IDS`` ids or one document, and Spark's writer puts them into the
shared folder, one file per task. Reading: Spark lists and reads the files;
each task decodes whole blocks. A document's global start is the number of
ids in earlier files (a sum over one row per file), in earlier blocks of its
file (kept in the block's header) and in its block (select).

Rows: a null text counts as empty; null doc_ids come first; repeated doc_ids
are kept, ordered by a hash of their text; an empty table gives no block and
no row; a document longer than a block has a block of its own. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import column_lists, portions, saved, with_schema
from quarry.llm.prefix_bpe import byte_alphabet
from quarry.session import scratch_path

BLOCK_IDS = 1 << 20
FILE_BLOCKS = 32
SAMPLE = 64  # every 64th one of the upper bits has its position stored
MAGIC = b"QEF1"
#: magic, task, ids before the block in its file, documents, of these with null doc_id, smallest doc_id, bytes per id, bytes of each of the three sections
HEAD = struct.Struct("<4sIQIIqBIII")


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @staticmethod
    def encode(values) -> "EliasFano":
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return EliasFano(0, 0, b"", b"", np.zeros(0, "<u4"))
        if np.any(v[1:] < v[:-1]):
            raise ValueError("the sequence must not decrease")
        low_bits = max(0, (int(v[-1]) // n).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        return EliasFano(n, low_bits, low, np.packbits(bits, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """Value ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        # from the stored place of the last sampled one, byte by byte
        pos, need = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = pos >> 3
        bits = self.high[byte] >> (pos & 7) << (pos & 7)
        while (ones := bits.bit_count()) <= need:
            need -= ones
            byte += 1
            bits = self.high[byte]
        for _ in range(need):
            bits &= bits - 1
        pos = (bits & -bits).bit_length() - 1
        low = 0
        if self.low_bits:
            at = i * self.low_bits
            raw = int.from_bytes(self.low[at >> 3:(at + self.low_bits + 7) >> 3], "little")
            low = raw >> (at & 7) & (1 << self.low_bits) - 1
        return (byte * 8 + pos - i) << self.low_bits | low

    def to_bytes(self) -> bytes:
        return struct.pack("<IBII", self.n, self.low_bits, len(self.low), len(self.high)) + self.low + self.high + self.samples.astype("<u4").tobytes()

    @staticmethod
    def from_bytes(b: bytes) -> "EliasFano":
        n, low_bits, nl, nh = struct.unpack_from("<IBII", b)
        at = struct.calcsize("<IBII")
        return EliasFano(n, low_bits, b[at:at + nl], b[at + nl:at + nl + nh], np.frombuffer(b, "<u4", offset=at + nl + nh))


def block_bytes(task: int, before: int, keys: list, ids: list[bytes], width: int) -> bytes:
    """One block; ``keys`` ascending with nulls first, ``ids`` in the given width."""
    nulls = sum(k is None for k in keys)
    real = [k for k in keys if k is not None]
    least = real[0] if real else 0
    lengths = np.fromiter((len(x) // width for x in ids), np.int64, len(ids))
    ends = EliasFano.encode(np.concatenate([[0], np.cumsum(lengths)])).to_bytes()
    names = EliasFano.encode([k - least for k in real]).to_bytes()
    body = b"".join(ids)
    return HEAD.pack(MAGIC, task, before, len(keys), nulls, least, width, len(ends), len(names), len(body)) + ends + names + body


def blocks_in(content: bytes):
    """The blocks of a file: (task, ids before, doc_ids, boundaries, id array).
    Blocks are separated by the line end that the writer puts between rows."""
    at = 0
    while at < len(content):
        magic, task, before, n, nulls, least, width, ne, nn, nb = HEAD.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        at += HEAD.size
        ends, names = EliasFano.from_bytes(content[at:at + ne]), EliasFano.from_bytes(content[at + ne:at + ne + nn])
        ids = np.frombuffer(content, f"<u{width}", nb // width, at + ne + nn)
        yield task, before, [None] * nulls + [names.select(i) + least for i in range(n - nulls)], ends, ids
        at += ne + nn + nb + 1


class Generation(dict):
    """Pieces and their ids; a missing piece is found and kept."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, p: str) -> bytes:
        ids = self[p] = self.find(p)
        return ids


class PieceEncoder:
    """Ids by the tokenizers library. White space only separates words in this
    vocabulary (its normalizer and pattern drop it), so texts are cut at
    blanks and line ends, and each distinct piece is encoded once. A piece of
    Latin-1 letters, then ASCII symbols, is two words under the
    tokenizer's pattern and needs no normalizer but lower case: its words go
    to the library's BPE model directly, any other piece to the whole
    tokenizer. Pieces are kept in two generations of about ``CACHE`` each; one
    that is used again moves to the younger."""

    CACHE = 400_000

    def __init__(self, spec: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_str(spec)
        self.t.no_truncation()
        self.t.no_padding()
        self.width = 2 if self.t.get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16 else 4
        self.end = end_id.to_bytes(self.width, "little")
        self.old: dict[str, bytes] = {}
        self.young = Generation(self.piece)
        self.plain = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@[-`{-~]*)").fullmatch
        self.printable = {b: c for c, b in byte_alphabet().items()}

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def piece(self, p: str) -> bytes:
        """Ids of a piece that the younger generation doesn't have."""
        ids = self.old.get(p)
        if ids is not None:
            return ids
        if m := self.plain(p):
            w, marks = m.groups()
            w, model = w.lower(), self.t.model.tokenize
            found = [x.id for x in model(w if w.isascii() else w.encode().decode("latin-1").translate(self.printable))]
            return self.pack(found + [x.id for x in model(marks)] if marks else found)
        return self.pack(self.t.encode(p, add_special_tokens=False).ids)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        if len(self.young) > self.CACHE:
            self.old, self.young = self.young, Generation(self.piece)
        get = self.young.__getitem__
        return [b"".join(map(get, x.replace("\n", " ").split(" "))) + self.end for x in texts]


_MADE: dict[str, PieceEncoder] = {}


def encoder(spec: str, end_id: int) -> PieceEncoder:
    key = f"{end_id}:{hashlib.sha256(spec.encode()).hexdigest()}"
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = PieceEncoder(spec, end_id)
    return _MADE[key]


def write_token_files(df: DataFrame, path: str, vocabulary: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> None:
    """Encode all texts and write the id files below ``path`` (any path that
    Spark can write). ``vocabulary``: path of a tokenizer JSON whose words do
    not span white space."""
    spec = open(vocabulary, encoding="utf-8").read()
    rows = df.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t")).repartitionByRange("k", "h").sortWithinPartitions("k", "h").drop("h")

    def run(batches):
        task, before, keys, ids, held = TaskContext.get().partitionId(), 0, [], [], 0
        enc = encoder(spec, end_id)
        for ks, ts in column_lists(batches):
            for k, x in zip(ks, (ids for part in portions(ts) for ids in enc.encode_many(part))):
                n = len(x) // enc.width
                if keys and held + n > BLOCK_IDS:
                    yield {"block": [block_bytes(task, before, keys, ids, enc.width)]}
                    before, keys, ids, held = before + held, [], [], 0
                keys.append(k)
                ids.append(x)
                held += n
        if keys:
            yield {"block": [block_bytes(task, before, keys, ids, enc.width)]}

    blocks = with_schema(rows, run, "block binary")
    # a task's blocks go to several files, so that none is too large to be read as one value
    blocks.select(F.col("block").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_BLOCKS).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files below ``path``: ``doc_id, start,
    n_tokens, ids_crc32`` (of the ids as little-endian unsigned 32-bit
    integers); ``start`` counts the ids of all documents before it."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                for task, before, keys, ends, ids in blocks_in(content.as_py()):
                    at = [ends.select(i) for i in range(len(keys) + 1)]
                    yield {"file": [task] * len(keys), "doc_id": keys, "at": [before + x for x in at[:-1]],
                           "n_tokens": [b - a for a, b in zip(at, at[1:])],
                           "ids_crc32": [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at, at[1:])]}

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    docs = saved(with_schema(files, run, "file long, doc_id long, at long, n_tokens long, ids_crc32 long"), "ids")
    # one row per file, so this window is as long as the list of files
    sums = docs.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    base = sums.select("file", (F.sum("n").over(W.orderBy("file")) - F.col("n")).alias("base"))
    return docs.join(base, "file").select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def token_files(df: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write the files into the shared folder, then report from them."""
    path = scratch_path(df.sparkSession, "token-files")
    write_token_files(df, path, vocabulary, end_id)
    return read_token_files(df.sparkSession, path)
