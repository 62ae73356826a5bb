"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

The BPE encoding of any prefix of a word is fixed by its *last token* and the
encoding of what precedes that token: a token may follow another exactly when
the merges applied to both together give those two tokens again. So one
"last token" per prefix is a complete state. The distinct words of a batch
form a trie; walking it depth first and propagating the last-token states
computes the state of every shared prefix once. Words in sorted order visit
the trie depth first, so the walk needs only the states of the current path.

Documents are cut into white-space-delimited pieces first; pieces are cut
into words by the tokenizer's own pre-tokenizer. A bounded cache per Python
worker keeps the ids of pieces seen before (those of the last used generation go on),
so a frequent word is looked up.
The work is one pass over the rows: no shuffle, nothing is collected.

Rows: a null text counts as empty, an empty text has no ids; repeated rows
give repeated results; ids of a very long text are joined piece by piece. The
operators append their columns to the caller's (a clash raises a
``ValueError``), so other column names do not matter.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import column_lists, portions, with_schema

#: Unicode White_Space, which is what the tokenizer's pattern calls \s.
PAIRS = 1_000_000  # remembered token pairs of one generation
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level
    vocabularies: printable Latin-1 stands for itself, the rest follows from
    U+0100 on in byte order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixBpe:
    """Vocabulary, merges and the memo of compatible neighbours."""

    CACHE = 400_000  # pieces in each of two generations that a worker keeps

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        j = json.loads(spec)
        model = j["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") or j["normalizer"]:
            raise ValueError("a byte-level BPE vocabulary without normalizer is needed")
        self.vocab: dict[str, int] = model["vocab"]
        self.rank = {(a, b): i for i, (a, b) in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = Tokenizer.from_str(spec).pre_tokenizer.pre_tokenize_str
        alphabet = byte_alphabet()
        self.bytes_of = [b""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for s, i in self.vocab.items():
            self.bytes_of[i] = bytes(alphabet[c] for c in s)
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.text_of = {i: s for s, i in self.vocab.items()}
        # a token takes part only if the merges build it from its own bytes
        self.usable = {s: i for s, i in self.vocab.items() if len(s) == 1 or self.merge(s) == [s]}
        # lengths of the tokens of three bytes or more that end in these three
        lengths: dict[str, set[int]] = {}
        for s in self.usable:
            if len(s) > 2:
                lengths.setdefault(s[-3:], set()).add(len(s))
        self.lengths = {tail: sorted(x, reverse=True) for tail, x in lengths.items()}
        self.follows: dict[tuple[int, int], bool] = {}
        self.older_follows: dict[tuple[int, int], bool] = {}
        self.ids_of_piece: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.printable = {b: c for c, b in alphabet.items()}

    def merge(self, s: str) -> list[str]:
        """Plain BPE: apply the earliest merge of the list, leftmost first."""
        parts = list(s)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def may_follow(self, a: int, b: int) -> bool:
        ok = self.follows.get((a, b))
        if ok is None:
            ok = self.older_follows.get((a, b))
            if ok is None:
                x, y = self.text_of[a], self.text_of[b]
                ok = self.merge(x + y) == [x, y]
            self.follows[(a, b)] = ok
        return ok

    def encode_words(self, words) -> dict[str, list[int]]:
        """Ids of every word. Sorted words are a depth-first walk over their
        trie; ``last`` holds the last-token state of each prefix on the path."""
        out: dict[str, list[int]] = {}
        if len(self.follows) > PAIRS:
            self.older_follows, self.follows = self.follows, {}
        usable, lengths, follows = self.usable, self.lengths, self.follows
        path, last, size = "", [-1], [0]
        for word in sorted(words):
            shared = 0
            for x, y in zip(path, word):
                if x != y:
                    break
                shared += 1
            del last[shared + 1:], size[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                for n in lengths.get(word[end - 3:end], ()) if end > 2 else ():
                    if n <= end and (t := usable.get(word[end - n:end])) is not None:
                        before = last[end - n]
                        if before < 0:
                            break
                        ok = follows.get((before, t))
                        if ok if ok is not None else self.may_follow(before, t):
                            break
                else:
                    n, t = 2, usable.get(word[end - 2:end]) if end > 1 else None
                    if t is None or end > 2 and not (follows.get((last[end - 2], t)) or self.may_follow(last[end - 2], t)):
                        n, t = 1, usable[word[end - 1]]
                last.append(t)
                size.append(n)
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at -= size[at]
            out[word] = ids[::-1]
            path = word
        return out

    def cut(self, piece: str) -> list[str]:
        """The words of a piece, in byte-alphabet characters. Letters after at
        most one blank are one word under the tokenizer's pattern."""
        if (piece[1:] if piece[0] == " " else piece).isalpha():
            return [piece.encode().decode("latin-1").translate(self.printable)]
        return [w for w, _ in self.words(piece)]

    def learn(self, pieces: set[str]) -> None:
        """Bring the ids of all pieces into the younger generation."""
        if len(self.ids_of_piece) > self.CACHE:
            self.older, self.ids_of_piece = self.ids_of_piece, {}
        cut = {}
        for p in pieces.difference(self.ids_of_piece):
            if (known := self.older.get(p)) is None:
                cut[p] = self.cut(p)
            else:
                self.ids_of_piece[p] = known
        ids = self.encode_words({w for ws in cut.values() for w in ws})
        for p, ws in cut.items():
            self.ids_of_piece[p] = struct.pack(f"<{sum(len(ids[w]) for w in ws)}I", *[i for w in ws for i in ids[w]])

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        parts = [self.split_special.split(t) if self.split_special and any(s in t for s in self.special) else [t] for t in texts]
        pieces = [[[s] if s in self.special else PIECE.findall(s) for s in p] for p in parts]
        new: set[str] = set()
        for doc in pieces:
            for p in doc:
                new.update(p)
        self.learn(new.difference(self.special))
        known = self.ids_of_piece
        get = lambda p: known[p] if p not in self.special else np.uint32(self.special[p]).tobytes()
        return [b"".join(b"".join(map(known.__getitem__, p)) if len(d) == 1 else b"".join(map(get, p)) for p in d) for d in pieces]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text; invalid sequences become U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").encode()


_MADE: dict[str, PrefixBpe] = {}


def codec(spec: str) -> PrefixBpe:
    """One codec per Python worker and vocabulary."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = PrefixBpe(spec)
    return _MADE[key]


def _append(df: DataFrame, source: str, function, added: str) -> DataFrame:
    names = [x.split()[0] for x in added.split(",")]
    if clash := sorted({c.lower() for c in df.columns} & set(names)):
        raise ValueError(f"columns {clash} are already there")
    kept = [c for c in df.columns]
    quoted = [f"`{c}`" for c in kept]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [added])

    def run(batches):
        for cols in column_lists(batches):
            yield dict(zip(kept, cols[:-1])) | dict(zip(names, function(cols[-1])))

    return with_schema(df.select(*quoted, F.col(source).alias("__source")), run, ddl)


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows with their ids, a binary of little-endian unsigned 32-bit
    integers. ``vocabulary``: path of the tokenizer's JSON, read once here."""
    spec = open(vocabulary, encoding="utf-8").read()
    return _append(df, text, lambda xs: [[i for part in portions([x or "" for x in xs]) for i in codec(spec).encode_many(part)]], f"{ids} binary")


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows with the text of their ids (null ids: empty text)."""
    spec = open(vocabulary, encoding="utf-8").read()
    return _append(df, ids, lambda xs: [[codec(spec).decode(x or b"").decode() for x in xs]], f"{text} string")


def round_trip(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode in one pass: ``key, n_tokens, ids_sha256,
    decoded_sha256`` for every row."""
    spec = open(vocabulary, encoding="utf-8").read()
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def digests(texts):
        c = codec(spec)
        n, a, b = [], [], []
        for part in portions([x or "" for x in texts]):
            for ids in c.encode_many(part):
                n.append(len(ids) // 4)
                a.append(sha(ids))
                b.append(sha(c.decode(ids)))
        return n, a, b

    return _append(df.select(F.col(key).alias(key), F.col(text).alias("__text")), "__text", digests,
                   "n_tokens long, ids_sha256 string, decoded_sha256 string").drop("__text")
