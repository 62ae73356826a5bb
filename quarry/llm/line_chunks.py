"""Line dedup over content-defined chunks of lines.

Every two neighbouring lines (blank ones between them do not count) have a rolling
hash of their line hashes. A chunk begins where this hash is not above the one
before or the one after it: boundaries depend on the lines around them only,
survive shifts, and are at most two lines apart; of any three lines that two
documents share, both cut the same chunk. A chunk is the two lines of such
a place. Two lines of together ``LONG`` words or more, and a single line
of as many, are chunks wherever they stand (a passage written as one or two lines).
Other single lines are never removed.

1. One pass over the texts gives chunk hashes; their aggregate gives the
   repeated hashes and the place that is kept (smallest doc_id, then text
   hash, then position).
2. A match is extended by the line before and the line after, where their hashes agree
   with those at the kept place; as chunks are at most two lines apart, this covers a shared run
   of three lines or more from its first line to its last.
3. Documents meet the list of their repeated chunks in one join (the only time
   texts move). The bytes of every match, its extensions included, are compared with
   those of the kept place; only equal ones are removed.
4. Lines of a kept place stay, whatever else they match, and so do the lines next
   to it that another document's match was extended by. So each
   removed passage still stands whole at its kept place. Texts are rebuilt from the lines that remain.

Skew: hashes are aggregated map-side, so a passage of a third of all documents
is one row per task; the joins on a chunk hash can be split by adaptive execution;
a list holds the chunks of one document.

Rows: a null text stays null and an empty one empty; rows equal in doc_id and
text are one document and get the same result; null doc_ids order last; a
chunk repeated inside one document is removed after its first place; an
empty table gives no rows. ``dedup`` keeps the columns, whatever their names, and replaces the text; a
document of which nothing remains is dropped unless ``drop_emptied`` is false.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import column_lists, fresh, saved, with_schema

LONG = 50
GOLD, M64 = 0x9E3779B97F4A7C15, (1 << 64) - 1


class Chunk(NamedTuple):
    """Lines start to stop (exclusive); the neighbours that a match may be extended
    by reach from ``before`` and to ``after`` (-1: none)."""

    start: int
    stop: int
    before: int = -1
    after: int = -1


def line_hash(line: str) -> bytes:
    return hashlib.blake2b(line.encode(), digest_size=8).digest()


def chunk_hash(parts: bytes) -> bytes:
    """Of the line hashes of a chunk and the blank lines between."""
    return parts if len(parts) == 16 else hashlib.blake2b(parts, digest_size=16).digest()


def n_words(line: str) -> int:
    return len(line.split()) if len(line) >= 2 * LONG - 1 else 0


def hashed_chunks(lines: list[str]) -> list[tuple[Chunk, bytes, bytes | None, bytes | None]]:
    """(chunk, its hash, hashes of the line before and after with the blank lines between)."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    hs = [line_hash(lines[i]) for i in full]
    gaps = ["\n".join(lines[i + 1:j]).encode() if j > i + 1 else b"" for i, j in zip(full, full[1:])]
    # the number of blank lines counts, too
    gaps = [b"%d " % (j - i) + g if j > i + 1 else b"" for i, j, g in zip(full, full[1:], gaps)]
    at = [int.from_bytes(h, "little") for h in hs]
    roll = [(x * GOLD + y) & M64 for x, y in zip(at, at[1:])]
    out, last = [], len(roll) - 1
    for i, r in enumerate(roll):
        a, b = full[i], full[i + 1]
        if not last or (i and r <= roll[i - 1]) or (i < last and r <= roll[i + 1]) or n_words(" ".join((lines[a], lines[b]))) >= LONG:
            out.append((Chunk(a, b + 1, full[i - 1] if i else -1, full[i + 2] + 1 if i < last else -1), chunk_hash(hs[i] + gaps[i] + hs[i + 1]),
                        hs[i - 1] + gaps[i - 1] if i else None, gaps[i + 1] + hs[i + 2] if i < last else None))
    for i, h in zip(full, hs):
        if n_words(lines[i]) >= LONG:
            out.append((Chunk(i, i + 1), chunk_hash(h + b"one"), None, None))
    return out


def chunks(lines: list[str]) -> list[Chunk]:
    return [c for c, *_ in hashed_chunks(lines)]


def parts(lines: list[str], c: Chunk) -> tuple[bytes | None, bytes, bytes | None]:
    """What a match compares: the lines before, of, and after the chunk."""
    def text(a: int, b: int) -> bytes:
        return "\n".join(lines[a:b]).encode()

    return (text(c.before, c.start) if c.before >= 0 else None, text(c.start, c.stop), text(c.stop, c.after) if c.after >= 0 else None)


def chunk_hashes(df: DataFrame) -> DataFrame:
    """(k, th, at, h, hb, ha): document, hash of its text, chunk number, hashes of the chunk
    and of its neighbours."""

    def run(batches):
        for ks, hs, ts in column_lists(batches):
            out = {"k": [], "th": [], "at": [], "h": [], "hb": [], "ha": []}
            for k, th, t in zip(ks, hs, ts):
                for at, (_, *found) in enumerate(hashed_chunks(t.split("\n"))):
                    for name, v in zip(out, (k, th, at, *found)):
                        out[name].append(v)
            yield out

    rows = df.filter(F.length("text") > 0).select(F.col("doc_id").cast("long").alias("k"), F.xxhash64("text").alias("th"), "text")
    return with_schema(rows, run, "k long, th long, at int, h binary, hb binary, ha binary")


#: a repeated chunk of a document: whether it is the kept place, and whether the
#: line before and after take part (of a kept place: must stay)
LISTED = "array<struct<at:int,h:binary,kept:boolean,before:boolean,after:boolean>>"


def _marked(df: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Documents with the list of their repeated chunks, what of these the byte
    comparison refuses, and the names of the two added columns."""
    place = F.struct(F.col("k").isNull().alias("no"), F.col("k"), F.col("th"), F.col("at"))
    found = saved(chunk_hashes(df), "chunks")
    least = F.min(F.struct(place.alias("place"), "hb", "ha"))
    repeated = found.groupBy("h").agg(least.alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "kept")
    # written before the join: a join straight on an aggregate by its key
    # cannot be split, and a passage of very many documents would be one task's
    repeated = saved(repeated, "repeated")
    mine = found.join(repeated, "h").select(
        "k", "th", "at", "h", (place == F.col("kept.place")).alias("kept"), F.coalesce(F.col("hb") == F.col("kept.hb"), F.lit(False)).alias("before"),
        F.coalesce(F.col("ha") == F.col("kept.ha"), F.lit(False)).alias("after"))
    mine = saved(mine, "mine")
    others = mine.filter("not kept")
    stay = others.groupBy("h").agg(F.max("before").alias("before"), F.max("after").alias("after"))
    kept = mine.filter("kept").select("k", "th", "at", "h", "kept").join(saved(stay, "stay"), "h")
    listed = others.unionByName(kept).select("k", "th", F.struct("at", "h", "kept", "before", "after").alias("c"))
    name, th, lk, lth = fresh(df, "repeated", "th", "lk", "lth")
    lists = listed.groupBy("k", "th").agg(F.collect_set("c").alias(name)).withColumnRenamed("k", lk).withColumnRenamed("th", lth)
    docs = df.withColumn(th, F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = docs.join(lists, F.col("doc_id").cast("long").eqNullSafe(F.col(lk)) & (F.col(th) == F.col(lth)), "left")
    marked = saved(joined.drop(lk, lth), "marked")

    def bodies(batches):
        for ks, hs, ts, rs in column_lists(batches):
            out = {"k": [], "th": [], "at": [], "h": [], "kept": [], "lead": [], "body": [], "tail": []}
            for k, h, t, r in zip(ks, hs, ts, rs):
                lines = t.split("\n")
                cut = chunks(lines)
                for c, (before, after) in zip(r, _needed(cut, r)):
                    lead, body, tail = parts(lines, cut[c["at"]])
                    for column, v in zip(out, (k, h, c["at"], c["h"], c["kept"], lead if before else None, body, tail if after else None)):
                        out[column].append(v)
            yield out

    with_list = marked.filter(F.col(name).isNotNull()).select(F.col("doc_id").cast("long").alias("k"), th, "text", name)
    data = saved(with_schema(with_list, bodies, "k long, th long, at int, h binary, kept boolean, lead binary, body binary, tail binary"), "bodies")
    first = saved(data.filter("kept").dropDuplicates(["h"]).select("h", *[F.col(x).alias(f"first_{x}") for x in ("lead", "body", "tail")]), "first")
    both = data.filter("not kept").join(first, "h")
    differs = {x: F.col(x).isNotNull() & ~F.col(x).eqNullSafe(F.col(f"first_{x}")) for x in ("lead", "body", "tail")}
    refused = both.filter(differs["lead"] | differs["body"] | differs["tail"]).select("k", "th", "at")
    return marked, saved(refused, "refused"), [name, th]


def _needed(cut: list[Chunk], listed: list) -> list[tuple[bool, bool]]:
    """For each listed chunk whether its extensions are used: of a match, those
    whose lines no other match covers; of a kept place, all that must stay."""
    covered = {i for c in listed if not c["kept"] for i in range(cut[c["at"]].start, cut[c["at"]].stop)}
    out = []
    for c in listed:
        x = cut[c["at"]]
        lead, tail = range(x.before, x.start), range(x.stop, x.after)
        out.append((c["before"] and (c["kept"] or not covered.issuperset(lead)), c["after"] and (c["kept"] or not covered.issuperset(tail))))
    return out


def removals(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows of ``df`` with one more column, and its name: the chunks that tell
    which lines go (null: none)."""
    marked, refused, (name, th) = _marked(df)
    if not refused.isEmpty():  # chunks of equal hash and different bytes stay
        stay, lk, lth = fresh(marked, "stay", "lk", "lth")
        bad = refused.groupBy(F.col("k").alias(lk), F.col("th").alias(lth)).agg(F.collect_set("at").alias(stay))
        marked = marked.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(lk)) & (F.col(th) == F.col(lth)), "left")
        left = F.filter(name, lambda c: c["kept"] | ~F.array_contains(F.coalesce(stay, F.array().cast("array<int>")), c["at"]))
        marked = marked.withColumn(name, left).drop(lk, lth, stay)
    return marked.drop(th), name


def _without(text: str, listed) -> tuple[list[str], list[tuple[int, int]]]:
    """The lines that remain and the removed ranges."""
    lines = text.split("\n")
    cut = chunks(lines)
    gone, stay = set(), set()
    for c, (before, after) in zip(listed, _needed(cut, listed)):
        x = cut[c["at"]]
        (stay if c["kept"] else gone).update(range(x.before if before else x.start, x.after if after else x.stop))
    gone -= stay
    spans: list[tuple[int, int]] = []
    for i in sorted(gone):
        if spans and i == spans[-1][1]:
            spans[-1] = (spans[-1][0], i + 1)
        else:
            spans.append((i, i + 1))
    return [x for i, x in enumerate(lines) if i not in gone], spans


def report(df: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_removed, removed, kept_chars, clean_sha256`` of
    every row; ``removed`` lists line ranges like 3-5,9-9 (from 0)."""

    def run(batches):
        for ks, ts, gs in column_lists(batches):
            out = {n: [] for n in ("doc_id", "n_lines", "n_removed", "removed", "kept_chars", "clean_sha256")}
            for k, t, g in zip(ks, ts, gs):
                lines = (t or "").split("\n") if t else []
                kept, spans = _without(t, g) if g else (lines, [])
                clean = "\n".join(kept)
                for n, v in zip(out, (k, len(lines), sum(b - a for a, b in spans), ",".join(f"{a}-{b - 1}" for a, b in spans),
                                      len(clean), hashlib.sha256(clean.encode()).hexdigest())):
                    out[n].append(v)
            yield out

    rows, name = removals(df.select("doc_id", "text"))
    rows = rows.select(F.col("doc_id").cast("long"), "text", name)
    return with_schema(rows, run, "doc_id long, n_lines long, n_removed long, removed string, kept_chars long, clean_sha256 string")


def dedup(df: DataFrame, drop_emptied: bool = True) -> DataFrame:
    """The rows of ``df`` with repeated chunks removed from ``text``."""
    import pyarrow as pa

    names = df.columns
    at = names.index("text")
    schema = df.schema

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts, gone = part.column(at).to_pylist(), part.column(len(names)).to_pylist()
                new = ["\n".join(_without(t, g)[0]) if g else t for t, g in zip(texts, gone)]
                keep = [not (drop_emptied and g and not n) for n, g in zip(new, gone)]
                cols = [pa.array(new, part.column(at).type) if c == at else part.column(c) for c in range(len(names))]
                yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep, pa.bool_()))

    rows, name = removals(df)
    return rows.select(*[F.col(f"`{n}`") for n in names], name).mapInArrow(run, schema)
