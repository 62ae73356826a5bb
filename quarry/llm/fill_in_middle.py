"""Fill-in-middle transformation with a learned rank index of token boundaries.

A text is cut into units (a run of ASCII letters, or one other code point).
Its index is the list of the offsets of all boundaries between units, from 0 to
the length, held as a piecewise-linear function of the boundary's rank: every
segment is the widest run of boundaries that one line through the segment's
first boundary meets within ``ERROR`` code points (shrinking cone), and one
byte per boundary holds the exact difference. The offset of a cut is the line's
prediction plus that residual, so cuts are exact and cost two look-ups.

Cuts come from a hash of ``seed:doc_id``: prefix and middle end after the smaller
and larger of two hash-drawn ranks. The form is plain for a share of the documents
and wherever a text is empty or contains a sentinel; of the others a share is
written suffix first (spm), the rest prefix first (psm). ``restore`` rebuilds
the text from output and form.

Skew: every row is handled alone, nothing is shuffled; a task holds the offsets
of one text at a time (8 bytes a boundary).

Rows: a null text counts as empty, a null doc_id hashes as ``seed:``; repeated
rows get the same result; an empty table gives no rows. ``transform`` keeps
the columns of its frame, whatever their names, and replaces the text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import column_lists, fresh, with_schema

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ERROR = 127  # so that a residual is one signed byte
WINDOW = 1024  # boundaries looked at at once while a segment grows


def boundaries(text: str) -> np.ndarray:
    """Offsets in code points of all boundaries, 0 and the length included."""
    if not text:
        return np.zeros(1, np.int64)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((c | 32) - np.uint32(97)) < 26
    start = np.ones(len(c) + 1, bool)
    start[1:-1] = ~(letter[1:] & letter[:-1])
    return np.flatnonzero(start)


@dataclass
class RankIndex:
    """Segment i covers the ranks from first[i] on: offset = base[i] +
    floor(slope[i] * (rank - first[i])) + residual[rank]."""

    first: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    @classmethod
    def fit(cls, offsets: np.ndarray, error: int = ERROR) -> RankIndex:
        if not 1 <= error <= ERROR:
            raise ValueError(f"the error bound is 1 to {ERROR}")
        bound = error - 1  # a prediction is rounded down
        first, slope, at, n = [], [], 0, len(offsets)
        while at < n:
            low, high, end = -np.inf, np.inf, at + 1
            while end < n:
                part = offsets[end:end + WINDOW]
                run = np.arange(end - at, end - at + len(part))
                rise = part - offsets[at]
                lows = np.maximum(np.maximum.accumulate((rise - bound) / run), low)
                highs = np.minimum(np.minimum.accumulate((rise + bound) / run), high)
                wide = lows <= highs
                fits = len(part) if wide.all() else int(np.argmin(wide))
                if fits:
                    low, high, end = float(lows[fits - 1]), float(highs[fits - 1]), end + fits
                if fits < len(part):
                    break
            first.append(at)
            slope.append((low + high) / 2 if end > at + 1 else 0.0)
            at = end
        first, slope = np.array(first, np.int64), np.array(slope)
        index = cls(first, offsets[first], slope, np.zeros(0, np.int8))
        rest = offsets - index.predict(np.arange(n))
        if len(rest) and max(rest.max(), -rest.min()) > ERROR:
            raise ArithmeticError("a residual is beyond its bound")
        index.residual = rest.astype(np.int8)
        return index

    def predict(self, rank: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.first, rank, side="right") - 1
        return self.base[i] + np.floor(self.slope[i] * (rank - self.first[i])).astype(np.int64)

    def offset(self, rank: int) -> int:
        """Exact offset of a boundary."""
        return int(self.predict(np.array([rank]))[0]) + int(self.residual[rank])

    def __len__(self) -> int:
        """Number of units."""
        return len(self.residual) - 1


def draws(key: int | None, seed: int) -> tuple[int, ...]:
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(h[i:i + 8], 16) for i in range(0, 32, 8))


@dataclass
class Options:
    seed: int = 1
    transformed: int = 90  # per cent that are not plain
    suffix_first: int = 20  # per cent of these


def cut(text: str, key: int | None, opt: Options) -> tuple[int, str, int | None, int | None]:
    """(number of units, form, end of the prefix, end of the middle)."""
    index = RankIndex.fit(boundaries(text))
    n = len(index)
    h1, h2, h3, h4 = draws(key, opt.seed)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= opt.transformed:
        return n, "plain", None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, "spm" if h4 % 100 < opt.suffix_first else "psm", index.offset(a), index.offset(b)


def output(text: str, form: str, a: int | None, b: int | None) -> str:
    if form == "plain":
        return text
    if form == "psm":
        return f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"
    return f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"


def restore(out: str, form: str) -> str:
    """The text, from the output and its form alone. No part holds a
    sentinel, and no sentinel overlaps another one, so the first place counts."""
    if form == "plain":
        return out
    inner = SUFFIX if form == "psm" else PREFIX
    i = out.index(inner, 3)
    j = out.index(MIDDLE, i + 3)
    one, two, middle = out[3:i], out[i + 3:j], out[j + 3:]
    return one + middle + two if form == "psm" else two + middle + one


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def report(df: DataFrame, opt: Options | None = None) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256,
    restored_sha256`` of every row."""
    opt = opt or Options()

    def run(batches):
        for ks, ts in column_lists(batches):
            out = {c: [] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")}
            for k, t in zip(ks, ts):
                n, form, a, b = cut(t or "", k, opt)
                made = output(t or "", form, a, b)
                for c, v in zip(out, (k, n, form, a, None if a is None else b - a, _sha(made), _sha(restore(made, form)))):
                    out[c].append(v)
            yield out

    return with_schema(df.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n long, form string, prefix_chars long, "
                       "middle_chars long, output_sha256 string, restored_sha256 string")


def transform(df: DataFrame, opt: Options | None = None, form_column: str = "form") -> DataFrame:
    """The rows of ``df`` with ``text`` in its fill-in-middle form and, if a
    name is given, a column with the form (under a fresh name where taken)."""
    import pyarrow as pa
    from pyspark.sql.types import StringType, StructType

    opt = opt or Options()
    names = df.columns
    at, key = names.index("text"), names.index("doc_id")
    form_column, = fresh(df, form_column)
    schema = StructType(list(df.schema.fields)).add(form_column, StringType())

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts, forms = [], []
                for k, t in zip(part.column(key).to_pylist(), part.column(at).to_pylist()):
                    _, form, a, b = cut(t or "", k, opt)
                    texts.append(t if form == "plain" else output(t, form, a, b))
                    forms.append(form)
                cols = [pa.array(texts, part.column(at).type) if c == at else part.column(c) for c in range(len(names))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(forms, pa.string())], names=[*names, form_column])

    return df.mapInArrow(run, schema)


def rank_index(df: DataFrame) -> DataFrame:
    """The index of every row: ``doc_id, first, base, slope`` (of the
    segments) and ``residual`` (a signed byte per boundary)."""

    def run(batches):
        for ks, ts in column_lists(batches):
            found = [RankIndex.fit(boundaries(t or "")) for t in ts]
            yield {"doc_id": ks, "first": [x.first.tolist() for x in found], "base": [x.base.tolist() for x in found],
                   "slope": [x.slope.tolist() for x in found], "residual": [x.residual.tobytes() for x in found]}

    return with_schema(df.select(F.col("doc_id").cast("long"), "text"), run,
                       "doc_id long, first array<long>, base array<long>, slope array<double>, residual binary")


ORACLE = r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
                  sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
     d AS (SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
                  ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM u),
     f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                       WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
     p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
                  array_to_string(units[b + 1:n], '') AS suffix FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
