"""Toxicity after noisy-channel deobfuscation.

1. A character trigram model is counted over all documents (letters a-z after
   folding accents, one class for every other letter, one word boundary: 28^3
   cells at most, whatever the corpus).
2. A word that may be disguised - symbols or digits among letters, a letter
   repeated three times or more, single characters spaced out - becomes a
   lattice: each character is itself, or a letter that it imitates; a run is
   one or two of its letter; a separator joins or parts. Viterbi finds the path
   of least cost under channel and character model. Any other word has one
   path, itself, and needs no search. Scoring also looks at second readings, beside
   the plain one: a token with separators inside, a word with a doubled letter (one of
   it may be noise), and two neighbouring tokens that together are a word of the model. Each
   counts only if its path costs less than leaving the text as it is.
3. The restored words (and their four and five letter beginnings) of a bounded
   sample of labelled documents, ``FIT_ROWS``, get log odds; a feature counts
   if its G statistic is beyond chance, with its log odds less a standard error; the best ``MODEL_FEATURES``
   make the model. A document's evidence is its strongest word and the sum of
   the next two, mapped to a probability by a logistic curve fitted on the evidence of
   labelled rows under the log odds of the folds that they are not in.

Every whole text is scored; each pass is a scan without shuffle of texts.

Rows: a null text counts as empty; an empty text has evidence 0 and is
scored; repeated rows score alike; a null doc_id has no label; without
positive labels every score is the same small value; an empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from functools import lru_cache
from heapq import nlargest

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import column_lists, saved, with_schema
from quarry.llm.quality import remainder

FIT_ROWS = 20_000
MODEL_FEATURES = 20_000
THRESHOLD = 0.3
STRONGEST = 3
FOLDS = 3
SURPRISE = 18.0  # least G statistic of a feature, against chance finds among very many features
CODES = 28  # 0: boundary, 1-26: letters, 27: other letter
CACHE = 400_000

#: What a character may stand for (usual leetspeak substitutions).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
        "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
COST = {"leet": 1.0, "run": 0.5, "pair": 1.0, "join": 0.2, "part": 1.5, "break": 6.0}
EDGES = ".,;:?\"'()[]{}<>*|-_~`&#%=/\\^!$+"
SEPARATORS = " .-_*/\t\r\n"
_GAP = r"(?:[ \t]{1,3}|\r?\n|[.\-_*/])"
SPACED = re.compile(rf"(?<![^\W_])[^\W_](?:{_GAP}[^\W_@$!]|{_GAP}[@$!](?={_GAP})){{2,}}(?![^\W_])")
RUN = re.compile(r"(.)\1\1")
DOUBLED = re.compile(r"([^\W\d_])\1")
GAPS = re.compile(r"[.\-_*/]+")
INNER = re.compile(r"[^\W_][.\-_*/][^\W_]")


@lru_cache(1)
def code_table() -> np.ndarray:
    """Code of every code point: its base letter, other letter or boundary."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            base = unicodedata.normalize("NFKD", c)[0].lower() if i > 127 else c.lower()
            out[i] = ord(base) - 96 if "a" <= base <= "z" else CODES - 1
    return out


def codes_of(text: str) -> np.ndarray:
    return code_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


def trigram_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of (previous two, this) over all texts; at most 28^3 rows reach
    the driver."""
    size = CODES**3

    def run(batches):
        total = np.zeros(size, np.int64)
        for (ts,) in column_lists(batches):
            c = codes_of("\n\n".join(["\n", *[t or "" for t in ts], "\n"])).astype(np.int32)
            # boundary runs count as two boundaries: enough to start a word
            k = (c[:-2] * CODES + c[1:-1]) * CODES + c[2:]
            total += np.bincount(k, minlength=size)
        at = np.flatnonzero(total)
        yield {"k": at.tolist(), "n": total[at].tolist()}

    rows = with_schema(df.select(text), run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r["k"]] = r["n"]
    out[0] = 0
    return out


class Channel:
    """Character model and lattice decoding."""

    def __init__(self, counts: np.ndarray):
        n3 = counts.reshape(CODES, CODES, CODES)
        n2, n1 = n3.sum(0), n3.sum((0, 1))
        p1 = (n1 + 1) / (n1.sum() + CODES)
        p2 = (n2 + 5 * p1) / (n2.sum(1, keepdims=True) + 5)
        p3 = (n3 + 5 * p2) / (n3.sum(2, keepdims=True) + 5)
        self.cost = (-np.log(p3)).tolist()

    def code(self, c: str) -> int:
        return int(code_table()[ord(c)])

    def lattice(self, s: str, spaced: bool, doubled: bool = False):
        """Steps of (emitted text, cost); a space is a word boundary. ``doubled``: two
        equal letters may be one."""
        steps, i = [], 0
        while i < len(s):
            c, j = s[i], i + 1
            while j < len(s) and s[j] == c:
                j += 1
            if spaced and c in SEPARATORS:
                steps.append([("", COST["join"]), (" ", COST["part"])])
            elif self.code(c):
                if j - i >= 3:
                    steps.append([(c, COST["run"]), (c + c, COST["pair"])])
                elif doubled and j - i == 2:
                    steps.append([(c + c, 0.0), (c, COST["pair"])])
                else:
                    steps += [[(c, 0.0)]] * (j - i)
            elif c in LEET:
                for _ in range(min(j - i, 2) if j - i >= 3 else j - i):
                    steps.append([(x, COST["leet"]) for x in LEET[c]] + [(" ", COST["break"])])
            else:
                steps.append([(" ", COST["break"]), ("", COST["leet"])])
            i = j
        return steps

    def decode(self, s: str, spaced: bool = False, doubled: bool = False) -> str:
        """The most probable reading of a disguised word or sequence."""
        # state: the last two codes; value: cost and the path as a linked list
        best = {(0, 0): (0.0, None)}
        cost, code = self.cost, self.code
        for options in [*self.lattice(s, spaced, doubled), [(" ", 0.0)]]:
            new: dict = {}
            for (a, b), (total, path) in best.items():
                for emitted, price in options:
                    x, y, t = a, b, total + price
                    for c in emitted:
                        z = 0 if c == " " else code(c)
                        if z or y:  # a further boundary after a boundary says nothing
                            t += cost[x][y][z]
                        x, y = (0, 0) if not z else (y, z)
                    if (x, y) not in new or t < new[x, y][0]:
                        new[x, y] = (t, (path, emitted) if emitted else path)
            best = new
        path, out = min(best.values(), key=lambda v: v[0])[1], []
        while path:
            path, emitted = path
            out.append(emitted)
        return " ".join("".join(out[::-1]).split())


def core(token: str) -> str:
    """A lower-case token without sentence marks and symbol runs at its ends;
    one symbol that may be a letter stays where letters follow or precede."""
    t = token.lower()
    s = t.strip(EDGES)
    if s and s != t:
        at = t.find(s)
        if at and t[at - 1] in "$+" and (at == 1 or t[at - 2] not in EDGES):
            s = t[at - 1] + s
            at -= 1
        end = at + len(s)
        if end + 1 == len(t) and t[end] in "$+":
            s += t[end]
    return s


def disguised(s: str) -> bool:
    """Letters together with what may stand for letters, or a long run."""
    if s.isalpha():
        return RUN.search(s) is not None
    return any(c.isalpha() for c in s) and (any(c in LEET for c in s) or RUN.search(s) is not None)


def single_letters(s: str) -> set[str]:
    """``s`` with any of its doubled letters (of the first eight) written once."""
    parts = DOUBLED.split(s)  # text, letter, text, letter, ..., text
    out = {parts[0]}
    for i in range(1, len(parts), 2):
        once = (parts[i], parts[i] * 2) if i < 16 else (parts[i] * 2,)
        out = {x + c + parts[i + 1] for x in out for c in once}
    return out


class Reader:
    """Texts to restored words, with a bounded cache per worker."""

    def __init__(self, counts: np.ndarray):
        self.channel = Channel(counts)
        self.cache: dict[str, tuple[str, ...]] = {}

    def words_of(self, token: str, spaced: bool = False) -> tuple[str, ...]:
        if spaced:
            return tuple(self.channel.decode(token.lower(), True).split())
        s = core(token)
        if not s:
            return ()
        if disguised(s):
            return tuple(self.channel.decode(s).split())
        return (s,)

    def second(self, token: str, known) -> tuple[str, ...]:
        """Words of a token's second reading that are in ``known``. Only a token that could hold
        such a word - without its separators, or with one letter for two - is searched."""
        s, out = core(token), ()
        if INNER.search(s) and known.keys() & {GAPS.sub("", s), *GAPS.split(s)}:
            out = tuple(self.channel.decode(s, True).split())
        if DOUBLED.search(s) and s.isalpha() and known.keys() & single_letters(s):
            out += tuple(self.channel.decode(s, False, True).split())
        return tuple(w for w in out if w != s and w in known)

    def joined(self, a: str, b: str) -> str | None:
        """Two tokens as one word, if that is their cheapest reading."""
        read = self.channel.decode(f"{a} {b}", True)
        return read if " " not in read else None

    def words(self, token: str) -> tuple[str, ...]:
        w = self.cache.get(token)
        if w is None:
            if len(self.cache) > CACHE:
                self.cache.clear()
            w = self.cache[token] = self.words_of(token)
        return w

    def distinct(self, text: str) -> set[str]:
        """All restored words of a whole text."""
        out: set[str] = set()
        for t in set(text.split()):
            out.update(self.words(t))
        for m in SPACED.finditer(text):
            out.update(self.words_of(m[0], True))
        return out

    def restore(self, text: str, known: dict | None = None) -> str:
        """The text in restored words; second readings and joined tokens where they give a
        word of ``known``."""
        known = known or {}
        text = SPACED.sub(lambda m: " ".join(self.words_of(m[0], True)), text)
        tokens, out, i = text.split(), [], 0
        while i < len(tokens):
            a, b = tokens[i].lower(), tokens[i + 1].lower() if i + 1 < len(tokens) else ""
            if b and core(a + b) in known and (word := self.joined(a, core(b))):
                out.append(word)
                i += 2
                continue
            out += self.second(tokens[i], known) or self.words(tokens[i])
            i += 1
        return " ".join(out)


def features(word: str) -> tuple[str, ...]:
    """A word and its beginnings, which inflected and compound forms share."""
    return (word, *(f"{word[:n]}-" for n in (4, 5) if len(word) > n))


_MADE: dict[int, Reader] = {}


def reader(counts: np.ndarray) -> Reader:
    key = zlib.crc32(counts.tobytes())
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Reader(counts)
    return _MADE[key]


def restore(df: DataFrame, counts: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, restored`` for every row."""

    def run(batches):
        r = reader(counts)
        for ks, ts in column_lists(batches):
            yield {"doc_id": ks, "restored": [r.restore(t or "") for t in ts]}

    return with_schema(df.select(F.col(key).cast("long"), text), run, "doc_id long, restored string")


class Model:
    """Feature weights and the logistic curve (slopes of the strongest and of
    the further words, offset) over a document's evidence."""

    def __init__(self, weights: dict[str, float], curve: tuple[float, float, float] = (1.0, 0.0, 0.0)):
        self.weights, self.curve = weights, curve

    def weight(self, words) -> float:
        get = self.weights.get
        return max((get(f, 0.0) for w in words for f in features(w)), default=0.0)


def evidence_of(df: DataFrame, counts: np.ndarray, weights: dict[str, float]) -> DataFrame:
    """``doc_id, strongest, further`` of every row."""
    model = Model(weights)
    # whole words of the model; of a joined pair both parts are shorter
    whole = {w: x for w, x in weights.items() if not w.endswith("-") and len(w) > 3}

    def run(batches):
        r = reader(counts)
        memo: dict[str, float] = {}
        pairs: dict[tuple[str, str], float] = {}
        for ks, ts in column_lists(batches):
            strongest, further = [], []
            for t in ts:
                t = t or ""
                found = []
                for tok in set(t.split()):
                    x = memo.get(tok)
                    if x is None:
                        if len(memo) > CACHE:
                            memo.clear()
                        x = model.weight(r.words_of(tok))
                        # a second reading has to be a whole word of the model
                        x = memo[tok] = max([x, *[whole[w] for w in r.second(tok, whole)]])
                    if x:
                        found.append(x)
                low = t.lower().split() if whole else ()
                for a, b in {(a, b) for a, b in zip(low, low[1:]) if a + b in whole}:
                    x = pairs.get((a, b))
                    if x is None:
                        if len(pairs) > CACHE:
                            pairs.clear()
                        x = pairs[a, b] = whole[a + b] if r.joined(a, b) == a + b else 0.0
                    if x:
                        found.append(x)
                for m in SPACED.finditer(t):
                    found.append(model.weight(r.words_of(m[0], True)))
                best = nlargest(STRONGEST, found)
                strongest.append(float(best[0]) if best else 0.0)
                further.append(float(sum(best[1:])))
            yield {"doc_id": ks, "strongest": strongest, "further": further}

    return with_schema(df, run, "doc_id long, strongest double, further double")


def fit(df: DataFrame, counts: np.ndarray, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """``labels``: (doc_id, y in {0, 1})."""
    y = labels.filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull()).groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    # bounded: at most fit_rows rows, the smallest by a hash of the id
    y = y.orderBy(F.xxhash64(F.lit(6), "doc_id"), "doc_id").limit(fit_rows).collect()
    known = {r["doc_id"]: (r["y"], zlib.crc32(b"fold:%d" % r["doc_id"]) % FOLDS) for r in y}
    sample = df.sparkSession.createDataFrame([(k, f) for k, (_, f) in known.items()], "doc_id long, fold int")
    rows = saved(df.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "fold"), "labelled")

    def count(batches):
        r = reader(counts)
        total: dict[str, list[int]] = {}
        for ks, ts in column_lists(batches):
            for k, t in zip(ks, ts):
                label, fold = known[k]
                for f in {f for w in r.distinct(t or "") for f in features(w)}:
                    total.setdefault(f, [0] * 2 * FOLDS)[2 * fold + label] += 1
        yield {"f": list(total), "n": list(total.values())}

    each = [f"n{i}" for i in range(2 * FOLDS)]
    counted = with_schema(rows.select("doc_id", "text"), count, "f string, n array<long>").groupBy("f").agg(
        *[F.sum(F.col("n")[i]).alias(c) for i, c in enumerate(each)])
    counted = saved(counted.filter(sum((F.col(c) for c in each[1::2]), F.lit(0)) >= 2), "features")

    def weights(but: int | None) -> dict[str, float]:
        """Log odds from all folds but one."""
        use = [f for f in range(FOLDS) if f != but]
        n = {v: sum(1 for y_, f in known.values() if y_ == v and f != but) for v in (0, 1)}
        neg, pos = (sum((F.col(each[2 * f + v]) for f in use), F.lit(0)) for v in (0, 1))
        odds = F.log((pos + 0.5) / (n[1] + 1.0)) - F.log((neg + 0.5) / (n[0] + 1.0))
        se = F.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
        part = lambda k, v: F.when(k > 0, k * F.log(k * (n[0] + n[1]) / ((pos + neg) * max(n[v], 1)))).otherwise(0.0)
        w = F.when(2 * (part(pos, 1) + part(neg, 0)) >= SURPRISE, odds - se).otherwise(0.0)
        best = counted.filter(pos >= 2).select("f", w.alias("w")).filter("w > 0")
        return {r["f"]: float(r["w"]) for r in best.orderBy(F.desc("w"), "f").limit(MODEL_FEATURES).collect()}

    bins: Counter = Counter()
    for fold in range(FOLDS):  # three numbers for each of at most fit_rows rows reach the driver
        held = evidence_of(rows.filter(F.col("fold") == fold).select("doc_id", "text"), counts, weights(fold))
        bins.update((round(r["strongest"], 2), round(r["further"], 2), known[r["doc_id"]][0]) for r in held.collect())
    return Model(weights(None), logistic(bins))


def logistic(bins: dict[tuple[float, float, int], int], steps: int = 200) -> tuple[float, float, float]:
    """Slopes and offset of P(1 | strongest, further), Newton steps with a
    weak prior on the slopes, from counts of (strongest, further, label)."""
    if not bins:
        return 1.0, 0.0, -4.0
    z = np.array([(a, b, 1.0) for a, b, _ in bins])
    y = np.array([k[2] for k in bins], float)
    n = np.array(list(bins.values()), float)
    beta, prior = np.array([0.5, 0.0, -2.0]), np.diag([0.02, 0.02, 1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z + prior + 1e-9 * np.eye(3), z.T @ (n * (y - p)) - prior @ beta)
        step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    # evidence never speaks against toxicity
    return max(float(beta[0]), 1e-3), max(float(beta[1]), 0.0), float(beta[2])


def score_documents(df: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; learns from
    ``labels.toxic`` where crc32(doc_id) mod 4 is not 2."""
    counts = trigram_counts(df)
    r = remainder(F.col("doc_id"), 4)
    model = fit(df, counts, labels.filter(r != 2).select("doc_id", F.col("toxic").alias("y")))
    found = evidence_of(df.select(F.col("doc_id").cast("long"), "text"), counts, model.weights)
    a, b, c = model.curve
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("strongest") * a + F.col("further") * b + c)))
    return found.select("doc_id", F.coalesce(r == 2, F.lit(False)).alias("held_out"), score.alias("score"), "strongest", "further",
                        (score >= THRESHOLD).cast("int").alias("predicted"))
