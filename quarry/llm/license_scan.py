"""License scan with a positional index of rare words.

A label has mandatory key phrases. The index holds, for every phrase, where
in it each word stands. Document frequencies of the phrases' words are counted over
the whole corpus; the words of highest IDF in a phrase are its anchors. A
document is looked up by the anchors it contains: each place of an anchor
minus the anchor's place in the phrase is a start, the starts of two anchors
are intersected, and at what remains the whole phrase is verified word for word. A
document without the rarest word of any phrase needs no lookup.

Built-in functions only; two scans (frequencies, lookup), no shuffle of
documents, nothing but the frequencies of the phrases' words reaches the driver.

Words: texts in lower case (A-Z), maximal runs of ``[0-9a-z]`` and characters
beyond ASCII. Rows: a null text counts as empty and has no words and no label;
a very long text is scanned whole; repeated rows give repeated results; an empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: phrase and base label.
BASE = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}

#: Further labels of the method, each with its mandatory key phrases (public licence wording).
FURTHER = {
    "agpl": ("gnu affero general public license",),
    "all-rights-reserved": ("all rights reserved",),
    "apache-2.0": ("apache license version 2 0",),
    "apache-2.0-notice": ("licensed under the apache license", "you may not use this file except in compliance with the license",
                          "without warranties or conditions of any kind"),
    "bsd-text": ("redistribution and use in source and binary forms with or without modification are permitted",
                 "redistributions of source code must retain the above copyright notice"),
    "cc-by-4.0": ("cc by 4 0",),
    "cc-by-nc": ("cc by nc",),
    "cc-by-sa": ("cc by sa",),
    "cc0": ("creative commons zero",),
    "creative-commons": ("creative commons attribution",),
    "gpl-2.0": ("gnu general public license version 2",),
    "gpl-3.0": ("gnu general public license version 3",),
    "gpl-notice": ("you can redistribute it and or modify it under the terms of the gnu general public license",
                   "without any warranty"),
    "isc-text": ("permission to use copy modify and or distribute this software for any purpose",),
    "lgpl": ("gnu lesser general public license",),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy",
                 "the software is provided as is without warranty of any kind"),
    "mpl": ("mozilla public license",),
    "public-domain": ("released into the public domain",),
}
TEMPLATES: dict[str, tuple[str, ...]] = {k: (v,) for k, v in BASE.items()} | FURTHER
ANCHORS = 2
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def phrases_of(templates: dict[str, tuple[str, ...]]) -> list[str]:
    return sorted({p for ps in templates.values() for p in ps})


def words_of(text: Column) -> Column:
    """The words of a text. The two letters beyond ASCII whose lower case is
    an ASCII letter (Kelvin sign, dotted capital I) are set aside, so that
    lower-casing changes no word into one of the phrases'."""
    plain = F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u03ba")), F.lit("\u0130"), F.lit("\u0131"))
    return F.array_remove(F.split(F.lower(plain), GAP), "")


def frequencies(df: DataFrame, vocabulary: set[str], text: str = "text") -> dict[str, int]:
    """Number of documents that hold each word; at most one row per word of
    the phrases reaches the driver."""
    known = F.array(*[F.lit(w) for w in sorted(vocabulary)])
    seen = df.select(F.explode(F.array_intersect(words_of(F.col(text)), known)).alias("w"))
    return {r["w"]: r["count"] for r in seen.groupBy("w").count().collect()}


def anchors_of(phrase: str, df_of: dict[str, int], n: int = ANCHORS) -> list[tuple[str, int]]:
    """The phrase's words of highest IDF (fewest documents), with their first
    place in it; rarest first."""
    ws = phrase.split()
    return sorted({w: ws.index(w) for w in ws}.items(), key=lambda x: (df_of.get(x[0], 0), -len(x[0]), x))[:n]


def starts_of(words: Column, hits: Column, phrase: str, anchors: list[tuple[str, int]]) -> Column:
    """Starts of the phrase: starts that its anchors agree on, verified."""
    ws = phrase.split()
    for k, (a, place) in enumerate(anchors):
        at = F.transform(F.filter(hits, lambda h: h["w"] == a), lambda h: h["i"] - place)
        starts = at if k == 0 else F.array_intersect(starts, at)
    whole = F.array(*[F.lit(w) for w in ws])
    return F.filter(starts, lambda s: (s >= 0) & (F.slice(words, F.greatest(s, F.lit(0)) + 1, len(ws)) == whole))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, tuple[str, ...]] | None = None,
         base: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score`` of every row. Score: the best label's share of key-phrase words
    that are verified (1 when a label is complete)."""
    templates, base = templates or TEMPLATES, base or BASE
    phrases = phrases_of(templates)
    df_of = frequencies(df, {w for p in phrases for w in p.split()}, text)
    anchors = {p: anchors_of(p, df_of) for p in phrases}
    t = F.coalesce(F.col(text), F.lit(""))
    rarest = {a[0][0] for a in anchors.values()}
    every = sorted({w for a in anchors.values() for w, _ in a})
    rows = df.select(F.col(key).cast("long").alias("doc_id"), t.alias("t"))
    rows = rows.select("doc_id", words_of(F.col("t")).alias("w"))
    # only documents that hold a rarest word are looked up
    none = F.array().cast("array<struct<w:string,i:int>>")
    numbered = F.transform("w", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    hits = F.filter(numbered, lambda h: h["w"].isin(every))
    rows = rows.select("doc_id", "w", F.size("w").cast("long").alias("n_words"),
                       F.when(F.arrays_overlap("w", F.array(*[F.lit(w) for w in sorted(rarest)])), hits).otherwise(none).alias("hits"))
    rows = rows.select("doc_id", "n_words", *[starts_of(F.col("w"), F.col("hits"), p, anchors[p]).alias(f"p{i}") for i, p in enumerate(phrases)])
    at = {p: F.col(f"p{i}") for i, p in enumerate(phrases)}
    of_base = F.concat(*[at[p] for p in base.values()])
    share = lambda ps: sum((F.when(F.size(at[p]) > 0, len(p.split())).otherwise(0) for p in ps), F.lit(0)) / float(sum(len(p.split()) for p in ps))
    label = lambda names, ps: F.concat_ws(",", *[F.when(_all([F.size(at[p]) > 0 for p in ps[n]]), F.lit(n)) for n in sorted(names)])
    return rows.select(
        "doc_id", "n_words", F.size(of_base).cast("long").alias("n_base"), F.array_min(of_base).cast("long").alias("first_word"),
        F.array_max(of_base).cast("long").alias("last_word"), label(base, {k: (v,) for k, v in base.items()}).alias("base_labels"),
        label(templates, templates).alias("labels"), F.round(F.greatest(*[share(ps) for ps in templates.values()]), 9).alias("score"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def oracle_sql() -> str:
    """The same result in DuckDB: phrases as word lists at every place."""
    phrases = phrases_of(TEMPLATES)
    at = {p: f"p{i}" for i, p in enumerate(phrases)}
    found = ",\n    ".join(
        f"list_filter(range(len(w)), lambda i: w[i+1:i+{len(p.split())}] = {p.split()!r}) AS p{i}" for i, p in enumerate(phrases))
    share = ", ".join("(" + " + ".join(f"CASE WHEN len({at[p]}) > 0 THEN {len(p.split())} ELSE 0 END" for p in ps)
                      + f") / {float(sum(len(p.split()) for p in ps))}" for ps in TEMPLATES.values())
    label = lambda names: "concat_ws(',', " + ", ".join(
        f"CASE WHEN {' AND '.join(f'len({at[p]}) > 0' for p in TEMPLATES[n])} THEN '{n}' END" for n in sorted(names)) + ")"
    base = "list_concat(" * (len(BASE) - 1) + at[list(BASE.values())[0]] + "".join(f", {at[p]})" for p in list(BASE.values())[1:])
    return f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{CAPITALS}', '{CAPITALS.lower()}'),
             '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words,
    {found} FROM d),
b AS (SELECT *, {base} AS b FROM f)
SELECT doc_id, n_words, len(b)::BIGINT AS n_base, list_min(b)::BIGINT AS first_word, list_max(b)::BIGINT AS last_word,
       {label(BASE)} AS base_labels, {label(TEMPLATES)} AS labels, round(greatest({share}), 9) AS score
FROM b"""
