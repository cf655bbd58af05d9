"""License scans by a positional rare-token index, in DataFrame functions only.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z
lower-cased. A template counts only where its mandatory key phrases stand word
for word, so each of its places holds the rarest word (of the highest IDF over
all texts) of its first key phrase. The index holds the postings (template,
position) of those words; every such word of a text, at place p with a posting
at q, is looked up and gives the place p - q. Each place at which the key
phrases stand is scored by all template words that stand where it says, and
the best score of a template counts.

Defined cases: null text counts as empty; repeated rows give repeated results;
a template's labels and score depend on its own places alone; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import functools
import json
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# License templates: label, notice, mandatory key phrases.
TEMPLATES = (
    ("agpl", "gnu affero general public license version 3", ("affero general public license",)),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("in compliance with the license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("general public license",)),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("lgpl", "gnu lesser general public license version 2 1", ("lesser general public license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("proprietary", "all rights reserved", ("all rights reserved",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("released into the public domain",)),
)

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MIN_SCORE = 0.6

VOCABULARY = sorted({w for _, t, _ in TEMPLATES for w in t.split()})


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased as far as ASCII goes: the two other characters whose
    lower case holds ASCII letters are put out of the way first. Non-ASCII
    letters may change too, but never into or out of a word."""
    for c in ("K", "İ"):
        text = F.replace(text, F.lit(c), F.lit("ª"))
    return F.lower(text)


def words(low: Column) -> Column:
    """Words of a lower-cased text: what lies between the separators."""
    return F.array_remove(F.split(low, SEPARATORS, -1), "")


def vocabulary_counts(docs: DataFrame, text_col: str) -> dict[str, int]:
    """How many texts hold each template word. At most one row per template
    word reaches the driver."""
    present = F.array_intersect(words(ascii_lower(F.col(text_col))), word_list(VOCABULARY))
    rows = (docs.select(F.explode_outer(present).alias("w")).where("w is not null")
            .groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect())
    return {r["w"]: r["n"] for r in rows}


def idf(total: int, counts: dict[str, int]) -> dict[str, float]:
    return {w: round(math.log((1 + total) / (1 + counts.get(w, 0))) + 1, 6) for w in VOCABULARY}


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also inside its lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _stands(ws: Column, at: Column, word: Column) -> Column:
    return F.coalesce((at >= 0) & (F.get(ws, F.greatest(at, F.lit(0))) == word), F.lit(False))


def phrase_places(ws: Column, hits: Column, phrase: str, label: str) -> Column:
    """Word numbers at which ``phrase`` stands, from the hits of its first
    word, each with the label."""
    first, *rest = phrase.split()
    found = F.filter(hits, lambda h: functools.reduce(
        operator.and_, [_stands(ws, h["at"] + i, F.lit(w)) for i, w in enumerate(rest, 1)], h["w"] == first))
    return F.transform(found, lambda h: F.struct(h["at"].alias("at"), F.lit(label).alias("label")))


def template_table(weight: dict[str, float]) -> Column:
    """The templates as a constant array: number, label, words (place, word,
    weight), their total weight, and the words of the key phrases (place,
    word). Written as JSON, which Spark reads once while planning."""
    rows = []
    for t, (label, notice, keys) in enumerate(TEMPLATES):
        parts = notice.split()
        key_words = []
        for key in keys:
            k = key.split()
            at = next(i for i in range(len(parts)) if parts[i:i + len(k)] == k)
            key_words += [{"at": at + i, "w": w} for i, w in enumerate(k)]
        rows.append({"t": t, "label": label, "total": sum(weight[w] for w in parts), "keys": key_words,
                     "words": [{"at": i, "w": w, "weight": weight[w]} for i, w in enumerate(parts)]})
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<t:int,label:string,total:double,"
                       "keys:array<struct<at:int,w:string>>,words:array<struct<at:int,w:string,weight:double>>>>")


def anchor_of(phrase: str, weight: dict[str, float]) -> str:
    """The rarest word of a phrase, of equally rare ones the longest."""
    return max(phrase.split(), key=lambda w: (weight[w], len(w), w))


def posting_table(weight: dict[str, float]) -> Column:
    """The index as a constant map: the rarest word of each template's first
    key phrase to its postings (template, place)."""
    postings: dict[str, list[dict[str, int]]] = {}
    for t, (_, notice, keys) in enumerate(TEMPLATES):
        parts, key = notice.split(), keys[0].split()
        w = anchor_of(keys[0], weight)
        at = next(i for i in range(len(parts)) if parts[i:i + len(key)] == key)
        postings.setdefault(w, []).append({"t": t, "q": at + key.index(w)})
    return F.from_json(F.lit(json.dumps(postings)), "map<string,array<struct<t:int,q:int>>>")


def word_list(ws: list[str]) -> Column:
    return F.split(F.lit(" ".join(ws)), " ")


def template_score(ws: Column, places: Column, template: Column) -> Column:
    """Score (0 to 1) of the best place of a template: the weight of its words
    that stand there, 0 where a key phrase is missing."""
    starts = F.transform(F.filter(places, lambda v: v["t"] == template["t"]), lambda v: v["start"])

    def score(start: Column) -> Column:
        got = F.aggregate(template["words"], F.lit(0.0), lambda acc, x: acc + F.when(
            _stands(ws, start + x["at"], x["w"]), x["weight"]).otherwise(F.lit(0.0)))
        keyed = F.forall(template["keys"], lambda x: _stands(ws, start + x["at"], x["w"]))
        return F.when(keyed, F.least(got / template["total"], F.lit(1.0))).otherwise(F.lit(0.0))

    return F.coalesce(F.array_max(F.transform(starts, score)), F.lit(0.0))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_words, n_base, first_word,
    last_word, base_labels, labels, score. Two passes over the texts, the
    first for the word counts behind the IDF; no row is shuffled."""
    weight = idf(docs.count(), vocabulary_counts(docs, text_col))
    index, vocabulary = posting_table(weight), word_list(VOCABULARY)

    low = F.coalesce(ascii_lower(F.col(text_col)), F.lit(""))
    df = docs.select(F.col(id_col), low.alias("_low"))
    # Every base phrase and every template's key phrases need one of these.
    rarest = sorted({anchor_of(k[0], weight) for _, _, k in TEMPLATES})
    anchors = sorted({*rarest, *(p.split()[-1] for p in PHRASES)})
    ws = F.col("_ws")
    marked = functools.reduce(operator.or_, [
        F.contains(F.col("_low"), F.lit(a)) if len(a) > 3 else F.array_contains(ws, a) for a in anchors])
    df = df.select(id_col, "_low", words(F.col("_low")).alias("_ws"))
    df = df.select(id_col, "_ws", marked.alias("_marked"))
    df = df.select(id_col, "_ws", F.size(ws).cast("long").alias("n_words"), F.when(F.col("_marked"), F.filter(
        F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("at"))),
        lambda h: F.array_contains(vocabulary, h["w"]))).alias("_hits"))
    hits = F.col("_hits")
    some = hits.isNotNull() & (F.size(hits) > 0)
    places = F.flatten(F.transform(
        F.filter(hits, lambda h: F.array_contains(word_list(rarest), h["w"])),
        lambda h: F.transform(F.element_at(index, h["w"]), lambda p: F.struct(
            p["t"].alias("t"), (h["at"] - p["q"]).alias("start")))))
    # Templates of any score, and the places of the base phrases.
    found = F.filter(let(places, lambda vs: F.transform(template_table(weight), lambda t: F.struct(
        t["label"].alias("label"), template_score(ws, vs, t).alias("score")))), lambda f: f["score"] > 0)
    base = F.flatten(F.array(*[phrase_places(ws, hits, *p) for p in PHRASES.items()]))
    df = df.select(id_col, "n_words",
                   F.when(some, found).otherwise(F.array().cast("array<struct<label:string,score:double>>")).alias("_found"),
                   F.when(some, base).otherwise(F.array().cast("array<struct<at:int,label:string>>")).alias("_base"))
    base_labels = F.transform("_base", lambda b: b["label"])
    labels = F.array_union(base_labels, F.transform(
        F.filter("_found", lambda f: f["score"] >= MIN_SCORE), lambda f: f["label"]))
    starts = F.transform("_base", lambda b: b["at"])
    return df.select(
        id_col, "n_words", F.size("_base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("_found", lambda f: f["score"])), F.lit(0.0)).alias("score"))
