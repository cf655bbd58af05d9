import re

from bazaar.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    ws = WORD.findall((text or "").translate(LOWER))
    at, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(ws) - len(p) + 1):
            if ws[i:i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def run(df):
    return {r.doc_id: r for r in licenses.scan_licenses(df).collect()}


TEXTS = [
    "Released under the MIT License.", "mit license mit-license MIT\tLICENSE", "Apache\nLicense and general public license",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
    "All rights reserved.", "all of the rights were reserved", "the mit has no licence", "miıt license", "mit licenſe",
    "xmit license", "MİT LICENSE mit LICENSE", "12 34 general public  license5", None, "", "license", "...",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that x",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "The lesser general public license of a gnu", "word " * 5000 + "mit license",
]


def test_base_matches_brute_force(spark):
    got = run(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))
    for i, text in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text), text and text[:50]
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1


def test_templates(spark):
    got = run(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))
    assert [got[i].labels for i in (0, 3, 4, 5, 6, 17, 18)] == ["mit", "gpl", "cc-by-nc", "proprietary", "", "bsd", "mit"]
    assert got[0].score == 1.0 and got[6].score == 0.0


def test_every_template_finds_itself(spark):
    docs = spark.createDataFrame([(i, "some words " + t + " more") for i, (_, t, _) in enumerate(licenses.TEMPLATES)],
                                 "doc_id long, text string")
    got = run(docs)
    for i, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in got[i].labels.split(","), label


def test_edge_rows(edge_docs, clashing, no_docs):
    want = sorted(map(str, licenses.scan_licenses(edge_docs).collect()))
    assert sorted(map(str, licenses.scan_licenses(clashing).collect())) == want
    rows = {(r.doc_id, r.n_words) for r in licenses.scan_licenses(edge_docs).collect()}
    assert rows == {(r.doc_id, base(r.text)[0]) for r in edge_docs.collect()}
    assert licenses.scan_licenses(no_docs).collect() == []


def test_no_python_in_the_plan(edge_docs):
    plan = licenses.scan_licenses(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def scores(text, weight):
    """Best score of each template by trying every place of the text."""
    ws, out = WORD.findall((text or "").translate(LOWER)), {}
    for label, notice, keys in licenses.TEMPLATES:
        parts = notice.split()
        key_at = [(next(i for i in range(len(parts)) if parts[i:i + len(k)] == k), k) for k in map(str.split, keys)]
        for start in range(-len(parts), len(ws)):
            at = [ws[start + i] if 0 <= start + i < len(ws) else None for i in range(len(parts))]
            if all(at[i:i + len(k)] == k for i, k in key_at):
                got = sum(weight[w] for w, x in zip(parts, at, strict=True) if w == x) / sum(weight[w] for w in parts)
                out[label] = max(out.get(label, 0), got)
    return out


def test_every_place_of_every_template_counts(spark):
    notices = [t for _, t, _ in licenses.TEMPLATES]
    rare = "redistribution mozilla documentation unencumbered affero lesser attribution commons foundation"
    texts = [*TEXTS, " and then ".join(notices), f"{rare} x " * 300 + "All rights reserved. " + f"{rare} y " * 300,
             f"{rare} licensed under CC BY 4.0 {rare}", "mit license " * 50 + notices[12], *notices]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weight = licenses.idf(docs.count(), licenses.vocabulary_counts(docs, "text"))
    got = run(docs)
    for i, text in enumerate(texts):
        want = scores(text, weight)
        labels = {x for x, y in want.items() if y >= licenses.MIN_SCORE} | set(filter(None, base(text)[4].split(",")))
        assert got[i].labels == ",".join(sorted(labels)), text and text[:50]
        assert abs(got[i].score - max(want.values(), default=0)) < 1e-9, text and text[:50]
    assert got[len(TEXTS)].labels == ",".join(sorted({x for x, _, _ in licenses.TEMPLATES}))
