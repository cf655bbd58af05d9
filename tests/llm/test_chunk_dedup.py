import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from bazaar.llm import chunk_dedup as cd
from bazaar.llm.words import words_of
from tests.llm.conftest import SCHEMA, prose


def cuts(text):
    return next(cd.cuts_of(w.data, w.base, w.starts, w.ends) for w in words_of(pa.array([text]))).tolist()


def pieces(text):
    raw = text.encode()
    c = cuts(text)
    return [raw[a:b] for a, b in zip(c, c[1:], strict=False)]


def gear_by_the_book(data):
    h, out = 0, []
    for b in data.tolist():
        h = ((h << 1) + int(cd._GEAR[b])) & 0xFFFF
        out.append(h)
    return out


def test_gear_hash_is_the_rolling_one():
    data = np.frombuffer(bytes(range(256)) * 3, np.uint8)
    assert cd.gear(data).tolist() == gear_by_the_book(data)


def test_chunks_round_trip_and_resist_insertions(rng):
    text = prose(rng, 3000) + " ünï 漢字" * 40
    assert b"".join(pieces(text)) == text.encode()
    assert all(p.decode() is not None for p in pieces(text))
    moved = prose(rng, 7) + " " + text
    assert len(set(pieces(text)) - set(pieces(moved))) <= 2
    han = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(3000))
    assert len(pieces(han)) > 5 and b"".join(pieces(han)) == han.encode()


def test_a_text_is_cut_alike_in_any_company(rng):
    texts = [prose(rng, 400) for _ in range(4)]
    for w in words_of(pa.array(texts)):
        all_cuts = cd.cuts_of(w.data, w.base, w.starts, w.ends)
        for i, t in enumerate(texts):
            lo, hi = w.base[i], w.base[i + 1]
            mine = all_cuts[(all_cuts >= lo) & (all_cuts <= hi)] - lo
            assert mine.tolist() == cuts(t)


def brute(rows, min_run):
    """Per (id, text): repeated chunks, dropped characters, kept text."""
    texts = sorted({(r[0], r[1]) for r in rows if r[1]}, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    owners = defaultdict(set)
    parsed = {}
    for t in texts:
        at, big = 0, []
        for p in pieces(t[1]):
            if len(p) >= cd.MIN_BYTES:
                big.append((at, at + len(p.decode()), len(p), hashlib.sha1(p).digest()))
                owners[big[-1][3]].add(t)
            at += len(p.decode())
        parsed[t] = big
    out, seen = {}, set()
    for t in texts:
        runs, run = [], []
        for c in [*parsed[t], None]:
            if c and len(owners[c[3]]) > 1:
                run.append(c)
            else:
                if sum(x[2] for x in run) >= min_run:
                    runs += run
                run = []
        drop = [c for c in runs if c[3] in seen]
        seen |= {c[3] for c in parsed[t]}
        kept = list(t[1])
        for c in drop:
            kept[c[0]:c[1]] = [""] * (c[1] - c[0])
        out[t] = (len(runs), "".join(kept))
    return out


def test_matches_brute_force(spark, rng):
    shared = [prose(rng, 60) for _ in range(3)]
    rows = []
    for i in range(80):
        parts = [prose(rng, rng.randrange(1, 60))]
        if rng.random() < 0.6:
            parts += [rng.choice(shared), prose(rng, rng.randrange(1, 40))]
        rows.append((i, "\n".join(parts), "en", "a", 1))
    rows += [(200 + i, rows[0][1], "en", "a", 1) for i in range(3)] + [rows[1]]
    got = cd.dedup_substrings(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = brute(rows, cd.MIN_RUN)
    text = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        assert (r._n_repeated, r.text) == want[r.doc_id, text[r.doc_id]]
    hold = {r[0] for r in rows if any(s in r[1] for s in shared)}
    found = {r.doc_id for r in got if r._n_repeated}
    assert hold <= found and found <= hold | {0, 1, 200, 201, 202}


def test_edge_rows(edge_docs, clashing, no_docs):
    rows = [tuple(r) for r in edge_docs.collect()]
    want = brute(rows, cd.MIN_RUN)
    for df in (edge_docs, clashing):
        got = cd.dedup_substrings(df).collect()
        assert sorted(str((r.doc_id, r._n_repeated, r.text)) for r in got) == sorted(
            str((r[0], *(want[r[0], r[1]] if r[1] else (0, r[1])))) for r in rows)
    assert cd.dedup_substrings(no_docs).collect() == []


LETTERS = {"en": "etaoinshrdlucmfwypvbgk", "fr": "esaitnrulodcmpéèàêçvqfbgh", "de": "enisratdhulcgmobwfkzpvüäöß",
           "el": "αεητιοσρνκλπμυδθω", "ru": "оеаинтсрвлкмдпуяыьгзбчй"}


def invented(rng, letters, n):
    return ["".join(rng.choice(letters) for _ in range(rng.choice((1, 2, 2, 3, 4, 5, 6, 7, 8, 11)))) for _ in range(n)]


def test_every_planted_passage_of_51_words_is_found(spark, rng):
    rows, planted = [], {}
    for lang, letters in LETTERS.items():
        words = invented(rng, letters, 2000)
        for _ in range(60):
            passage = " ".join(rng.choices(words, k=51)) + rng.choice(["", ".", "?", "9"])
            for _ in range(2):
                before, after = (" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(2))
                planted[len(rows)] = passage
                rows.append((len(rows), f"{before} {passage} {after}", lang, "a", 1))
        rows += [(len(rows) + i, " ".join(rng.choices(words, k=120)), lang, "a", 1) for i in range(40)]
    got = {r.doc_id: r for r in cd.dedup_substrings(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    text = {r[0]: r[1] for r in rows}
    missed = []
    for i, passage in planted.items():
        at = text[i].find(passage)
        if not any(p.start < at + len(passage) and p.end > at for p in got[i]._passages or ()):
            missed.append((i, rows[i][2]))
    assert missed == []
    assert {i for i, r in got.items() if r._n_repeated} == set(planted)


def test_columns_named_as_its_own_stay(clashing):
    mine = ("_id", "_key", "_dropped")
    df = clashing.withColumns({c: F.lit("mine") for c in (*mine, "_n_repeated", "_passages", "_first_ids")})
    out = cd.dedup_substrings(df)
    assert {c for c in df.columns} == {c for c in out.columns}
    assert {tuple(r[c] for c in mine) for r in out.collect()} == {("mine",) * 3}
    assert all(r._n_repeated != "mine" for r in out.collect())
