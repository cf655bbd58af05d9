import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bazaar.llm import prefix_parse as P
from bazaar.llm.queries import op11_prefix_parse
from tests.llm.conftest import prose


def brute(rows, length=P.LENGTH):
    """Contract rows by counting every string of the length."""
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[p:p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, int)
        for p in range(len(t) - length + 1):
            if count[t[p:p + length]] > 1:
                gone[p] += 1
                gone[p + length] -= 1
        cover = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~cover])
        out.append((i, len(t), int(cover.sum()), int((np.diff(np.concatenate([[0], cover])) == 1).sum()),
                    hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    out = P.remove_repeats(df).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")), F.size("spans").cast("long"), F.sha2("kept", 256))
    return sorted((tuple(r) for r in out.collect()), key=str)


def corpus(rng):
    """Copies, passages around the length in other surroundings, edits, and
    periodic text."""
    rows = [prose(rng, rng.choice([5, 60, 100, 300])) for _ in range(25)]
    for k, n in enumerate([398, 399, 400, 401, 402, 430, 470, 520, 700]):
        passage = prose(rng, 200)[:n]
        rows += [prose(rng, 30) + passage + prose(rng, 20 + j) for j in range(2 + k % 2)]
    shared = prose(rng, 80)[:430]
    rows += [prose(rng, 12) + shared + prose(rng, 12) for _ in range(40)]  # more reaches than one task compares
    base = prose(rng, 500)
    rows += [base, base, base + " end"]
    for _ in range(6):
        words = base.split(" ")
        for _ in range(3):
            words[rng.randrange(len(words))] = "EDIT"
        rows.append(" ".join(words))
    twice = prose(rng, 90)
    rows += [twice + "\n" + prose(rng, 10) + twice, "x" * 399, "y" * 400, "z" * 401, "ab" * 700, "abc" * 300 + prose(rng, 40),
             "ab" * 333, "é" * 250, "日本語 " * 150, prose(rng, 10) + "-" * 900 + prose(rng, 100) + "-" * 450]
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def small(spark):
    import random
    rows = corpus(random.Random(8))
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_matches_brute_force(small):
    rows, df = small
    want = brute(rows)
    assert sum(r[2] > 0 for r in want) > 60 and sum(r[3] > 1 for r in want) > 4
    assert result(df) == want


def test_cut_segments_and_many_reaches(small, monkeypatch):
    # Pieces of segments and hashed chunks as small as they may be, no key compared in one task.
    rows, df = small
    for name, value in (("PIECE", 90), ("CHUNK", 2000), ("TOGETHER", 1), ("EVERY", 11)):
        monkeypatch.setattr(P, name, value)
    assert result(df) == brute(rows)


def test_blocks_of_a_common_passage(rng):
    # Spans of a passage that 60 texts have in other surroundings, and of a longer one that two of them share.
    passage, longer = prose(rng, 60)[:340], prose(rng, 70)[:140]
    texts = [(prose(rng, 40) + " " + passage + (longer if k < 2 else prose(rng, 40))[:140]).encode() for k in range(60)]
    rows = []
    for k, t in enumerate(texts):
        for kind, *found in P.pieces_of([(t, P.find_triggers(np.frombuffer(t, np.uint8))[0].tolist())]):
            if kind == P.SPAN:
                rows += [(bytes([k]) * 16, x, t[x:y + P.LENGTH], k1) for x, y, k1 in
                         zip(*(f.tolist() for f in found[:2]), found[2].view(np.int64).tolist(), strict=True)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["md5", "lo", "bytes", "k1"])
    blocks = [r for b in P.block_rows(iter([batch])) for r in b.to_pylist()]

    def starts(some):
        return [(r["md5"], r["lo"] + p, r["bytes"][p:p + P.LENGTH]) for r in some for p in range(len(r["bytes"]) - P.LENGTH + 1)]
    spans = [(m, lo + p, x[p:p + P.LENGTH]) for m, lo, x, _ in rows for p in range(len(x) - P.LENGTH + 1)]
    assert sorted(starts(blocks)) == sorted(spans)  # each start in one block
    count = Counter((r["c1"], r["c2"]) for r in blocks)
    left = starts(r for r in blocks if count[r["c1"], r["c2"]] > 1)
    times = Counter(x for _, _, x in spans)
    assert sum(n > 1 for n in times.values()) > 50
    assert {x for x in spans if times[x[2]] > 1} <= set(left)
    # Every start of the spans was dealt by string before.
    assert len(blocks) + len(left) < len(spans) / 5


@pytest.mark.parametrize("block", [1, 7, 300])
def test_other_blocks(small, monkeypatch, block):
    rows, df = small
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "TOGETHER", 1)
    assert result(df) == brute(rows)


def test_few_triggers(small, monkeypatch):
    rows, df = small
    monkeypatch.setattr(P, "EVERY", 500)
    assert result(df) == brute(rows)


def test_triggers_do_not_depend_on_chunks_or_neighbours(rng, monkeypatch):
    data = np.frombuffer(prose(rng, 3000).encode(), np.uint8)
    ends, keys = P.find_triggers(data)
    assert len(ends) > 100
    cut = int(ends[20]) - P.CONTEXT
    e, k = P.find_triggers(data[cut:])
    assert (e + cut).tolist() == ends[20:].tolist() and k.tolist() == keys[20:].tolist()
    assert len(P.find_triggers(np.frombuffer(b"abcde" * 500, np.uint8))[0]) == 0


def test_edges(spark, edge_docs, clashing, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    want = brute(rows)
    assert result(edge_docs) == want
    assert result(clashing) == want
    assert result(no_docs) == []
    again = edge_docs.unionByName(edge_docs)
    assert result(again) == brute(rows + rows)


def test_spans_and_kept_give_the_text_back(small):
    rows, df = small
    texts = dict(rows)
    for r in P.remove_repeats(df).collect():
        data, at, back = texts[r.doc_id].encode(), 0, []
        for s in r.spans:
            assert s.end - s.start >= P.LENGTH
            back.append(data[at:s.start])
            at = s.end
        assert b"".join([*back, data[at:]]) == bytes(r.kept)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op11_prefix_parse(spark, sf).collect()), key=str) == brute(rows)
