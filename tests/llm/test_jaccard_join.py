import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from bazaar.llm import jaccard_join
from bazaar.llm.components import connected_components
from tests.llm.conftest import SCHEMA, VOCAB, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(ws[k:k + 5]) for k in range(max(1, len(ws) - 4))) if ws else frozenset()


def brute(rows):
    """Component of each row by all pairs; null ids are never the smallest."""
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


def edited(rng, text, share):
    return " ".join(rng.choice(VOCAB) if rng.random() < share else w for w in text.split())


def corpus(rng):
    """Groups of near copies of many degrees around the threshold, chains,
    exact copies, and a passage that many texts share."""
    rows, passage = [], prose(rng, 30)
    for _ in range(12):
        text = prose(rng, rng.choice((6, 20, 60, 150, 400)))
        rows += [edited(rng, text, rng.choice((0, 0.005, 0.02, 0.04, 0.08))) for _ in range(rng.choice((2, 5, 20)))]
    for _ in range(60):
        rows.append(prose(rng, rng.choice((2, 10, 25))) + " " + passage + " " + prose(rng, rng.choice((1, 5, 40))))
    chain = prose(rng, 100).split()
    for k in range(10):
        rows.append(" ".join(chain[2 * k:] + [f"z{k}{i}" for i in range(2 * k)]))
    rows += [rows[0].upper()] * 5 + ["One two", "one  TWO", "one two three"]
    rng.shuffle(rows)
    return [(i * 3, t, "en", "a", 1) for i, t in enumerate(rows)]


def run(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_copies(df).collect())


@pytest.mark.parametrize("least", [2, 8])
def test_components_match_all_pairs(spark, rng, monkeypatch, least):
    monkeypatch.setattr(jaccard_join, "COMMON_LEAST", least)
    rows = corpus(rng)
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


@pytest.mark.parametrize("block", [3, 2048])
def test_the_exact_phase_alone_finds_all_links(spark, rng, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "MEETINGS", 0)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = corpus(rng)
    assert run(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_joins_by_shuffle_too(spark, rng, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_BYTES", -1)
    rows = corpus(rng)[:80]
    assert run(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_edge_rows(edge_docs, clashing, no_docs):
    want = brute([tuple(r) for r in edge_docs.collect()])
    assert run(edge_docs) == want
    assert run(clashing) == want
    assert jaccard_join.near_copies(no_docs).collect() == []


def test_drop_near_copies(clashing, no_docs):
    got = jaccard_join.drop_near_copies(clashing)
    assert got.columns == clashing.columns
    # 1004 twice (repeated rows stay together); the null id and 1005 are copies of it.
    ids = Counter(r.doc_id for r in got.collect())
    assert ids == Counter([1000, 1001, 1002, 1003, 1004, 1004, 1006, 1007, 1008, None])
    assert jaccard_join.drop_near_copies(no_docs).collect() == []


def test_the_bitmap_never_bounds_too_low(rng):
    r = np.random.default_rng(1)
    for _ in range(300):
        n, m, both = r.integers(1, 300), r.integers(1, 300), r.integers(0, 200)
        pool = r.integers(0, 2**64, n + m + both, dtype=np.uint64)
        x, y = np.unique(pool[:n + both]), np.unique(pool[n:])
        true = len(np.intersect1d(x, y))
        assert jaccard_join.overlap_bound(jaccard_join.bitmap(x), jaccard_join.bitmap(y), len(x), len(y)) >= true


def test_components(spark, rng):
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)]
    up = {x: x for e in edges for x in e}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    want = {x: find(x) for x in up}
    got = {r.node: r.component for r in connected_components(
        spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    alone = {a for a, b in edges if a == b} - set(got)
    assert {k: v for k, v in want.items() if k not in alone} == got
