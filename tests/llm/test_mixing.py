import hashlib
import re

import pytest
from pyspark.sql import functions as F

from bazaar.llm import mixing
from bazaar.llm.mixing import mix_sources, weights_by_position
from tests.llm.conftest import SCHEMA, prose


def water_fill(sizes, weights, budget, cap):
    """Rounds of sharing the excess by weight, as the contract words it."""
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    left = budget * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(weights[s] for s in open_)
        over, spent = set(), left
        left = 0.0
        for s in open_:
            target[s] += spent * weights[s] / total
            if target[s] > cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                over.add(s)
        open_ -= over
        if not over:
            break
    return target


def key(s):
    return (s is None, s or "")


@pytest.fixture()
def docs(spark, rng):
    rows = [(i, prose(rng, rng.choice((1, 5, 40, 200))), "en", s, 0) for i, s in enumerate(
        rng.choices(["a", "b", "c", "dé", None], [60, 20, 10, 8, 2], k=400))]
    return spark.createDataFrame(rows, SCHEMA)


def test_targets_and_taken(docs):
    got = mix_sources(docs, weights_by_position(docs, (3, 1, 2))).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs.collect()}
    sizes = {}
    for d, s in source.items():
        sizes[s] = sizes.get(s, 0) + words[d]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=key))}
    want = water_fill(sizes, weights, 1.5, 2)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.size == words[r.doc_id] and r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(3, 0.05 * want[s]), s


def test_reruns_and_partitions_agree(docs):
    w = weights_by_position(docs, (3, 1, 2))
    a = sorted(tuple(r) for r in mix_sources(docs, w).collect())
    assert a == sorted(tuple(r) for r in mix_sources(docs.repartition(7), w).collect())


def test_longer_documents_are_likelier(docs):
    got = mix_sources(docs, weights_by_position(docs, (3, 1, 2))).where("target < 2 * source_size").collect()
    mean = lambda rows: sum(r.copies for r in rows) / len(rows)
    assert mean([r for r in got if r.size == 200]) > mean([r for r in got if r.size == 1])


def test_edge_rows(edge_docs, clashing, no_docs):
    for df in (edge_docs, clashing):
        got = mix_sources(df, weights_by_position(df, (3, 1, 2))).collect()
        assert len(got) == 12 and all(r.taken <= 2 * r.size for r in got)
        assert all(r.taken == 0 for r in got if r.size == 0)
    assert mix_sources(no_docs, weights_by_position(no_docs, (3, 1, 2))).collect() == []


def test_a_source_without_weight_gets_nothing(docs):
    w = weights_by_position(docs, (1,)).where("source <> 'a'")
    got = {r.doc_id: r for r in mix_sources(docs, w).collect()}
    assert all(got[r.doc_id].taken == 0 for r in docs.where("source = 'a'").collect())


def down_the_rank(rows, targets, cap=2, seed=7):
    """Words taken of each (id, source, size), by going down the whole rank."""
    out = {}
    for source, target in targets.items():
        mine = [(i, size, 1 + (len(bin(size + 1)) - 3) / 8) for i, s, size in rows if s == source]
        full = set()
        while True:
            rest = sum(size * imp for _, size, imp in mine if imp not in full)
            factor = (target - cap * sum(size for _, size, imp in mine if imp in full)) / rest if rest else 0
            over = {imp for _, _, imp in mine if imp not in full and factor * imp > cap}
            if not over:
                break
            full |= over
        ranked, need = [], 0.0
        for i, size, imp in mine:
            copies = cap if imp in full else factor * imp
            out[i], p = size * int(copies), copies - int(copies)
            need += size * p
            if p > 0 and size:
                u = (int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                ranked.append((u / (1 - u) / (u / (1 - u) + p / (1 - p)), i, size))
        for _, i, size in sorted(ranked):
            if size <= need:
                out[i] += size
                need -= size
    return out


@pytest.mark.parametrize("few", [0, 10_000])
def test_the_whole_rank_is_gone_down(spark, rng, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_ROWS", few)
    rows = [(i, "w " * 100, "en", "long", 0) for i in range(100)] + [(100, "w " * 20_000, "en", "long", 0)]
    rows += [(200 + i, "w " * rng.choice((0, 1, 7, 40, 200, 3000)), "en", s, 0) for i, s in enumerate(
        rng.choices(["a", "b", "c"], [60, 20, 10], k=300))]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    weights = spark.createDataFrame([("long", 1.0), ("a", 3.0), ("b", 1.0), ("c", 2.0)], "source string, weight double")
    got = {r.doc_id: r for r in mix_sources(docs, weights).collect()}
    source = {r[0]: r[3] for r in rows}
    want = down_the_rank([(i, s, got[i].size) for i, s in source.items()], {source[i]: r.target for i, r in got.items()})
    assert {i: r.taken for i, r in got.items()} == want


def test_a_document_longer_than_the_need_blocks_no_other(spark):
    rows = [(i, "w " * 100, "en", "a", 0) for i in range(100)] + [(100, "w " * 20_000, "en", "a", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mix_sources(docs, weights_by_position(docs, (1,)), importance=F.lit(1.0)).collect()
    assert got[0].target == 45_000 and sum(r.taken for r in got) == 40_000


def test_rows_that_repeat_id_and_text_are_taken_together_if_they_fit(spark):
    rows = [(i // 3, "w " * 10, "en", "a", 0) for i in range(90)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mix_sources(docs, weights_by_position(docs, (1,)), budget=0.25).collect()
    assert len(got) == 90 and sum(r.taken for r in got) == 210 and got[0].target == 225
