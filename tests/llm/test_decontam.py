import numpy as np
import pytest

from bazaar.llm import decontam
from tests.llm.conftest import SCHEMA, VOCAB, prose

ITEMS = "item_id long, text string"


def align(item, text):
    """Smith-Waterman by the book: best score only."""
    best, row = 0, [0] * (len(text) + 1)
    for x in item:
        new = [0]
        for j, y in enumerate(text):
            new.append(max(0, row[j] + (decontam.MATCH if x == y else decontam.MISMATCH),
                           row[j + 1] + decontam.GAP, new[j] + decontam.GAP))
        best, row = max(best, *new), new
    return best


def test_alignment_matches_the_book(rng):
    for _ in range(150):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 12))]
        b = [rng.randrange(6) for _ in range(rng.randrange(1, 25))]
        score, lo, hi = decontam.smith_waterman(np.array(a, np.uint64), np.array(b, np.uint64))
        assert score == align(a, b)
        assert align(a, b[lo:hi]) == score


def edited(rng, text, every):
    words = text.split()
    for k in range(2, len(words), every):
        words[k] = rng.choice(VOCAB)
    return " ".join(words)


@pytest.fixture()
def case(rng):
    items = [(i, prose(rng, rng.choice((14, 30, 60)))) for i in range(12)] + [(50, "Two Words"), (51, ""), (52, None)]
    docs, planted = [], set()
    for d in range(120):
        text = prose(rng, rng.randrange(5, 200))
        if d % 4 == 0:
            i = rng.randrange(12)
            leak = items[i][1] if d % 8 else edited(rng, items[i][1], 6)
            text = text + "\n" + leak.upper() + " " + prose(rng, 20)
            planted.add((d, i))
        docs.append((d, text, "en", "a", 1))
    docs.append((900, "so two  words here", "en", "a", 1))
    return docs, items, planted | {(900, 50)}


@pytest.mark.parametrize("block", [2_000_000, 20])
def test_planted_copies_and_only_those(spark, case, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
    docs, items, planted = case
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS)
    got = decontam.find_contamination(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == planted
    text = {r[0]: r[1].lower().split() for r in docs}
    item = {i: (t or "").lower().split() for i, t in items}
    for r in got:
        best = align(item[r.item_id], text[r.doc_id])
        assert r.score == pytest.approx(best / (2 * len(item[r.item_id])))
        assert 0 <= r.start_word < r.end_word <= len(text[r.doc_id])
    kept = {r.doc_id for r in decontam.drop_contaminated(d, b).collect()}
    assert kept == set(text) - {x for x, _ in planted}


def test_a_passage_in_most_texts_is_still_found(spark, rng):
    item = prose(rng, 30)
    docs = [(i, prose(rng, 5) + " " + item, "en", "a", 1) for i in range(40)]
    got = decontam.find_contamination(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(7, item)], ITEMS))
    assert got.count() == 40


def test_edge_rows(spark, edge_docs, clashing, no_docs, rng):
    rows = edge_docs.collect()
    one = next(r.text for r in rows if r.doc_id == 1005)
    items = spark.createDataFrame([(1, one), (1, one), (2, prose(rng, 20)), (None, None)], ITEMS)
    want = sorted([(None, 1), (None, 1), (1004, 1), (1004, 1), (1004, 1), (1004, 1), (1005, 1), (1005, 1)], key=str)
    for df in (edge_docs, clashing):
        got = decontam.find_contamination(df, items).collect()
        assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == want
    assert decontam.drop_contaminated(clashing, items).columns == clashing.columns
    none = spark.createDataFrame([], ITEMS)
    assert decontam.find_contamination(edge_docs, none).collect() == []
    assert decontam.drop_contaminated(edge_docs, none).count() == len(rows)
    assert decontam.find_contamination(no_docs, items).collect() == []


def test_a_slice_of_texts_without_any_seed(spark, rng):
    item = prose(rng, 30)
    docs = spark.createDataFrame([(1, "nothing of the kind stands here", "en", "a", 1)], SCHEMA)
    items = spark.createDataFrame([(1, item)], ITEMS)
    assert decontam.find_contamination(docs, items).collect() == []
    assert decontam.drop_contaminated(docs, items).count() == 1


def test_capitals_and_punctuation_do_not_hide_a_copy(spark):
    item = "Élan ñandú, öffnet die Tür: los más altos. Una vez más!"
    loud = " ".join(w.upper() + "!!" for w in item.split())
    listed = " | ".join(item.split())
    docs = spark.createDataFrame([(1, "x y " + loud, "en", "a", 1), (2, listed + " | z", "en", "a", 1)], SCHEMA)
    got = decontam.find_contamination(docs, spark.createDataFrame([(5, item)], ITEMS)).collect()
    assert sorted((r.doc_id, r.score) for r in got) == [(1, 1.0), (2, 1.0)]
