import hashlib
import re
from collections import defaultdict

from bazaar.llm.exact_dedup import exact_dedup, filter_bits, mark_possible, repeat_filter


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        t = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        groups[hashlib.sha256(t.encode()).hexdigest()].append(doc_id)
    out = []
    for sha, ids in groups.items():
        ids.sort(key=lambda x: (x is None, x or 0))
        out += [(i, ids[0], len(ids), k == 0, sha) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def test_edge_cases_match_brute_force(edge_docs, clashing):
    want = brute([tuple(r) for r in edge_docs.collect()])
    assert sorted((tuple(r) for r in exact_dedup(edge_docs).collect()), key=str) == want
    assert sorted((tuple(r) for r in exact_dedup(clashing).collect()), key=str) == want


def test_many_copies(spark, rng):
    rows = [(i, "same  text" if rng.random() < 0.4 else f"text {rng.randrange(60)}\n{i % 7}") for i in range(500)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_empty(no_docs):
    assert exact_dedup(no_docs).collect() == []


def test_a_full_filter_only_lets_more_rows_through(spark):
    df = spark.range(4000).selectExpr("cast(id % 3990 as string) as sha")
    words = repeat_filter(df, "sha", 64)
    assert mark_possible(df, "sha", words, 64, "p").where("p").count() == 4000
    bits = filter_bits(4000)
    marked = mark_possible(df, "sha", repeat_filter(df, "sha", bits), bits, "p")
    assert 20 <= marked.where("p").count() < 400
    assert marked.where("p").select("sha").distinct().count() >= 10


def test_no_python_in_the_plan(edge_docs):
    plan = exact_dedup(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
