import random
import re
import tempfile

import pytest

import corpus_pipeline
from bazaar.llm import queries
from tests.llm.conftest import SCHEMA, edge_rows, prose
from tests.llm.test_mixing import down_the_rank, water_fill

SF = "/root/testdata/sf0.001"


def corpus(edges):
    """Rows, labels and the benchmark item of a small corpus with planted cases."""
    rng = random.Random(12)
    rows, labels = [], []
    item = prose(rng, 30)
    base = prose(rng, 120)
    for i in range(200):
        text = "\n".join([prose(rng, rng.randrange(20, 80)), "this line stands on every page"])
        if i % 10 == 0:
            text += " vilewort scornbag gritfool"
        if i % 10 == 1:
            text += "\n" + prose(rng, 6) + " " + item
        if i % 10 == 2:
            text = base + f" end{i}"
        rows.append((i, text, "en", "ab"[i % 2], len(text)))
        if i < 150:
            labels.append((i, 1, int(i % 10 == 0)))
    if edges:
        rows += edge_rows(rng)
    return rows, labels, item


def written(spark, rows, labels, item):
    out = tempfile.mkdtemp(prefix="bazaar-test-")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


@pytest.fixture(scope="module")
def folder(spark):
    return written(spark, *corpus(True))


def test_all_values_match_plain_python(spark):
    """run()'s whole rows: what each stage should do with the planted cases is
    known, and the mix follows from the texts that are left."""
    rows, labels, item = corpus(False)
    left = {}
    for i, text, _, source, _ in rows:
        if i % 10 in (0, 1) or i % 10 == 2 and i != 2:  # toxic, holding the item, copies of document 2
            continue
        lines = [x for x in text.split("\n") if not x.startswith("this line stands on every page")]
        left[i] = source, "\n".join(lines)
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, (_, t) in left.items()}
    of_source = {s: sum(n for i, n in sizes.items() if left[i][0] == s) for s in "ab"}
    targets = water_fill(of_source, {"a": 3, "b": 1}, 1.5, 2)
    taken = down_the_rank([(i, left[i][0], sizes[i]) for i in left], targets)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, written(spark, rows, labels, item)).collect()}
    assert {i: (r.size, r.source_size, r.taken) for i, r in got.items()} == {
        i: (sizes[i], of_source[left[i][0]], taken[i]) for i in left}
    for i, r in got.items():
        assert r.target == pytest.approx(targets[left[i][0]])


def test_each_stage_takes_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, seen[-1], folder)
        seen.append(got.sparkSession.createDataFrame(got.collect(), got.schema))
    assert [d.columns == columns for d in seen] == [True] * 5 + [False]
    ids = [[r.doc_id for r in d.collect()] for d in seen]
    small = [{i for i in x if i is not None and i < 200} for x in ids]
    assert small[1] == {i for i in range(200) if i % 10 != 0}
    assert small[2] == small[1]
    text = {r.doc_id: r for r in seen[2].collect()}
    assert "every page" not in text[3].text and text[3].n_chars == len(text[3].text)
    assert text[1005].text == next(r.text for r in docs.collect() if r.doc_id == 1005)
    assert small[3] == {i for i in small[2] if i % 10 != 2} | {2}
    assert small[4] == {i for i in small[3] if i % 10 != 1}
    assert sorted(ids[5], key=str) == sorted(ids[4], key=str)


def test_run_is_the_stages_in_turn(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in got.collect() if r.doc_id is not None and r.doc_id < 200} == {
        i for i in range(200) if i % 10 not in (0, 1, 2)} | {2}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_copies", "decontamination", "mixing"]


def test_stages_take_empty_tables(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == []


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_runs(spark, name):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    got = queries.QUERIES[name](spark, SF)
    if name == "op12_hard_negatives":
        assert got.columns[0] == "anchor_id" and got.count() > 0
        return
    assert "doc_id" in got.columns
    assert got.count() == n or name == "op9_decontam"
