import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaar.llm import nbsvm, toxicity
from tests.llm.conftest import SCHEMA, prose

LABELS = "doc_id long, quality int, toxic int"
BAD = ["vilewort", "scornbag", "gritfool"]


@pytest.fixture(scope="module")
def data(spark):
    import random
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(900):
        words = prose(rng, rng.choice((8, 40, 200))).split()
        toxic, junk = rng.random() < 0.2, rng.random() < 0.25
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        if junk:
            words = [w + "###" for w in words] if rng.random() < 0.5 else words + ["same"] * 12
        docs.append((i, " ".join(words), "en", "a", 1))
        labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(docs, SCHEMA).cache(), spark.createDataFrame(labels, LABELS).cache()


def test_quality_on_held_out_rows(data):
    docs, labels = data
    got = nbsvm.score_quality(docs, labels).join(labels, "doc_id").collect()
    assert {r.doc_id: r.held_out for r in got} == {
        r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 100
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_held_out_labels_are_never_read(data):
    docs, labels = data
    other = labels.withColumn("quality", F.when(nbsvm.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = nbsvm.score_quality(docs, labels).orderBy("doc_id").collect()
    b = nbsvm.score_quality(docs.repartition(3), other).orderBy("doc_id").collect()
    assert [r.score for r in a] == pytest.approx([r.score for r in b])


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    rows = [np.flatnonzero(rng.random(12) < 0.4) for _ in range(60)]
    scale = rng.normal(size=12)
    y = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    x = np.zeros((60, 13))
    for i, r in enumerate(rows):
        x[i, r] = scale[r]
    x[:, 12] = 1
    w, bias = nbsvm.dual_coordinate_descent(rows, scale, y, c=0.1, epochs=2000)
    loss = lambda v: 0.5 * v @ v + 0.1 * np.maximum(0, 1 - y * (x @ v)).sum()
    v, rate = np.zeros(13), 0.05
    best = loss(v)
    for k in range(20000):
        g = v - 0.1 * (x * y[:, None])[y * (x @ v) < 1].sum(axis=0)
        v = v - rate / (1 + k / 50) * g
        best = min(best, loss(v))
    assert loss(np.append(w, bias)) <= best + 1e-3


def test_toxicity_on_rows_it_has_not_seen(data):
    docs, labels = data
    seen = labels.where("doc_id % 3 <> 0")
    got = toxicity.score_toxicity(docs, seen).join(labels, "doc_id").where("doc_id % 3 = 0").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.97
    for r in got:
        assert all(0 <= p <= 1 for p in (r.p_toxic, r.p_toxic_prose, r.p_toxic_junk))
    junk = [r for r in got if r.toxic and not r.quality]
    assert np.mean([r.p_toxic_junk > r.p_toxic_prose for r in junk]) > 0.8


def test_later_links_use_earlier_probabilities():
    rng = np.random.default_rng(4)
    x = rng.random((400, 6)) < 0.5
    first = x[:, 0] & x[:, 1]
    links = toxicity.fit_chain(x, [first, first], np.ones(400), np.arange(400) % 5)
    assert len(links[1].earlier) == 1 and links[1].earlier[0] > 0.1
    p = toxicity.predict_chain(x.astype(np.float32), tuple(links))
    assert ((p[:, 1] > 0.5) == first).mean() > 0.95


def test_drop_toxic_keeps_columns_and_clean_rows(data):
    docs, labels = data
    out = toxicity.drop_toxic(docs.withColumn("p_toxic", F.lit("x")), labels)
    assert out.columns == [*docs.columns, "p_toxic"]
    left = {r.doc_id for r in out.collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert np.mean([truth[i] == 0 for i in left]) > 0.98
    assert len(left) > 0.98 * sum(t == 0 for t in truth.values())


def test_edge_rows(spark, data, edge_docs, clashing, no_docs):
    _, labels = data
    docs = data[0].unionByName(edge_docs)
    odd = labels.unionByName(spark.createDataFrame([(1, 1, 1), (None, 1, 1), (1000, None, None), (1003, 0, None)], LABELS))
    q = nbsvm.score_quality(docs, odd).where("doc_id >= 1000 or doc_id is null").collect()
    t = toxicity.score_toxicity(docs, odd).where("doc_id >= 1000 or doc_id is null").collect()
    assert len(q) == len(t) == 12
    blank = {r.score for r in q if r.doc_id in (1000, 1001)}
    assert len(blank) == 1
    assert nbsvm.score_quality(clashing, odd).count() == 12
    assert toxicity.score_toxicity(clashing, odd).count() == 12
    assert toxicity.drop_toxic(clashing, odd).columns == clashing.columns
    for scored in (nbsvm.score_quality(no_docs, odd), toxicity.score_toxicity(no_docs, odd)):
        assert scored.collect() == []


def test_missing_classes(spark, data):
    docs, labels = data
    none = labels.where("false")
    assert {r.score for r in nbsvm.score_quality(docs, none).collect()} == {0.5}
    assert {r.predicted for r in toxicity.score_toxicity(docs, none).collect()} == {0}
    good = labels.where("quality = 1 and toxic = 0")
    assert {r.predicted for r in nbsvm.score_quality(docs, good).collect()} == {1}
    assert {r.predicted for r in toxicity.score_toxicity(docs, good).collect()} == {0}
