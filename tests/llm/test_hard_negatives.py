import math
import struct

import numpy as np
from pyspark.sql import functions as F

from bazaar.llm import hard_negatives as H
from bazaar.llm.queries import op12_hard_negatives, query_label

NAN, INF = float("nan"), float("inf")


def brute(rows, every=100, n_pos=5, n_neg=10):
    """Contract rows, by scoring and sorting everything an anchor."""
    items = {}
    for i, vec, label in rows:
        if i is None or vec is None or label is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        # Labels as SQL computes them: the remainder has the sign of the dividend.
        label = int(math.fmod(label + 1, 10)) if i % 7 == 0 else label
        one = (str(label), [math.floor(256 * x) for x in vec])
        items[i] = min(items.get(i, one), one)
    out = []
    for a, (label, vec) in items.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(vec, w, strict=False)), i, k) for i, (k, w) in items.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:n_pos]:
            inside = [(i, -t) for t, i, k in scored if k != label and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(a, p, r + 1, i, -s, t) for r, (i, t) in enumerate(inside[:n_neg])]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int"


def mined(df, block=H.ANCHORS, **kw):
    v = H.integer_vectors(df, "vec_id", "embedding", query_label())
    return sorted(tuple(r) for r in H.mine(v, F.col("id") % 100 == 0, block=block, **kw).collect())


def table(rng, n, width=6, labels=4, digits=1):
    return [(i, [round(rng.gauss(0.3, 1), digits) for _ in range(width)], rng.randrange(labels)) for i in range(n)]


def test_matches_brute_force(spark, rng):
    rows = table(rng, 900)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert len(want) > 200
    assert mined(df.repartition(7)) == want
    assert mined(df, block=3) == want


def test_ties_hot_label_and_few_rows(spark, rng):
    # One vector and one label hold a third of all rows; scores of zero.
    rows = [(i, [1.0, 0.5] if i % 3 == 0 else [round(rng.gauss(0, 1), 1), 0.0], 1 if i % 3 == 0 else i % 5) for i in range(600)]
    rows += [(700, [0.0, 0.0], 2), (800, [-1.0, -1.0], 9)]
    want = brute(rows)
    assert any(r[4] == 0 for r in want) and len({r[0] for r in want}) > 4
    assert mined(spark.createDataFrame(rows, SCHEMA)) == want


def test_edges(spark, rng):
    rows = [*table(rng, 350), (None, [1.0] * 6, 1), (400, None, 1), (500, [1.0] * 6, None), (600, [1.0, None, 0.0], 1),
            (401, [NAN] * 6, 1), (402, [INF, 1.0], 1), (403, [], 2), (404, [1.0, 2.0], 0), (405, [1e30] * 6, 3),
            (7, [0.5] * 6, 0), (100, [0.25] * 6, -1), (100, [0.25] * 6, -1), (200, [0.1] * 6, 1), (1100, [2.0] * 9, 99)]
    want = brute([r for r in rows if r[0] != 405])
    df = spark.createDataFrame(rows, SCHEMA)
    assert mined(df.where("vec_id is null or vec_id <> 405")) == want
    assert {r[0] for r in mined(df)} >= {r[0] for r in want if r[0] != 100} - {200}
    assert mined(df.limit(0)) == []
    clash = df.where("vec_id is null or vec_id <> 405").withColumns({c: F.lit("x") for c in ("id", "vec", "key", "anchor", "row")})
    assert mined(clash) == want


def test_exact_products_beyond_doubles():
    a, b = np.array([[(1 << 30) + 1, 7]]), np.array([[(1 << 30) - 1, 3], [1 << 62, 1 << 62]])
    assert H.products(a, b).tolist() == [[(1 << 60) - 1 + 21, (1 << 63) - 1]]
    assert H.products(np.zeros((2, 0), np.int64), b).tolist() == [[0, 0], [0, 0]]


def test_key_order():
    keys = [(a, s, n, i) for a in (-5, 0, 9) for s in (-(1 << 63), -1, 0, (1 << 63) - 1) for n in (False, True) for i in (-3, 4)]
    packed = sorted(H.packed_key(*k) for k in keys)
    assert [H.unpacked_key(p) for p in packed] == sorted(keys, key=lambda k: (k[0], -k[1], k[2], k[3]))
    assert all(len(p) == struct.calcsize(">QQ?Q") for p in packed)


def test_the_n_best_over_blocks(rng):
    scores = np.array([[rng.randrange(6) for _ in range(300)] for _ in range(4)])
    fits = np.array([[rng.random() < 0.6 for _ in range(300)] for _ in range(4)])
    ids = np.arange(300) * 2
    best = H.Best(4, 5)
    for at in (0, 7, 150):
        to = {0: 7, 7: 150, 150: 300}[at]
        best.add(scores[:, at:to], fits[:, at:to], ids[at:to])
    for k in range(4):
        want = sorted((-s, i) for s, f, i in zip(scores[k].tolist(), fits[k].tolist(), ids.tolist(), strict=True) if f)[:5]
        assert list(zip((-best.scores[k]).tolist(), best.ids[k].tolist(), strict=True)) == want


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(tuple(r) for r in op12_hard_negatives(spark, sf).collect()) == brute(rows)
