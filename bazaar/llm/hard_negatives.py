"""Hard-negative mining by a secondary-sort shuffle.

Rows are scored against anchors by integer inner products. Each scored pair
that can matter is packed into one binary key whose byte order is (anchor,
descending score, positives before negatives, id); the pairs are repartitioned
by anchor and sorted within partitions by that key (Spark's sort, which
spills), and an iterator reads each anchor's pairs in one pass: a row of the
anchor's label opens a window of scores, a row of another label is emitted to
every open window that it falls into and that is not full. The iterator holds
the windows of one anchor, never its pairs.

Two such shuffles run for each block of anchors. The first finds the anchors'
positives; each task sends only its best ``n_positives`` rows of the label an
anchor, as no other can be among the best of all. Then the windows' bounds are
known, and each task sends, for every window, only its first ``n_negatives``
rows in it. Nothing that could be in the result is left out, and what is
shuffled is bounded by tasks x anchors x windows, not by the pairs. Anchors
come in blocks of about ``ANCHORS`` by a hash of their ids; a block's vectors
are broadcast (its size is that bound), and the rows are read once a shuffle.

Defined cases: rows with a null id, label or vector, or with a null or
non-finite component take no part; rows of one id count once, as the smallest
by (label, vector); a shorter vector counts as filled up with zeros; scores
that do not fit 64 bits are computed exactly and held at the ends of that
range; ties go to the smaller id; an anchor without positives, and a window
without negatives, has no rows; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.llm.scratch import stage

#: Anchors of a block, on average; rows scored at once.
ANCHORS, ROWS = 1024, 2048
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = 256) -> DataFrame:
    """(id, label, vec): components as floor(scale * x), rows that take part,
    one row an id."""
    vec = F.col(vector_col).cast("array<double>")
    whole = F.transform(vec, lambda x: F.floor(x * F.lit(float(scale))))
    usable = (F.col(id_col).isNotNull() & label.isNotNull() & F.col(vector_col).isNotNull()
              & ~F.exists(vec, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(True))))
    kept = rows.where(usable).select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"),
                                     whole.alias("vec"))
    first = F.min(F.struct("label", "vec")).alias("row")
    # A fixed number of partitions: scoring takes long for few bytes.
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept.repartition(n, "id").groupBy("id").agg(first).select("id", "row.label", "row.vec")


def matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors as rows of equal width."""
    rows = [np.asarray(v, np.int64) for v in vectors.to_pylist()]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for i, v in enumerate(rows):
        out[i, :len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all of b, as 64-bit integers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = int(np.abs(a.astype(float)).max()) * int(np.abs(b.astype(float)).max()) * width
    if bound < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, _LEAST, _MOST).astype(np.int64)


class Block(NamedTuple):
    """Anchors, and where known the score bounds (inclusive) of their windows."""
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def packed_key(anchor: int, score: int, negative: bool, row: int) -> bytes:
    """Bytes that sort by anchor, descending score, positives first, id."""
    return struct.pack(">QQ?Q", anchor - _LEAST, _MOST - score, negative, row - _LEAST)


def unpacked_key(key: bytes) -> tuple[int, int, bool, int]:
    anchor, score, negative, row = struct.unpack(">QQ?Q", key)
    return anchor + _LEAST, _MOST - score, negative, row + _LEAST


class Best:
    """The n best (score, smaller id) of each of some lists, over blocks of rows."""

    def __init__(self, lists: int, n: int):
        self.n = n
        self.scores = np.zeros((lists, 0), np.int64)
        self.ids = np.zeros((lists, 0), np.int64)
        self.there = np.zeros((lists, 0), bool)

    def add(self, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
        """Rows in order of their ids; of ``scores`` those that fit."""
        # A stable sort keeps the smaller id first among equal scores.
        if scores.shape[1] > 8 * self.n:
            order = self._cut(scores, fits)
        else:
            order = np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
        take = lambda x: np.take_along_axis(x, order, 1)
        self.scores = np.hstack([self.scores, take(scores)])
        self.there = np.hstack([self.there, take(fits)])
        self.ids = np.hstack([self.ids, ids[order]])
        best = np.lexsort((self.ids, ~self.scores, ~self.there), axis=1)[:, :self.n]
        self.scores, self.ids, self.there = (np.take_along_axis(x, best, 1)
                                             for x in (self.scores, self.ids, self.there))

    def _cut(self, scores: np.ndarray, fits: np.ndarray) -> np.ndarray:
        """Columns among which the n best of each list are: those above the
        n-th best score, and of those equal to it the first."""
        low = np.where(fits, scores, _LEAST)
        edge = np.partition(low, -self.n, axis=1)[:, -self.n:].min(1, keepdims=True)
        # 2: above the edge, 1: equal to it; the first n by class and column.
        above, equal = fits & (low > edge), fits & (low == edge)
        spare = np.cumsum(equal, 1) <= self.n - above.sum(1, keepdims=True)
        keep = above | equal & spare
        return np.argsort(~keep, axis=1, kind="stable")[:, :self.n]


def _scored(block: Block, batch: pa.RecordBatch):
    """(ids, scores, whether of the anchor's label) of a batch, by id."""
    ids = np.asarray(batch.column("id"), np.int64)
    order = np.argsort(ids, kind="stable")
    labels = np.array(batch.column("label").to_pylist(), object)[order]
    scores = products(block.vectors, matrix(batch.column("vec"))[order])
    return ids[order], scores, block.labels[:, None] == labels[None, :]


def _few(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _pairs(keys: list[tuple[int, int, bool, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()),
                                       pa.array([packed_key(*k) for k in keys], pa.binary())], names=["anchor", "key"])


def positive_pairs(block, n: int):
    """Task over rows (id, label, vec): the n best rows of each anchor's label."""
    def run(batches):
        b = block.value
        best = Best(len(b.ids), n)
        for batch in _few(batches):
            ids, scores, same = _scored(b, batch)
            best.add(scores, same & (ids[None, :] != b.ids[:, None]), ids)
        at, k = np.nonzero(best.there)
        yield _pairs([(int(b.ids[i]), int(best.scores[i, j]), False, int(best.ids[i, j]))
                      for i, j in zip(at.tolist(), k.tolist(), strict=True)])
    return run


def negative_pairs(block, n: int):
    """Task over rows: for each window of each anchor the n best rows of other
    labels in it."""
    def run(batches):
        b = block.value
        best = [Best(len(b.ids), n) for _ in range(b.low.shape[1])]
        for batch in _few(batches):
            ids, scores, same = _scored(b, batch)
            for w, x in enumerate(best):
                x.add(scores, ~same & (scores >= b.low[:, w, None]) & (scores <= b.high[:, w, None]), ids)
        # Windows overlap: a row that is in several is sent once.
        keys = {(int(b.ids[i]), int(x.scores[i, j]), True, int(x.ids[i, j]))
                for x in best for i, j in zip(*(k.tolist() for k in np.nonzero(x.there)), strict=True)}
        yield _pairs(sorted(keys))
    return run


def _sorted_keys(batches):
    for batch in batches:
        yield from map(unpacked_key, batch.column("key").to_pylist())


def first_positives(n: int):
    """Iterator over sorted pairs: the first n of each anchor."""
    def run(batches):
        anchor, taken, out = None, 0, []
        for a, score, _, row in _sorted_keys(batches):
            taken = taken + 1 if a == anchor else 1
            anchor = a
            if taken <= n:
                out.append((a, row, score))
                if len(out) >= ROWS:
                    yield _table(out, _POSITIVE)
                    out = []
        yield _table(out, _POSITIVE)
    return run


def window_negatives(n_positives: int, n_negatives: int, low: tuple[int, int], high: tuple[int, int]):
    """Iterator over sorted pairs: positives open windows, negatives go to
    every window that they are in and that is not full."""
    def run(batches):
        anchor, windows, out = None, [], []
        for a, score, negative, row in _sorted_keys(batches):
            if a != anchor:
                anchor, windows = a, []
            if not negative:
                if len(windows) < n_positives:
                    windows.append([row, score, 0])
                continue
            for w in windows:
                if w[2] < n_negatives and low[0] * w[1] <= low[1] * score and high[1] * score <= high[0] * w[1]:
                    w[2] += 1
                    out.append((a, w[0], w[2], row, w[1], score))
            if len(out) >= ROWS:
                yield _table(out, _RESULT)
                out = []
        yield _table(out, _RESULT)
    return run


_POSITIVE = pa.schema([("anchor", pa.int64()), ("row", pa.int64()), ("score", pa.int64())])
_RESULT = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("rank", pa.int32()),
                     ("negative_id", pa.int64()), ("positive_score", pa.int64()), ("negative_score", pa.int64())])
_RESULT_DDL = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long,"
               " negative_score long")


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)],
                                      schema=schema)


def secondary_sort(pairs: DataFrame) -> DataFrame:
    """Pairs of one anchor in one partition, in order of their keys: the
    DataFrame form of repartitionAndSortWithinPartitions."""
    return pairs.repartition("anchor").sortWithinPartitions("key")


def mine(vectors: DataFrame, anchors: Column, n_positives: int = 5, n_negatives: int = 10,
         low: tuple[int, int] = (30, 100), high: tuple[int, int] = (90, 100), block: int = ANCHORS) -> DataFrame:
    """Hard negatives of ``vectors`` (id, label, vec of integers): for each row
    for which ``anchors`` holds and each of its first ``n_positives`` rows of
    the same label, the first ``n_negatives`` rows of other labels whose score
    is between ``low`` and ``high`` (numerator, denominator) of the positive's."""
    spark = vectors.sparkSession
    rows = stage(vectors, "mine-vectors")
    wanted = rows.where(anchors)
    blocks = -(-wanted.count() // block)
    out = None
    for k in range(max(1, blocks)):
        got = wanted.where(F.pmod(F.xxhash64("id"), F.lit(max(1, blocks))) == k).orderBy("id").toArrow()
        of = Block(np.asarray(got.column("id"), np.int64), np.array(got.column("label").to_pylist(), object),
                   matrix(got.column("vec").combine_chunks()))
        shared = spark.sparkContext.broadcast(of)
        positives = stage(secondary_sort(rows.mapInArrow(positive_pairs(shared, n_positives), "anchor long, key binary"))
                          .mapInArrow(first_positives(n_positives), "anchor long, row long, score long"), "mine-positives")
        # At most n_positives rows an anchor of this block.
        found = positives.orderBy("anchor", F.desc("score"), "row").toArrow()
        at = np.searchsorted(of.ids, np.asarray(found.column("anchor"), np.int64))
        place = np.arange(len(at)) - np.searchsorted(at, at)
        bounds = np.full((2, len(of.ids), n_positives), 0, np.int64)
        bounds[0], bounds[1] = 1, 0  # no window
        for i, j, score in zip(at.tolist(), place.tolist(), found.column("score").to_pylist(), strict=True):
            bounds[0, i, j] = -(-low[0] * score // low[1])
            bounds[1, i, j] = high[0] * score // high[1]
        windows = spark.sparkContext.broadcast(of._replace(low=bounds[0], high=bounds[1]))
        opening = positives.mapInArrow(_opening, "anchor long, key binary")
        pairs = rows.mapInArrow(negative_pairs(windows, n_negatives), "anchor long, key binary").unionByName(opening)
        part = secondary_sort(pairs).mapInArrow(
            window_negatives(n_positives, n_negatives, low, high), _RESULT_DDL)
        if blocks > 1:
            part = stage(part, "mine-block")
        out = part if out is None else out.unionByName(part)
    return out


def _opening(batches):
    for batch in batches:
        yield _pairs([(a, s, False, r) for a, s, r in zip(*(batch.column(c).to_pylist() for c in (
            "anchor", "score", "row")), strict=True)])
