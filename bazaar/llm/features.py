"""Hashed text features for the classifiers: presence of plain words, of byte
trigrams and of runs of one word, and word beginnings that come at least twice
(inflected forms of one stem), in a fixed number of buckets.

Everything is vectorised over Arrow columns, in slices of bounded size, and
covers whole texts. Learning reads a bounded sample of labelled rows (its
bound is a parameter of each classifier); counts per bucket are summed by
Spark and only the selected buckets reach the driver.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.llm.words import LOWER, Words, mix, words_of

BITS = 18
BUCKETS = 1 << BITS
#: Lengths of runs of one and the same word that count as features.
RUNS = (3, 5, 8)
#: Lengths in bytes of word beginnings, and how often one must come.
STEMS = (4, 5, 6, 7)
STEM_TIMES = 2


def stems_of(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row of each word's beginning, its bucket) for all lengths of ``STEMS``."""
    row_of_word = np.repeat(np.arange(len(w.ptr) - 1), np.diff(w.ptr))
    length = w.ends - w.starts
    at = np.flatnonzero(length >= STEMS[0])
    h = np.zeros(len(at), np.uint64)
    rows, buckets = [], []
    for k in range(1, STEMS[-1] + 1):
        keep = length[at] >= k
        at, h = at[keep], h[keep]
        h = h * np.uint64(0x100000001B3) + LOWER[w.data[w.starts[at] + k - 1]]
        if k in STEMS:
            rows.append(row_of_word[at])
            buckets.append((mix(h) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


def buckets_of(column: pa.Array) -> Iterator[tuple[Words, int, np.ndarray, np.ndarray]]:
    """(words of a slice, rows, row of each feature from 0, its bucket), not distinct."""
    shift = np.uint64(64 - BITS)
    for w in words_of(column, plain=True):
        n = len(w.ptr) - 1
        row_of_word = np.repeat(np.arange(n), np.diff(w.ptr))
        rows, codes = [row_of_word], [w.hashes]
        for run in RUNS:
            same = np.ones(max(0, len(w.hashes) - run + 1), bool)
            for i in range(1, run):
                same &= w.hashes[i:len(same) + i] == w.hashes[:len(same)]
                same &= row_of_word[i:len(same) + i] == row_of_word[:len(same)]
            at = np.flatnonzero(same)
            rows.append(row_of_word[at])
            codes.append(np.full(len(at), mix(np.array([run], np.uint64))[0]))
        if len(w.data) >= 3:
            b = w.data.astype(np.uint32)
            tri = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
            row = np.repeat(np.arange(n), np.diff(w.base))
            at = row[:-2] == row[2:]
            rows.append(row[:-2][at])
            # 32-bit multiplicative hashing: the upper bits, as for the words.
            codes.append((tri[at] * np.uint32(2654435761)).astype(np.uint64) << np.uint64(32))
        yield w, n, np.concatenate(rows), (np.concatenate(codes) >> shift).astype(np.int64)


def indicators(column: pa.Array, selected: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, 0/1 matrix of the selected features) for slices of rows.
    Features from ``BUCKETS`` on are those of repeated stems."""
    table = np.full(2 * BUCKETS, -1, np.int32)
    table[selected] = np.arange(len(selected))
    stems = (selected >= BUCKETS).any()
    for w, n, rows, buckets in buckets_of(column):
        found = table[buckets]
        at = found >= 0
        m = np.zeros((n, len(selected)), bool)
        m[rows[at], found[at]] = True
        if stems:
            rows, buckets = stems_of(w)
            found = table[BUCKETS + buckets]
            at = found >= 0
            cells, times = np.unique(rows[at] * len(selected) + found[at], return_counts=True)
            m.reshape(-1)[cells[times >= STEM_TIMES]] = True
        yield w.first, m


def bounded_sample(docs: DataFrame, labelled: DataFrame, cls: str, classes: tuple[int, ...], per_class: int,
                   id_col: str, text_col: str) -> DataFrame:
    """The columns of ``labelled`` (one row an ``id``) and ``text`` for at most
    ``per_class`` ids of each of the classes, by a hash of the id. Ids are
    chosen before any text is read; the chosen few (a bounded number) are
    broadcast, so no text is shuffled to find theirs. Of several texts of an
    id the smallest counts."""
    order = F.xxhash64("id", F.lit(11))
    parts = [labelled.where((F.col(cls) == c) & F.col("id").isNotNull()).orderBy(order, "id").limit(per_class)
             for c in classes]
    chosen = functools.reduce(DataFrame.unionByName, parts)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "id").groupBy(*chosen.columns).agg(F.min("text").alias("text"))


def bucket_counts(sample: DataFrame, classes: int, stems: bool = False) -> DataFrame:
    """(bucket, n0, n1, ...): how many sample rows of each class (column
    ``cls``, from 0) hold the feature; ``stems``: those of stems too."""
    def count(batches):
        total = np.zeros((classes, 2 * BUCKETS), np.int32)
        for batch in batches:
            cls = np.asarray(batch.column("cls"))
            for w, _, rows, buckets in buckets_of(batch.column("text")):
                pairs = np.unique(rows * BUCKETS + buckets)
                np.add.at(total, (cls[w.first + pairs // BUCKETS], pairs % BUCKETS), 1)
                if stems:
                    rows, buckets = stems_of(w)
                    pairs, times = np.unique(rows * BUCKETS + buckets, return_counts=True)
                    pairs = pairs[times >= STEM_TIMES]
                    np.add.at(total, (cls[w.first + pairs // BUCKETS], BUCKETS + pairs % BUCKETS), 1)
        held = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int64()), *[pa.array(total[c, held].astype(np.int64)) for c in range(classes)]],
            names=["bucket", *[f"n{c}" for c in range(classes)]])

    names = [f"n{c}" for c in range(classes)]
    parts = sample.select("text", "cls").mapInArrow(
        count, "bucket long, " + ", ".join(f"{c} long" for c in names))
    return parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names])


def sample_matrix(sample: DataFrame, selected: np.ndarray, columns: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """0/1 matrix (rows x selected) and the given columns of a bounded sample,
    on the driver; each row travels as packed bits."""
    def pack(batches):
        for batch in batches:
            bits = [np.packbits(m, axis=1) for _, m in indicators(batch.column("text"), selected)]
            flat = [row.tobytes() for part in bits for row in part]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array(flat, pa.binary())], names=[*columns, "bits"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in sample.select(*columns).schema]
    got = sample.select("text", *columns).mapInArrow(pack, ", ".join([*fields, "bits binary"])).toArrow()
    order = np.lexsort([np.asarray(got.column(c)) for c in columns])
    packed = np.frombuffer(b"".join(got.column("bits").to_pylist()), np.uint8).reshape(got.num_rows, -1)
    x = np.unpackbits(packed, axis=1, count=len(selected)).astype(bool) if got.num_rows else \
        np.zeros((0, len(selected)), bool)
    return x[order], {c: np.asarray(got.column(c))[order] for c in columns}
