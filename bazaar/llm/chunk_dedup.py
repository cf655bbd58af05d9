"""Substring dedup by content-defined chunks.

A gear rolling hash (h = 2h + G[byte], kept to 16 bits, so it depends on the
last 16 bytes alone) is taken at the end of every word and mixed, as its low
bits depend on the last bytes alone. A chunk ends where the mixed hash is the
smallest among the ``NEIGHBOURS`` word ends on either side (of equal ones the
first). Where text is cut thus depends on the text around the cut only, and an
insertion shifts nothing beyond the next cuts; a chunk has at least
``NEIGHBOURS`` + 1 words and 2 x ``NEIGHBOURS`` + 1 on average, whatever the
letters. All chunks are compared by digest over all texts. A run of
consecutive chunks that each occur in another text too, of at least
``MIN_RUN`` bytes, is a repeated passage; all occurrences of its chunks go but
the first (by id, then place).

Defined cases: null and empty texts have no chunks; chunks compare byte for
byte; repetition inside one text alone is none; rows that repeat an id and a
text are one text (each row gets its results); null ids sort last; a text
without word ends and cuts is one chunk, and so is a stretch that repeats
itself every ``NEIGHBOURS`` words or sooner; an empty table gives an empty result;
extra columns are kept by ``dedup_substrings`` and not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.llm.scratch import small_batches, stage, unused
from bazaar.llm.words import mix, words_of

#: Word ends on either side of a cut that have no smaller hash.
NEIGHBOURS = 3
WINDOW = 16
#: No chunk is too short to be compared.
MIN_BYTES = 1
MIN_RUN = 90
#: Words longer than this (scripts without spaces) may be cut inside: one in
#: INNER_DIVISOR of their character ends counts as a word end.
LONG_WORD, INNER_DIVISOR = 64, 4

_GEAR = np.random.default_rng(1009).integers(0, 1 << 16, 256, dtype=np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash of every byte position, by doubling: sums over 2, 4, 8 and 16
    bytes each come from two sums of half the length."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8):
        earlier = np.zeros_like(h)
        earlier[width:] = h[:-width] << np.uint16(width)
        h = h + earlier
    return h


def cuts_of(data: np.ndarray, base: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Byte positions of all chunk ends, those of the texts included. A hash
    that would reach into the text before is not used, and a word end with
    fewer than ``NEIGHBOURS`` others on a side is no cut."""
    h = mix(gear(data).astype(np.uint64))
    parts = [ends]
    long = np.flatnonzero(ends - starts > LONG_WORD)
    for i in long.tolist():
        inner = np.arange(starts[i] + 1, ends[i])
        inner = inner[(h[inner - 1] % INNER_DIVISOR == 0) & (data[inner] & 0xC0 != 0x80)]
        parts.append(inner)
    at = np.unique(np.concatenate(parts))
    row = np.searchsorted(base, at, "left") - 1
    whole = at - base[row] >= WINDOW
    at, row = at[whole], row[whole]
    value = h[at - 1]
    least = np.ones(len(at), bool)
    for s in range(1, NEIGHBOURS + 1):
        least[:s] = least[-s:] = False
        together = row[s:] == row[:-s]
        least[s:] &= together & (value[s:] < value[:-s])
        least[:-s] &= together & (value[:-s] <= value[s:])
    return np.union1d(at[least], base)


def chunk_rows(batches):
    """Rows of the chunks to compare: id, key, number among those of the text,
    start and end in code points, bytes, digest."""
    for batch in batches:
        ids, keys = batch.column("id"), np.asarray(batch.column("key"))
        for w in words_of(batch.column("text")):
            cuts = cuts_of(w.data, w.base, w.starts, w.ends)
            lo, hi = cuts[:-1], cuts[1:]
            big = hi - lo >= MIN_BYTES
            lo, hi = lo[big], hi[big]
            row = np.searchsorted(w.base, lo, "right") - 1
            first = np.searchsorted(row, row)
            # Code points before each byte, from the start of the slice.
            points = np.concatenate([[0], np.cumsum(w.data & 0xC0 != 0x80)])
            origin = points[w.base[row]]
            raw = w.data.tobytes()
            digest = [hashlib.blake2b(raw[a:b], digest_size=16).digest()
                      for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            source = w.first + row
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(source)), pa.array(keys[source]),
                 pa.array((np.arange(len(row)) - first).astype(np.int32)),
                 pa.array((points[lo] - origin).astype(np.int32)), pa.array((points[hi] - origin).astype(np.int32)),
                 pa.array((hi - lo).astype(np.int32)), pa.array(digest, pa.binary())],
                names=["id", "key", "no", "start", "end", "bytes", "digest"])


def chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.where(F.length(text_col) > 0).select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(chunk_rows, f"id {kind}, key long, no int, start int, end int, bytes int, digest binary")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_run: int = MIN_RUN) -> DataFrame:
    """One row per text that shares a passage with another: id, key (of the
    text), n_repeated (chunks), passages (array of start, end, bytes; code
    points), dropped (array of start, end: chunks that occur earlier) and
    first_ids (the texts where those occur first)."""
    small_batches(docs)
    all_chunks = stage(chunks(docs, id_col, text_col), "chunks")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "key", "no")
    owner = F.struct(F.col("id").isNull().alias("no_id"), "id", "key")
    # Pre-aggregated on the map side, so that a passage of a third of all
    # texts is a few rows; staged, so that the join can split its chunks.
    shared = stage(all_chunks.groupBy("digest").agg(
        F.min(place).alias("first"), F.min(owner).alias("a"), F.max(owner).alias("b"))
        .where("a <> b").select(F.col("digest").alias("_digest"), "first"), "chunks-shared")
    hits = all_chunks.join(shared, F.col("digest") == F.col("_digest")).select(
        "id", "key", F.struct("no", "start", "end", "bytes",
                              (place != F.col("first")).alias("later"),
                              F.col("first.id").alias("first_id")).alias("hit"))
    # Rows that repeat an id and a text have the same chunks: once is enough.
    texts = hits.groupBy("id", "key").agg(F.array_sort(F.collect_set("hit")).alias("hits"))
    runs = texts.withColumn("runs", _runs(F.col("hits"), min_run)).where(F.size("runs") > 0)
    inside = F.flatten(F.col("runs"))
    dropped = F.filter(inside, lambda h: h["later"])
    return runs.select(
        "id", "key", F.size(inside).cast("long").alias("n_repeated"),
        F.transform("runs", lambda r: F.struct(
            F.get(r, F.lit(0))["start"].alias("start"), F.element_at(r, -1)["end"].alias("end"),
            F.aggregate(r, F.lit(0), lambda acc, h: acc + h["bytes"]).alias("bytes"))).alias("passages"),
        F.transform(dropped, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"))).alias("dropped"),
        F.array_sort(F.array_distinct(F.transform(dropped, lambda h: h["first_id"]))).alias("first_ids"))


def _runs(hits: Column, min_run: int) -> Column:
    """Hits grouped into runs of consecutive numbers, those of enough bytes."""
    @F.arrow_udf("array<array<int>>")
    def split_(nos: pa.Array, sizes: pa.Array) -> pa.Array:
        out = []
        for no, size in zip(nos, sizes, strict=True):
            n, s = np.array(no.as_py()), np.array(size.as_py())
            starts = np.flatnonzero(np.diff(n, prepend=n[0] - 2) != 1)
            total = np.add.reduceat(s, starts)
            ends = np.append(starts[1:], len(n))
            out.append([list(range(a, b)) for a, b, t in zip(starts.tolist(), ends.tolist(), total.tolist(), strict=True)
                        if t >= min_run])
        return pa.array(out, pa.list_(pa.list_(pa.int32())))

    index = split_(F.transform(hits, lambda h: h["no"]), F.transform(hits, lambda h: h["bytes"]))
    return F.transform(index, lambda run: F.transform(run, lambda i: F.get(hits, i)))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     min_run: int = MIN_RUN) -> DataFrame:
    """``docs`` with ``text_col`` rid of repeated passages that occur earlier,
    plus _n_repeated, _passages and _first_ids (in place of any of those names)."""
    found = repeated_passages(docs, id_col, text_col, min_run)
    docs = docs.drop("_n_repeated", "_passages", "_first_ids")
    # Names that no column has.
    at, key, gone = (unused(docs, c) for c in ("_id", "_key", "_dropped"))
    f = stage(found, "chunk-passages").select(
        F.col("id").alias(at), F.col("key").alias(key), F.col("n_repeated").alias("_n_repeated"),
        F.col("passages").alias("_passages"), F.col("first_ids").alias("_first_ids"), F.col("dropped").alias(gone))
    out = docs.join(f, docs[id_col].eqNullSafe(f[at]) & (F.xxhash64(docs[text_col]) == f[key]), "left")

    @F.arrow_udf("string")
    def without(texts: pa.Array, spans: pa.Array) -> pa.Array:
        kept = []
        for text, drop in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            at, parts = 0, []
            for s in drop or ():
                parts.append(text[at:s["start"]])
                at = s["end"]
            kept.append("".join([*parts, text[at:]]) if drop else text)
        return pa.array(kept, pa.string())

    return out.withColumn(text_col, without(F.col(text_col), F.col(gone))).drop(at, key, gone) \
        .withColumn("_n_repeated", F.coalesce("_n_repeated", F.lit(0)))
