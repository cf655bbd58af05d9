"""Repeated substrings by a prefix-free parse of the corpus.

Wanted are all bytes covered by a string of ``LENGTH`` bytes that also starts
elsewhere. A rolling hash (gear, 32 bytes) marks *triggers*; whether a place is
one depends on the ``CONTEXT`` bytes before it alone, so equal strings have
equal triggers inside. The stretches between triggers are the phrases of the
parse, and no phrase, with the context it starts in, is a prefix of another.

1. A string with a trigger of a context that occurs once in the corpus occurs
   once. Texts are cut at those; only the stretches in between that are long
   enough (*segments*) go on: the highly repetitive part of the corpus.
2. The strings of ``LENGTH`` bytes in a segment are dealt by their first and
   last trigger: all strings between the same phrases in the parse are one
   *span* of neighbouring starts. Its key is what lies between these triggers
   (whole phrases: a piece of the parse), its reach the key with the pieces of
   phrases that its strings have on either side (suffixes and prefixes of
   phrases of the dictionary). Equal strings have equal keys.
3. Spans of equal reach repeat each other whole. Where one key has several
   reaches, one span of each is compared string by string; where it has many,
   first by what neighbouring strings have in common.
4. Strings without a trigger inside are compared as such; those that repeat
   close by (periodic text) are settled at once.

The suffix arrays of dictionary and parse serve to bring equal strings
together; as only equality at one length is asked for, steps 2 to 4 do this
by digests of 128 bits in place of ranks, and by Spark's hash aggregation in
place of a sorted corpus. No task holds more than a text or a few spans.

Defined cases: null and empty texts have no bytes; strings never reach over
the end of a text; rows that repeat an id or a text are texts of their own (a
text of at least ``LENGTH`` bytes that occurs twice goes whole); null ids stay
null; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.llm.scratch import stage
from bazaar.llm.words import mix, slices

LENGTH = 400
#: Bytes that the rolling hash covers; earlier hashes that a trigger's differs
#: from (so periodic text has none); bytes that decide on a trigger.
WINDOW, APART = 32, 16
CONTEXT = WINDOW + APART
#: One place in so many is a trigger.
EVERY = 48
#: Reaches of one key that are compared in one task; more are dealt by block of
#: so many starts, and the blocks that repeat by string.
TOGETHER, BLOCK = 16, 32
#: Bytes hashed at once; starts of strings in a piece of a segment.
CHUNK, PIECE = 1 << 18, 1 << 15

_rng = np.random.default_rng(40961)
_GEAR = _rng.integers(0, 1 << 32, 256, dtype=np.uint32)
#: Two independent hashes: values of the bytes, odd bases and their inverses.
_VALUES = _rng.integers(1, 2**64, (2, 256), dtype=np.uint64) | np.uint64(1)
_BASES = [int(b) | 1 for b in _rng.integers(1, 2**64, 2, dtype=np.uint64)]
_powers: list = [np.ones((2, 1), np.uint64), np.ones((2, 1), np.uint64)]


def _power(n: int) -> list:
    """Powers of the bases and of their inverses, at least n of each."""
    if _powers[0].shape[1] < n:
        for k, bases in enumerate((_BASES, [pow(b, -1, 1 << 64) for b in _BASES])):
            steps = np.array(bases, np.uint64)[:, None].repeat(2 * n, 1)
            steps[:, 0] = 1
            _powers[k] = np.cumprod(steps, axis=1, dtype=np.uint64)
    return _powers


class Hashes:
    """Hashes of all stretches of some bytes, by sums from their start."""

    def __init__(self, data: np.ndarray, two: bool = True):
        n = len(data)
        power, self.inverse = _power(n + 1)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[k][data] * power[k, :n], dtype=np.uint64)])
                     for k in range(1 + two)]

    def of(self, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
        return [mix((s[hi] - s[lo]) * self.inverse[k, lo]) for k, s in enumerate(self.sums)]


def gear(data: np.ndarray) -> np.ndarray:
    h = _GEAR[data]
    width = 1
    while width < WINDOW:
        earlier = np.zeros_like(h)
        earlier[width:] = h[:-width] << np.uint32(width)
        h = h + earlier
        width *= 2
    return h


def find_triggers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends of triggers, hashes of their contexts) of some bytes; a trigger
    needs its whole context."""
    if len(data) < CONTEXT:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gear(data)
    at = np.flatnonzero(mix(h.astype(np.uint64)) % np.uint64(EVERY) == 0)
    at = at[at >= CONTEXT - 1]
    for s in range(1, APART + 1):
        at = at[h[at] != h[at - s]]
    return at + 1, Hashes(data, two=False).of(at + 1 - CONTEXT, at + 1)[0]


def trigger_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(md5, n, ends, contexts) of texts of at least LENGTH bytes."""
    for batch in batches:
        names = batch.column("md5")
        for first, base, data in slices(batch.column("text")):
            ends, keys = [], []
            # A hash that reaches into the text before is not used below.
            for at in range(0, max(len(data), 1), CHUNK):
                lo = max(0, at - CONTEXT)
                e, k = find_triggers(data[lo:at + CHUNK])
                new = e + lo > at if at else e > 0
                ends.append(e[new] + lo)
                keys.append(k[new])
            ends, keys = np.concatenate(ends), np.concatenate(keys)
            row = np.searchsorted(base, ends, "left") - 1
            inside = ends - base[row] >= CONTEXT
            ends, keys, row = ends[inside], keys[inside], row[inside]
            sizes = np.diff(base)
            starts = np.searchsorted(row, np.arange(len(sizes) + 1)).astype(np.int32)
            out = pa.RecordBatch.from_arrays(
                [names.slice(first, len(sizes)), pa.array(sizes),
                 pa.ListArray.from_arrays(pa.array(starts), pa.array(ends - base[row])),
                 pa.ListArray.from_arrays(pa.array(starts), pa.array(keys.view(np.int64)))],
                names=["md5", "n", "ends", "keys"])
            yield out.filter(pa.array(sizes >= LENGTH))


_SEGMENTS = "md5 binary, segments array<struct<lo:long,hi:long,ends:array<long>>>"


def segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches without a trigger of a unique context, of LENGTH bytes or
    more, with the triggers whose context lies in them. Long ones are cut so
    that each string starts in one piece and lies in it."""
    for batch in batches:
        keys, values = [], []
        for r in batch.to_pylist():
            ends = np.array(r["ends"], np.int64)
            unique = ends[~np.isin(ends, np.array(r["repeated"] or [], np.int64))]
            lo = np.concatenate([[0], unique - CONTEXT + 1])
            hi = np.concatenate([unique - 1, [r["n"]]])
            long = hi - lo >= LENGTH
            found = []
            for x, y in zip(lo[long].tolist(), hi[long].tolist(), strict=True):
                for a in range(x, y - LENGTH + 1, PIECE):
                    b = min(y, a + PIECE - 1 + LENGTH)
                    found.append({"lo": a, "hi": b, "ends": ends[np.searchsorted(ends, a + CONTEXT):
                                                                 np.searchsorted(ends, b, "right")]})
            if found:
                keys.append(r["md5"])
                values.append(found)
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("ends", pa.list_(pa.int64()))]))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, kind)], names=["md5", "segments"])


#: What segments yield. SPAN: starts lo to hi in the segment at ``of``, hashes
#: of key and reach; ALONE: a string without triggers at lo, its hashes; SURE:
#: starts that repeat; HELD: the segment's bytes.
SPAN, ALONE, SURE, HELD = 0, 1, 2, 3
_PIECES = "md5 binary, kind byte, of long, lo long, hi long, k1 long, k2 long, c1 long, c2 long, bytes binary"


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of runs of neighbouring numbers."""
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at) != 1)
    return at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]


def _repeated(d: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(whether each pair of hashes occurs twice, the first place of each)."""
    order = np.lexsort((d[1], d[0]))
    a, b = d[0][order], d[1][order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    twice = np.zeros(len(a), bool)
    twice[order] = ~new | ~np.append(new[1:], True)
    return twice, np.sort(order[new])


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers from lo to hi, pair by pair."""
    n = hi - lo + 1
    return np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)


def pieces_of(segments: list[tuple[bytes, list[int]]]) -> Iterator[tuple]:
    """(kind, first starts, last starts, key hashes, reach hashes) of the
    strings of some segments (bytes, ends of triggers), laid end to end."""
    data = np.frombuffer(b"".join(x for x, _ in segments), np.uint8)
    size = np.array([len(x) for x, _ in segments])
    hi = np.cumsum(size)
    lo = hi - size
    count = np.array([len(e) for _, e in segments])
    of = np.repeat(np.arange(len(segments)), count)
    ends = np.array([e for _, x in segments for e in x], np.int64) + lo[of]
    hashes = Hashes(data)
    # The stretches between triggers; a segment has one more than triggers.
    first_of = np.cumsum(count) - count
    gap_of = np.repeat(np.arange(len(segments)), count + 1)
    before = np.insert(ends, first_of, lo - 1 + CONTEXT)
    after = np.insert(ends, np.cumsum(count), hi + 1)
    gap = np.arange(len(ends)) + of  # the stretch before a trigger

    first, last = np.arange(len(ends)), np.arange(len(ends))
    while len(first):
        # Starts with no trigger before the first in the string and none after the last.
        s = of[first]
        a = np.maximum(np.maximum(before[gap[first]] - CONTEXT + 1, lo[s]), ends[last] - LENGTH)
        b = np.minimum(np.minimum(ends[first] - CONTEXT, after[gap[last] + 1] - 1 - LENGTH), hi[s] - LENGTH)
        ok = a <= b
        f, x, a, b = first[ok], last[ok], a[ok], b[ok]
        c = hashes.of(a, b + LENGTH)
        # Equal reaches also have the key at the same place.
        c[0] = mix(c[0] + (ends[f] - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        yield SPAN, a, b, *hashes.of(ends[f] - CONTEXT, ends[x]), *c
        last = last + 1
        near = np.minimum(last, len(ends) - 1)
        more = (last < len(ends)) & (of[near] == of[first]) & (ends[near] <= ends[first] - CONTEXT + LENGTH)
        first, last = first[more], last[more]

    u = np.maximum(before - CONTEXT + 1, lo[gap_of])
    v = np.minimum(after - 1, hi[gap_of]) - LENGTH
    at = _ranges(u[v >= u], v[v >= u])
    d = hashes.of(at, at + LENGTH)
    twice, once = _repeated(d)
    # Strings that repeat here are settled; one of each is left for other tasks.
    none = np.zeros(len(at), np.uint64)
    yield ALONE, at[once], at[once], none[once], none[once], d[0][once], d[1][once]
    a, b = _runs(at[twice])
    yield SURE, a, b, *[np.zeros(len(a), np.uint64)] * 4


def piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the segments of texts. Copies that follow each other count
    once: that their strings repeat is known."""
    names = ["md5", "kind", "of", "lo", "hi", "k1", "k2", "c1", "c2", "bytes"]
    group: list[tuple] = []

    def out():
        keys = pa.array([g[0] for g in group], pa.binary())
        origin = np.array([g[1] for g in group])
        size = np.cumsum([0] + [len(g[2]) for g in group])
        for kind, a, b, *hashes in pieces_of([g[2:] for g in group]):
            s = np.searchsorted(size, a, "right") - 1
            shift = origin[s] - size[s]
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(s)), pa.array(np.full(len(a), kind, np.int8)), pa.array(origin[s]),
                 pa.array(a + shift), pa.array(b + shift), *(pa.array(h.view(np.int64)) for h in hashes),
                 pa.nulls(len(a), pa.binary())], names=names)
        none = pa.array(np.zeros(len(group), np.int64))
        yield pa.RecordBatch.from_arrays(
            [keys, pa.array(np.full(len(group), HELD, np.int8)), pa.array(origin), pa.array(origin),
             pa.array(origin + np.diff(size)), none, none, none, none, pa.array([g[2] for g in group], pa.binary())],
            names=names)
        group.clear()

    before, held = None, 0
    for batch in batches:
        keys, texts, segments = (batch.column(c) for c in ("md5", "text", "segments"))
        for i in range(batch.num_rows):
            key = keys[i].as_py()
            if key == before:
                continue
            before = key
            data = texts[i].as_py().encode()
            for s in segments[i].as_py():
                group.append((key, s["lo"], data[s["lo"]:s["hi"]], [e - s["lo"] for e in s["ends"]]))
                held += s["hi"] - s["lo"]
                if held >= CHUNK:
                    yield from out()
                    held = 0
    if group:
        yield from out()


def string_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of spans: from their first start to the end of the last string."""
    for batch in batches:
        lo, hi = (np.asarray(batch.column(c)) - np.asarray(batch.column("of")) for c in ("lo", "hi"))
        held = batch.column("bytes")
        cut = [held[i].as_buffer().slice(a, b + LENGTH - a).to_pybytes()
               for i, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True))]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("k1", "k2", "g", "md5", "lo")] + [pa.array(cut, pa.binary())],
                                         names=["k1", "k2", "g", "md5", "lo", "bytes"])


def _strings(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(row, place, hashes) of all strings of LENGTH bytes of some spans."""
    data = np.frombuffer(b"".join(r[1] for r in rows), np.uint8)
    sizes = np.array([len(r[1]) for r in rows])
    n = sizes - LENGTH + 1
    row = np.repeat(np.arange(len(rows)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum(sizes) - sizes, n) + place
    return row, place, Hashes(data).of(at, at + LENGTH)


def compare_reaches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over spans sorted by key: the starts whose strings repeat in the key's
    other spans, as runs. The last key of a batch waits for the next."""
    def found(rows):
        kinds = [pa.binary(), pa.int64(), pa.int64()]
        out: list[tuple] = []
        if rows:
            row, place, d = _strings([(r["md5"], r["bytes"]) for r in rows])
            twice, _ = _repeated(d)
            for k in np.unique(row[twice]).tolist():
                a, b = _runs(place[twice & (row == k)])
                out += [(rows[k]["md5"], rows[k]["lo"] + x, rows[k]["lo"] + y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)],
                                          names=["md5", "lo", "hi"])

    waiting: list[dict] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            waiting += batch.slice(at, 256).to_pylist()
            last = (waiting[-1]["k1"], waiting[-1]["k2"])
            cut = next(i for i, r in enumerate(waiting) if (r["k1"], r["k2"]) == last)
            if cut:
                yield found(waiting[:cut])
                waiting = waiting[cut:]
    yield found(waiting)


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of spans in blocks of neighbouring starts, cut by the
    distance from start to first trigger: hashes of the key and of the bytes
    that a whole block's strings have in common. Equal strings lie in blocks of
    equal hashes."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = batch.slice(at, 256).to_pylist()
            data = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
            sizes = np.array([len(r["bytes"]) for r in rows])
            begin = np.cumsum(sizes) - sizes
            trigger = find_triggers(data)[0] - CONTEXT
            far = trigger[np.searchsorted(trigger, begin)] - begin  # of the first start; the last is not behind it
            low, high = (far - sizes + LENGTH) // BLOCK, far // BLOCK
            row, block = np.repeat(np.arange(len(rows)), high - low + 1), _ranges(low, high)
            near = far[row] - block * BLOCK  # the block's last start, if the span has it
            first, last = np.maximum(near - BLOCK + 1, 0), np.minimum(near, sizes[row] - LENGTH)
            c = Hashes(data).of(begin[row] + near, begin[row] + near - BLOCK + 1 + LENGTH)
            # Spans that share a first trigger may share a block, but not the key.
            key = np.array([r["k1"] for r in rows], np.int64).view(np.uint64)[row]
            c[0] = mix(mix(c[0] + key) + block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            cut = [rows[r]["bytes"][a:b + LENGTH] for r, a, b in zip(row.tolist(), first.tolist(), last.tolist(), strict=True)]
            keys = pa.array([r["md5"] for r in rows], pa.binary()).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(first + np.array([r["lo"] for r in rows])[row]),
                 *(pa.array(x.view(np.int64)) for x in c), pa.array(cut, pa.binary())],
                names=["md5", "lo", "c1", "c2", "bytes"])


def string_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(md5, lo, c1, c2) of all strings of blocks."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = batch.slice(at, 256).to_pylist()
            row, place, d = _strings([(r["md5"], r["bytes"]) for r in rows])
            keys = pa.array([r["md5"] for r in rows], pa.binary()).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(place + np.array([r["lo"] for r in rows])[row]),
                 *(pa.array(x.view(np.int64)) for x in d)], names=["md5", "lo", "c1", "c2"])


def _twice(rows: DataFrame, name: str) -> DataFrame:
    """The rows whose hashes another row has too."""
    keys = stage(rows.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("c1", "c2"), name)
    return rows.join(keys, ["c1", "c2"], "left_semi")


def repeated_starts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(md5 of a text, starts: array of lo, hi): where the strings of LENGTH
    bytes start that also start elsewhere."""
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") >= LENGTH) \
        .withColumn("md5", F.unhex(F.md5("text")))
    parsed = stage(texts.mapInArrow(trigger_rows, "md5 binary, n long, ends array<long>, keys array<long>")
                   .withColumn("row", F.monotonically_increasing_id()), "parse-triggers")
    each = parsed.select("row", F.inline(F.arrays_zip("ends", "keys")).alias("end", "key"))
    repeated = stage(each.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("key"),
                     "parse-repeated")
    marks = each.join(repeated, "key", "left_semi").groupBy("row").agg(F.collect_list("end").alias("repeated"))
    # Texts that occur twice have the same segments: once is enough to find them.
    segments = stage(parsed.select("row", "md5", "n", "ends").join(marks, "row", "left").drop("row")
                     .mapInArrow(segment_rows, _SEGMENTS).groupBy("md5").agg(F.first("segments").alias("segments")),
                     "parse-segments")
    pieces = stage(texts.join(segments, "md5").select("md5", "text", "segments").mapInArrow(piece_rows, _PIECES),
                   "parse-pieces")
    copies = parsed.groupBy("md5").agg(F.count(F.lit(1)).alias("times"), F.max("n").alias("n")).where("times > 1").select(
        "md5", F.lit(0).cast("long").alias("lo"), (F.col("n") - LENGTH).alias("hi"))

    spans = pieces.where(F.col("kind") == SPAN)
    reaches = stage(spans.groupBy("k1", "k2", "c1", "c2").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("md5", "of", "lo", "hi")).alias("one")), "parse-reaches")
    keys = stage(reaches.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("g")).where("g > 1"), "parse-keys")
    certain = spans.join(reaches.where("times > 1").select("k1", "k2", "c1", "c2"), ["k1", "k2", "c1", "c2"], "left_semi")
    # One span of each reach, with its bytes.
    open_spans = reaches.join(keys, ["k1", "k2"]).select("k1", "k2", "g", "one.*")
    held = pieces.where(F.col("kind") == HELD).select("md5", "of", "bytes")
    strings = stage(open_spans.join(held, ["md5", "of"]).mapInArrow(
        string_rows, "k1 long, k2 long, g long, md5 binary, lo long, bytes binary"), "parse-strings")
    few = strings.where(F.col("g") <= TOGETHER).repartition("k1", "k2").sortWithinPartitions("k1", "k2") \
        .mapInArrow(compare_reaches, "md5 binary, lo long, hi long")

    digest = "md5 binary, lo long, c1 long, c2 long"
    blocks = stage(strings.where(F.col("g") > TOGETHER).mapInArrow(block_rows, f"{digest}, bytes binary"), "parse-blocks")
    dealt = stage(_twice(blocks, "parse-block-keys").mapInArrow(string_digests, digest), "parse-dealt")
    alone = pieces.where(F.col("kind") == ALONE).select("md5", "lo", "c1", "c2").unionByName(dealt)
    again = _twice(alone, "parse-twice").select("md5", "lo", F.col("lo").alias("hi"))

    found = certain.select("md5", "lo", "hi").unionByName(copies).unionByName(few).unionByName(again).unionByName(
        pieces.where(F.col("kind") == SURE).select("md5", "lo", "hi"))
    return found.groupBy("md5").agg(F.collect_set(F.struct("lo", "hi")).alias("starts"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            sizes, spans, kept = [], [], []
            for text, starts in zip(part.column("text").to_pylist(), part.column("starts").to_pylist(), strict=True):
                data = (text or "").encode()
                runs: list[dict] = []
                for lo, hi in sorted((s["lo"], s["hi"] + LENGTH) for s in starts or ()):
                    if runs and lo <= runs[-1]["end"]:
                        runs[-1]["end"] = max(runs[-1]["end"], hi)
                    else:
                        runs.append({"start": lo, "end": hi})
                edges = [0, *(e for r in runs for e in (r["start"], r["end"])), len(data)]
                sizes.append(len(data))
                spans.append(runs)
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                names=["id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, spans (array of start, end of
    the removed runs, in bytes) and kept (the other bytes)."""
    starts = stage(repeated_starts(docs, text_col), "parse-starts")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")) \
        .withColumn("md5", F.unhex(F.md5("text")))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.join(starts, "md5", "left").select("id", "text", "starts").mapInArrow(
        _without, f"id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumnRenamed("id", id_col)
