"""N-gram Jaccard join: exact classes of near-duplicates by shingle sets.

Two texts link when ``100 * |A & B| >= 75 * |A | B|`` for their sets of word
shingles. Every link is found, and classes are the connected components:

1. Texts of equal sets are one node. A node has its set size, a parity bitmap
   of its shingle hashes (its width set by the size band) and the smallest
   hash of each of 16 parts of the hash space.
2. Nodes that share a part's smallest hash meet one random node of that group.
   The most promising meetings are verified, and linked nodes put together.
   This only saves work below.
3. Shingles are put in one global order, rare ones first. Linked sets share a
   shingle among the first ``n - ceil(0.75 n) + 1`` of each, so nodes are dealt
   by those. A tile holds the nodes of the shingles that have the same smallest
   node; in it, nodes of like size that are not yet together are compared by
   bitmap: the bits in which two bitmaps differ bound the overlap from above.
4. Pairs that pass are verified by intersecting the sorted shingle arrays.

Shingles that at least one text in 1000 holds come last in the order; of these
there can be at most 1000 times the mean set size, whatever the data, so the
list is broadcast. Any order gives the same links; this one keeps passages
that many texts share out of the tiles.

Defined cases: texts without words have the empty set and link with nothing;
null ids belong to no class (component null) unless the text links to one with
an id; equal sets link even if ids repeat; an empty table gives an empty
result; extra columns are kept by ``drop_near_copies`` and not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bazaar.llm.components import connected_components
from bazaar.llm.scratch import small_batches, stage
from bazaar.llm.words import mix, shingle_rows, words_of

SHINGLE = 5
PARTS = 16
#: Bits of a bitmap for each shingle of the band's smallest set.
BITS_PER_SHINGLE = 2
#: A shingle is common from this share of texts on, and from so many texts.
COMMON_SHARE, COMMON_LEAST = 1 / 1000, 8
#: Meetings verified per node in step 2.
MEETINGS = 3
#: Nodes that one tile compares; larger tiles are cut into blocks.
BLOCK = 2048
#: Tables of up to so many bytes (rows counted, fixed width) are broadcast;
#: larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20

_SALT = np.uint64(0x5851F42D4C957F2D)


def linked(overlap, a, b):
    """100 * I >= 75 * U with U = a + b - I."""
    return 7 * overlap >= 3 * (a + b)


def bitmap(hashes: np.ndarray) -> bytes:
    """Parity bitmap: a bit is set if an odd number of shingles falls on it."""
    width = 64
    while width < BITS_PER_SHINGLE * len(hashes):
        width *= 2
    odd = np.bincount((hashes >> np.uint64(20)).astype(np.int64) & (width - 1), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of 64-bit words narrowed to ``words``, parity kept."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def overlap_bound(x: bytes, y: bytes, a: int, b: int) -> int:
    """Most shingles that two sets of sizes a and b can share."""
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    n = min(len(p), len(q))
    return (a + b - int(np.bitwise_count(_fold(p, n) ^ _fold(q, n)).sum())) // 2


# -- step 1 ---------------------------------------------------------------

SIGNATURE_FIELDS = [
    ("id", None), ("key", pa.int64()), ("n", pa.int64()), ("sig1", pa.int64()), ("sig2", pa.int64()),
    ("parts", pa.list_(pa.struct([("part", pa.int32()), ("hash", pa.int64())]))), ("bits", pa.binary()),
    ("token", pa.int64()), ("held", pa.int64())]
#: Shingle hashes gathered before their counts are taken (16 MB of them).
GATHERED = 1 << 21


def _record(id_type: pa.DataType, **columns) -> pa.RecordBatch:
    """A batch with the given columns, the others null."""
    rows = len(next(iter(columns.values())))
    arrays = []
    for name, kind in SIGNATURE_FIELDS:
        kind = kind or id_type
        a = columns.get(name)
        arrays.append(pa.nulls(rows, kind) if a is None else a if isinstance(a, pa.Array) else pa.array(a, kind))
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in SIGNATURE_FIELDS])


def _signatures(batches):
    """A row for each text (n, sig1, sig2, parts, bits), and rows (token,
    held) for shingles that many of the texts gathered so far hold."""
    held, size, id_type = [], 0, None
    for batch in batches:
        id_type = batch.column("id").type
        n, sig1, sig2, parts, bits = [], [], [], [], []
        for w in words_of(batch.column("text")):
            for _, s in shingle_rows(w, SHINGLE):
                n.append(len(s))
                sig1.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                sig2.append(int(mix(s ^ _SALT).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                part = (s & np.uint64(PARTS - 1)).astype(np.int64)
                numbers, at = np.unique(part, return_index=True)
                parts.append([{"part": p, "hash": h} for p, h in
                              zip(numbers.tolist(), s[at].view(np.int64).tolist(), strict=True)])
                bits.append(bitmap(s))
                held.append(s)
                size += len(s)
        yield _record(id_type, id=batch.column("id"), key=batch.column("key"), n=n, sig1=sig1, sig2=sig2,
                      parts=parts, bits=bits)
        if size >= GATHERED:
            tokens, count = _frequent(held, max(2, len(held) * COMMON_SHARE))
            yield _record(id_type, token=tokens, held=count)
            held, size = [], 0
    if held:
        tokens, count = _frequent(held, max(2, len(held) * COMMON_SHARE))
        yield _record(id_type, token=tokens, held=count)


def _frequent(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that at least so many of the sorted sets hold, and their counts;
    an eighth of the hash space at a time, which bounds the copies made."""
    tokens, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    edges = [np.searchsorted(s, np.arange(1, 8, dtype=np.uint64) << np.uint64(61)) for s in sets]
    for k in range(8):
        part = [s[(e[k - 1] if k else 0):(e[k] if k < 7 else len(s))] for s, e in zip(sets, edges, strict=True)]
        token, count = np.unique(np.concatenate([tokens[0], *part]), return_counts=True)
        many = count >= least
        tokens.append(token[many])
        counts.append(count[many])
    return np.concatenate(tokens).view(np.int64), np.concatenate(counts)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate([np.zeros(0, np.int64), *arrays])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.xxhash64(text_col).alias("key"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_signatures, f"id {kind}, key long, n long, sig1 long, sig2 long, "
                           "parts array<struct<part:int,hash:long>>, bits binary, token long, held long")


def common_shingles(table: DataFrame, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted common shingles and their classes (log2 of their counts). Every
    text is counted; a shingle that is common over all texts is so among the
    texts gathered somewhere. At most mean set size / COMMON_SHARE of them."""
    rows = (table.where("token is not null").groupBy("token").agg(F.sum("held").alias("n"))
            .where(F.col("n") >= max(COMMON_LEAST, texts * COMMON_SHARE)).toArrow())
    tokens = np.asarray(rows.column("token")).astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    count = np.asarray(rows.column("n")).astype(np.int64)
    return tokens[order], (1 + np.log2(np.maximum(count, 1))[order]).astype(np.int64)


# -- sets and their verification -------------------------------------------

def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(node, set) for the nodes in ``wanted`` (node, id, sig1, sig2): the
    sorted shingle hashes of the node's text, as bytes."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    w = _small(wanted, 64)
    rows = rows.join(w, rows._id.eqNullSafe(w.id)).select("node", "sig1", "sig2", "text")

    def sets(batches):
        for batch in batches:
            node, out = batch.column("node"), []
            want1, want2 = np.asarray(batch.column("sig1")), np.asarray(batch.column("sig2"))
            keep = []
            for w_ in words_of(batch.column("text")):
                for i, s in shingle_rows(w_, SHINGLE):
                    # Another text of the same id is not this node's.
                    if s.sum(dtype=np.uint64).view(np.int64) == want1[i] and len(s) \
                            and mix(s ^ _SALT).sum(dtype=np.uint64).view(np.int64) == want2[i]:
                        keep.append(i)
                        out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([node.take(pa.array(keep, pa.int64())), pa.array(out, pa.binary())],
                                             names=["node", "set"])

    return rows.mapInArrow(sets, "node long, set binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) that link, by exact intersection of their sets."""
    ends = pairs.select(F.col("a").alias("_n")).unionByName(pairs.select(F.col("b").alias("_n"))).distinct()
    wanted = stage(nodes.join(ends, F.col("node") == F.col("_n"), "left_semi").select("node", "id", "sig1", "sig2"),
                   "jaccard-wanted")
    sets = stage(shingle_sets(docs, id_col, text_col, wanted), "jaccard-sets")
    x = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))

    @F.arrow_udf("boolean")
    def links(p: pa.Array, q: pa.Array) -> pa.Array:
        out = []
        for s, t in zip(p, q, strict=True):
            s, t = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
            both = np.intersect1d(s, t, assume_unique=True)
            out.append(linked(len(both), len(s), len(t)))
        return pa.array(out, pa.bool_())

    return stage(pairs.join(x, "a").join(y, "b").where(links("x", "y")).select("a", "b"), "jaccard-links")


def _passes(n1: str, bits1: str, n2: str, bits2: str) -> Column:
    """Bound on the overlap as a share of what a link needs; below 1: none."""
    @F.arrow_udf("double")
    def bound(a: pa.Array, x: pa.Array, b: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([7 * overlap_bound(p.as_buffer(), q.as_buffer(), m, n) / (3 * (m + n))
                         for m, p, n, q in zip(a.to_pylist(), x, b.to_pylist(), y, strict=True)], pa.float64())

    return bound(n1, bits1, n2, bits2)


# -- step 2 ---------------------------------------------------------------

def meetings(nodes: DataFrame) -> DataFrame:
    """Pairs of a node and a random node of the same smallest hash, those of
    the best bounds for each node. Groups are reduced to one node on the map
    side, so their size does not matter."""
    keys = nodes.select("node", F.explode("parts").alias("k")).select("node", "k.part", "k.hash")
    chosen = keys.groupBy("part", "hash").agg(
        F.count(F.lit(1)).alias("size"),
        F.min(F.struct(F.xxhash64("node", "part").alias("order"), "node")).alias("least"))
    chosen = chosen.where("size > 1").select("part", "hash", F.col("least.node").alias("b"))
    pairs = keys.join(chosen, ["part", "hash"]).where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    met = (pairs.join(a, "a").join(b, "b")
           .where((F.col("n_a") * 4 >= F.col("n_b") * 3) & (F.col("n_b") * 4 >= F.col("n_a") * 3))
           .select("a", "b", _passes("n_a", "bits_a", "n_b", "bits_b").alias("bound")).where("bound >= 1"))
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.col("bound").desc(), "b"))
    return met.withColumn("_r", best).where(F.col("_r") <= MEETINGS).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# -- step 3 ---------------------------------------------------------------

def prefixes(docs: DataFrame, id_col: str, text_col: str, tokens: np.ndarray, classes: np.ndarray) -> DataFrame:
    """(id, sig1, sig2, rare, common): the first shingles of each text's set in
    the global order, apart for common ones."""
    def take(batches):
        for batch in batches:
            row, sig1, sig2, rare, common = [], [], [], [], []
            for w in words_of(batch.column("text")):
                for i, s in shingle_rows(w, SHINGLE):
                    if not len(s):
                        continue
                    row.append(i)
                    sig1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                    sig2.append(int(mix(s ^ _SALT).sum(dtype=np.uint64).view(np.int64)))
                    first = len(s) - (3 * len(s) + 3) // 4 + 1
                    at = np.searchsorted(tokens, s)
                    at[at == len(tokens)] = 0
                    known = tokens[at] == s if len(tokens) else np.zeros(len(s), bool)
                    plain = s[~known]
                    if len(plain) >= first:
                        rare.append(plain[:first].view(np.int64))
                        common.append(plain[:0].view(np.int64))
                    else:
                        rest = s[known][np.argsort(classes[at[known]], kind="stable")]
                        rare.append(plain.view(np.int64))
                        common.append(rest[:first - len(plain)].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row, pa.int64())),
                 pa.array(sig1, pa.int64()), pa.array(sig2, pa.int64()),
                 _lists(rare), _lists(common)],
                names=["id", "sig1", "sig2", "rare", "common"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(take, f"id {kind}, sig1 long, sig2 long, rare array<long>, common array<long>")


def _contested(batches):
    """(owner, node) for shingles that nodes of different components hold; the
    owner is the smallest node of the shingle. A partition holds all rows of
    its shingles."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    token, node, comp = (np.asarray(table.column(c)) for c in ("token", "node", "comp"))
    order = np.argsort(token, kind="stable")
    t, v, c = token[order], node[order], comp[order]
    start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    length = np.diff(np.append(start, len(t)))
    keep = np.repeat(np.minimum.reduceat(c, start) != np.maximum.reduceat(c, start), length)
    owner = np.repeat(np.minimum.reduceat(v, start), length)
    rows = np.unique(np.stack([owner[keep], v[keep]], axis=1), axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["owner", "node"])


def tile_members(docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame, tokens: np.ndarray,
                 classes: np.ndarray) -> DataFrame:
    """(owner, node) of all tiles in which there is something to compare: a
    tile gathers the nodes of all shingles that have the same smallest node,
    so two nodes that share many shingles meet in few tiles, not once for each.
    ``nodes`` has id, sig1, sig2, node, comp."""
    held = prefixes(docs, id_col, text_col, tokens, classes)
    # One text of each set is enough: that of the node's id.
    held = held.join(nodes.select("sig1", "sig2", F.col("id").alias("_id"), "node", "comp"), ["sig1", "sig2"]) \
        .where(F.col("id").eqNullSafe(F.col("_id")))
    rare = held.select(F.explode("rare").alias("token"), "node", "comp")
    plain = rare.repartition("token").mapInArrow(_contested, "owner long, node long")
    # Common shingles: found by counts from the map side, never one task each.
    common = stage(held.select(F.explode("common").alias("token"), "node", "comp"), "jaccard-common")
    differ = stage(common.groupBy("token").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("node").alias("owner"))
        .where("lo <> hi").select("token", "owner"), "jaccard-differ")
    return stage(plain.unionByName(common.join(differ, "token").select("owner", "node")).distinct(), "jaccard-members")


def tiles(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(owner, i, j, block, node, comp, n, bits): the members of each tile with
    their signatures. A tile of more than ``BLOCK`` nodes is cut into blocks,
    and each pair of blocks (i, j) is a tile of its own, so that none outgrows
    a task."""
    large = members.groupBy("owner").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK).select(
        F.col("owner").alias("_owner"), F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    rows = members.join(large, F.col("owner") == F.col("_owner"), "left").select(
        "owner", "node", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("owner", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                       "block", "node")
    return rows.join(nodes.select("node", "comp", "n", "bits"), "node").repartition("owner", "i", "j")


def _pairs(batches):
    """Pairs (a, b) of a tile that may link and are not yet together. Nodes go
    by bitmap width (size band) and are compared with the next ones of their
    own and of the neighbouring band, as far as sizes allow a link."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    owner, i, j, block, node, comp, n = (np.asarray(table.column(c)) for c in (
        "owner", "i", "j", "block", "node", "comp", "n"))
    bits = table.column("bits").combine_chunks()
    order = np.lexsort((node, n, j, i, owner))
    key = np.stack([owner[order], i[order], j[order]])
    cut = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0), [True]]))
    found = [np.zeros((0, 2), np.int64)]
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        rows = order[lo:hi]
        across = i[rows[0]] + j[rows[0]]
        bands: dict[int, list] = {}
        for r in rows.tolist():
            b = np.frombuffer(bits[r].as_buffer(), np.uint64)
            bands.setdefault(len(b), []).append((r, b))
        packed = {k: (np.array([r for r, _ in v]), np.stack([b for _, b in v])) for k, v in bands.items()}
        for words, (mine, own) in packed.items():
            others = [(mine, own, True)]
            if 2 * words in packed:
                up, wide = packed[2 * words]
                others.append((up, _fold(wide, words), False))
            for them, theirs, same in others:
                sizes, theirs_comp, theirs_block = n[them], comp[them], block[them]
                for k, r in enumerate(mine.tolist()):
                    first = k + 1 if same else 0
                    last = int(np.searchsorted(sizes, n[r] * 4 // 3, "right"))
                    if last <= first:
                        continue
                    at = first + np.flatnonzero((theirs_comp[first:last] != comp[r])
                                                & (theirs_block[first:last] + block[r] == across))
                    if not len(at):
                        continue
                    apart = np.bitwise_count(theirs[at] ^ own[k]).sum(axis=1, dtype=np.int64)
                    total = sizes[at] + n[r]
                    ok = 7 * ((total - apart) // 2) >= 3 * total
                    if ok.any():
                        other = node[them[at[ok]]]
                        me = np.full(len(other), node[r])
                        found.append(np.stack([np.minimum(me, other), np.maximum(me, other)], axis=1))
        if len(found) > 4096:
            found = [np.unique(np.concatenate(found), axis=0)]
    pairs = np.unique(np.concatenate(found), axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


# -- the join ---------------------------------------------------------------

def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_shingles, component_id (smallest
    id reachable by links), text_key (a hash of the text)."""
    small_batches(docs)
    table = stage(signatures(docs, id_col, text_col), "jaccard-signatures")
    texts = table.where("token is null")
    # Equal sets are one node; numbered when written, so the numbers stay.
    groups = texts.where("n > 0").groupBy("sig1", "sig2").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("parts").alias("parts"), F.first("bits").alias("bits"))
    nodes = stage(groups.withColumn("node", F.monotonically_increasing_id()), "jaccard-nodes")
    tokens, classes = common_shingles(table, texts.count())

    met = stage(meetings(nodes), "jaccard-meetings")
    early = verified(met, nodes, docs, id_col, text_col)
    first = stage(connected_components(early, "a", "b"), "jaccard-early")
    f = first.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    labelled = nodes.join(f, F.col("node") == F.col("_n"), "left") \
        .withColumn("comp", F.coalesce("_c", "node")).drop("_n", "_c")

    members = tile_members(docs, id_col, text_col, labelled, tokens, classes)
    signed = labelled.select("node", "comp", "n", "bits")
    pairs = stage(tiles(members, signed).mapInArrow(_pairs, "a long, b long").distinct(), "jaccard-pairs")
    late = verified(pairs, nodes, docs, id_col, text_col)

    comps = stage(connected_components(early.unionByName(late), "a", "b"), "jaccard-components")
    c = comps.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    classes_ = nodes.join(c, F.col("node") == F.col("_n"), "left").select(
        "sig1", "sig2", "id", F.coalesce("_c", "node").alias("comp"))
    lowest = classes_.groupBy("comp").agg(F.min("id").alias("component_id"))
    final = stage(classes_.join(lowest, "comp").select("sig1", "sig2", "component_id"), "jaccard-classes")
    return texts.select("id", "key", "n", "sig1", "sig2").join(final, ["sig1", "sig2"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.col("key").alias("text_key"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their class (those of the smallest
    id), with all columns. Rows that repeat an id and a text stay together."""
    found = near_copies(docs, id_col, text_col)
    gone = stage(found.where(~F.col(id_col).eqNullSafe(F.col("component_id")))
                 .select(F.col(id_col).alias("_gone"), F.col("text_key").alias("_key")).distinct(), "jaccard-gone")
    g = _small(gone, 32)
    return docs.join(g, docs[id_col].eqNullSafe(g._gone) & (F.xxhash64(docs[text_col]) == g._key), "left_anti")
