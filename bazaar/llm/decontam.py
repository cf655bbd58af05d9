"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman.

The test items are taken in blocks of a bounded number of words. For a block
the corpus is read twice. The first pass counts in how many texts each of the
items' word n-grams occurs; those that are rare for their item are its seeds.
The second pass looks up the seeds in every text, aligns the item with the
passage around each cluster of seeds (local alignment of words), and keeps
places whose score is at least ``min_score`` of a perfect copy's, so edited
and paraphrased copies count too. Both are maps over the texts; only counts of
the block's n-grams are shuffled.

Words are runs of letters and digits (any script), lower-cased, so copies in
capitals or with other punctuation are copies.

Defined cases: null and empty texts match nothing; items of fewer words than
an n-gram match as a whole, items without words never; each text and item has
one result, its best place (the first of equal ones; places count words); equal items each have their own; repeated rows give repeated
results; empty tables give empty results; extra columns are kept by
``drop_contaminated`` and not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.llm.scratch import small_batches
from bazaar.llm.words import Words, ngrams, words_of

N = 3
MIN_SCORE = 0.5
#: Words of test items in a block (about 8 bytes each, several times over).
BLOCK_WORDS = 2_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
HIT = "array<struct<item_id:{id},score:double,start_word:long,end_word:long>>"


class Block(NamedTuple):
    ids: list
    id_type: pa.DataType
    items: list[np.ndarray]     # word hashes
    grams: np.ndarray           # sorted distinct n-gram hashes


class Seeds(NamedTuple):
    grams: np.ndarray           # sorted distinct hashes
    ptr: np.ndarray             # postings of gram i: ptr[i] to ptr[i + 1]
    item: np.ndarray
    place: np.ndarray


def normal_words(texts: pa.Array) -> Iterator[Words]:
    return words_of(pc.utf8_lower(texts), plain=True)


def _item_grams(words: np.ndarray) -> np.ndarray:
    return ngrams(words, min(N, len(words)))


def blocks_of(items: DataFrame, id_col: str, text_col: str) -> int:
    words = items.agg(F.sum(F.length(text_col)).alias("n")).first()["n"] or 0
    return 1 + int(words / 4 / BLOCK_WORDS)


def load_block(items: DataFrame, id_col: str, text_col: str) -> Block:
    got = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).toArrow()
    ids, words = got.column("id").to_pylist(), []
    for w in normal_words(got.column("text").combine_chunks()):
        words += [w.hashes[w.ptr[i]:w.ptr[i + 1]] for i in range(len(w.ptr) - 1)]
    order = sorted((i for i in range(len(ids)) if len(words[i])), key=lambda i: (str(ids[i]), words[i].tobytes()))
    ids, words = [ids[i] for i in order], [words[i] for i in order]
    grams = np.unique(np.concatenate([_item_grams(w) for w in words])) if words else np.zeros(0, np.uint64)
    return Block(ids, got.schema.field("id").type, words, grams)


class Lookup:
    """Finds which of many hashes are among a sorted few."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.near = keys, np.zeros(1 << 20, bool)
        self.near[keys >> np.uint64(44)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``hashes``, positions in the keys) of the hits."""
        at = np.flatnonzero(self.near[hashes >> np.uint64(44)])
        k = np.searchsorted(self.keys, hashes[at])
        k[k == len(self.keys)] = 0
        hit = self.keys[k] == hashes[at] if len(self.keys) else np.zeros(0, bool)
        return at[hit], k[hit]


def _text_grams(w: Words) -> list[tuple[int, np.ndarray]]:
    """n-gram hashes of a slice as (n, hashes) for every n that items need;
    shorter ones than N serve items of so few words."""
    return [(n, ngrams(w.hashes, n)) for n in range(1, N + 1)]


def gram_counts(docs: DataFrame, text_col: str, block: Block) -> np.ndarray:
    """In how many texts each n-gram of the block occurs (over all texts)."""
    find, short = Lookup(block.grams), {min(N, len(w)) for w in block.items}

    def count(batches):
        total = np.zeros(len(find.keys), np.int64)
        for batch in batches:
            for w in normal_words(batch.column(0)):
                row = np.repeat(np.arange(len(w.ptr) - 1), np.diff(w.ptr))
                for n, grams in _text_grams(w):
                    if n in short and len(grams):
                        at, k = find(grams)
                        same = row[at] == row[at + n - 1]
                        pairs = np.unique(row[at[same]] * len(find.keys) + k[same])
                        np.add.at(total, pairs % len(find.keys), 1)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["gram", "n"])

    out = np.zeros(len(block.grams), np.int64)
    if len(block.grams):
        rows = docs.select(text_col).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        got = rows.toArrow()
        out[np.asarray(got.column("gram"))] = np.asarray(got.column("n"))
    return out


def choose_seeds(block: Block, counts: np.ndarray) -> Seeds:
    """The n-grams of each item that are rare for it: all but those that occur
    in far more texts than most of the item's own n-grams do. Rarity is not
    ranked any finer: the n-grams that edited copies have kept are among the
    more frequent ones of a leaked item, and they are the ones to find."""
    gram, item, place = [], [], []
    for i, words in enumerate(block.items):
        g = _item_grams(words)
        n = counts[np.searchsorted(block.grams, g)]
        rare = np.flatnonzero(n <= 4 * np.quantile(n, 0.75, method="higher") + 10)
        gram.append(g[rare])
        item.append(np.full(len(rare), i))
        place.append(rare)
    if not gram:
        none = np.zeros(0, np.int64)
        return Seeds(none.astype(np.uint64), np.zeros(1, np.int64), none, none)
    gram, item, place = map(np.concatenate, (gram, item, place))
    order = np.argsort(gram, kind="stable")
    keys, first = np.unique(gram[order], return_index=True)
    return Seeds(keys, np.append(first, len(order)), item[order], place[order])


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences with linear gaps: (score,
    first word, end word) in ``text``. Each cell carries where its alignment
    began, packed below the score, so that one maximum moves both."""
    w, base = len(text), 1 << 40
    place = np.arange(w + 1)
    zero = base - 1 - place                      # score 0, beginning here
    row = zero.copy()
    best = (0, 0, 0)
    for x in item:
        step = row[:-1] + np.where(text == x, MATCH, MISMATCH) * base
        new = zero.copy()
        new[1:] = np.maximum(new[1:], np.maximum(step, row[1:] + GAP * base))
        # Gaps along the text: the running best, less GAP for each step.
        new = np.maximum.accumulate(new - GAP * base * place) + GAP * base * place
        new = np.maximum(new, zero)
        j = int(np.argmax(new))
        score = int((new[j]) // base)
        if score > best[0]:
            best = (score, int(base - 1 - new[j] % base), j)
        row = new
    return best


def places_in(words: np.ndarray, at: np.ndarray, item: np.ndarray, place: np.ndarray,
              block: Block, min_score: float) -> list[tuple]:
    """Results (item number, score, start, end) for one text from its seed
    hits: word numbers ``at`` with the item and the item's place of each."""
    by_item: dict[int, set] = defaultdict(set)
    for a, i, p in zip(at.tolist(), item.tolist(), place.tolist(), strict=True):
        by_item[i].add(a - p)
    out = []
    for i, starts in sorted(by_item.items()):
        target = block.items[i]
        m, best, full = len(target), (0, 0, 0), MATCH * len(target)
        slack, cluster = max(4, m // 2), []
        for s in [*sorted(starts), None]:
            if cluster and (s is None or s - cluster[-1] > slack):
                if any(c >= 0 and np.array_equal(words[c:c + m], target) for c in cluster):
                    c = next(c for c in cluster if c >= 0 and np.array_equal(words[c:c + m], target))
                    found = (full, c, c + m)
                else:
                    lo, hi = max(0, cluster[0] - slack), min(len(words), cluster[-1] + m + slack)
                    score, start, end = smith_waterman(target, words[lo:hi])
                    found = (score, lo + start, lo + end)
                if found[0] > best[0]:
                    best = found
                cluster = []
            if s is not None:
                cluster.append(s)
        if best[0] >= min_score * full:
            out.append((i, best[0] / full, best[1], best[2]))
    return out


def contaminations(text: Column, block: Block, seeds: Seeds, min_score: float, id_type: str) -> Column:
    """Array of (item_id, score, start_word, end_word) for a text column."""
    short = {min(N, len(w)) for w in block.items}
    find = Lookup(seeds.grams)

    @F.arrow_udf(HIT.format(id=id_type))
    def search(texts: pa.Array) -> pa.Array:
        out: list[list] = [[] for _ in range(len(texts))]
        for w in normal_words(texts):
            row = np.repeat(np.arange(len(w.ptr) - 1), np.diff(w.ptr))
            at, key = [], []
            for n, grams in _text_grams(w):
                if n in short and len(grams):
                    a, k = find(grams)
                    same = row[a] == row[a + n - 1]
                    at.append(a[same])
                    key.append(k[same])
            at, key = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, key))
            if not len(at):
                continue
            many = seeds.ptr[key + 1] - seeds.ptr[key]
            post = np.repeat(seeds.ptr[key] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            at = np.repeat(at, many)
            order = np.argsort(row[at], kind="stable")
            at, post = at[order], post[order]
            rows, first = np.unique(row[at], return_index=True)
            for r, lo, hi in zip(rows.tolist(), first.tolist(), [*first[1:].tolist(), len(at)], strict=True):
                a, p = w.ptr[r], post[lo:hi]
                out[w.first + r] = [
                    {"item_id": block.ids[i], "score": s, "start_word": b, "end_word": e}
                    for i, s, b, e in places_in(w.hashes[a:w.ptr[r + 1]], at[lo:hi] - a,
                                                seeds.item[p], seeds.place[p], block, min_score)]
        return pa.array(out, pa.list_(pa.struct([("item_id", block.id_type), ("score", pa.float64()),
                                                 ("start_word", pa.int64()), ("end_word", pa.int64())])))

    return search(text)


def contamination_column(docs: DataFrame, items: DataFrame, text_col: str, item_id: str, item_text: str,
                         min_score: float) -> Column:
    """The results over all blocks of items, as one array column. The blocks
    are a stated query set run against all rows in turn."""
    small_batches(docs)
    blocks = blocks_of(items, item_id, item_text)
    kind = items.schema[item_id].dataType.simpleString()
    parts = []
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64(item_id, item_text), F.lit(blocks)) == b)
        block = load_block(mine, item_id, item_text)
        seeds = choose_seeds(block, gram_counts(docs, text_col, block))
        parts.append(contaminations(F.col(text_col), block, seeds, min_score, kind))
    return F.concat(*parts)


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_id: str = "item_id", item_text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """One row per text and test item found in it: ``id_col``, ``item_id``,
    score (1 for a perfect copy), start_word, end_word (exclusive)."""
    found = contamination_column(docs, items, text_col, item_id, item_text, min_score)
    # explode_outer: a plain explode would run the search a second time, to
    # filter empty results first.
    rows = docs.select(F.col(id_col), found.alias("_found")).select(
        id_col, F.explode_outer("_found").alias("_f")).where("_f is not null")
    return rows.select(id_col, F.col("_f.item_id").alias(item_id), "_f.score", "_f.start_word", "_f.end_word")


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                      item_text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` in which no test item is found, with all columns."""
    found = contamination_column(docs, items, text_col, item_id, item_text, min_score)
    return docs.where(F.size(found) == 0)
