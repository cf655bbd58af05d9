"""Cross-tokenizer alignment by an associative fragment monoid.

Two tokenizers cut the same bytes (a space, then the text) into tokens. Where
tokens of both end, a group ends; a group holds some tokens A and some B that
cover the same bytes, and tokens of a group whose byte ranges overlap are
linked. Linked id pairs are counted over all texts (once a text).

A byte range of a text gives a *fragment*: the tokens up to its first common
end (open prefix: their group may have begun in the range before), the groups
closed after it, and the tokens after its last common end (open suffix). Two
neighbouring fragments compose by closing one group from the left one's suffix
and the right one's prefix. This is associative, so the fragments of a long
text, made by many tasks, are composed by a tree of ``FAN`` at a time; no task
ever holds the tokens of more than ``FAN`` fragments apart. Texts of at most
``PIECE`` bytes are one fragment.

Neither tokenizer has a token that reaches over the place between a character
that is no white space and a space (checked when the vocabularies are read). Stretches between such places (*units*, mostly words) are tokenized
alone; units met before are not tokenized again. A unit is never cut, however
long.

Texts are tokenized once: the alignments are staged with each text's distinct
id pairs, which are counted over the corpus and joined with their counts. The
table of counts is broadcast if it has at most ``pairs_limit`` rows; a larger
one is joined by a shuffle, with equal results.

Defined cases: null and empty texts, and texts that a tokenizer does not give
back byte for byte, have no tokens; each row is a text of its own, also rows
that repeat an id, and null ids stay null; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import json
import re
import sys
import types
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.llm.scratch import stage

#: Bytes of text up to which a text is one fragment; pieces of longer texts.
PIECE = 1 << 16
#: Bytes of a fragment's range in longer texts, and fragments composed at once.
RANGE, FAN = 1 << 15, 16
#: Units that a Python worker remembers.
MEMO = 250_000
#: Rows of the table of pair counts up to which it is broadcast (17 bytes a row).
PAIRS_LIMIT = 1_000_000
#: Units joined for one call of the tokenizers; characters up to which the
#: fast form of A gets a text.
CALL, FAST_CHARS = 500, 1 << 15
#: Texts whose units a task holds at once.
ROWS = 400

#: How byte-level vocabularies name bytes: printable ones by themselves.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_NAMED = {chr(b): b for b in _PRINTABLE} | {
    chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: Fixed value: the public pre-tokenizer pattern of byte-level BPE.
BYTE_LEVEL_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_CUT = re.compile(r"(?<=\S) (?=.)", re.S)
_SPACES = {chr(i) for i in range(0x3001) if chr(i).isspace()}


class Vocabularies(NamedTuple):
    """What tasks need to build the tokenizers: A's JSON, B's model, their ids'
    bytes, and whether A's ids are in order of its merges."""
    json_a: str
    model_b: bytes
    bytes_a: list[bytes]
    bytes_b: list[bytes]
    ranked: bool


def read_vocabularies(path_a: str, path_b: str) -> Vocabularies:
    """Read a byte-level BPE (JSON) and a piece BPE with byte fallback on the
    driver; tasks get their contents, not the paths."""
    import sentencepiece

    with open(path_a, encoding="utf-8") as f:
        json_a = f.read()
    with open(path_b, "rb") as f:
        model_b = f.read()
    model = json.loads(json_a)["model"]
    bytes_a = [b""] * (1 + max(model["vocab"].values()))
    for piece, i in model["vocab"].items():
        bytes_a[i] = bytes(_NAMED[c] for c in piece)
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ranked = all(model["vocab"]["".join(m)] == 256 + i for i, m in enumerate(merges))
    b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
    bytes_b = []
    for i in range(b.get_piece_size()):
        piece = b.id_to_piece(i)
        if b.is_control(i) or b.is_unknown(i):
            bytes_b.append(b"")
        elif b.is_byte(i):
            bytes_b.append(bytes([int(piece[3:5], 16)]))
        else:
            bytes_b.append(piece.replace("▁", " ").encode())
    split = json.loads(json_a)["pre_tokenizer"] or {}
    if split.get("type") != "ByteLevel" or not split.get("use_regex") or any(
            re.search(r"[^\s▁]▁", b.id_to_piece(i)) for i in range(b.get_piece_size())):
        raise ValueError("a token may reach over the start of a word: units can't be tokenized alone")
    return Vocabularies(json_a, model_b, bytes_a, bytes_b, ranked)


def units_of(text: str) -> list[str]:
    """The units of space + text, each without its leading space."""
    units = text.split(" ")
    if "" not in units and _SPACES.isdisjoint(map(itemgetter(-1), units[:-1])):
        return units
    whole = " " + text
    cuts = [0, *(m.start() for m in _CUT.finditer(whole)), len(whole)]
    return [whole[a + 1:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def encoder_of(v: Vocabularies) -> Encoder:
    return kept("encoder", (v.json_a, v.model_b), lambda: Encoder(v))


class Tokens(NamedTuple):
    """Tokens of units in a row: ids and byte ends of A and B, and the ends of
    the units. ``bad`` units have none."""
    a: np.ndarray
    ends_a: np.ndarray
    b: np.ndarray
    ends_b: np.ndarray
    unit_ends: np.ndarray
    bad: list[int]


class Encoder:
    """Both tokenizers, in one task."""

    def __init__(self, v: Vocabularies):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.v = v
        self.slow = None
        self.make = lambda: Tokenizer.from_str(v.json_a)
        # The same merges in the same order, several times as fast.
        special = {t["id"] for t in json.loads(v.json_a)["added_tokens"]}
        ranks = {p: i for i, p in enumerate(v.bytes_a) if p and i not in special}
        self.fast = tiktoken.Encoding("a", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks,
                                      special_tokens={}) if v.ranked else None
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=v.model_b)
        self.size_a = np.array([len(p) for p in v.bytes_a])
        self.size_b = np.array([len(p) for p in v.bytes_b])

    def ids_a(self, text: str) -> list[int]:
        if self.fast is not None and len(text) <= FAST_CHARS:
            return self.fast.encode_ordinary(text)
        if self.slow is None:
            self.slow = self.make()
            self.slow.encode_special_tokens = True
        return self.slow.encode(text, add_special_tokens=False).ids

    def call(self, units: list[str]) -> tuple[list[int], list[int]] | None:
        """Ids of units joined by spaces; None if the bytes are not given back."""
        text = " ".join(units)
        a, b = self.ids_a(" " + text), self.pieces.encode(text)
        raw = b" " + text.encode()
        if b"".join(map(self.v.bytes_a.__getitem__, a)) == raw == b"".join(map(self.v.bytes_b.__getitem__, b)):
            return a, b
        return None

    def tokens(self, units: list[str]) -> Tokens:
        """Tokenize units, some hundred joined for one call where they may be."""
        a: list[int] = []
        b: list[int] = []
        bad: list[int] = []
        # A unit that is long, or ends in white space, is the last of its call.
        alone = [i + 1 for i, u in enumerate(units) if len(u) > 256 or u[-1:].isspace()]
        alone += range(CALL, len(units) + CALL, CALL)
        at = 0
        for to in sorted(set(alone)):
            to = min(to, len(units))
            if to == at:
                continue
            got = self.call(units[at:to])
            if got is None and to - at > 1:
                singles = [self.call([u]) for u in units[at:to]]
                bad += [at + i for i, x in enumerate(singles) if x is None]
                got = [i for x in singles if x for i in x[0]], [i for x in singles if x for i in x[1]]
            elif got is None:
                bad.append(at)
                got = [], []
            a += got[0]
            b += got[1]
            at = to
        sizes = np.array([len(u.encode()) + 1 for u in units], np.int64)
        sizes[bad] = 0
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        return Tokens(ids_a, np.cumsum(self.size_a[ids_a]), ids_b, np.cumsum(self.size_b[ids_b]),
                      np.cumsum(sizes), bad)


def _merged(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two rising arrays in one, and whether the next value is the same."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return both, np.append(both[1:] == both[:-1], False)


def links_of(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(id pair packed in 64 bits, byte end of the overlap) of all links: two
    tokens overlap in one stretch between neighbouring token ends."""
    both, twice = _merged(t.ends_a, t.ends_b)
    ends = both[~twice]
    pair = t.a[np.searchsorted(t.ends_a, ends)] << 32 | t.b[np.searchsorted(t.ends_b, ends)]
    return pair, ends


def groups_of(t: Tokens) -> tuple[list[str], np.ndarray]:
    """Groups as ``a1,a2|b1`` and their byte ends."""
    both, twice = _merged(t.ends_a, t.ends_b)
    common = both[twice]
    stop_a = (np.searchsorted(t.ends_a, common) + 1).tolist()
    stop_b = (np.searchsorted(t.ends_b, common) + 1).tolist()
    a, b = list(map(str, t.a.tolist())), list(map(str, t.b.tolist()))
    out, la, lb = [], 0, 0
    for ha, hb in zip(stop_a, stop_b, strict=True):
        left = a[la] if ha - la == 1 else ",".join(a[la:ha])
        right = b[lb] if hb - lb == 1 else ",".join(b[lb:hb])
        out.append(f"{left}|{right}")
        la, lb = ha, hb
    return out, common


def kept(name: str, key, make):
    """What ``make`` gives, kept by the Python worker for its next tasks of the
    same ``key``; one thing a name."""
    store = sys.modules.setdefault("bazaar_worker_cache", types.ModuleType("bazaar_worker_cache")).__dict__
    if store.get(name, (None,))[0] != key:
        store.pop(name, None)
        store[name] = key, make()
    return store[name][1]


class Lexicon:
    """What a Python worker remembers of units, by number: tokens, groups and
    links (``numbers``: n_a, n_b, n_groups, n_links, whether not given back),
    the groups' texts, and the packed pairs of its links from ``start`` on.
    Beyond ``MEMO`` units it forgets the half seen least often."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.numbers = np.zeros((0, 5), np.int64)
        self.start = np.zeros(1, np.int64)
        self.pairs = np.zeros(0, np.int64)
        self.seen = np.zeros(0, np.int64)

    def forget(self) -> None:
        least = np.partition(self.seen, len(self.seen) // 2)[len(self.seen) // 2] if len(self.seen) else 0
        often = self.seen > least
        stay = np.flatnonzero(often)
        self.number = {u: i for i, u in enumerate(u for u, s in zip(list(self.number), often.tolist(), strict=True) if s)}
        self.groups = [self.groups[i] for i in stay.tolist()]
        n = self.start[stay + 1] - self.start[stay]
        self.pairs = self.pairs[spread(self.start[stay], n)]
        self.start = np.concatenate([[0], np.cumsum(n)])
        self.numbers, self.seen = self.numbers[stay], self.seen[stay] // 2

    def add(self, units: list[str]) -> None:
        t = self.encoder.tokens(units)
        pair, ends = links_of(t)
        groups, common = groups_of(t)
        edges = np.concatenate([[0], t.unit_ends])
        spans = [np.searchsorted(x, edges, "right") for x in (t.ends_a, t.ends_b, common, ends)]
        numbers = np.zeros((len(units), 5), np.int64)
        numbers[:, :4] = np.diff(spans, axis=1).T
        numbers[t.bad, 4] = 1
        self.numbers = np.concatenate([self.numbers, numbers])
        self.seen = np.concatenate([self.seen, np.zeros(len(units), np.int64)])
        self.start = np.concatenate([self.start, self.start[-1] + spans[3][1:]])
        self.pairs = np.concatenate([self.pairs, pair])
        at = spans[2].tolist()
        self.groups += [";".join(groups[a:b]) for a, b in zip(at, at[1:], strict=False)]
        self.number.update(zip(units, range(len(self.number), len(self.number) + len(units)), strict=True))

    def of(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all units of some texts, where each text starts)."""
        wanted = set().union(*texts)
        new = wanted.difference(self.number)
        if len(self.number) + len(new) > MEMO:
            self.forget()
            new = wanted.difference(self.number)
        if new:
            self.add(list(new))
        flat = np.fromiter(map(self.number.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))
        self.seen += np.bincount(flat, minlength=len(self.seen))
        return flat, np.concatenate([[0], np.cumsum([len(u) for u in texts])])


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n numbers from each start on, end to end."""
    return np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)


def totals(numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of rows between starts, also where there are none."""
    run = np.concatenate([np.zeros((1, numbers.shape[1]), np.int64), np.cumsum(numbers, axis=0)])
    return run[starts[1:]] - run[starts[:-1]]


# --- the fragment monoid ---------------------------------------------------

class Fragment(NamedTuple):
    """Tokens are (id, byte start, byte end). Without a common end all tokens
    are in the prefix and ``closed`` is false. ``ok`` is false if a part of the
    text was not given back."""
    ok: bool
    closed: bool
    prefix_a: list
    prefix_b: list
    n_a: int
    n_b: int
    groups: list
    links: Counter
    suffix_a: list
    suffix_b: list


def _group(a: list, b: list) -> tuple[str, list[int]]:
    """A closed group's text and its links."""
    links, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        links.append(a[i][0] << 32 | b[j][0])
        end_a, end_b = a[i][2], b[j][2]
        i += end_a <= end_b
        j += end_b <= end_a
    return ",".join(str(x[0]) for x in a) + "|" + ",".join(str(x[0]) for x in b), links


def fragment(a: list, b: list, ok: bool = True) -> Fragment:
    """The fragment of the tokens that end in one byte range."""
    common = sorted({x[2] for x in a} & {x[2] for x in b})
    if not common:
        return Fragment(ok, False, a, b, 0, 0, [], Counter(), [], [])
    parts, ia, ib = [], 0, 0
    for end in common:
        ja, jb = ia, ib
        while ja < len(a) and a[ja][2] <= end:
            ja += 1
        while jb < len(b) and b[jb][2] <= end:
            jb += 1
        parts.append((a[ia:ja], b[ib:jb]))
        ia, ib = ja, jb
    groups, links = [], Counter()
    for x, y in parts[1:]:
        text, pairs = _group(x, y)
        groups.append(text)
        links.update(pairs)
    return Fragment(ok, True, *parts[0], sum(len(x) for x, _ in parts[1:]), sum(len(y) for _, y in parts[1:]),
                    groups, links, a[ia:], b[ib:])


EMPTY = Fragment(True, False, [], [], 0, 0, [], Counter(), [], [])


def compose(x: Fragment, y: Fragment) -> Fragment:
    """Two neighbouring fragments as one; associative, ``EMPTY`` is neutral."""
    ok = x.ok and y.ok
    if not x.closed:
        return y._replace(ok=ok, prefix_a=x.prefix_a + y.prefix_a, prefix_b=x.prefix_b + y.prefix_b)
    if not y.closed:
        return x._replace(ok=ok, suffix_a=x.suffix_a + y.prefix_a, suffix_b=x.suffix_b + y.prefix_b)
    a, b = x.suffix_a + y.prefix_a, x.suffix_b + y.prefix_b
    text, pairs = _group(a, b)
    links = Counter(x.links)
    links.update(pairs)
    links.update(y.links)
    return Fragment(ok, True, x.prefix_a, x.prefix_b, x.n_a + len(a) + y.n_a, x.n_b + len(b) + y.n_b,
                    [*x.groups, text, *y.groups], links, y.suffix_a, y.suffix_b)


class Aligned(NamedTuple):
    n_a: int
    n_b: int
    n_groups: int
    groups: str
    links: Counter


NOTHING = Aligned(0, 0, 0, "", Counter())


def whole(x: Fragment) -> Aligned:
    """A whole text's fragment: its prefix starts at byte 0, so it is a group."""
    if not x.ok or not x.closed or x.suffix_a or x.suffix_b:
        return NOTHING
    text, pairs = _group(x.prefix_a, x.prefix_b)
    links = Counter(x.links)
    links.update(pairs)
    return Aligned(x.n_a + len(x.prefix_a), x.n_b + len(x.prefix_b), len(x.groups) + 1,
                   ";".join([text, *x.groups]), links)


# --- tasks -----------------------------------------------------------------

def few_rows(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches, so many rows at a time: what Python makes of them is
    held for those alone."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_TOKEN = "array<struct<id:int,lo:long,hi:long>>"
_FRAGMENT = (f"row long, lo long, ok boolean, closed boolean, prefix_a {_TOKEN}, prefix_b {_TOKEN}, n_a long, n_b long,"
             f" groups array<string>, pairs array<long>, times array<long>, suffix_a {_TOKEN}, suffix_b {_TOKEN}")
_ARROW_TOKEN = pa.list_(pa.struct([("id", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64())]))
_FRAGMENT_SCHEMA = pa.schema([
    ("row", pa.int64()), ("lo", pa.int64()), ("ok", pa.bool_()), ("closed", pa.bool_()), ("prefix_a", _ARROW_TOKEN),
    ("prefix_b", _ARROW_TOKEN), ("n_a", pa.int64()), ("n_b", pa.int64()), ("groups", pa.list_(pa.string())),
    ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())), ("suffix_a", _ARROW_TOKEN),
    ("suffix_b", _ARROW_TOKEN)])
_LINKS = "array<struct<pair:long,n:long>>"
_ARROW_LINKS = pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int64())]))


def _packed(row: int, lo: int, x: Fragment) -> dict:
    token = lambda xs: [{"id": i, "lo": a, "hi": b} for i, a, b in xs]
    return {"row": row, "lo": lo, "ok": x.ok, "closed": x.closed, "prefix_a": token(x.prefix_a),
            "prefix_b": token(x.prefix_b), "n_a": x.n_a, "n_b": x.n_b, "groups": x.groups, "pairs": list(x.links),
            "times": list(x.links.values()), "suffix_a": token(x.suffix_a), "suffix_b": token(x.suffix_b)}


def _unpacked(r: dict) -> Fragment:
    token = lambda xs: [(t["id"], t["lo"], t["hi"]) for t in xs]
    return Fragment(r["ok"], r["closed"], token(r["prefix_a"]), token(r["prefix_b"]), r["n_a"], r["n_b"], r["groups"],
                    Counter(dict(zip(r["pairs"], r["times"], strict=True))), token(r["suffix_a"]), token(r["suffix_b"]))


def cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Long texts as pieces of whole units of about PIECE bytes, each with the
    byte where it starts in space + text."""
    for batch in batches:
        for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
            units, at, lo, size, start = units_of(text), 0, 0, 0, 0
            for i, u in enumerate(units):
                size += len(u.encode()) + 1
                if size >= PIECE or i + 1 == len(units):
                    yield pa.RecordBatch.from_pydict({"row": [row], "lo": [lo], "units": [units[at:i + 1]]})
                    at, start, size = i + 1, start + size, 0
                    lo = start


def piece_fragments(v: Vocabularies):
    def run(batches):
        encoder = encoder_of(v)
        for batch in few_rows(batches, 1):
            for r in batch.to_pylist():
                t = encoder.tokens(r["units"])
                sides = []
                for ids, ends in ((t.a, t.ends_a), (t.b, t.ends_b)):
                    ends = ends + r["lo"]
                    starts = np.concatenate([[r["lo"]], ends[:-1]])
                    # A token belongs to the byte range that its last byte is in.
                    sides.append((list(zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True)),
                                  (ends - 1) // RANGE))
                rows = []
                for k in np.union1d(sides[0][1], sides[1][1]).tolist() or [r["lo"] // RANGE]:
                    a, b = (tokens[np.searchsorted(of, k):np.searchsorted(of, k, "right")] for tokens, of in sides)
                    rows.append(_packed(r["row"], max(r["lo"], k * RANGE), fragment(a, b, not t.bad)))
                yield from pa.Table.from_pylist(rows, _FRAGMENT_SCHEMA).to_batches()
    return run


def compose_rows(table: pa.Table) -> pa.Table:
    """The fragments of one stretch of one text, in order, as one."""
    rows = sorted(table.to_pylist(), key=lambda r: r["lo"])
    out = EMPTY
    for r in rows:
        out = compose(out, _unpacked(r))
    return pa.Table.from_pylist([_packed(rows[0]["row"], rows[0]["lo"], out)], _FRAGMENT_SCHEMA)


def _finish(batches):
    for batch in few_rows(batches, 1):
        rows = []
        for r in batch.to_pylist():
            x = whole(_unpacked(r))
            rows.append({"row": r["row"], "n_a": x.n_a, "n_b": x.n_b, "n_groups": x.n_groups, "groups": x.groups,
                         "links": [{"pair": p, "n": n} for p, n in x.links.items()]})
        yield from pa.Table.from_pylist(rows, pa.schema([
            ("row", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
            ("groups", pa.string()), ("links", _ARROW_LINKS)])).to_batches()


def align_long(texts: DataFrame, v: Vocabularies) -> DataFrame:
    """Alignment of long texts (row, text): pieces are tokenized by as many
    tasks as there are, their fragments composed by a tree. Columns: row, n_a,
    n_b, n_groups, groups, links (pair, n)."""
    pieces = stage(texts.mapInArrow(cut_pieces, "row long, lo long, units array<string>"), "align-pieces")
    parts = stage(pieces.repartition("row", "lo").mapInArrow(piece_fragments(v), _FRAGMENT), "align-fragments")
    last, width = parts.agg(F.max("lo")).first()[0], RANGE
    while last is not None and last >= width:
        width *= FAN
        parts = stage(parts.groupBy("row", F.floor(F.col("lo") / width)).applyInArrow(
            compose_rows, _FRAGMENT), "align-fragments")
    return stage(parts.mapInArrow(
        _finish, f"row long, n_a long, n_b long, n_groups long, groups string, links {_LINKS}"), "align-long")


def align_short(v: Vocabularies):
    """Task over (id, text) of texts of one fragment: id, n_a, n_b, n_groups,
    groups and links."""
    def run(batches):
        known = kept("lexicon", (v.json_a, v.model_b), lambda: Lexicon(encoder_of(v)))
        size_b = len(v.bytes_b)
        every = len(v.bytes_a) * size_b
        for batch in few_rows(batches):
            texts = [units_of(t) if t else [] for t in batch.column("text").to_pylist()]
            flat, starts = known.of(texts)
            sums = totals(known.numbers[flat], starts)
            bad = sums[:, 4] > 0
            sums[bad] = 0
            edges, order = starts.tolist(), flat.tolist()
            get = known.groups.__getitem__
            groups = ["" if no else ";".join(map(get, order[a:b]))
                      for a, b, no in zip(edges, edges[1:], bad.tolist(), strict=False)]
            # Pairs of all texts at once, packed closer, so that the text fits in.
            text = np.repeat(np.arange(len(texts)), np.diff(starts))
            text, unit = text[~bad[text]], flat[~bad[text]]
            n = known.start[unit + 1] - known.start[unit]
            pair = known.pairs[spread(known.start[unit], n)]
            pair = (pair >> 32) * size_b + (pair & 0xFFFFFFFF)
            pair, times = np.unique(np.repeat(text, n) * every + pair, return_counts=True)
            stops = np.searchsorted(pair, np.arange(len(texts) + 1) * every).astype(np.int32)
            pair %= every
            links = pa.StructArray.from_arrays([pa.array(pair // size_b << 32 | pair % size_b), pa.array(times)], ["pair", "n"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(sums[:, k]) for k in range(3)), pa.array(groups, pa.string()),
                 pa.ListArray.from_arrays(pa.array(stops), links)], names=["id", *_NUMBERS, "groups", "links"])
    return run


_NUMBERS, _SCORES = ["n_a", "n_b", "n_groups"], ["n_links", "n_best", "count_sum"]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, text) of texts of one fragment; (row, id, text) of longer ones."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    long = F.coalesce(F.octet_length("text") > PIECE, F.lit(False))
    # Staged, so that the numbers of the rows stay.
    return rows.where(~long), stage(rows.where(long).withColumn("row", F.monotonically_increasing_id()), "align-texts")


def align(docs: DataFrame, v: Vocabularies, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b, n_groups, groups (``a1,a2|b1;a3|b2,b3``)
    and links (distinct id pairs ``a << 32 | b``, with their number)."""
    short, long = _texts(docs, id_col, text_col)
    done = align_long(long.select("row", "text"), v).join(long.select("row", "id"), "row")
    kind = short.schema["id"].dataType.simpleString()
    near = short.mapInArrow(align_short(v), f"id {kind}, n_a long, n_b long, n_groups long, groups string, links {_LINKS}")
    return near.unionByName(done.drop("row")).withColumnRenamed("id", id_col)


def agreement(aligned: DataFrame, pairs_limit: int = PAIRS_LIMIT) -> DataFrame:
    """``aligned`` (its links, and any other columns; staged) plus n_links,
    n_best (links whose pair no other pair of its A id beats in texts) and
    count_sum (texts that hold the pair, over the links), without the links."""
    rows = stage(aligned.withColumn("row", F.monotonically_increasing_id()), "align-rows")
    # A text has a pair once, so rows are texts.
    pairs = stage(rows.select(F.inline("links")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs")), "align-pairs")
    top = pairs.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("top"))
    counts = stage(pairs.join(top, F.shiftright("pair", 32) == F.col("a")).select(
        "pair", "docs", (F.col("docs") == F.col("top")).alias("best")), "align-counts")
    if counts.count() <= pairs_limit:
        counts = F.broadcast(counts)
    scores = rows.select("row", F.inline("links")).join(counts, "pair").groupBy("row").agg(
        F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
        F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
    return rows.drop("links").join(scores, "row", "left").drop("row").fillna(0, _SCORES)


def digest_columns(aligned: DataFrame) -> DataFrame:
    """``align`` with the groups as their SHA-256 (empty without tokens)."""
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return aligned.withColumn("groups_sha256", digest).drop("groups")
