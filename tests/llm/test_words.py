import re

import numpy as np
import pyarrow as pa

from bazaar.llm import words
from tests.llm.conftest import edge_rows, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def test_words_agree_with_a_regular_expression(rng, monkeypatch):
    texts = [r[1] for r in edge_rows(rng)] + [prose(rng, 50) for _ in range(40)]
    for size in (64, 1 << 21):
        monkeypatch.setattr(words, "SLICE_BYTES", size)
        seen, rows = {}, 0
        for w in words.words_of(pa.array(texts)):
            assert len(w.hashes) == len(w.starts) == len(w.ends) == w.ptr[-1]
            for i in range(len(w.ptr) - 1):
                want = split(texts[w.first + i])
                lo, hi = w.ptr[i], w.ptr[i + 1]
                assert [bytes(w.data[a:b]).decode().translate(LOWER) for a, b in
                        zip(w.starts[lo:hi], w.ends[lo:hi], strict=True)] == want
                for x, h in zip(want, w.hashes[lo:hi].tolist(), strict=True):
                    assert seen.setdefault(x, h) == h
                rows += 1
        assert rows == len(texts)
        assert len(set(seen.values())) == len(seen)


def test_shingles_count_distinct_runs(rng):
    texts = [prose(rng, n) for n in (0, 1, 3, 4, 5, 6, 50)] + ["a a a a a a a a", None]
    got = {i: len(s) for w in words.words_of(pa.array(texts)) for i, s in words.shingle_rows(w, 5)}
    for i, t in enumerate(texts):
        ws = split(t)
        want = {tuple(ws[k:k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()
        assert got[i] == len(want)


def test_a_short_text_is_not_a_longer_one():
    a, b, c = (words.ngrams(np.arange(1, n + 1, dtype=np.uint64), n) for n in (3, 4, 5))
    assert len({*a.tolist(), *b.tolist(), *c.tolist()}) == 3
