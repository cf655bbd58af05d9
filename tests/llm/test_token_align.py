import hashlib
from collections import Counter, defaultdict
from functools import reduce

import pytest

from bazaar.llm import token_align as T
from bazaar.llm.queries import op13_token_align

PATHS = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
EDGES = ["", " ", "  ", "a", " a", "a ", "a  b", "a\n b\n\n  c", "\ta\x1cb", "\x00 \x00a", "▁ x", "a▁b", "<s> <0x41> </s>",
         "<|endoftext|>x", "日本語 テキスト です", "é ü ﬁ  🙂🙂 x", "x" * 9000, "foo" + " " * 3000 + "bar", "　   a  b",
         "don't we'll  it's 12345 67.8 !!! ...", "a\r\n b", "  x\u0085 y"]


@pytest.fixture(scope="module")
def vocabularies():
    return T.read_vocabularies(*PATHS)


def plain_tokens(texts):
    """Both token streams of whole texts, by the tokenizers alone."""
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    named = {n: bytes([x]) for n, x in T._NAMED.items()}
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        ta = [(i, b"".join(named[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        tb = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            tb.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        raw = (" " + text).encode()
        out.append((ta, tb) if b"".join(x for _, x in ta) == raw == b"".join(x for _, x in tb) else None)
    return out


def brute(rows):
    """Contract rows by comparing every token with every other of its text."""
    streams, texts = plain_tokens([t for _, t in rows]), []
    for s in streams:
        spans = []
        for side in s or ((), ()):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        a, b = spans
        common = sorted({x[2] for x in a} & {x[2] for x in b})
        groups, last = [], 0
        for c in common:
            groups.append(",".join(str(x[0]) for x in a if last < x[2] <= c) + "|"
                          + ",".join(str(x[0]) for x in b if last < x[2] <= c))
            last = c
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        texts.append((a, b, groups, links))
    held = Counter(p for *_, links in texts for p in set(links))
    top = defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    return [(i, len(a), len(b), len(g), len(k), sum(held[p] == top[p[0]] for p in k), sum(held[p] for p in k),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
            for (i, _), (a, b, g, k) in zip(rows, texts, strict=True)]


def result(df, v, **kw):
    out = T.agreement(T.digest_columns(T.align(df, v)), **kw).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r) for r in out.collect()), key=str)


def small_docs(spark):
    rows = [(i, t) for i, t in enumerate(EDGES)] + [(None, "the cat"), (3, "the cat"), (3, "the cat"), (50, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_edges_match_brute_force(spark, vocabularies):
    rows, df = small_docs(spark)
    assert result(df, vocabularies) == sorted(brute(rows), key=str)


def test_long_texts_by_the_tree_and_pairs_by_a_join(spark, vocabularies, rng, monkeypatch):
    words = ["the", "cat", "pneumono", "Straße", "x1", "naïve", "日本", "\n", "", "it's", "<s>", "z" * 60]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 200, 900])))) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute(rows), key=str)
    assert result(df, vocabularies) == want
    assert result(df, vocabularies, pairs_limit=1) == want
    # Byte ranges of a few tokens and trees of many levels.
    for name, value in (("PIECE", 150), ("RANGE", 7), ("FAN", 3)):
        monkeypatch.setattr(T, name, value)
    assert result(df, vocabularies) == want


def test_fragments_compose_in_any_order(vocabularies, rng):
    encoder = T.Encoder(vocabularies)
    text = "Straßenbahn naïve 日本語 <0x41>  unbelievable\n\n antidisestablishmentarianism " * 3
    t = encoder.tokens(T.units_of(text))
    a, b = ([(int(i), int(e - n), int(e)) for i, e, n in zip(ids, ends, size[ids], strict=True)]
            for ids, ends, size in ((t.a, t.ends_a, encoder.size_a), (t.b, t.ends_b, encoder.size_b)))
    want = T.whole(T.fragment(a, b))
    assert want.n_a == len(a) and want.n_b == len(b)
    opened = 0
    for _ in range(50):
        cuts = sorted(rng.sample(range(1, len(text.encode())), 9))
        edges = [0, *cuts, 10**9]
        xs = [T.fragment([x for x in a if lo < x[2] <= hi], [x for x in b if lo < x[2] <= hi])
              for lo, hi in zip(edges, edges[1:], strict=False)]
        opened += sum(not x.closed or bool(x.suffix_a) for x in xs)
        assert T.whole(reduce(T.compose, xs)) == want
        while len(xs) > 1:
            i = rng.randrange(len(xs) - 1)
            xs[i:i + 2] = [T.compose(xs[i], xs[i + 1])]
        assert T.whole(xs[0]) == want
    assert opened > 30


def test_alignment_gives_the_text_back(spark, vocabularies):
    rows, df = small_docs(spark)
    got = {(r.doc_id, r.groups): r for r in T.align(df, vocabularies).collect()}
    texts = {(" " + t).encode() for _, t in rows if t}
    backs = 0
    for (_, groups), r in got.items():
        ids = [g.split("|") for g in groups.split(";")] if groups else []
        back = b"".join(vocabularies.bytes_a[int(i)] for g in ids for i in g[0].split(","))
        assert back == b"".join(vocabularies.bytes_b[int(i)] for g in ids for i in g[1].split(","))
        assert not groups or back in texts
        assert sum(x.n for x in r.links) >= max(r.n_a, r.n_b)
        backs += bool(groups)
    assert backs > 15


def test_empty_clashing_and_more_edges(spark, vocabularies, no_docs, edge_docs, clashing):
    assert result(no_docs, vocabularies) == []
    want = result(edge_docs, vocabularies)
    assert len(want) == edge_docs.count()
    assert result(clashing, vocabularies) == want


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows = [(i, t) for i, t in rows]
    got = {r.doc_id: r for r in op13_token_align(spark, "/root/testdata/sf0.001").collect()}
    short = [(i, t) for i, t in rows if len(t or "") < 800]
    want = {w[0]: w for w in brute(short)}
    assert len(got) == len(rows) and len(want) > 20
    for i, w in want.items():
        r = got[i]
        # Numbers of the text alone; the corpus-wide counts are held against the small tables above.
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == (*w[1:5], w[7])
