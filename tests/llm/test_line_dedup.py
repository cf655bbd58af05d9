from collections import defaultdict

from pyspark.sql import functions as F

from bazaar.llm.line_dedup import drop_boilerplate, drop_boilerplate_lines, host_of
from tests.llm.conftest import SCHEMA, prose

ENDS = " \t\r\x0b\x0c"


def brute(rows, ratio, least, copies=True):
    pages = [(r.source, r.text) for r in rows if r.text is not None]
    if not copies:
        pages = set(pages)
    total, held = defaultdict(int), defaultdict(int)
    for host, text in pages:
        total[host] += 1
        for line in {x.strip(ENDS) for x in text.split("\n")} - {""}:
            held[host, line] += 1
    bad = {k for k, n in held.items() if n >= least and n > ratio * total[k[0]]}
    out = []
    for r in rows:
        lines = [] if r.text is None else r.text.split("\n")
        keep = [x for x in lines if (r.source, x.strip(ENDS)) not in bad]
        out.append((r.doc_id, len(lines), len(lines) - len(keep), None if r.text is None else "\n".join(keep)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r._lines_in, r._lines_dropped, r.text) for r in df.collect()), key=str)


def test_matches_brute_force(spark, rng):
    common = [prose(rng, 4) for _ in range(5)]
    rows = []
    for i in range(300):
        lines = [prose(rng, 3) for _ in range(rng.randrange(1, 5))]
        lines += [rng.choice(["", " "]) + c for c in common if rng.random() < 0.15]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), "en", rng.choice(["hot"] * 5 + ["b", None]), 1))
    rows += [(1000 + i, rows[0][1], "en", "hot", 1) for i in range(60)]      # mirrored pages
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for copies in (True, False):
        got[copies] = rows_of(drop_boilerplate(df, max_ratio=0.1, min_pages=3, copies=copies))
        assert got[copies] == brute(df.collect(), 0.1, 3, copies)
        assert any(r[2] for r in got[copies])
    # Where copies count once, a mirrored page keeps its own lines.
    assert sum(r[2] for r in got[True]) > sum(r[2] for r in got[False])


def test_edge_rows(edge_docs, clashing, no_docs):
    want = brute(edge_docs.collect(), 0.3, 1)
    assert rows_of(drop_boilerplate(edge_docs, max_ratio=0.3, min_pages=1)) == want
    out = drop_boilerplate(clashing, max_ratio=0.3, min_pages=1)
    assert rows_of(out) == want and {r.key for r in out.collect()} == {"clash"}
    assert drop_boilerplate(no_docs).collect() == []
    assert drop_boilerplate_lines(clashing).columns == clashing.columns
    helpers = ("_host", "_boilerplate", "_stays", "_lines_in", "_lines_dropped", "host", "page", "pages", "line")
    more = clashing.drop("host").withColumns({c: F.lit("mine") for c in helpers})
    out = drop_boilerplate_lines(more)
    assert out.columns == more.columns
    assert {tuple(r[c] for c in helpers) for r in out.collect()} == {("mine",) * len(helpers)}


def test_host_of(spark):
    urls = ["https://User@WWW.Example.org:80/a?b", "ftp://x/y", "no address", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(host_of(F.col("u")).alias("h"))
    assert [r.h for r in df.collect()] == ["www.example.org", "x", "", None]


def test_small_hosts_are_cleaned(spark, rng):
    rows = [(n * 1000 + i, "\n".join([prose(rng, 9), "all over"] + ["on some"] * (i < 3) + ["on nine"] * (i < 9)),
             "en", f"host{n}", 1) for n in (1, 2, 3, 5, 9, 40, 70, 100) for i in range(n)]
    for r in drop_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect():
        pages, i, lines = int(r.source[4:]), r.doc_id % 1000, r.text.split("\n")
        assert ("all over" in lines) == (pages < 3), r
        assert ("on some" in lines) == (i < 3 and (pages < 3 or pages > 60)), r
        assert ("on nine" in lines) == (i < 9 and pages < 3), r
