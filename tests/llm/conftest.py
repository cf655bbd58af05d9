import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of other meanings under names that the operators use inside.
CLASHES = ("id", "size", "n", "node", "bits", "row", "rank", "key", "host", "word", "text_key", "keep_id",
           "target", "token", "label", "cls", "sha", "kept", "score", "_key", "hit", "digest", "need")

VOCAB = [a + b for a in ("ba", "de", "ki", "lo", "mu", "na", "po", "ri", "sa", "te") for b in
         ("ran", "sel", "tim", "vor", "wex", "yal", "zod", "qui", "fen", "gul")]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def edge_rows(rng):
    """Nulls in every column, empty and blank and very long texts, ties and
    repeated rows."""
    long = prose(rng, 30_000)
    one = prose(rng, 12)
    return [
        (None, one, "en", "a", 1), (1000, None, "en", "a", None), (1001, "", None, None, 0),
        (1002, " \t\n\x0b ", "en", "b", 5), (1003, long, "en", "b", len(long)),
        (1004, one, "en", None, 1), (1004, one, "en", None, 1), (1005, one.replace(" ", "  \n"), "en", "b", 2),
        (1006, "word", "en", "a", 4), (1007, "x" * 50_000, "en", "c", 50_000),
        (1008, "Ünï cödé ✓ K İ ſ text", "de", "ü", 3), (None, None, None, None, None),
    ]


@pytest.fixture()
def rng():
    return random.Random(5)


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(edge_rows(random.Random(3)), SCHEMA)


@pytest.fixture(scope="session")
def clashing(edge_docs):
    return edge_docs.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
