"""Secret scans: fixed patterns plus windowed entropy, in DataFrame functions only.

Base kinds are regular expressions (leftmost, non-overlapping per kind). The
entropy kinds take candidate strings of one character class, slide a window
over each, and keep the Shannon entropy of the window by incremental counts:
when a character enters or leaves, only the terms of that character change.
A candidate whose best window reaches the class's threshold is a span, unless
the allow-list knows it. Allow-listing never removes a base span.

Defined cases: null text counts as empty; repeated rows give repeated results;
an empty table gives an empty result; texts are scanned whole; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base patterns, in listing order.
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
ASSIGN_MIN, ACCESS_MIN = 12, 18

# Entropy classes: name, candidate pattern, window, bits a character.
CLASSES = (
    ("entropy_hex", r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{20,}(?![0-9A-Za-z])", 20, 3.0),
    ("entropy_base64", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}", 20, 3.6),
)
# Candidates known to be harmless.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example",
    r"(?i)placeholder",
    r"(?i)^(?:0123456789abcdef)+[0-9a-f]*$",
    r"(?i)abcdefghijklmnop",
    r"^[a-z]+(?:[_-][a-z0-9]+){2,}$",
)

KIND_ORDER = ("assign", "access", "hex", *(c[0] for c in CLASSES))
#: Spans gathered at a time, so that a text with very many matches stays linear.
BLOCK = 256
SPAN = "array<struct<start:int,ord:int,kind:string,end:int,found:string>>"


def match_spans(text: Column, pattern: str, kind: str) -> Column:
    """All matches of ``pattern`` as structs (start, ord, kind, end, found),
    in code points. Splitting at the matches gives what lies between them, so
    running sums of piece and match lengths are the positions."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    order = F.lit(KIND_ORDER.index(kind))
    empty = F.array().cast(SPAN)
    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        block = F.concat(acc["block"], F.array(F.struct(
            start.alias("start"), order.alias("ord"), F.lit(kind).alias("kind"),
            end.alias("end"), x["m"].alias("found"))))
        full = F.size(block) >= BLOCK
        return F.struct(
            end.alias("at"), F.when(full, empty).otherwise(block).alias("block"),
            F.when(full, F.concat(acc["done"], F.array(block))).otherwise(acc["done"]).alias("done"))

    folded = F.aggregate(
        F.arrays_zip(found.alias("m"), F.slice(pieces, F.lit(1), F.size(found)).alias("p")),
        F.struct(F.lit(0).alias("at"), empty.alias("block"),
                 F.array().cast(f"array<{SPAN}>").alias("done")),
        step, lambda acc: F.concat(F.flatten(acc["done"]), acc["block"]))
    return F.when(F.rlike(text, F.lit(pattern)), folded).otherwise(empty)


def _nlogn(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n)).otherwise(F.lit(0.0))


def window_entropy(s: Column, window: int) -> Column:
    """The highest Shannon entropy (bits a character) of any ``window``
    consecutive characters of ``s``. With n the count of a character in the
    window, the state is the sum of n*log2(n), updated by the terms of the
    entering and the leaving character alone."""
    def count_in(w: Column, c: Column) -> Column:
        return (F.length(w) - F.length(F.replace(w, c, F.lit("")))).cast("double")

    def step(acc: Column, c: Column) -> Column:
        w = acc["window"]
        leaves = F.when(F.length(w) >= window, F.substring(w, 1, 1)).otherwise(F.lit(""))
        rest = F.when(F.length(w) >= window, F.substring(w, 2, window)).otherwise(w)
        n_out, n_in = count_in(w, leaves), count_in(rest, c)
        total = acc["sum"] - (_nlogn(n_out) - _nlogn(n_out - 1)) + _nlogn(n_in + 1) - _nlogn(n_in)
        now = F.concat(rest, c)
        full = F.when(F.length(now) >= window, F.log2(F.lit(float(window))) - total / window)
        return F.struct(now.alias("window"), total.alias("sum"),
                        F.greatest(acc["best"], full).alias("best"))

    return F.aggregate(F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0)),
                       F.struct(F.lit("").alias("window"), F.lit(0.0).alias("sum"),
                                F.lit(0.0).alias("best")), step, lambda acc: acc["best"])


def entropy_spans(text: Column, kind: str, pattern: str, window: int, bits: float) -> Column:
    def keep(x: Column) -> Column:
        allowed = F.lit(False)
        for a in ALLOW:
            allowed = allowed | F.rlike(x["found"], F.lit(a))
        return ~allowed & (window_entropy(x["found"], window) >= bits)

    return F.filter(match_spans(text, pattern, kind), keep)


def secret_spans(text: Column) -> tuple[Column, Column, Column, Column]:
    """Spans by kind: assign, access, hex, and all entropy kinds together."""
    assign = F.filter(match_spans(text, ASSIGN, "assign"), lambda x: F.length(
        F.regexp_extract(x["found"], ASSIGN, 2)) >= ASSIGN_MIN)
    access = F.filter(match_spans(text, ACCESS, "access"),
                      lambda x: F.length(x["found"]) >= ACCESS_MIN)
    hexes = match_spans(text, HEX, "hex")
    entropy = F.concat(*[entropy_spans(text, *c) for c in CLASSES])
    return assign, access, hexes, entropy


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col`` and the arrays assign, access, hex,
    entropy of spans (start, ord, kind, end, found), by start. A map over the
    rows: no shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign, access, hexes, entropy = secret_spans(F.col("_text"))
    return docs.select(F.col(id_col), text.alias("_text")).select(
        id_col, assign.alias("assign"), access.alias("access"), hexes.alias("hex"),
        entropy.alias("entropy"))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
