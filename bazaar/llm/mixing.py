"""Mixing sources to target weights by Pareto order sampling.

Targets: sources share a budget by weight, a source's target stops at
``max_repeat`` times its size, and the excess goes to the others by weight
until none is above. Within a source each document gets an expected number
of copies, in proportion to its importance and at most ``max_repeat``, so that
the expected words meet the target. The whole part of it is certain; the rest
is an inclusion probability p, and the sample is the Pareto order sample:
documents rank by random odds over inclusion odds, (u / (1-u)) / (p / (1-p)),
and go down the rank: each one that still fits into the target's words is
taken (a sample of fixed size in words), until none of the others fits.

The random u is a hash of the id, so reruns agree. No source is ever sorted
as a whole: a histogram of the ranks, then one of the ranks inside the bin
that holds the cut, narrow the sorting down to a small share of a source. What
follows a document that does not fit is cut in the same way again, without the
documents larger than what is left, which is then less than that document.

Defined cases: null text has size 0; a null source is a source of its own;
equal ranks go by id; rows that repeat an id are documents of their own, in
the order of a hash of their text, and rows that repeat both are taken
together; sources without words take nothing; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaar.llm.scratch import stage

WORD = r"[^\x20\x09-\x0D]+"
#: Bins of a rank histogram; two levels narrow a source to 1 / BINS**2.
BINS = 4096
#: Rows that one window over them, by source, is good enough for.
FEW_ROWS = 2000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_targets(sources: DataFrame, budget: float, max_repeat: float) -> DataFrame:
    """Add ``target`` to (source, source_size, weight, ...): the budget is
    this multiple of all sizes. With sources in the order of the level at
    which they fill up (size / weight), a prefix is at its cap and the others
    share what is left; the first source for which that share fits ends the
    prefix. One row a source, so one window over them is small."""
    up = Window.orderBy(F.col("_fill"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rest = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = (sources.withColumn("_cap", F.col("source_size") * F.lit(float(max_repeat)))
          .withColumn("_fill", F.col("_cap") / F.col("weight"))
          .withColumn("_budget", F.sum("source_size").over(everything) * F.lit(float(budget)))
          .withColumn("_level", (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
                      / F.sum("weight").over(rest)))
    # The level rises along the prefix and falls after it, so the first one
    # that fits is the highest that fits.
    df = df.withColumn("_share", F.max(F.when(F.col("_level") <= F.col("_fill"), F.col("_level"))).over(everything))
    target = F.when(F.col("_share").isNull() | (F.col("_fill") < F.col("_share")), F.col("_cap")) \
        .otherwise(F.col("_share") * F.col("weight"))
    return df.withColumn("target", target).drop("_cap", "_fill", "_budget", "_level", "_share")


def expected_copies(classes: DataFrame, max_repeat: float) -> DataFrame:
    """Add ``copies`` to (source, imp, class_size, target): the expected
    copies of a document of importance ``imp``, proportional to it, capped at
    ``max_repeat``, with the class sizes' total at the target. As with the
    sources, the most important classes fill up first."""
    down = Window.partitionBy("source").orderBy(F.col("imp").desc())
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    rest = down.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy("source")
    cap = F.lit(float(max_repeat))
    df = classes.withColumn("_factor", F.try_divide(
        F.col("target") - cap * F.coalesce(F.sum("class_size").over(before), F.lit(0)),
        F.sum(F.col("class_size") * F.col("imp")).over(rest)))
    df = df.withColumn("_fits", F.max(F.when(F.col("_factor") * F.col("imp") <= cap, F.struct(
        F.col("imp").alias("imp"), F.col("_factor").alias("factor")))).over(whole))
    copies = F.when(F.col("_fits").isNull() | (F.col("imp") > F.col("_fits.imp")), cap) \
        .otherwise(F.least(cap, F.col("_fits.factor") * F.col("imp")))
    return df.withColumn("copies", F.greatest(copies, F.lit(0.0))).drop("_factor", "_fits")


def pareto_rank(id_col: str, p: Column, seed: int) -> Column:
    """Random odds over inclusion odds, mapped from (0, inf) to (0, 1) in the
    same order; 2 (never taken) where p is 0. u has 52 bits of an md5."""
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), 1, 13), 16, 10)
         .cast("double") + 0.5) / F.lit(float(2**52))
    odds, chance = u / (1 - u), p / (1 - p)
    return F.when(p <= 0, F.lit(2.0)).otherwise(odds / (odds + chance))


def _cut(ranked: DataFrame, low: str, width: float) -> DataFrame:
    """Per source, the bin of ``rank`` in which the running words reach
    ``need``: (source, bin, need): need is what is left for the bin."""
    bin_ = F.floor((F.col("rank") - F.col(low)) / F.lit(width)).cast("long")
    bins = (ranked.groupBy("source", bin_.alias("bin")).agg(
        F.sum("size").alias("words"), F.first("need").alias("need")))
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    return (bins.where((F.col("before") < F.col("need")) & (F.col("before") + F.col("words") >= F.col("need")))
            .select("source", "bin", (F.col("need") - F.col("before")).alias("left")))


def mix_sources(docs: DataFrame, weights: DataFrame, budget: float = 1.5, max_repeat: float = 2.0,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                importance: Column | None = None, seed: int = 7) -> DataFrame:
    """One row per input row: ``id_col``, size, source_size, target, copies,
    taken. ``weights`` has (source, weight); a source without a weight gets
    none of the budget. ``importance`` (a positive function of the column
    ``size``, of few distinct values) sets how copies differ within a source;
    default: 1 more for each doubling of the size, so longer documents are
    likelier."""
    if importance is None:
        importance = 1.0 + (F.length(F.bin(F.col("size") + 1)) - 1) / F.lit(8.0)
    sized = stage(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("tie"))
        .withColumn("imp", importance), "mix-sizes")
    classes = stage(sized.groupBy("source", "imp").agg(F.sum("size").alias("class_size")), "mix-classes")
    sources = classes.groupBy("source").agg(F.sum("class_size").alias("source_size"))
    w = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double"))
    sources = (sources.join(w, sources.source.eqNullSafe(w._s), "left").drop("_s")
               .withColumn("weight", F.coalesce("weight", F.lit(0.0))))
    targets = capped_targets(sources.where("weight > 0"), budget, max_repeat).select(
        F.col("source").alias("_s"), "source_size", "target")
    targets = targets.unionByName(sources.where("weight <= 0").select(
        F.col("source").alias("_s"), "source_size", F.lit(0.0).alias("target")))
    plan = stage(expected_copies(
        classes.join(targets, classes.source.eqNullSafe(targets._s)).drop("_s"), max_repeat), "mix-plan")

    p = plan.select(F.col("source").alias("_s"), F.col("imp").alias("_imp"), "source_size", "target", "copies")
    docs_ = sized.join(p, sized.source.eqNullSafe(p._s) & (sized.imp == p._imp)).drop("_s", "_imp", "imp")
    docs_ = (docs_.withColumn("whole", F.floor("copies").cast("long"))
             .withColumn("rank", pareto_rank("id", F.col("copies") - F.floor("copies"), seed)))
    whole = plan.groupBy("source").agg(F.sum(
        F.col("class_size") * (F.col("copies") - F.floor("copies"))).alias("need"))
    whole = whole.select(F.col("source").alias("_s"), "need")
    ranked = stage(docs_.join(whole, docs_.source.eqNullSafe(whole._s)).drop("_s"), "mix-ranks")

    out = _draw_whole(ranked)
    copies = F.col("whole") + F.col("drawn").cast("int")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target",
                      copies.cast("int").alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


def _cut_edges(drawn: DataFrame) -> DataFrame:
    """Per source, where the cut lies: (_s, bin1, bin2, edge). A source that
    fits as a whole has no row."""
    # First histogram: the bin that holds the cut. Second: the same inside it.
    width = 1.0 / BINS
    drawn = drawn.withColumn("_zero", F.lit(0.0))
    cut1 = stage(_cut(drawn, "_zero", width).select(
        F.col("source").alias("_s"), F.col("bin").alias("bin1"), F.col("left").alias("left1")), "mix-cut1")
    inside = drawn.drop("need").join(cut1, drawn.source.eqNullSafe(cut1._s)
                                     & (F.floor(drawn["rank"] / width) == cut1.bin1)).drop("_s")
    inside = inside.withColumn("low", F.col("bin1") * F.lit(width)).withColumnRenamed("left1", "need")
    cut2 = stage(_cut(inside, "low", width / BINS).select(
        F.col("source").alias("_s2"), F.col("bin").alias("bin2"), F.col("left").alias("left2")), "mix-cut2")
    edge = inside.drop("need").join(cut2, inside.source.eqNullSafe(cut2._s2)
                                    & (F.floor((inside["rank"] - inside.low) / (width / BINS)) == cut2.bin2))
    # The few rows of the last bin, in order: taken while they fit.
    order = Window.partitionBy("source").orderBy("rank", F.col("id").asc_nulls_last(), "tie")
    last = edge.withColumn("_words", F.sum("size").over(order.rangeBetween(
        Window.unboundedPreceding, Window.currentRow))) \
        .where("_words <= left2")
    cut = (last.groupBy("source").agg(F.max(_key()).alias("edge")).select(F.col("source").alias("_s3"), "edge"))
    lowest = cut1.join(cut2, cut1._s.eqNullSafe(cut2._s2)).drop("_s2")
    lowest = lowest.join(cut, lowest._s.eqNullSafe(cut._s3), "left").drop("_s3")
    return stage(lowest.select("_s", "bin1", "bin2", "edge"), "mix-edge")


def _before_cut() -> Column:
    """Whether a row, joined with its source's cut, is before it."""
    width = 1.0 / BINS
    bin1 = F.floor(F.col("rank") / width)
    bin2 = F.floor((F.col("rank") - F.col("bin1") * F.lit(width)) / (width / BINS))
    return F.coalesce((bin1 < F.col("bin1")) | ((bin1 == F.col("bin1")) & (
        (bin2 < F.col("bin2")) | ((bin2 == F.col("bin2")) & (_key() <= F.col("edge"))))), F.lit(False))


def _draw_whole(ranked: DataFrame) -> DataFrame:
    """Add ``drawn``: down the rank, each document that still fits. Rounds of
    cuts, each over the documents that fit into what the one before has left;
    of a round only its bounds are kept, one row a source."""
    # Rows that repeat an id and a text are taken together, so their sum fits.
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("source", "id", "tie")]
    repeated = stage(ranked.groupBy("source", "id", "tie").agg(F.sum("size").alias("_unit"), F.count(F.lit(1)).alias("n"))
                     .where("n > 1").select(*[F.col(c).alias(f"_{c}") for c in ("source", "id", "tie")], "_unit"), "mix-repeated")
    ranked = (ranked.join(repeated, same[0] & same[1] & same[2], "left")
              .withColumn("unit", F.coalesce("_unit", "size")).drop("_source", "_id", "_tie", "_unit"))
    ranked = stage(ranked, "mix-units")
    open_ = ranked.where("rank < 2 and unit > 0 and unit <= need").select(
        "source", "rank", "id", "tie", "size", "unit", "need")
    rounds = None
    while n := (open_ := stage(open_, "mix-open")).count():
        if n <= FEW_ROWS:
            down = Window.partitionBy("source").orderBy("rank", F.col("id").asc_nulls_last(), "tie") \
                .rangeBetween(Window.unboundedPreceding, Window.currentRow)
            marked = open_.withColumn("taken", F.sum("size").over(down) <= F.col("need"))
        else:
            lowest = _cut_edges(open_)
            marked = (open_.join(lowest, open_.source.eqNullSafe(lowest._s), "left")
                      .withColumn("taken", F.col("bin1").isNull() | _before_cut()).drop("_s", "bin1", "bin2", "edge"))
        bounds = stage(marked.where("taken").groupBy(F.col("source").alias("_s")).agg(
            F.first("need").alias("fits"), F.sum("size").alias("used"), F.max(_key()).alias("edge")), "mix-round")
        rounds = bounds if rounds is None else rounds.unionByName(bounds)
        open_ = (open_.join(bounds, open_.source.eqNullSafe(bounds._s))
                 .where((_key() > F.col("edge")) & (F.col("unit") <= F.col("fits") - F.col("used")))
                 .withColumn("need", F.col("fits") - F.col("used")).drop("_s", "fits", "used", "edge"))
    if rounds is None:
        return ranked.withColumn("drawn", F.lit(False))
    rounds = stage(rounds.groupBy("_s").agg(F.collect_list(F.struct("fits", "edge")).alias("rounds")), "mix-rounds")
    taken = F.exists("rounds", lambda r: (F.col("unit") <= r["fits"]) & (_key() <= r["edge"]))
    return (ranked.join(rounds, ranked.source.eqNullSafe(rounds._s), "left")
            .withColumn("drawn", (F.col("rank") < 2) & (F.col("unit") > 0) & F.coalesce(taken, F.lit(False))))


def _key() -> Column:
    return F.struct("rank", F.col("id").isNull().alias("no_id"), "id", "tie")


def weights_by_position(docs: DataFrame, cycle: tuple[float, ...], source_col: str = "source") -> DataFrame:
    """(source, weight): sources by code point, null last, take the weights of
    ``cycle`` in turn. One row a source."""
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return (docs.select(F.col(source_col).alias("source")).distinct()
            .select("source", F.get(F.array(*[F.lit(float(c)) for c in cycle]),
                                    (n % len(cycle)).cast("int")).alias("weight")))
