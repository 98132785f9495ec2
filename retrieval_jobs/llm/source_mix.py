"""Mixing sources to target weights: a low-discrepancy schedule of slots, each of which takes one block of a source's words.

Everything here is Spark's own functions, windows and joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

GOLDEN = 0.6180339887498949  # steps of this length round a circle fill it evenly
BLOCK_WORDS = 1024
#: A table of one row per source goes to every task up to so many rows; beyond, it is joined by shuffles.
SMALL = 10_000
#: Keeps a target that a rounding error has put just below a whole number at that number.
NEXT_TO_WHOLE = 1e-6


def word_count(text: Column) -> Column:
    """How many runs of other characters than blank, tab, line ends and their like; a null text has none."""
    blank = r"\x20\x09-\x0D"
    # each word with the blanks round it becomes one letter
    marks = F.regexp_replace(text, f"[{blank}]*[^{blank}]+[{blank}]*", "x")
    return F.when(text.rlike(f"[^{blank}]"), F.length(marks)).otherwise(0).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, repeats: float) -> DataFrame:
    """One row per source of sized (source, size): source_no, documents, source_size, target and quota, its whole words.

    Sources in order of their code points, null last, have the weights in turn. They share `share` times all words by
    weight. A source stops at `repeats` times its own, and the excess goes to the others by weight until none is above: with
    sources in order of the level (target by weight) at which each stops, the level of all that don't stop is
    what is left over their weights, at the first source that reaches it.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    # windows over one row per source
    numbered = totals.withColumn("source_no", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))).cast("long") - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    capped = numbered.withColumns({"weight": weight, "cap": F.col("source_size") * F.lit(float(repeats))}).withColumn("stop", F.col("cap") / F.col("weight"))
    order = Window.orderBy("stop", "source_no")
    stopped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    levelled = capped.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)) - stopped) / open_weight)
    reached = F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "source_no", "level"))).over(Window.partitionBy())
    target = F.least(F.col("cap"), F.coalesce(reached["level"], F.lit(float("inf"))) * F.col("weight"))
    out = levelled.withColumn("target", target)
    return out.select("source", "source_no", "documents", "source_size", "target", F.floor(F.col("target") + NEXT_TO_WHOLE).cast("long").alias("quota"))


def schedule(targets: DataFrame, block_words: int) -> DataFrame:
    """slot, source_no and rank: which source each slot takes, and how many slots of that source come before.

    The points of the golden ratio, one for each slot, fall into the sources' intervals, as long as their shares of all slots. The
    unit interval is cut into cells, so that slots and intervals meet by an equal cell. Ranks are counted in
    stretches of slots, about as many as a stretch has slots, and the stretches added up. A source has as many slots as its quota has
    blocks: what the points give beyond is left out, and the few that they lack come at the end, in turns.
    """
    spark = targets.sparkSession
    needed = targets.where("quota > 0").select("source_no", F.ceil(F.col("quota") / block_words).cast("long").alias("slots"))
    total, sources = needed.agg(F.sum("slots"), F.count("*")).first()
    total = total or 0
    ends = F.sum("slots").over(Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0))
    intervals = needed.withColumn("end", ends).select("source_no", "slots", ((F.col("end") - F.col("slots")) / F.lit(float(total or 1))).alias("low"), (F.col("end") / F.lit(float(total or 1))).alias("high"))
    cells = max(1024, 4 * sources)
    reach = F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1).cast("long")))
    intervals = intervals.withColumn("cell", F.explode(reach))
    if sources <= SMALL:
        intervals = F.broadcast(intervals)  # cells + sources rows at most
    turn = F.col("id") * F.lit(GOLDEN)
    stretch = max(1, ceil(total**0.5))
    points = spark.range(1, total + 1).withColumn("point", turn - F.floor(turn)).withColumn("cell", F.floor(F.col("point") * cells))
    drawn = points.join(intervals, "cell").where("point >= low and point < high").select(F.col("id").alias("slot"), "source_no", "slots", F.floor(F.col("id") / stretch).alias("stretch"))
    counts = drawn.groupBy("source_no", "stretch").agg(F.count("*").alias("here"))
    before = F.coalesce(F.sum("here").over(Window.partitionBy("source_no").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = drawn.join(counts.select("source_no", "stretch", before.alias("before")), ["source_no", "stretch"])
    rank = F.col("before") + F.row_number().over(Window.partitionBy("source_no", "stretch").orderBy("slot")) - 1
    ranked = placed.withColumn("rank", rank).where("rank < slots").select("slot", "source_no", "rank")
    given = counts.groupBy("source_no").agg(F.sum("here").alias("given"))
    short = needed.join(given, "source_no", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < slots")
    late = short.withColumn("rank", F.explode(F.sequence("given", F.col("slots") - 1)))
    last = F.lit(total + 1) + (F.col("rank") - F.col("given")) * F.lit(sources) + F.col("source_no")
    return ranked.unionByName(late.select(last.alias("slot"), "source_no", "rank"))


def shuffled_pieces(sized: DataFrame, targets: DataFrame, repeats: float, block_words: int, seed: str) -> DataFrame:
    """Documents laid end to end in a shuffled order, source by source, and cut where blocks end: one row per piece.

    Columns of sized and targets, with start (of the document in its source), copy (0, or which of several equal rows), pass,
    block, first_word (of the piece in the document) and n_words. A document of which the quota takes nothing has
    one row with a negative block. The order is that of a hash of doc_id; a source's documents are dealt to as many ranges of the hash as
    the root of their number, summed up in each, and the ranges added up. Equal rows are counted before they are dealt.
    """
    sources = targets.count()
    joined = sized.join(F.broadcast(targets) if sources <= SMALL else targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    ranges = F.ceil(F.sqrt("documents"))
    dealt = joined.withColumn("place", place).withColumn("range", F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * ranges / F.lit(2.0**32)))
    sums = dealt.groupBy("source_no", "range").agg(F.sum("size").alias("words"))
    ahead = F.coalesce(F.sum("words").over(Window.partitionBy("source_no").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    units = dealt.groupBy("source_no", "range", "place", "doc_id", "size", "source", "source_size", "target", "quota").agg(F.count("*").alias("copies"))
    within = Window.partitionBy("source_no", "range").orderBy("place", F.asc_nulls_last("doc_id"), "size")
    before = F.coalesce(F.sum(F.col("size") * F.col("copies")).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = units.withColumn("before", before).join(sums.select("source_no", "range", ahead.alias("ahead")), ["source_no", "range"])
    single = laid.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("start", F.col("ahead") + F.col("before") + F.col("copy") * F.col("size"))
    passed = single.withColumn("pass", F.explode(F.array(*[F.lit(n) for n in range(ceil(repeats))])))
    passed = passed.withColumn("begin", F.col("start") + F.col("pass") * F.col("source_size")).withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("quota")))
    first, last = F.floor(F.col("begin") / block_words), F.floor((F.col("end") - 1) / block_words)
    # rows without a piece are spread by a hash, since nothing meets them
    nothing = F.array(-1 - F.pmod(F.xxhash64("doc_id", "copy"), F.lit(1 << 30)))
    blocks = F.when(F.col("end") > F.col("begin"), F.sequence(first, last)).when(F.col("pass") == 0, nothing)
    cut = passed.withColumn("block", F.explode(blocks))
    low = F.greatest(F.col("begin"), F.col("block") * block_words)
    words = F.least(F.col("end"), (F.col("block") + 1) * block_words) - low
    taken = F.col("block") >= 0
    return cut.select(
        "doc_id", "source", "source_no", "size", "source_size", "target", "start", "copy", "pass", "block",
        F.when(taken, low - F.col("begin")).alias("first_word"), F.when(taken, words).alias("n_words"),
    )


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, repeats: float = 2.0, block_words: int = BLOCK_WORDS, seed: str = "mix") -> DataFrame:
    """The mix of docs (doc_id, source, text) as pieces: slot, source, doc_id, first_word and n_words, with size, source_size, target, start and copy.

    In order of slot the pieces are the mixed stream, in which every long stretch has the sources near their shares. Source number s
    gives its blocks 0, 1, 2, ... to the slots of rank 0, 1, 2, ...; a block is block_words words of the source's shuffled
    documents laid end to end, round and round, and its last one ends where its target does. So it gives floor(target) words, and a
    document's are taken as often as any other's of the source, or once more. Documents of which nothing is taken have one row
    without slot. A null text is empty; null sources are one source, the last. Equal rows are taken one by one, in any order. Rows without
    doc_id are documents like others. Other columns of docs are not looked at. An empty table gives no rows.
    """
    sized = materialize(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "mix-sizes")
    targets = materialize(source_targets(sized, weights, share, repeats), "mix-targets")
    pieces = shuffled_pieces(sized, targets, repeats, block_words, seed)
    slots = schedule(targets, block_words).withColumnRenamed("rank", "block")
    return pieces.join(slots, ["source_no", "block"], "left").drop("source_no", "block")


def taken_words(pieces: DataFrame) -> DataFrame:
    """One row per row of the documents mixed: doc_id, source, size, source_size, target, and taken, its words in the slots of the mix."""
    words = F.sum(F.when(F.col("slot").isNotNull(), F.col("n_words")).otherwise(0))
    return pieces.groupBy("doc_id", "source", "size", "source_size", "target", "start", "copy").agg(words.alias("taken")).drop("start", "copy")
