"""Cross-site boilerplate: lines found on many sites, by HyperLogLog sketches with exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_few, materialize

MIN_SITES, MIN_CHARS = 10, 20
FEW_SITES = 4  # where documents are counted too, a fifth of the sources will do, and never more than this
LOG_K, MARGIN = 12, 0.25  # a sketch of 2**12 slots is off by a quarter once in far more lines than exist
BROADCAST_LINES = 500_000  # 12 MB of line keys at most go to every executor; more are joined by a shuffle


def _lines(docs: DataFrame, *more: Column) -> DataFrame:
    """One row per line that is long enough: two hashes of the line, and the given columns."""
    cut = docs.select(*more, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return cut.where(F.length("line") >= F.col("min_chars")).withColumns({"one": F.xxhash64("line"), "two": F.xxhash64(F.lit(1), "line")}).drop("line", "min_chars")


def few_sites(docs: DataFrame) -> int:
    """How many sources make a line of many documents spread: a fifth of docs' sources, from 2 to FEW_SITES."""
    n = docs.where(F.col("source").isNotNull()).select("source").distinct().limit(5 * FEW_SITES).count()
    return min(FEW_SITES, max(2, -(-n // 5)))


def spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, few: int | None = None) -> DataFrame:
    """Keys (one, two) of the lines on at least min_sites sites, with the smallest doc_id that has the line.

    With few, also those that stand in at least min_sites documents on at least few sites.

    Sketches of sites are built per line in each task and merged; what they estimate clearly above the
    threshold is spread, what they estimate clearly below isn't, and the rest is counted exactly.
    """
    columns = (F.col("doc_id"), F.col("source"), F.lit(min_chars).alias("min_chars"))
    lines = _lines(docs, *columns).drop("pos")
    least = min_sites if few is None else min(few, min_sites)
    more = [] if few is None else [F.count("*").alias("seen")]
    sketched = lines.groupBy("one", "two").agg(F.hll_sketch_agg("source", LOG_K).alias("sites"), F.min("doc_id").alias("first_doc"), *more)
    sketched = sketched.withColumn("sites", F.hll_sketch_estimate("sites")).where(F.col("sites") >= least * (1 - MARGIN))
    if few is not None:
        sketched = sketched.where(F.col("seen") >= min_sites).drop("seen")
    sketched = materialize(sketched, "line-sites")
    sure = sketched.where(F.col("sites") > min_sites * (1 + MARGIN)).select("one", "two", "first_doc")
    near = sketched.where(F.col("sites") <= min_sites * (1 + MARGIN)).select("one", "two", "first_doc")
    counted = lines.join(broadcast_if_few(near.select("one", "two"), BROADCAST_LINES), ["one", "two"], "left_semi")
    if few is None:
        counted = counted.where(F.col("source").isNotNull()).groupBy("one", "two", "source").agg(F.lit(1).alias("seen")).groupBy("one", "two").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    else:
        counted = counted.groupBy("one", "two").agg(F.count_distinct("source").alias("sites"), F.count_distinct("doc_id").alias("docs"))
        counted = counted.where((F.col("sites") >= min_sites) | ((F.col("sites") >= least) & (F.col("docs") >= min_sites)))
    return materialize(sure.unionByName(near.join(counted.select("one", "two"), ["one", "two"], "left_semi")), "spread-lines")


def without_spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, few: int | None = None) -> DataFrame:
    """docs (doc_id, text, source and any others) with spread lines taken out of text, and n_lines, n_removed.

    A line is spread if at least min_sites different sources have it, or, with few, if it stands in at
    least min_sites documents on at least few sources, so that a source that holds most of the documents
    doesn't hide it; lines of fewer than min_chars characters never are. It stays in the document with the smallest doc_id, so that nothing is lost
    altogether. Lines are compared as they stand, and the others keep their order. A null source is no
    site; a null text stays null and has no lines; a text of spread lines only becomes empty. Repeated
    rows are treated alike; rows with null doc_id lose spread lines too. Columns of docs named n_lines or
    n_removed are replaced. The order of rows is not kept.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")])
    spread = spread_lines(docs.select("doc_id", "text", "source"), min_sites, min_chars, few)
    own = _lines(docs.select("doc_id", "text"), F.col("doc_id"), F.xxhash64("text").alias("text_hash"), F.lit(min_chars).alias("min_chars"))
    hit = own.join(broadcast_if_few(spread, BROADCAST_LINES), ["one", "two"]).where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    removed = materialize(hit.groupBy(F.col("doc_id").alias("removed_doc"), F.col("text_hash").alias("removed_hash")).agg(F.collect_set("pos").alias("removed")), "removed-lines")
    both = docs.join(removed, docs["doc_id"].eqNullSafe(removed["removed_doc"]) & (F.xxhash64(docs["text"]) == removed["removed_hash"]), "left")
    body = docs["text"]
    cut, gone = F.split(body, "\n", -1), F.coalesce(removed["removed"], F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), gone)
    text = F.when(F.size(gone) == 0, body).otherwise(F.array_join(F.transform(stay, lambda k: F.element_at(cut, k + 1)), "\n"))
    counts = {"n_lines": F.when(body.isNull(), F.lit(0)).otherwise(F.size(cut)).cast("long"), "n_removed": F.size(gone).cast("long")}
    return both.select(*[(text.alias("text") if c == "text" else docs[c]) for c in docs.columns], *[v.alias(k) for k, v in counts.items()])
