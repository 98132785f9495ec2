"""Bounded samples of labelled documents, to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: At most so many labelled rows are fitted on; the order by hash makes the choice the same in every run.
TRAINING_ROWS = 12_000


def training_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows: int = TRAINING_ROWS) -> DataFrame:
    """(text, label) of up to rows documents whose label is 0 or 1 and for which allowed (over doc_id) holds.

    A document labelled more than once has its largest label. Rows of documents without text count as empty.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & allowed)
    chosen = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most `rows` rows go to every executor
    sample = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "label")
    return materialize(sample.repartition(16), "training")
