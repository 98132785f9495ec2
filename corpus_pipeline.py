"""From raw documents to packed training sequences, in five stages that each write a table for the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrieval_jobs.llm.common import held_out, materialize, table
from retrieval_jobs.llm.curve_packing import pack_along_curve
from retrieval_jobs.llm.line_spread import few_sites, without_spread_lines
from retrieval_jobs.llm.minhash import near_duplicates
from retrieval_jobs.llm.preference import train_quality, with_quality
from retrieval_jobs.llm.toxicity import train_toxicity, with_toxicity


def _apart(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with columns of these names renamed, so that a stage's own can't clash with them, and what restores docs' columns."""
    aside = {}
    for name in set(names) & set(docs.columns):
        free = name + "_"
        while free in docs.columns:
            free += "_"
        aside[name] = free
    back = {free: name for name, free in aside.items()}
    return docs.withColumnsRenamed(aside), lambda df: df.drop(*names).withColumnsRenamed(back).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the preference model scores at one half or more.

    A null text is scored as an empty one, and kept or not with it. Repeated rows and rows without doc_id are
    judged by their text alone. Further columns stay as they are. An empty table stays empty.
    """
    apart, back = _apart(docs, "quality_score")
    model = train_quality(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 3, 1))
    return back(with_quality(apart, model).where("quality_score >= 0.5"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the n-gram model scores below one half; nulls, repeated rows and further columns as in quality."""
    apart, back = _apart(docs, "toxicity_score")
    model = train_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 5, 0))
    return back(with_toxicity(apart, model).where("toxicity_score < 0.5"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that many sources share, or many documents of a few; a document that loses its last line goes.

    n_chars counts the characters that are left. A null or empty text has no such lines and stays. Repeated rows
    are treated alike, and rows without doc_id lose such lines too.
    """
    apart, back = _apart(docs, "n_lines", "n_removed")
    left = without_spread_lines(apart, few=few_sites(docs)).where("n_removed = 0 or length(trim(text)) > 0")
    return back(left.withColumn("n_chars", F.length("text").cast("long")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates, and what has no doc_id.

    Null, empty and blank texts are like nothing, and stay. Repeated rows of a kept doc_id stay, all of them.
    """
    gone = near_duplicates(docs, words=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(materialize(gone, "near-copies"), "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens along the curve; one row per piece.

    A null or empty text has the end id alone. Repeated rows are packed one by one. An empty table gives no pieces.
    """
    return pack_along_curve(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [("quality", quality), ("toxicity", toxicity), ("lines", lines), ("near_copies", near_copies), ("packing", packing)]

#: Classifiers and the tokenizer have no SQL form; tests hold each stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
