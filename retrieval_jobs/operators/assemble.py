"""From lines and pages to the text of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank


def _in_order(position: str, text: str, keep: Column | None = None) -> Column:
    row = F.struct(F.col(position).alias("p"), F.col(text).alias("t"))
    ordered = F.array_sort(F.collect_list(row if keep is None else F.when(keep, row)))
    return F.transform(ordered, lambda x: x["t"])


def lines_to_pages(blocks: DataFrame) -> DataFrame:
    """Text of each page (document_id, page) from its LINE blocks, joined by line ends in block order."""
    lines = blocks.where(F.col("block_type") == "LINE")
    return lines.groupBy("document_id", "page").agg(F.array_join(_in_order("block_no", "text"), "\n").alias("page_text"))


def document_text(blocks: DataFrame) -> DataFrame:
    """Text of each document from its LINE blocks, without regard to pages."""
    lines = blocks.where(F.col("block_type") == "LINE")
    return lines.groupBy("document_id").agg(F.array_join(_in_order("block_no", "text"), "\n").alias("text"))


def page_counts(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """num_pages of every document, 0 for those without readable pages."""
    counts = pages.where("page_no > 0").groupBy("document_id").agg(F.count("*").alias("n"))
    return documents.join(counts, "document_id", "left").withColumn("num_pages", F.coalesce("n", F.lit(0)).cast("long")).drop("n")


def is_large(num_pages: Column, limit: int = 50) -> Column:
    return num_pages > limit


def pages_to_text(pages: DataFrame, rule: str) -> DataFrame:
    """Text of each document (document_id, page_no, page_text) with num_pages; wholly blank documents are left out.

    structured: every page ends in a blank line, blank pages have no text of their own. ocr: pages with
    text, a blank line between. plain: all pages, a line end between.
    """
    texts = F.col("texts")
    joined = {
        "structured": F.array_join(F.transform(texts, lambda t: F.concat(F.when(is_blank(t), "").otherwise(t), F.lit("\n\n"))), ""),
        "ocr": F.array_join(F.filter(texts, lambda t: ~is_blank(t)), "\n\n"),
        "plain": F.array_join(F.transform(texts, lambda t: F.coalesce(t, F.lit(""))), "\n"),
    }[rule]
    grouped = pages.where("page_no > 0").groupBy("document_id").agg(_in_order("page_no", "page_text").alias("texts"), F.count("*").alias("num_pages"))
    return grouped.select("document_id", "num_pages", joined.alias("text")).where(~is_blank(F.col("text")))


def first_qr_line(blocks: DataFrame) -> DataFrame:
    """Per document the first LINE that holds a link, a WIFI: or an otpauth:// code, stripped; null if none does."""
    found = F.when((F.col("block_type") == "LINE") & F.col("text").rlike(r"(?i)(https?://\S+|WIFI:|otpauth://)"), F.struct("block_no", "text"))
    first = blocks.groupBy("document_id").agg(F.min(found).alias("first"))
    return first.select("document_id", F.regexp_replace(F.regexp_replace("first.text", r"(?U)^\s+", ""), r"(?U)\s+$", "").alias("qr_line"))
