"""Uploads to chunk rows with vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_config, is_blank
from ..operators.assemble import pages_to_text
from ..operators.chunking import chunk_documents
from ..operators.embedding import Encoder, embed
from ..operators.tenants import assign_chunk_ids, ensure_agents


def document_texts(pages: DataFrame) -> DataFrame:
    """document_id, num_pages and text of pages (document_id, page_no, page_text), by the rule of the document's size.

    Both rules are applied to one grouping of the pages, so they are sent once.
    """
    row = F.struct(F.col("page_no").alias("p"), F.col("page_text").alias("t"))
    grouped = pages.where("page_no > 0").groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["t"]).alias("texts"), F.count("*").alias("num_pages"))
    structured = F.array_join(F.transform("texts", lambda t: F.concat(F.when(is_blank(t), "").otherwise(t), F.lit("\n\n"))), "")
    ocr = F.array_join(F.filter("texts", lambda t: ~is_blank(t)), "\n\n")
    text = F.when(chunk_config(F.col("num_pages"))["use_ocr"], ocr).otherwise(structured)
    return grouped.select("document_id", "num_pages", text.alias("text")).where(~is_blank(F.col("text")))


def ingest(objects: DataFrame, pages: DataFrame, agents: DataFrame, encoder: Callable[[], Encoder], now: Column | None = None, encode_tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, agents) of uploaded objects (bucket, key, etag, tenant_id, agent_id, document_name, valid_agent, arrived_at) with their pages (bucket, key, page_no, page_text).

    Objects without a valid agent id are left out; redelivered ones count once. Agents are made for every
    object, also those without chunks.
    """
    valid = objects.where("valid_agent").dropDuplicates(["bucket", "key", "etag"])
    named = valid.withColumn("object_id", F.sha2(F.concat_ws("\n", "bucket", "key"), 256))
    numbered = pages.withColumn("document_id", F.sha2(F.concat_ws("\n", "bucket", "key"), 256)).select("document_id", "page_no", "page_text")
    chunks = chunk_documents(document_texts(numbered)).withColumnRenamed("document_id", "object_id")
    rows = assign_chunk_ids(chunks.join(named, "object_id"), now)
    rows = rows.select("tenant_id", "chunk_id", "agent_id", "document_id", "document_name", "chunk_index", "chunk_text", "created_at")
    if encode_tasks:
        rows = rows.repartition(encode_tasks, "chunk_id")  # evens out the encoder's work
    return embed(rows, encoder, "chunk_text"), ensure_agents(valid, agents, now)


__all__ = ["document_texts", "ingest", "pages_to_text"]
