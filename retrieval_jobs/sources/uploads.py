"""Upload notifications, documents and the chunk table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from .scratch import scratch_path
from .text_objects import TextObjects, read_objects

EVENT_SCHEMA = (
    "Records array<struct<eventVersion: string, eventSource: string, awsRegion: string, eventTime: string, eventName: string, "
    "s3: struct<bucket: struct<name: string>, object: struct<key: string, size: bigint, eTag: string, sequencer: string>>>>"
)
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


HELD_CHARS = 8 << 20  # of texts that a task has read of objects, before it sends them on


def upload_events(notifications: DataFrame) -> DataFrame:
    """One row per created .pdf object of notifications (Records ...); works on streams too."""
    record = notifications.select(F.explode("Records").alias("r"))
    rows = record.select(
        F.col("r.s3.bucket.name").alias("bucket"),
        F.col("r.s3.object.key").alias("key_raw"),
        F.col("r.s3.object.size").alias("size"),
        F.col("r.s3.object.eTag").alias("etag"),
        F.col("r.s3.object.sequencer").alias("sequencer"),
        F.col("r.eventTime").try_cast("timestamp").alias("event_time"),
        F.col("r.eventName").alias("event_name"),
    )
    return rows.where(F.col("event_name").startswith("ObjectCreated:") & F.col("key_raw").endswith(".pdf"))


def read_upload_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Notifications from JSON files, as a table or as a stream without redelivered events."""
    if not streaming:
        return upload_events(spark.read.schema(EVENT_SCHEMA).json(path))
    events = upload_events(spark.readStream.schema(EVENT_SCHEMA).json(path))
    return events.withWatermark("event_time", "1 hour").dropDuplicatesWithinWatermark(["bucket", "key_raw", "sequencer"])


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(UUID), F.lit(False))


def parse_object_keys(events: DataFrame) -> DataFrame:
    """Adds key, tenant_id, agent_id, document_name and valid_agent, read off key_raw."""
    key = F.regexp_replace(F.coalesce(F.try_url_decode("key_raw"), F.col("key_raw")), "^/+", "")
    parts = F.split("key", "/", -1)
    out = events.withColumn("key", key).withColumns({"tenant_id": F.get(parts, 0), "agent_id": F.get(parts, 1), "document_name": F.element_at(parts, -1)})
    return out.withColumn("valid_agent", is_uuid(F.col("agent_id")))


def parsed_pages(batches: Iterable[pd.DataFrame], extract_pages: Callable[[bytes], list[str | None]]) -> Iterator[pd.DataFrame]:
    """The pages of files (path, content), one file after another, so that the pages of one file are held at a time."""
    for batch in batches:
        for name, content in zip(batch["path"], batch["content"], strict=True):
            try:
                pages = list(extract_pages(bytes(content)))
            except Exception:
                pages = []
            rows = [(name, k, text) for k, text in enumerate(pages, 1)] or [(name, 0, None)]
            yield pd.DataFrame(rows, columns=["document_path", "page_no", "page_text"])


def read_documents(spark: SparkSession, path: str, extract_pages: Callable[[bytes], list[str | None]], pattern: str = "*.pdf") -> DataFrame:
    """Pages (document_path, page_no, page_text) of binary files with names like pattern, by the caller's page parser.

    A file that the parser fails on has one row with page_no 0 and no text, so that it still counts.
    """

    def parse(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return parsed_pages(batches, extract_pages)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(parse, "document_path string, page_no int, page_text string")


def write_chunks(chunks: DataFrame, path: str, mode: str = "append", files_per_tenant: int = 8) -> None:
    """Appends chunks in one commit, by tenant; a tenant's rows are spread over several tasks by a salt."""
    salt = F.pmod(F.xxhash64("chunk_id"), F.lit(files_per_tenant))
    chunks.repartition("tenant_id", salt).write.mode(mode).partitionBy("tenant_id").parquet(path)


def read_chunks(spark: SparkSession, path: str, tenant_id: str | None = None) -> DataFrame:
    """The chunk table, or one tenant's folder of it.

    Tenants are text, whatever their names look like, so ``007`` and ``7`` stay two tenants. Null and empty
    tenants share a folder and read as null; no tenant_id finds them.
    """
    found = spark.read.parquet(path).schema
    named = StructType([StructField(f.name, StringType() if f.name == "tenant_id" else f.dataType) for f in found])
    chunks = spark.read.schema(named).parquet(path).drop(BUCKET)
    return chunks if tenant_id is None else chunks.where(F.col("tenant_id") == tenant_id)


BUCKET, NEW = "document_bucket", "_new"
PASS_FOLDERS = 100_000  # tenants and buckets, at most so many of which go to every task


def upsert_chunks(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """Puts chunks (tenant_id, document_id, chunk_id ...) into the table at path, whose rows of the same documents they replace.

    So an upload that is delivered or ingested again leaves the table as it was, and one that now has fewer chunks leaves no old ones. The
    table is partitioned by tenant and by a hash of the document in so many buckets. Only the buckets of the documents at
    hand are read, and written again with the new rows in place of those documents', in one commit that replaces these folders alone. Of new rows
    with equal tenant, document and chunk_id one counts. Null and empty tenants are one, as in read_chunks. One writer at a time.

    Rows are sent once, to the task that writes their folder, which there sorts out repeated and replaced ones. Where the table is there already, new rows are
    staged first, so that their folders are known; where it isn't, they are written as they come. A dynamic overwrite replaces folders after
    its last task, so the table can be read in the job that replaces them.
    """
    spark = chunks.sparkSession
    tenant = F.when(F.col("tenant_id") != "", F.col("tenant_id"))
    rows = chunks.withColumn("tenant_id", tenant).withColumn(BUCKET, F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int")).withColumn(NEW, F.lit(True))
    if _exists(spark, path):
        staged, told = scratch_path(spark, "new-chunks"), rows.schema
        rows.write.parquet(staged)
        rows = spark.read.schema(told).parquet(staged)
        named = StructType([*[f for f in told if f.name not in ("tenant_id", BUCKET, NEW)], StructField("tenant_id", StringType()), StructField(BUCKET, IntegerType())])
        old = spark.read.schema(named).parquet(path)

        def same(*names: str) -> Column:
            return reduce(lambda a, b: a & b, [old[c].eqNullSafe(F.col(f"new_{c}")) for c in names])

        folders = rows.select(F.col("tenant_id").alias("new_tenant_id"), F.col(BUCKET).alias(f"new_{BUCKET}")).distinct()
        folder_path = scratch_path(spark, "new-folders")
        folders.write.parquet(folder_path)
        folders = spark.read.schema(folders.schema).parquet(folder_path)
        if folders.count() <= PASS_FOLDERS:
            folders = F.broadcast(folders)
        rows = old.join(folders, same("tenant_id", BUCKET), "left_semi").withColumn(NEW, F.lit(False)).unionByName(rows)
    sent = rows.repartition("tenant_id", BUCKET)
    copies = Window.partitionBy("tenant_id", BUCKET, "document_id", "chunk_id").orderBy(F.desc(NEW))
    once = sent.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy").eqNullSafe(1) | ~F.col(NEW))
    of_document = Window.partitionBy("tenant_id", BUCKET, "document_id")
    kept = once.withColumn("_replaced", F.max(NEW).over(of_document)).where(F.col(NEW) == F.col("_replaced"))
    kept.drop("_copy", "_replaced", NEW).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant_id", BUCKET).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException:  # nothing yet
        return False


def split_by_size(texts: DataFrame, max_kb: float) -> DataFrame:
    """texts (document_id, text) with stored_inline, and stored: the text itself or where the long text goes."""
    long = F.octet_length("text") / 1024 > max_kb
    where = F.concat(F.lit("extracted_text/"), F.url_encode("document_id"), F.lit(".txt"))
    return texts.withColumns({"stored_inline": ~long, "stored": F.when(long, where).otherwise(F.col("text"))})


def save_text(texts: DataFrame, max_kb: float, inline_path: str, offload_path: str) -> None:
    """Writes rows with short texts whole, and of long texts the place below offload_path where each is one object of its own."""
    split = split_by_size(texts, max_kb)
    spark = texts.sparkSession
    spark.dataSource.register(TextObjects)
    long = split.where(~F.col("stored_inline")).select(F.col("stored").alias("location"), "text")
    long.write.format("text_objects").mode("append").save(offload_path)
    split.select("document_id", "stored_inline", "stored").write.mode("append").parquet(inline_path)


def stored_texts(spark: SparkSession, inline_path: str, offload_path: str) -> DataFrame:
    """document_id, stored_inline, stored and text of what save_text wrote: each task opens the long texts that its rows name, and lists no folder."""
    rows = spark.read.parquet(inline_path)
    shown = ["document_id", "stored_inline", "stored", "text"]
    inline = rows.where("stored_inline").withColumn("text", F.col("stored")).select(*shown)
    # rows with places are short, so that a few tasks would read them all: dealt out, they open as many objects each
    long = rows.where("not stored_inline").select("document_id", "stored_inline", "stored").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "stored")

    def opened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts, held = 0, [], 0
            for n, text in enumerate(read_objects(offload_path, batch.column("stored").to_pylist()), 1):
                texts.append(text)
                held += len(text or "")
                if held > HELD_CHARS or n == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.slice(at, n - at).columns, pa.array(texts, pa.string())], names=shown)
                    at, texts, held = n, [], 0

    schema = StructType([*long.schema.fields, StructField("text", StringType())])
    rest = rows.where("stored_inline is null").withColumn("text", F.lit(None).cast("string")).select(*shown)
    return inline.unionByName(long.mapInArrow(opened, schema)).unionByName(rest)
