"""Document status: folding a log of changes, its history, and look-ups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, parse_decimal

# The statuses a document can have.
STATUSES = (
    "RECEIVED", "OCR_IN_PROGRESS", "OCR_DONE", "OCR_FAILED", "TEXT_EXTRACTION_IN_PROGRESS", "TEXT_EXTRACTION_DONE",
    "TEXT_EXTRACTION_FAILED", "BEDROCK_IN_PROGRESS", "BEDROCK_DONE", "BEDROCK_FAILS", "VALIDATION_IN_PROGRESS",
    "VALIDATION_DONE", "VALIDATION_FAILED", "VALIDATION_REJECTED", "PROCESS_COMPLETED", "PROCESS_FAILED",
    "PROCESS_PARTIALLY_COMPLETED",
)
RECEIVED = "RECEIVED"
TERMINAL = ("PROCESS_COMPLETED", "PROCESS_FAILED", "PROCESS_PARTIALLY_COMPLETED")
RESERVED = ("document_id", "status", "updated_at", "start_at", "end_at", "duration")
NO_TEXT = "No valid extracted text found (aws_extract_text is empty or null)"


def marked_events(events: DataFrame) -> DataFrame:
    """Events with the status right-trimmed, and _good: whether status, id and time are there and valid, and no extra has a reserved name."""
    trimmed = events.withColumn("status", F.rtrim("status"))
    names = F.coalesce(F.map_keys("extra"), F.array().cast("array<string>"))
    good = F.col("status").isin(*STATUSES) & F.col("document_id").isNotNull() & F.col("at").isNotNull() & ~F.arrays_overlap(names, F.array(*map(F.lit, RESERVED)))
    return trimmed.withColumn("_good", F.coalesce(good, F.lit(False)))


def clean_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid events with the status right-trimmed, and the others: unknown status, no id or time, or reserved extra names."""
    marked = marked_events(events)
    return marked.where("_good").drop("_good"), marked.where("not _good").drop("_good")


def current_status(events: DataFrame) -> DataFrame:
    """One row per document of a log (document_id, status, at, seq, extra), merged in order of (at, seq).

    Status and updated_at come from the last event, start_at from the first RECEIVED, end_at from the first
    terminal one; duration is the whole seconds from start_at to the first terminal event after it. Of
    each extra name the last value counts. All are grouped minima and maxima, so that a document with
    very many events is summed up in every task before it is sent. Events are cleaned first (``clean_events``); refused ones don't count.
    """
    events, _ = clean_events(events)
    when = F.struct("at", "seq")
    terminal = F.col("status").isin(*TERMINAL)
    base = events.groupBy("document_id").agg(
        F.max_by(F.struct("status", "at"), when).alias("last"),
        F.min(F.when(F.col("status") == RECEIVED, when)).alias("start"),
        F.min(F.when(terminal, F.col("at"))).alias("end_at"),
    )
    after = events.where(terminal).join(base.where("start is not null").select("document_id", "start"), "document_id").where(when > F.col("start"))
    ends = after.groupBy("document_id").agg(F.min("at").alias("after_start"))
    named = events.where(F.size("extra") > 0).select("document_id", "at", "seq", F.explode("extra").alias("name", "value"))
    values = named.groupBy("document_id", "name").agg(F.max_by("value", when).alias("value"))
    extras = values.groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("extra"))
    duration = F.timestamp_diff("SECOND", F.col("start.at"), F.col("after_start"))
    full = base.join(ends, "document_id", "left").join(extras, "document_id", "left")
    return full.select("document_id", F.col("last.status").alias("status"), F.col("last.at").alias("updated_at"), F.col("start.at").alias("start_at"), "end_at", duration.alias("duration"), F.coalesce("extra", F.create_map().cast("map<string,string>")).alias("extra"))


def latest_status(events: DataFrame) -> DataFrame:
    """One row per document from its last event alone; what earlier events said is lost. Refused events (``clean_events``) don't count."""
    events, _ = clean_events(events)
    last = events.groupBy("document_id").agg(F.max_by(F.struct("status", "at", "extra"), F.struct("at", "seq")).alias("e"))
    at = F.col("e.at")
    return last.select(
        "document_id", F.col("e.status").alias("status"), at.alias("updated_at"),
        F.when(F.col("e.status") == RECEIVED, at).alias("start_at"), F.when(F.col("e.status").isin(*TERMINAL), at).alias("end_at"), F.col("e.extra").alias("extra"),
    )


def status_history(events: DataFrame, now: Column | None = None) -> DataFrame:
    """One row per (document_id, transition_at); a later write (larger seq) of the same key wins. A null time is now. Otherwise refused events (``clean_events``) have no row."""
    dated, _ = clean_events(events.withColumn("at", F.coalesce("at", F.current_timestamp() if now is None else now)))
    kept = dated.withColumnRenamed("at", "transition_at").groupBy("document_id", "transition_at").agg(F.max_by(F.struct("status", "extra"), F.col("seq")).alias("e"))
    return kept.select("document_id", "transition_at", F.col("e.status").alias("status"), F.col("e.extra").alias("extra"))


def find_by_fields(items: DataFrame, **equal: object) -> DataFrame:
    """All items whose columns have the given values."""
    return items.where(reduce(lambda a, b: a & b, [F.col(f"`{c}`") == F.lit(v) for c, v in equal.items()], F.lit(True)))


def query_partition(items: DataFrame, key: str, value: object, filters: dict[str, object] | None = None) -> DataFrame:
    """The items of one key, and of those the ones whose columns have the given values."""
    return find_by_fields(items.where(F.col(f"`{key}`") == F.lit(value)), **(filters or {}))


def save_items(items: DataFrame, path: str, key: str, look_up: Sequence[str] = (), row_group: int = 8 << 20) -> None:
    """Writes items so that look-ups by key, and by the columns of look_up, skip most of the files.

    Rows are dealt out by ranges of the key and sorted, so that a file, and a row group in it, holds a short range of keys. The key and the look-up
    columns have Bloom filters in each row group, which say of most values that they aren't there. A key with very many rows fills row groups
    of its own.
    """
    writer = items.repartitionByRange(key, F.xxhash64(*items.columns[:1])).sortWithinPartitions(key).write.option("parquet.block.size", row_group)
    for column in {key, *look_up}:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)


def apply_updates(items: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """items with the non-null columns of updates put in; keys that items lack are added. updated says which rows had one."""
    news = {c: f"_new_{c}" for c in updates.columns if c != key}
    renamed = updates.select(F.col(key), *[F.col(c).alias(n) for c, n in news.items()], F.lit(True).alias("_updated"))
    joined = items.join(renamed, key, "full_outer")
    columns = [F.col(key), *[(F.coalesce(news[c], c) if c in news and c in items.columns else F.col(c)).alias(c) for c in items.columns if c != key]]
    columns += [F.col(n).alias(c) for c, n in news.items() if c not in items.columns]
    return joined.select(*columns, F.coalesce("_updated", F.lit(False)).alias("updated"))


def best_extracted_text(items: DataFrame) -> DataFrame:
    """items with best_text and text_error: the OCR text where an OCR amount other than zero is there, else the other text."""
    amount = parse_decimal(F.col("ocr_ammount"))
    use_ocr = F.coalesce((F.col("ocr_ammount") != "") & (amount != 0), F.lit(False))
    other = ~is_blank(F.col("aws_extract_text"))
    best = F.when(use_ocr, F.col("ocr_extracted_text")).when(other, F.col("aws_extract_text"))
    return items.withColumns({"best_text": best, "text_error": F.when(~use_ocr & ~other, NO_TEXT)})


def notifications(events: DataFrame) -> DataFrame:
    """Notification rows of events (document_id, status, at): ids are hashes, so that a second run gives the same."""
    made = F.substring(F.sha2(F.concat_ws("|", "document_id", "status", F.col("at").cast("string")), 256), 1, 6)
    return events.select(made.alias("id"), F.col("status").alias("title"), F.concat(F.lit("Documento "), "document_id", F.lit(": "), "status").alias("message"), F.unix_timestamp("at").alias("time"), F.lit(0).alias("read"), F.lit("status").alias("type"))
