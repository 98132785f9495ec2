"""The status fold as a stream: one query that keeps a document's fold in the state store and writes current status, history and notifications together."""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.utils import AnalysisException

from ..operators.status import RECEIVED, TERMINAL, marked_events, notifications, status_history

TABLES = ("current", "history", "notifications", "rejected")
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CURRENT = "document_id string, status string, updated_at long, start_at long, end_at long, after_start long, extra map<string,string>"

HELD_FOLDS = 20_000  # documents whose folds a task holds before it sends them on

#: A fold of some of a document's events. Places are [microseconds, seq], and sort as events do. `ends` are the terminal
#: events that a start can be followed by: all up to the first one after the start, since an earlier start may still come.
Fold = dict[str, Any]


def trimmed(fold: Fold) -> Fold:
    start, ends = fold["start"], fold["ends"]
    if start is not None:
        after = next((n for n, end in enumerate(ends) if end > start), len(ends))
        fold["ends"] = ends[: after + 1]
    return fold


def merged(one: Fold | None, two: Fold) -> Fold:
    """The fold of the events of both; in any order of merging the same, as long as no two events have one place."""
    if one is None:
        return trimmed(two)
    starts = [f["start"] for f in (one, two) if f["start"] is not None]
    extras = dict(one["extras"])
    for name, value in two["extras"].items():
        if name not in extras or extras[name][:2] <= value[:2]:
            extras[name] = value
    ends = sorted({tuple(x) for x in one["ends"]} | {tuple(x) for x in two["ends"]})
    return trimmed({"last": max(one["last"], two["last"], key=lambda x: x[:2]), "start": min(starts) if starts else None, "ends": [list(x) for x in ends], "extras": extras})


def fold_of(status: str, at: int, seq: int | None, extra: dict[str, str | None] | None) -> Fold:
    place = [at, -(1 << 63) if seq is None else seq]
    return {"last": [*place, status], "start": place if status == RECEIVED else None, "ends": [place] if status in TERMINAL else [], "extras": {k: [*place, v] for k, v in (extra or {}).items()}}


def add_event(fold: Fold, status: str, at: int, seq: int | None, extra: Iterable[tuple[str, str | None]]) -> None:
    """Puts one event into a fold, as merged does with the fold of that event alone."""
    place = [at, -(1 << 63) if seq is None else seq]
    if place > fold["last"][:2]:
        fold["last"] = [*place, status]
    extras = fold["extras"]
    for name, value in extra:
        if name not in extras or extras[name][:2] <= place:
            extras[name] = [*place, value]
    start, ends = fold["start"], fold["ends"]
    if status == RECEIVED and (start is None or place < start):
        fold["start"] = place
        trimmed(fold)
    elif status in TERMINAL and not (start is not None and ends and start < ends[-1] < place):
        at_end = bisect.bisect_left(ends, place)
        if at_end == len(ends) or ends[at_end] != place:
            ends.insert(at_end, place)
            trimmed(fold)


def current_row(document_id: str, fold: Fold) -> Row:
    """A fold as a row of CURRENT."""
    start, ends = fold["start"], fold["ends"]
    after = next((end[0] for end in ends if start is not None and end > start), None)
    at, _, status = fold["last"]
    return Row(document_id=document_id, status=status, updated_at=at, start_at=start and start[0], end_at=ends[0][0] if ends else None, after_start=after, extra={k: v[2] for k, v in fold["extras"].items()})


def partial_folds(events: DataFrame) -> DataFrame:
    """document_id and fold, as JSON: what a task reads of a document is summed up before it is sent, of HELD_FOLDS documents at a time."""

    def told(found: dict[str, Fold]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([json.dumps(f) for f in found.values()], pa.string())], names=["document_id", "fold"])

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Fold] = {}
        for batch in batches:
            extras = batch.column("extra")
            names, values, ends = extras.keys.to_pylist(), extras.items.to_pylist(), extras.offsets.to_pylist()
            there = extras.is_valid().to_pylist()
            for n, (document, status, at, seq) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True)):
                pairs = list(zip(names[ends[n] : ends[n + 1]], values[ends[n] : ends[n + 1]], strict=True)) if there[n] else []
                if document in found:
                    add_event(found[document], status, at, seq, pairs)
                else:
                    found[document] = fold_of(status, at, seq, dict(pairs))
            if len(found) > HELD_FOLDS:
                yield told(found)
                found = {}
        if found:
            yield told(found)

    rows = events.select(F.col("document_id").cast("string").alias("document_id"), "status", F.unix_micros("at").alias("at"), F.col("seq").cast("long").alias("seq"), "extra")
    return rows.mapInArrow(fold, "document_id string, fold string")


class StatusFold(StatefulProcessor):
    """Keeps one fold per document, and gives its current row whenever events change it."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", "fold string", self.idle_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.state.get()
        fold = json.loads(held[0]) if held else None
        for row in rows:
            fold = merged(fold, json.loads(row["fold"]))
        self.state.update((json.dumps(fold),))
        yield current_row(key[0], fold)

    def close(self) -> None:
        pass


def start_status_stream(events: DataFrame, path: str, checkpoint: str, idle_ms: int | None = None, **trigger):
    """Runs the fold over a stream (document_id, status, at, seq, extra) and writes its tables under path.

    Events are cleaned first (as by ``clean_events``; what it refuses goes to ``rejected``). A document's fold lives in the state store
    of the query, so that a micro-batch reads nothing that earlier ones wrote, and it is exact whatever the order of events, late ones too. With
    idle_ms, a document without events for so long is dropped from the store; what comes later starts it anew. Each micro-batch's rows of
    current, history, notifications and rejected are written to folders of its number. Its number is put down last, and
    readers (``read_status``) only look at numbers put down, so the tables always stand at the same event. A micro-batch that is
    run again replaces what its first try left.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)  # the only one with values of a user's own
    marked = marked_events(events)
    good = marked.where("_good")
    mode = "ProcessingTime" if idle_ms else "None"
    folds = partial_folds(good).groupBy("document_id").transformWithState(StatusFold(idle_ms), CURRENT, "Update", mode)
    raw = ["document_id", "status", "at", "seq", "extra"]
    current = folds.select(F.lit("current").alias("kind"), F.struct(*folds.columns).alias("now"))
    told = marked.select(F.when(F.col("_good"), "good").otherwise("bad").alias("kind"), *raw)
    everything = current.unionByName(told, allowMissingColumns=True)

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            events_of = {kind: rows.where(F.col("kind") == kind).select(*raw) for kind in ("good", "bad")}
            now = rows.where("kind = 'current'").select("now.*")
            moments = {c: F.timestamp_micros(c) for c in ("updated_at", "start_at", "end_at")}
            duration = F.timestamp_diff("SECOND", F.timestamp_micros("start_at"), F.timestamp_micros("after_start"))
            out = {
                "current": now.withColumn("duration", duration).withColumns(moments).select("document_id", "status", "updated_at", "start_at", "end_at", "duration", "extra"),
                "history": status_history(events_of["good"]),
                "notifications": notifications(events_of["good"]),
                "rejected": events_of["bad"],
            }
            for name, df in out.items():
                df.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
            spark.range(1).select(F.lit(number).alias("batch")).write.mode("append").json(f"{path}/commits")
        finally:
            rows.unpersist()

    return everything.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _batches(spark: SparkSession, folder: str) -> DataFrame | None:
    """What the committed micro-batches wrote to a folder, with the number of each."""
    try:
        committed = spark.read.schema("batch long").json(f"{folder.rpartition('/')[0]}/commits")
        rows = spark.read.parquet(folder).withColumn("batch", F.col("batch").cast("long"))
    except AnalysisException:  # nothing yet
        return None
    return rows.join(F.broadcast(committed.distinct()), "batch", "left_semi")


def read_status(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the stream, of TABLES, as of the last micro-batch that was written whole: of current the last row of each
    document, of history the last write of each (document_id, transition_at), of the others all rows."""
    rows = _batches(spark, f"{path}/{name}")
    if rows is None:
        raise ValueError(f"the stream has written nothing to {path} yet")
    if name == "current":
        columns = [c for c in rows.columns if c not in ("document_id", "batch")]
        return rows.groupBy("document_id").agg(F.max_by(F.struct(*columns), "batch").alias("e")).select("document_id", "e.*")
    if name == "history":
        kept = rows.groupBy("document_id", "transition_at").agg(F.max_by(F.struct("status", "extra"), "batch").alias("e"))
        return kept.select("document_id", "transition_at", "e.status", "e.extra")
    return rows.drop("batch")
