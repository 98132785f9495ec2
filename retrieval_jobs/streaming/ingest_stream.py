"""Uploads as a stream: notifications to the chunk table and the agents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.embedding import Encoder
from ..plans.ingest import ingest
from ..sources.scratch import scratch_path
from ..sources.uploads import parse_object_keys, upsert_chunks

AGENTS = "tenant_id string, agent_id string, agent_name string, description string, prompt_template string, created_at timestamp"


def read_agents(spark: SparkSession, path: str) -> DataFrame:
    """The agents of the newest whole version under path; none where there is none."""
    try:
        return spark.read.schema(f"{AGENTS}, version long").parquet(f"{path}/agents").transform(_newest).select(*[c.split(" ")[0] for c in AGENTS.split(", ")])
    except AnalysisException:
        return spark.createDataFrame([], AGENTS)


def _newest(rows: DataFrame) -> DataFrame:
    last = rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == last)


def start_ingest_stream(uploads: DataFrame, pages_of: Callable[[DataFrame], DataFrame], encoder: Callable[[], Encoder], path: str, checkpoint: str, now: Column | None = None, **trigger):
    """Runs a stream of upload events (as read_upload_events gives them) through ingest into path/chunks and path/agents.

    pages_of gives the pages (bucket, key, page_no, page_text) of objects (bucket, key). Each micro-batch makes the agents that are missing and puts the
    chunks of its documents in place of what the table has of them, so that a batch or an upload that comes again changes nothing.
    The agents are written whole, one version per micro-batch, and a version that is written again replaces itself.
    """

    def batch(events: DataFrame, number: int) -> None:
        spark = events.sparkSession
        staged = scratch_path(spark, "uploads")
        parse_object_keys(events).withColumn("arrived_at", F.col("event_time")).write.parquet(staged)
        objects = spark.read.parquet(staged)
        chunks, agents = ingest(objects, pages_of(objects), read_agents(spark, path), encoder, now)
        if not objects.isEmpty():
            upsert_chunks(chunks, f"{path}/chunks")
            kept = scratch_path(spark, "agents")
            agents.write.parquet(kept)  # a version that is run again reads what it replaces
            spark.read.schema(agents.schema).parquet(kept).coalesce(1).write.mode("overwrite").parquet(f"{path}/agents/version={number}")

    return uploads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()
