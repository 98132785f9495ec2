"""What the training-data operators share: table access, the shared folder, columns."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path

THREADS = 2  # of tokenizer libraries in a Python worker


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as a table in the shared folder and reads it back: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_few(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has no more than so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == fold


def tokenizers_library():
    """The tokenizers package, with the one setting of its threads that all tasks of a worker share."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    import tokenizers

    return tokenizers


def strings(column: pa.StringArray) -> list[str]:
    """What to_pylist gives, in a quarter of the time."""
    return column.to_numpy(zero_copy_only=False).tolist()


def sized_slices(batches: Iterable[pa.RecordBatch], column: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about size bytes of one column at most; a larger row comes alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(at, end - at)
            at = end


def slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that long texts don't pile up."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
