"""Embedding requests, responses, and vectors from a caller's encoder."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType
from pyspark.sql.utils import AnalysisException

MAX_CHARS = 20_000
DIMENSIONS = 1536
Encoder = Callable[[Sequence[str]], np.ndarray]


def embedding_request(text: Column) -> Column:
    """The JSON body for one text, of which the service takes the first 20,000 characters."""
    return F.to_json(F.struct(F.array(F.substring(text, 1, MAX_CHARS)).alias("texts"), F.lit("search_document").alias("input_type")))


def parse_embedding_response(text: Column) -> Column:
    """struct(embedding, error). An object of one key holds [[...]] under it; otherwise embeddings.float[0] counts."""
    keys = F.json_object_keys(text)
    lists = F.from_json(text, "map<string,array<array<float>>>", {"mode": "PERMISSIVE"})
    single = F.get(F.get(F.map_values(lists), 0), 0)
    nested = F.get(F.from_json(text, "embeddings struct<float: array<array<float>>>")["embeddings"]["float"], 0)
    vector = F.when(F.size(keys) == 1, single).when(F.array_contains(keys, "embeddings"), nested)
    error = F.when(vector.isNotNull(), None).when(F.size(keys) == 1, F.concat(F.lit("unexpected embedding under key "), F.get(keys, 0))).otherwise("no embedding in the response")
    return F.struct(vector.alias("embedding"), error.alias("error"))


def hash_encoder(dimensions: int = 64) -> Encoder:
    """Stands in for a model in tests: hashed word counts, signed, at length one."""

    def encode(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                row[h % dimensions] += 1 if h & 0x80000000 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length == 0, 1, length)

    return encode


def embed(df: DataFrame, encoder: Callable[[], Encoder], text: str, out: str = "embedding", batch_size: int = 256) -> DataFrame:
    """df with a vector column: the encoder, made once per task, gets the first 20,000 characters of up to batch_size texts.

    Vectors are brought to length one; a null text has a null vector.
    """
    kept = [c for c in df.columns if c != out]
    df = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = StructType([*df.schema.fields, StructField(out, ArrayType(FloatType()))])

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder()
        for whole in batches:
            for at in range(0, whole.num_rows, batch_size):
                batch = whole.slice(at, batch_size)
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                vectors = np.asarray(model([(x or "")[:MAX_CHARS] for x in texts]), np.float32)
                length = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors = vectors / np.where(length == 0, 1, length)
                rows = [None if x is None else v for x, v in zip(texts, vectors, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float32()))], names=[*batch.schema.names, out])

    return df.mapInArrow(encode, schema)


def embed_once(df: DataFrame, encoder: Callable[[], Encoder], text: str, store: str, model: str, out: str = "embedding", batch_size: int = 256) -> DataFrame:
    """embed, with each distinct text encoded once, ever: vectors are kept at store, by model and a hash of what the encoder gets of a text.

    Texts that the store lacks are found by an anti-join, encoded and appended, and vectors are joined back from there. A text that stands in very
    many rows is one row where it is encoded. If a run is repeated, or two overlap, a text may be in the store twice, and counts once.
    """
    spark = df.sparkSession
    key = F.sha2(F.substring(text, 1, MAX_CHARS), 256)
    place = f"{store.rstrip('/')}/model={model}"
    shape, batches = "text_hash string, vector array<float>", f"{place}/batch=*"
    try:
        known = spark.read.schema(shape).parquet(batches)
    except AnalysisException:  # nothing yet
        known = spark.createDataFrame([], shape)
    texts = df.where(F.col(text).isNotNull()).groupBy(key.alias("text_hash")).agg(F.min(F.substring(text, 1, MAX_CHARS)).alias("known_text"))
    new = texts.join(known.select("text_hash"), "text_hash", "left_anti")
    embed(new, encoder, "known_text", "vector", batch_size).select("text_hash", "vector").write.parquet(f"{place}/batch={uuid.uuid4().hex}")
    # read by folders, since Spark takes two readings of one path for the same table, though one has more files
    vectors = spark.read.schema(shape).parquet(batches).groupBy("text_hash").agg(F.first("vector").alias("vector"))
    kept = [F.col(f"`{c}`") for c in df.columns if c != out]
    joined = df.withColumn("text_hash_", key).join(vectors, F.col("text_hash_") == F.col("text_hash"), "left")
    return joined.select(*kept, F.col("vector").alias(out))


def validate_vectors(df: DataFrame, vector: str = "embedding", dimensions: int = DIMENSIONS) -> tuple[DataFrame, DataFrame]:
    """Rows whose vector has the right size, and the others, null ones too."""
    right = F.coalesce(F.size(vector) == dimensions, F.lit(False))
    return df.where(right), df.where(~right)
