"""Packing along a space-filling curve: similar documents share sequences, with next to no padding."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import sized_slices, slices
from .unit_encoder import unit_encoder

DIMENSIONS, BITS, FEATURES, SEED = 3, 16, 4096, 20

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of unsigned coordinates below 2**bits.

    From the highest bit down, the curve's frame is turned: where a coordinate's bit is set, the first
    coordinate's lower bits are inverted, else they change places with that coordinate's. The bits then
    form a Gray code, read off coordinate by coordinate.
    """
    x = points.astype(np.uint64).T.copy()
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        below = (one << np.uint64(b)) - one
        for d in range(len(x)):
            is_set = ((x[d] >> np.uint64(b)) & one).astype(bool)
            swap = np.where(is_set, np.uint64(0), (x[0] ^ x[d]) & below)
            x[0] ^= np.where(is_set, below, swap)
            x[d] ^= swap
    for d in range(1, len(x)):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint64(b)) & one == one, (one << np.uint64(b)) - one, np.uint64(0))
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(len(x)):
            key = (key << one) | ((x[d] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def document_points(texts: list[str]) -> np.ndarray:
    """Coordinates of texts: hashed byte trigrams, as a unit vector, projected on fixed random directions."""
    axes = np.random.default_rng(SEED).standard_normal((FEATURES, DIMENSIONS))
    out = np.zeros((len(texts), DIMENSIONS))
    for k, text in enumerate(texts):
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
        if len(raw) < 3:
            continue
        mixed = (raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)) * np.uint32(2654435761)
        vector = np.bincount(mixed >> np.uint32(20), minlength=FEATURES).astype(np.float64)
        out[k] = vector @ axes / np.linalg.norm(vector)
    spread = 4.0  # coordinates of unit vectors are standard normal over the directions
    return ((np.clip(out / spread, -1, 1) + 1) / 2 * (2**BITS - 1)).astype(np.uint32)


def with_curve_key(docs: DataFrame) -> DataFrame:
    """Columns doc_id, text and curve_key of docs."""

    def key(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            keys = hilbert_keys(document_points([x or "" for x in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64())], names=["doc_id", "text", "curve_key"])

    return docs.select("doc_id", "text").mapInArrow(key, "doc_id long, text string, curve_key long")


def pack_along_curve(docs: DataFrame, tokenizer: str, end_id: int, sequence_tokens: int = 4096, markers: bool = True) -> DataFrame:
    """Cuts the ids of docs (doc_id, text), in Hilbert order, into sequences; returns one row per piece.

    The order is a range partition by (curve key, doc_id), so many copies of one text still spread over
    tasks. Each task fills sequences without gaps, cutting documents freely; what is left at its end
    goes to sequences whose lengths are powers of two, which need no padding. Ids of sequences hold the
    task's number in the high bits. A null text counts as empty and has the end id alone; rows with
    equal doc_id are packed one by one. Added tokens in a text get their own ids, as by the library's
    default; without markers they are plain characters. Memory holds a few MB of texts and one document.
    """

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, encoder = TaskContext.get().partitionId() << 40, unit_encoder(tokenizer, markers)
        number = 0
        held: list[tuple] = []  # documents, or their rest, that wait for a full sequence
        waiting = 0

        def cut(size: int) -> list[tuple]:
            """Takes the next size ids as one sequence."""
            nonlocal held, waiting, number
            rows, offset = [], 0
            while offset < size:
                doc_id, ids, start, total = held[0]
                n = min(size - offset, len(ids) - start)
                rows.append((doc_id, start, n, zlib.crc32(ids[start : start + n].tobytes()), total, base | number, offset, size))
                offset += n
                if start + n == len(ids):
                    held.pop(0)
                else:
                    held[0] = (doc_id, ids, start + n, total)
            waiting -= size
            number += 1
            return rows

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"])

        for batch in sized_slices(batches, 1):
            rows = []
            ids, ends = encoder.encode(batch.column(1))
            start = 0
            for doc_id, end in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
                own = np.append(ids[start:end], np.uint32(end_id)).astype("<u4")
                held.append((doc_id, own, 0, len(own)))
                waiting += len(own)
                start = end
                while waiting >= sequence_tokens:
                    rows += cut(sequence_tokens)
            if rows:
                yield batch_of(rows)
        rows = []
        while waiting:
            rows += cut(1 << (waiting.bit_length() - 1))
        if rows:
            yield batch_of(rows)

    keyed = with_curve_key(docs).repartitionByRange("curve_key", "doc_id").sortWithinPartitions("curve_key", "doc_id")
    return keyed.select("doc_id", "text").mapInArrow(fill, PIECES)
