"""Patched frame-of-reference coding of integer ids: the block format, and writing and reading it as Spark jobs.

A segment holds whole documents in order. Its ids are cut into blocks of ``BLOCK``. A block stores its
minimum, and the differences from it packed at a width that holds a given share (``percentile``) of them;
the high bits of the others go to an exception list. The start of each block's packed bytes is in the
segment's index, so that a block can be decoded alone.

Layout, little-endian: magic ``PFR1``, ids uint32, blocks uint32, exceptions uint32; then for each block
its minimum uint32, start uint32, exceptions uint16 and width uint8; the packed bytes; for each exception
its position in the block uint16 and the bits above the width uint32.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, sized_slices, slices
from .unit_encoder import unit_encoder

BLOCK = 256
HEAD = struct.Struct("<4sIII")
MAGIC = b"PFR1"

SEGMENTS = "part int, segment int, ids_before long, n_ids long, doc_ids array<long>, doc_lengths array<long>, payload binary"


def pack(ids: np.ndarray, percentile: float = 0.9) -> bytes:
    """One segment's ids, uint32, as bytes."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    padded[n:] = ids[-1] if n else 0
    padded = padded.reshape(blocks, BLOCK)
    low = padded.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = padded - low[:, None]
    rank = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    limit = np.partition(rest, rank, axis=1)[:, rank] if blocks else low
    width = np.frexp(limit.astype(np.float64))[1].astype(np.uint8)  # bits of the limit
    over = rest >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    block_of, position = np.nonzero(over)
    high = rest[block_of, position] >> width[block_of]
    sizes = width.astype(np.int64) * (BLOCK // 8)
    starts = np.cumsum(sizes) - sizes
    packed = np.zeros(int(sizes.sum()), np.uint8)
    for w in np.unique(width[width > 0]):
        which = np.nonzero(width == w)[0]
        bits = (rest[which][:, :, None] >> np.arange(w, dtype=np.uint32)).astype(np.uint8) & 1
        out = np.packbits(bits.reshape(len(which), -1), axis=1, bitorder="little")
        packed[starts[which][:, None] + np.arange(out.shape[1])] = out
    counts = np.bincount(block_of, minlength=blocks).astype("<u2")
    return b"".join([HEAD.pack(MAGIC, n, blocks, len(high)), low.astype("<u4").tobytes(), starts.astype("<u4").tobytes(), counts.tobytes(), width.tobytes(), packed.tobytes(), position.astype("<u2").tobytes(), high.astype("<u4").tobytes()])


def _index(data: bytes):
    magic, n, blocks, exceptions = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment of packed ids")
    at, out = HEAD.size, []
    for kind in ("<u4", "<u4", "<u2", "u1"):
        out.append(np.frombuffer(data, kind, blocks, at))
        at += out[-1].nbytes
    low, starts, counts, width = out
    size = int(width.astype(np.int64).sum()) * (BLOCK // 8)
    packed = np.frombuffer(data, np.uint8, size, at)
    position = np.frombuffer(data, "<u2", exceptions, at + size)
    high = np.frombuffer(data, "<u4", exceptions, at + size + position.nbytes)
    return n, low, starts, counts, width, packed, position, high


def unpack(data: bytes, blocks: np.ndarray | None = None) -> np.ndarray:
    """All ids of a segment, or those of the given block numbers only."""
    n, low, starts, counts, width, packed, position, high = _index(data)
    chosen = np.arange(len(low)) if blocks is None else np.asarray(blocks, np.int64)
    out = np.zeros((len(chosen), BLOCK), np.uint32)
    for w in np.unique(width[chosen]):
        which = np.nonzero(width[chosen] == w)[0]
        if w:
            got = packed[starts[chosen[which]].astype(np.int64)[:, None] + np.arange(int(w) * (BLOCK // 8))]
            bits = np.unpackbits(got, axis=1, bitorder="little").reshape(len(which), BLOCK, int(w))
            value = np.zeros((len(which), BLOCK), np.uint32)
            for k in range(int(w)):
                value |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
            out[which] = value
    ends = np.cumsum(counts, dtype=np.int64)
    begins = ends - counts
    take = np.repeat(begins[chosen] - np.cumsum(counts[chosen], dtype=np.int64) + counts[chosen], counts[chosen]) + np.arange(int(counts[chosen].sum()))
    row = np.repeat(np.arange(len(chosen)), counts[chosen])
    out[row, position[take]] |= high[take] << width[chosen][row].astype(np.uint32)
    out += low[chosen][:, None]
    flat = out.ravel()
    if blocks is None:
        return flat[:n]
    return flat[(chosen[:, None] * BLOCK + np.arange(BLOCK) < n).ravel()]


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, percentile: float = 0.9, segment_ids: int = 1 << 16, markers: bool = True) -> DataFrame:
    """Encodes the texts of docs (doc_id, text) and writes their ids as packed segments; returns the written table.

    Rows come in ascending doc_id, those of equal or null id by a hash of their text: a range partition,
    sorted, with segments numbered in order. All rows are kept, null ids first. ``ids_before`` counts the
    ids of the part before the segment. A null or empty text has the end id alone; an empty table gives no
    segments. Added tokens in a text get their own ids, as by the library's default; without markers they
    are plain characters. Memory holds a segment, a few MB of texts and one document.
    """

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder = TaskContext.get().partitionId(), unit_encoder(tokenizer, markers)
        number, before, held = 0, 0, 0
        names, lengths, parts = [], [], []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([pack(ids, percentile)], pa.binary())],
                names=["part", "segment", "ids_before", "n_ids", "doc_ids", "doc_lengths", "payload"],
            )

        for batch in sized_slices(batches, 1):
            ids, ends = encoder.encode(batch.column(1))
            start = 0
            for doc_id, end in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
                names.append(doc_id)
                lengths.append(end - start + 1)
                parts += [ids[start:end], np.array([end_id], np.uint32)]
                held += lengths[-1]
                start = end
                if held >= segment_ids:
                    yield flush()
                    number, before, held = number + 1, before + held, 0
                    names, lengths, parts = [], [], []
        if names:
            yield flush()

    tie = F.xxhash64("text")  # parts many rows of one doc_id
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    return materialize(ordered.mapInArrow(encode, SEGMENTS), "token-ids")


def read_ids(segments: DataFrame) -> DataFrame:
    """Per document of written segments: doc_id, start (ids before it in the whole order), n_tokens, ids_crc32.

    The driver gets one number for each written part, to turn positions in a part into positions overall.
    """
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    before, offsets = 0, {}
    for row in sorted(totals, key=lambda r: r.part):
        offsets[row.part] = before
        before += row.n

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8):
            doc_ids, starts, counts, sums = [], [], [], []
            for row in batch.to_pylist():
                ids = unpack(row["payload"]).astype("<u4")
                at, start = 0, offsets[row["part"]] + row["ids_before"]
                for doc_id, n in zip(row["doc_ids"], row["doc_lengths"], strict=True):
                    doc_ids.append(doc_id)
                    starts.append(start + at)
                    counts.append(n)
                    sums.append(zlib.crc32(ids[at : at + n].tobytes()))
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc_ids, starts, counts, sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
