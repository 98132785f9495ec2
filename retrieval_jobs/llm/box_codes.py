"""Vectors as short codes: each part of a vector is replaced by the number of the nearest entry of its part's codebook.

Rows are cut into chunks, and each part of a chunk into blocks along a Hilbert curve that store the least and greatest components
and the sum of their members. An entry that is farther than another from every corner of a block's box is nearest to none of the
block, so members are compared with the few entries left, and a block with one left is added by its sum alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from ..sources.scratch import scratch_path
from .common import materialize
from .curve_packing import hilbert_keys
from .vectors import sizes

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
CHUNK_ROWS, BLOCK_ROWS = 16_384, 16
#: Scaled components beyond this count as this, so that squared distances are whole numbers of 64 bits.
LARGEST = 1 << 24
#: A table of one row per label goes to every task up to so many rows.
SMALL = 10_000


def finite(vector: Column) -> Column:
    """Vectors that are there and hold no null, infinite or undefined component; empty ones and zeros do."""
    x = vector.cast("array<double>")
    return F.coalesce(~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))


def part_bounds(size: int, parts: int) -> list[tuple[int, int]]:
    """Where each part of a vector lies: equal parts where parts divides size."""
    return [(p * size // parts, (p + 1) * size // parts) for p in range(parts)]


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * scale), -LARGEST, LARGEST).astype(np.int64)


def curve_order(points: np.ndarray) -> np.ndarray:
    """The order of rows of whole numbers along a Hilbert curve through their box; of more than 15 components the first 15 count."""
    points = points[:, :15]
    dimensions = points.shape[1]
    if not dimensions or not len(points):
        return np.arange(len(points))
    low, high = points.min(axis=0), points.max(axis=0)
    bits = min(8, 60 // dimensions)
    cells = (points - low) * ((1 << bits) - 1) // np.maximum(1, high - low)
    keys = cells[:, 0] if dimensions == 1 else hilbert_keys(cells, bits)
    return np.argsort(keys, kind="stable")


class Blocks:
    """One part of a chunk: its rows along the curve, and of each block the box and the sums."""

    def __init__(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.rows, self.low, self.high, self.sums = rows, low, high, sums
        self.starts = np.arange(0, len(rows), BLOCK_ROWS)
        self.lengths = np.minimum(BLOCK_ROWS, len(rows) - self.starts)

    @classmethod
    def of(cls, rows: np.ndarray) -> Blocks:
        starts = np.arange(0, len(rows), BLOCK_ROWS)
        return cls(rows, np.minimum.reduceat(rows, starts, axis=0), np.maximum.reduceat(rows, starts, axis=0), np.add.reduceat(rows, starts, axis=0))

    def shortlists(self, book: np.ndarray) -> np.ndarray:
        """Which entries can be nearest to a member of each block.

        One is the nearest to the middle of the block's box. Another can win only if, at some corner of the box, its squared distance is
        less than that one's, or the same and its number lower; the difference of the two is greatest at a corner.
        """
        middle = np.zeros((len(self.low), len(book)), np.int64)
        for t in range(book.shape[1]):
            apart = (self.low[:, t] + self.high[:, t])[:, None] - 2 * book[None, :, t]
            middle += apart * apart
        first = middle.argmin(axis=1)
        ahead = np.zeros_like(middle)  # by how much another is nearer, at its best corner
        for t in range(book.shape[1]):
            one, other = book[first, t, None], book[None, :, t]
            corner = np.where(other > one, self.high[:, t, None], self.low[:, t, None])
            ahead += (other - one) * (2 * corner - one - other)
        number = np.arange(len(book))[None]
        return (ahead > 0) | ((ahead == 0) & (number <= first[:, None]))

    def _groups(self, possible: np.ndarray, chosen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks whose shortlists have like lengths, and those lists, each filled up with entries that can't win."""
        counts = possible.sum(axis=1)
        ordered = np.argsort(~possible, axis=1, kind="stable")
        width = 1
        while True:
            own = chosen[(counts[chosen] <= width) & (counts[chosen] > width // 2)]
            if len(own):
                yield own, ordered[own, : min(width, possible.shape[1])]
            if width >= possible.shape[1]:
                return
            width *= 2

    def nearest(self, book: np.ndarray, possible: np.ndarray, chosen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of the chosen blocks: rows (places in self.rows), the number of each one's nearest entry, the first of equals, and the squared distance."""
        size = book.shape[1]
        reach = int(max(np.abs(self.low).max(initial=0), np.abs(self.high).max(initial=0), np.abs(book).max(initial=0)))
        kind = np.int32 if size * (2 * reach) ** 2 < 1 << 31 else np.int64
        values, entries = self.rows.astype(kind), book.astype(kind)
        for own, lists in self._groups(possible, chosen):
            step = max(1, (1 << 20) // (BLOCK_ROWS * lists.shape[1]))
            for at in range(0, len(own), step):
                blocks, wanted = own[at : at + step], lists[at : at + step]
                places = np.minimum(self.starts[blocks, None] + np.arange(BLOCK_ROWS), len(self.rows) - 1)
                x, c = values[places], entries[wanted]
                distance = np.zeros((len(blocks), BLOCK_ROWS, wanted.shape[1]), kind)
                for t in range(size):
                    apart = x[:, :, None, t] - c[:, None, :, t]
                    distance += apart * apart
                first = distance.argmin(axis=2)
                there = np.arange(BLOCK_ROWS) < self.lengths[blocks, None]
                yield places[there], np.take_along_axis(wanted, first, axis=1)[there], np.take_along_axis(distance, first[:, :, None], axis=2)[:, :, 0][there].astype(np.int64)

    def add_to(self, book: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
        """Adds every row to the sums and counts of its nearest entry."""
        possible = self.shortlists(book)
        alone = possible.sum(axis=1) == 1
        only = possible[alone].argmax(axis=1)
        np.add.at(counts, only, self.lengths[alone])
        np.add.at(sums, only, self.sums[alone])
        for places, entry, _ in self.nearest(book, possible, np.flatnonzero(~alone)):
            counts += np.bincount(entry, minlength=len(book))
            for t in range(book.shape[1]):
                sums[:, t] += np.bincount(entry, self.rows[places, t], len(book)).astype(np.int64)

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of every row and its squared distance."""
        entry, distance = np.zeros(len(self.rows), np.int64), np.zeros(len(self.rows), np.int64)
        for places, number, apart in self.nearest(book, self.shortlists(book), np.arange(len(self.low))):
            entry[places], distance[places] = number, apart
        return entry, distance


def _chunked(vectors: DataFrame, size: int, parts: int, scale: int) -> DataFrame:
    """vectors (vec_id, label, embedding of that size) as a written table of chunks: ids, labels, and for all parts the order, rows, boxes and sums as bytes."""
    bounds = part_bounds(size, parts)

    def chunk(table: pa.Table) -> pa.RecordBatch:
        rows = table.num_rows
        whole = scaled(table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, size), scale)
        order, values, low, high, sums = [], [], [], [], []
        for a, b in bounds:
            along = curve_order(whole[:, a:b])
            blocks = Blocks.of(whole[along, a:b])
            order.append(along.astype("<u2").tobytes())
            for out, x, kind in ((values, blocks.rows, "<i4"), (low, blocks.low, "<i4"), (high, blocks.high, "<i4"), (sums, blocks.sums, "<i8")):
                out.append(x.astype(kind).tobytes())
        held = [pa.array([b"".join(x)], pa.binary()) for x in (order, values, low, high, sums)]
        lists = [pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), table[c].combine_chunks()) for c in ("vec_id", "label")]
        return pa.RecordBatch.from_arrays([*lists, pa.array([rows], pa.int32()), *held], names=["vec_ids", "labels", "n", "order", "rows", "low", "high", "sums"])

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            while count >= CHUNK_ROWS:
                table = pa.Table.from_batches(held)
                yield chunk(table.slice(0, CHUNK_ROWS))
                held, count = table.slice(CHUNK_ROWS).to_batches(), count - CHUNK_ROWS
        if count:
            yield chunk(pa.Table.from_batches(held))

    lists = [StructField(f"{c}s", ArrayType(vectors.schema[c].dataType)) for c in ("vec_id", "label")]
    schema = StructType([*lists, StructField("n", IntegerType()), *[StructField(c, BinaryType()) for c in ("order", "rows", "low", "high", "sums")]])
    path = scratch_path(vectors.sparkSession, "vector-blocks")
    # a row is a chunk; small row groups keep few of them in memory
    vectors.select("vec_id", "label", "embedding").mapInArrow(chunks, schema).write.option("parquet.block.size", 8 << 20).parquet(path)
    return vectors.sparkSession.read.schema(schema).parquet(path)


def _blocks(batch: pa.RecordBatch, row: int, bounds: list[tuple[int, int]]) -> Iterator[Blocks]:
    """The parts of one chunk of the table, in order."""
    rows = batch.column("n")[row].as_py()
    size = bounds[-1][1]
    count = -(-rows // BLOCK_ROWS)

    def read(name: str, kind: str, height: int) -> list[np.ndarray]:
        flat = np.frombuffer(batch.column(name)[row].as_buffer(), kind).astype(np.int64)
        assert len(flat) == height * size
        return [flat[height * a : height * b].reshape(height, b - a) for a, b in bounds]

    yield from map(Blocks, read("rows", "<i4", rows), read("low", "<i4", count), read("high", "<i4", count), read("sums", "<i8", count))


def _better(chunks: DataFrame, books: list[np.ndarray], bounds: list[tuple[int, int]]) -> list[np.ndarray]:
    """The codebooks after one round: each entry the floored mean of the rows nearest to it, or as it was where there are none.

    Tasks send sums, at most one for each component of each entry, and so many come to the driver.
    """

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for row in range(batch.num_rows):
                for blocks, book, own, count in zip(_blocks(batch, row, bounds), books, sums, counts, strict=True):
                    blocks.add_to(book, own, count)
        out = [(p, e, t, int(own[e, t]), int(count[e])) for p, (own, count) in enumerate(zip(sums, counts, strict=True)) for e in np.flatnonzero(count).tolist() for t in range(own.shape[1])]
        columns = [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "place", "total", "members"])

    summed = chunks.select("n", "rows", "low", "high", "sums").mapInArrow(add, "part long, entry long, place long, total long, members long")
    new = [b.copy() for b in books]
    for r in summed.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("members").alias("members")).collect():
        new[r.part][r.entry, r.place] = r.total // r.members
    return new


def _coded(chunks: DataFrame, books: list[np.ndarray], bounds: list[tuple[int, int]]) -> DataFrame:
    """vec_id, label, code and error of every row of the chunks."""

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                rows = batch.column("n")[row].as_py()
                orders = np.frombuffer(batch.column("order")[row].as_buffer(), "<u2").reshape(len(bounds), rows)
                codes, error = np.zeros((rows, len(bounds)), np.uint8), np.zeros(rows, np.int64)
                for p, (blocks, book, order) in enumerate(zip(_blocks(batch, row, bounds), books, orders, strict=True)):
                    entry, distance = blocks.assign(book)
                    codes[order, p] = entry
                    error[order] += distance
                text, wide = codes.tobytes().hex(), 2 * len(bounds)
                own = [text[at : at + wide] for at in range(0, len(text), wide)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_ids")[row].values, batch.column("labels")[row].values, pa.array(own, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    fields = {f.name: f.dataType for f in chunks.schema}
    schema = StructType([StructField("vec_id", fields["vec_ids"].elementType), StructField("label", fields["labels"].elementType), StructField("code", StringType()), StructField("error", LongType())])
    return chunks.mapInArrow(assign, schema)


def compressed_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """(vec_id, label, code, error, codebooks_sha256) of vectors (vec_id, label, embedding), and the codebooks by vector size.

    Vectors that are null or hold a null or non-finite component are left out. A component x counts as floor(scale * x), or as 2**24
    where that is larger (in either direction). Each part's codebook starts as that part of the vectors with the smallest ids (null
    last, equal ids in order of components), and is bettered in rounds: rows go to the nearest entry, ties to the lower number, and an
    entry becomes the floored mean of its rows. All distances are whole numbers, so partitions and order don't change a bit. Vectors
    of each size have codebooks of their own; where parts doesn't divide the size, parts differ by one component. Equal rows count
    each. At most 256 entries. No vectors give no rows and no codebooks.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes have two hexadecimal digits for each part, so 1 to 256 entries")
    kept = vectors.select("vec_id", "label", "embedding").where(finite(F.col("embedding")))
    books, coded = {}, []
    for size in sizes(kept):
        own = kept.where(F.size("embedding") == size)
        bounds = part_bounds(size, parts)
        first = own.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").collect()
        start = scaled(np.array([r.embedding for r in first], np.float64).reshape(len(first), size), scale)
        found = [start[:, a:b].copy() for a, b in bounds]
        chunks = _chunked(own, size, parts, scale)
        for _ in range(rounds):
            found = _better(chunks, found, bounds)
        books[size] = found
        written = ",".join(str(x) for book in found for x in book.ravel().tolist())
        coded.append(_coded(chunks, found, bounds).withColumn("codebooks_sha256", F.lit(hashlib.sha256(written.encode()).hexdigest())))
    if not coded:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit("").alias("codebooks_sha256")), books
    out = coded[0]
    for more in coded[1:]:
        out = out.unionByName(more)
    return materialize(out, "vector-codes"), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the errors of all rows of the label added up; null labels are one label."""
    totals = materialize(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    few = totals.count() <= SMALL
    return coded.join(F.broadcast(totals) if few else totals, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def decoded(code: str, books: list[np.ndarray], scale: int = SCALE) -> np.ndarray:
    """The vector that a code stands for: the middles of the cells of its entries."""
    numbers = bytes.fromhex(code)
    return (np.concatenate([book[n] for book, n in zip(books, numbers, strict=True)]) + 0.5) / scale
