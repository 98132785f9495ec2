"""Ranking chunks for questions by cosine distance: exact, over all chunks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark import Accumulator, TaskContext
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from ..functions.vectors import cosine_distance
from ..sources.scratch import scratch_path

DEFAULT_K = 50
#: Questions of this many bytes at most go to every task, which then holds them all with their hits, if the tasks then send on this many hits at most; else chunks and questions meet by shuffles.
PASS_BYTES, PASS_HITS = 8 << 20, 20_000_000
BLOCK_BYTES, CHUNK_BLOCK, QUESTION_BLOCK = 1 << 20, 2048, 1024  # of vectors packed in one row
#: Groups that the questions of a tenant and agent are dealt to, where they meet chunks by shuffles, and the blocks of questions in one at most.
SPREAD, GROUP_BLOCKS = 32, 32
PASS_ROWS = 500_000  # rows that say which group asks for which list, at most so many of which go to every task
HELD_HITS = 2_000_000  # hits that a task holds of questions that go to all tasks, before it sends them on
#: Stand for an undefined distance, a missing one, and a chunk that isn't asked for; so they sort last.
UNDEFINED, MISSING, EXCLUDED = 1e300, 2e300, 3e300
ROUNDING = 1e-9  # added to bounds, so that rounding errors don't cut off a hit
SINGLE = 2.0**-23  # for each component, twice as much as single precision may take from a cosine
JOINED_BLOCKS, JOINED_ROWS = 64, 1024  # blocks of one list, and their rows before the last, that are compared at once


class Vectors:
    """A column of vectors: by size, the rows of that size with their values and lengths (NaN where a component is missing)."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        self.rows = len(column)
        there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        held = column.drop_null()
        sizes = held.value_lengths().to_numpy(zero_copy_only=False) if len(held) else np.zeros(0, np.int64)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            flat = held.take(pa.array(own)).flatten()
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), size)
            whole = flat.is_valid().to_numpy(zero_copy_only=False).reshape(len(own), size).all(axis=1)
            values[~whole] = 0
            self.by_size[size] = there[own], values, np.sqrt((values * values).sum(axis=1)), whole
        sizes = [size for size, (rows, _, _, whole) in self.by_size.items() if len(rows) == self.rows and whole.all()]
        self.alone = sizes[0] if sizes else None  # the size of all rows, if each has a vector without gaps
        length = self.by_size[sizes[0]][2] if sizes else np.zeros(1)
        self.proper = bool(length.all() and np.isfinite(length).all())  # each has an angle to every other of its size

    @cached_property
    def unit(self) -> np.ndarray:
        """Proper vectors brought to length one, in single precision."""
        _, x, length, _ = self.by_size[self.alone]
        return (x / length[:, None]).astype(np.float32)

    def pair_distances(self, other: Vectors, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Cosine distances of pairs of proper vectors of one size."""
        (_, x, length, _), (_, y, other_length, _) = self.by_size[self.alone], other.by_size[other.alone]
        out = np.empty(len(rows))
        step = max(1, BLOCK_BYTES // x.shape[1])
        for at in range(0, len(rows), step):
            a, b = rows[at : at + step], columns[at : at + step]
            out[at : at + step] = 1 - np.einsum("ij,ij->i", x[a], y[b]) / (length[a] * other_length[b])
        return out

    def distances(self, other: Vectors, chosen: np.ndarray) -> np.ndarray:
        """Cosine distances of the chosen rows (ascending) from all rows of other.

        MISSING where either is null, lacks a component, or they differ in size; UNDEFINED where either is zero or not a number.
        """
        alone = self.alone, other.alone
        if None not in alone and alone[0] == alone[1]:  # whole vectors of one size, as nearly all are
            _, x, length, _ = self.by_size[alone[0]]
            _, y, other_length, _ = other.by_size[alone[1]]
            if len(chosen) < self.rows:
                x, length = x[chosen], length[chosen]
            scale = np.outer(length, other_length)
            with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                out = x @ y.T
                out /= scale
                np.subtract(1, out, out=out)
            odd = np.isnan(out)
            if not (length.all() and other_length.all()):
                odd |= scale == 0
            out[odd] = UNDEFINED
            return out
        out = np.full((len(chosen), other.rows), MISSING)
        for size, (rows, x, length, whole) in self.by_size.items():
            mine = np.flatnonzero(np.isin(rows, chosen, assume_unique=True) & whole)
            for other_size, (columns, y, other_length, other_whole) in other.by_size.items():
                theirs = np.flatnonzero(other_whole)
                scale = np.outer(length[mine], other_length[theirs])
                if size == other_size:
                    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                        part = 1 - x[mine] @ y[theirs].T / scale
                else:
                    part = np.full(scale.shape, MISSING)
                part[(scale == 0) | np.isnan(part)] = UNDEFINED
                out[np.ix_(np.searchsorted(chosen, rows[mine]), columns[theirs])] = part
        return out

    def within(self, centers: np.ndarray, radii: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """For each row and center, whether a vector within the radius (an angle) of the center can be as near as the row's limit; true where a distance isn't a number."""
        out = np.ones((self.rows, len(centers)), bool)
        if centers.shape[1] in self.by_size:
            rows, x, length, whole = self.by_size[centers.shape[1]]
            good = np.flatnonzero(whole & (length > 0) & np.isfinite(length))
            if len(good) < len(x):
                rows, x, length = rows[good], x[good], length[good]
            angle = np.arccos(np.clip(1 - limits[rows] - ROUNDING, -1, 1))
            out[rows] = (x @ centers.T) / length[:, None] >= np.cos(np.minimum(np.pi, angle[:, None] + radii)) - ROUNDING
        return out


def sphere(vectors: pa.Array) -> tuple[np.ndarray, float]:
    """The middle direction of vectors of one size, none zero, and the largest angle of any from it; the angle is undefined where there is no such direction."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    center = x.mean(axis=0)
    length = np.linalg.norm(center)
    center = (center / length if length > 1e-12 else x[0]).astype(np.float32).astype(np.float64)
    center /= np.linalg.norm(center)
    return center, float(np.arccos(np.clip(x @ center, -1, 1)).max()) + 1e-6


def packed(df: DataFrame, keys: list[str], vector: str, rows: int, spheres: bool = False) -> DataFrame:
    """Rows of df in blocks of equal keys: the keys, a number for the block, and the other columns as the bytes of an Arrow stream.

    Blocks are made of what a task reads at once, of at most so many rows or about BLOCK_BYTES of vectors. With spheres, keys hold size, the
    vectors' number of components, and each block has n, center and radius too; the radius is NaN where size is 0, which stands
    for vectors that are nothing to measure an angle by. Where rows have asked_lists, each block has lists, all that are among them.
    """
    others = [c for c in df.columns if c not in keys]
    schema = StructType([*[df.schema[c] for c in keys], StructField("block", LongType()), StructField("packed", BinaryType())])
    if spheres:
        schema = StructType([*schema.fields, StructField("n", IntegerType()), StructField("center", ArrayType(DoubleType())), StructField("radius", DoubleType())])
    if "asked_lists" in others:
        schema = StructType([*schema.fields, StructField("lists", ArrayType(IntegerType()))])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.zeros(batch.num_rows, np.int64)
            for c in keys:
                own = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                codes = codes * (int(own.max()) + 1) + own
            order = np.argsort(codes, kind="stable")
            codes, batch = codes[order], batch.take(pa.array(order))
            flat = batch.column(vector).flatten()
            step = max(16, min(rows, BLOCK_BYTES * batch.num_rows // max(1, flat.nbytes)))
            starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            places = [at for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True) for at in range(a, b, step)]
            blocks = []
            for a, b in zip(places, [*places[1:], batch.num_rows], strict=True):
                sink = pa.BufferOutputStream()
                part = batch.select(others).slice(a, b - a)
                with pa.ipc.new_stream(sink, part.schema) as stream:
                    stream.write_batch(part)
                blocks.append(sink.getvalue().to_pybytes())
            firsts = batch.select(keys).take(pa.array(places))
            numbers = pa.array(range(number, number + len(blocks)), pa.int64())
            number += len(blocks)
            columns = [*firsts.columns, numbers, pa.array(blocks, pa.binary())]
            if spheres:
                sizes = firsts.column("size").to_pylist()
                ends = [*places[1:], batch.num_rows]
                found = [sphere(batch.column(vector).slice(a, b - a)) if size else (None, float("nan")) for a, b, size in zip(places, ends, sizes, strict=True)]
                columns += [pa.array([b - a for a, b in zip(places, ends, strict=True)], pa.int32()), pa.array([c for c, _ in found], pa.list_(pa.float64())), pa.array([r for _, r in found], pa.float64(), from_pandas=False)]
            if "asked_lists" in others:
                asked = batch.column("asked_lists")
                found = [np.bitwise_or.reduce(bit_rows(asked.slice(a, b - a))) for a, b in zip(places, [*places[1:], batch.num_rows], strict=True)]
                columns.append(pa.array([np.flatnonzero(np.unpackbits(bits)).astype(np.int32) for bits in found], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(*keys, *others).mapInArrow(pack, schema)


def bit_rows(column: pa.Array) -> np.ndarray:
    """The bytes of a binary column, a row for each of its own, zeros after shorter ones."""
    rows = column.to_pylist()
    width = max(map(len, rows), default=0)
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in rows), np.uint8).reshape(len(rows), width)


def unpacked(block: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(block.as_buffer()).read_all()


class Chunks:
    """Blocks of chunks of one list that are compared at once, each with a center and radius of its own if they have such."""

    def __init__(self, tables: list[pa.Table], centers: list[np.ndarray | None], radii: list[float | None], list_id: int | None):
        self.tables, self.centers, self.radii, self.list_id = tables, centers, radii, list_id

    @cached_property
    def table(self) -> pa.Table:
        return pa.concat_tables(self.tables).combine_chunks() if len(self.tables) > 1 else self.tables[0]

    @cached_property
    def vectors(self) -> Vectors:
        return Vectors(self.table["embedding"])

    @cached_property
    def each(self) -> list[Chunks]:
        return [Chunks([t], [c], [r], self.list_id) for t, c, r in zip(self.tables, self.centers, self.radii, strict=True)]

    def beside(self, center: np.ndarray | None, radius: float | None, list_id: int | None) -> bool:
        """May a block with these be compared at once with the others?"""
        if list_id != self.list_id or len(self.tables) >= JOINED_BLOCKS or sum(t.num_rows for t in self.tables) >= JOINED_ROWS:
            return False
        if radius is None or self.radii[0] is None:
            return radius is self.radii[0]
        return not (np.isnan(radius) or np.isnan(self.radii[0])) and len(center) == len(self.centers[0])


class Asked:
    """A block of questions in a task, and the nearest chunks found for them so far."""

    def __init__(self, block: pa.Scalar, k: int):
        table, self.k = unpacked(block), k
        self.vectors = Vectors(table["query_embedding"])
        wanted = table["wanted_document"].to_pylist()
        self.wanted = {place: name for place, name in enumerate(wanted) if name}
        limits = table["limit"].to_numpy().astype(np.float64)
        self.limits = np.where(np.isnan(limits), EXCLUDED, limits)  # what is farther doesn't count
        # by eights of lists, so that who asks for a list is found in one stretch of bytes
        self.asks = np.ascontiguousarray(bit_rows(table["asked_lists"].combine_chunks()).T) if "asked_lists" in table.column_names else None
        # a copy, since what is unpacked lies in the memory of the whole batch that it came in, which would stay as long as the questions are open
        self.table = table.select(["tenant_id", "query_id"]).take(pa.array(np.arange(len(table))))
        self.found: list[pa.Table] = []
        self.held = 0

    def askers(self, list_id: int | None) -> np.ndarray:
        """The questions that ask for a list."""
        if self.asks is None:
            return np.arange(len(self.table))
        if list_id is None or not 0 <= list_id < 8 * len(self.asks):
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.asks[list_id >> 3] & (128 >> (list_id & 7)))

    def visit(self, chunks: Chunks) -> int:
        """Compares the questions with blocks of chunks, but for those that the list, or a block's center and radius, keep them from; how many pairs that were."""
        own = self.askers(chunks.list_id)
        radius = chunks.radii[0]
        if radius is None or not len(own):
            return self.compare(chunks, own)
        if np.isnan(radius):  # a block without proper distances, for questions that have too few others
            return self.compare(chunks, own[self.limits[own] >= UNDEFINED])
        near = self.vectors.within(np.array(chunks.centers), np.array(chunks.radii), self.limits)[own]
        if len(chunks.tables) == 1:
            return self.compare(chunks, own[near[:, 0]])
        if 2 * np.count_nonzero(near) >= near.size:  # few would be left out, and small blocks one by one take longer
            return self.compare(chunks, own[near.any(axis=1)])
        return sum(self.visit(chunks.each[n]) for n in np.flatnonzero(near.any(axis=0)).tolist())

    def compare(self, chunks: Chunks, chosen: np.ndarray) -> int:
        """Keeps what chunks the chosen questions (ascending) find among these; how many pairs were compared."""
        if not len(chosen):
            return 0
        vectors, columns = chunks.vectors, chunks.table.num_rows
        asking = [n for n, place in enumerate(chosen.tolist()) if place in self.wanted] if self.wanted else []
        if asking:
            names = chunks.table["document_id"].combine_chunks().dictionary_encode()
            code = {name: n for n, name in enumerate(names.dictionary.to_pylist())}
            of = names.indices.fill_null(-1).to_numpy()
            want = np.array([code.get(self.wanted[place], -2) for place in chosen[asking].tolist()])
            other = of != want[:, None]
        free = np.flatnonzero(self.limits[chosen] >= UNDEFINED) if columns > self.k else np.zeros(0, np.int64)
        if self.vectors.proper and vectors.proper and self.vectors.alone == vectors.alone:
            # single precision finds what may be near enough, by more than its errors; distances are those of double precision
            slack = (vectors.alone + 8) * SINGLE
            likeness = (self.vectors.unit if len(chosen) == self.vectors.rows else self.vectors.unit[chosen]) @ vectors.unit.T
            if asking:
                likeness[asking] = np.where(other, -np.inf, likeness[asking])
            if len(free):
                near = np.partition(likeness[free], columns - self.k, axis=1)[:, columns - self.k].astype(np.float64)
                self.limits[chosen[free]] = np.where(np.isfinite(near), 1 - near + slack, self.limits[chosen[free]])
            least = np.maximum(1 - self.limits[chosen] - ROUNDING - slack, -2).astype(np.float32)
            row, column = np.divmod(np.flatnonzero((likeness >= least[:, None]).ravel()), columns)
            distance = self.vectors.pair_distances(vectors, chosen[row], column)
            kept = distance <= self.limits[chosen[row]] + ROUNDING
            row, column, distance = row[kept], column[kept], distance[kept]
        else:
            every = self.vectors.distances(vectors, chosen)
            if asking:
                every[asking] = np.where(other, EXCLUDED, every[asking])
            if len(free):
                near = np.partition(every[free], self.k - 1, axis=1)[:, self.k - 1]
                self.limits[chosen[free]] = np.minimum(self.limits[chosen[free]], near)
            row, column = np.nonzero((every <= self.limits[chosen, None] + ROUNDING) & (every < EXCLUDED))
            distance = every[row, column]
        if len(row):
            keys = chunks.table.select(["chunk_id", "row_key"]).take(pa.array(column))
            self.found.append(keys.append_column("question", pa.array(chosen[row].astype(np.int64))).append_column("distance", pa.array(distance)))
            self.held += len(row)
            if self.held > 4 * self.k * len(self.table) + 10_000:
                self.compact()
        return len(chosen) * columns

    def compact(self) -> None:
        """Keeps the k nearest of each question, ties by chunk_id, and lets nothing farther in."""
        if not self.found:
            return
        found = pa.concat_tables(self.found).combine_chunks()
        found = found.sort_by([("question", "ascending"), ("distance", "ascending"), ("chunk_id", "ascending")])
        question = found["question"].to_numpy()
        place = np.arange(len(question)) - np.searchsorted(question, question, "left")
        last = np.flatnonzero(place == self.k - 1)
        self.limits[question[last]] = np.minimum(self.limits[question[last]], found["distance"].to_numpy()[last])
        self.found = [found.filter(pa.array(place < self.k))]
        self.held = len(self.found[0])

    def hits(self) -> Iterator[pa.RecordBatch]:
        self.compact()
        for found in self.found:
            distance = found["distance"].to_numpy()
            asked = self.table.take(found["question"].combine_chunks())
            # null where a distance is missing, NaN where it is undefined
            shown = pa.array(np.where(distance == UNDEFINED, np.nan, distance), pa.float64(), mask=distance == MISSING, from_pandas=False)
            columns = [asked["tenant_id"], asked["query_id"], found["chunk_id"], found["row_key"], pa.chunked_array([shown])]
            yield from pa.Table.from_arrays(columns, names=["tenant_id", "query_id", "chunk_id", "row_key", "distance"]).to_batches()
        self.found, self.held = [], 0


def asked_rows(queries: DataFrame) -> DataFrame:
    """What a search needs of its questions; an empty agent or document stands for any."""
    agent = F.when(F.col("agent_id") != "", F.col("agent_id"))
    document = F.when(F.col("wanted_document") != "", F.col("wanted_document").cast("string"))
    limit = F.col("limit").cast("double") if "limit" in queries.columns else F.lit(None).cast("double")
    asked = queries.select("query_id", "tenant_id", agent.alias("asked_agent"), document.alias("wanted_document"), "query_embedding", limit.alias("limit"))
    return asked.where(F.col("tenant_id").isNotNull())


def row_key() -> Column:
    return F.xxhash64("agent_id", F.col("document_id").cast("string"), "embedding")


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """What a search needs of chunks, without their texts. row_key tells rows of one chunk_id apart."""
    return chunks.where(F.col("tenant_id").isNotNull()).select("tenant_id", "agent_id", F.col("document_id").cast("string").alias("document_id"), "chunk_id", row_key().alias("row_key"), "embedding")


def met_blocks(asked: DataFrame, chunks: DataFrame, k: int, kinds: tuple[str, str, str], pass_bytes: int = PASS_BYTES, compared: Accumulator | None = None) -> DataFrame:
    """tenant_id, query_id, chunk_id, row_key and distance: in each task, the k best chunks of each question among the blocks that it meets.

    asked: rows as asked_rows gives them; chunks: blocks with tenant_id, agent_id, packed, center, radius and list_id. Blocks of equal tenants meet where the
    questions name no agent, or the chunks'; if questions have asked_lists, only with chunks of these. Questions are packed into a written table
    first, so that their size is known: a small one goes to all tasks and chunks stay where they are. Otherwise the questions of a tenant and agent are
    dealt to groups, and the chunks that a group asks for are sent to its task, where they pass one after another: each question
    is sent once and gets k hits in all, and a chunk is sent SPREAD times, or once for GROUP_BLOCKS blocks of questions where there are very many.
    """
    spark = asked.sparkSession
    path = scratch_path(spark, "questions")
    listed = "asked_lists" in asked.columns
    order = [*["tenant_id", "asked_agent"], *(["nearest_list"] if listed else [])]  # so that a block's questions ask for much the same lists
    dealt = asked.repartition("tenant_id", F.pmod(F.xxhash64("query_id"), F.lit(8))).sortWithinPartitions(*order).drop("nearest_list").withColumn("tenant", F.col("tenant_id"))
    blocks = packed(dealt, ["tenant", "asked_agent"], "query_embedding", QUESTION_BLOCK).withColumnsRenamed({"packed": "asked", "block": "asked_block"})
    written = Observation()
    asks = F.sum(F.size("lists") if listed else F.lit(1))
    blocks.observe(written, F.sum(F.octet_length("asked")).alias("bytes"), F.count(F.lit(1)).alias("blocks"), asks.alias("asks")).write.parquet(path)
    blocks = spark.read.schema(blocks.schema).parquet(path)
    few = (written.get["bytes"] or 0) <= pass_bytes and written.get["blocks"] * QUESTION_BLOCK * k * chunks.rdd.getNumPartitions() <= PASS_HITS
    held = chunks.withColumnsRenamed({"tenant_id": "_tenant", "list_id": "_list"})
    same = (F.col("tenant") == F.col("_tenant")) & (F.col("asked_agent").isNull() | (F.col("asked_agent") == F.col("agent_id")))
    shown = ["asked_block", "asked", "packed", "center", "radius", "_list"]
    if few:
        if listed:  # lets Spark read only the folders of lists that some question asks for
            lists = blocks.select("tenant", F.explode("lists").alias("list_id")).where("list_id >= 0").distinct()
            held = held.join(F.broadcast(lists), (F.col("tenant") == F.col("_tenant")) & (F.col("list_id") == F.col("_list")), "left_semi")
            same = same & F.array_contains("lists", F.col("_list"))
        met = held.join(F.broadcast(blocks), same).select(F.lit(None).cast("long").alias("met_group"), *shown)
    else:
        own = Window.partitionBy("tenant", "asked_agent")
        number, count = F.row_number().over(own.orderBy("asked_block")) - 1, F.count("*").over(own)
        parts = F.greatest(F.least(count, F.lit(SPREAD)), F.ceil(count / GROUP_BLOCKS))
        places = blocks.select("tenant", "asked_agent", "asked_block").withColumn("part", F.floor(number * parts / count)).select("asked_block", "part")
        grouped = blocks.join(places, "asked_block")
        tasks = max(SPREAD, int(spark.conf.get("spark.sql.shuffle.partitions")))
        grouped = grouped.withColumns({"met_group": F.xxhash64("tenant", "asked_agent", "part"), "task": F.pmod(F.xxhash64("tenant", "asked_agent") + F.col("part"), F.lit(tasks)).cast("int")})
        group = ["tenant", "asked_agent", "part", "met_group", "task"]
        if listed:
            groups = grouped.select(*group, F.explode("lists").alias("list_id")).where("list_id >= 0").distinct()
            same = same & (F.col("list_id") == F.col("_list"))
        else:
            groups = grouped.select(*group).distinct()
        if (written.get["asks"] or 0) <= PASS_ROWS:
            groups = F.broadcast(groups)
        copies = held.join(groups, same).select("task", "met_group", "packed", "center", "radius", "_list")
        met = grouped.select("task", "met_group", "asked_block", "asked").unionByName(copies, allowMissingColumns=True)
        met = met.repartitionById(tasks, "task").sortWithinPartitions("met_group", F.asc_nulls_last("asked_block"), "_list").select("met_group", *shown)

    def held_now(open_: dict[int, Asked]) -> int:
        return sum(a.held + len(a.table) for a in open_.values())

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, Asked] = {}
        group, last, chunks = None, None, None

        def compare(askers: Iterable[Asked]) -> None:
            for asker in askers:
                pairs = asker.visit(chunks)
                if compared is not None:
                    compared.add(pairs)

        for batch in batches:
            centers, radii, lists = batch.column("center"), batch.column("radius").to_pylist(), batch.column("_list").to_pylist()
            for n, (its, number) in enumerate(zip(batch.column("met_group").to_pylist(), batch.column("asked_block").to_pylist(), strict=True)):
                if its != group:
                    if chunks is not None:
                        compare(open_.values())
                    for a in open_.values():
                        yield from a.hits()
                    group, open_, chunks = its, {}, None
                if number is not None and number not in open_:
                    open_[number] = Asked(batch.column("asked")[n], k)
                if not batch.column("packed")[n].is_valid:
                    continue
                block = batch.column("packed")[n].as_buffer()
                center = centers[n].values.to_numpy().astype(np.float64) if centers[n].is_valid else None
                if group is not None:  # the group's questions have come, and its chunks pass
                    if chunks is not None and chunks.beside(center, radii[n], lists[n]):
                        chunks.tables.append(unpacked(batch.column("packed")[n]))
                        chunks.centers.append(center)
                        chunks.radii.append(radii[n])
                    else:
                        if chunks is not None:
                            compare(open_.values())
                        chunks = Chunks([unpacked(batch.column("packed")[n])], [center], [radii[n]], lists[n])
                    continue
                if last is None or not block.equals(last):
                    last, chunks = block, Chunks([unpacked(batch.column("packed")[n])], [center], [radii[n]], lists[n])
                compare([open_[number]])
                if held_now(open_) > HELD_HITS:
                    for a in open_.values():
                        a.compact()
                    if held_now(open_) > HELD_HITS // 2:
                        for a in open_.values():
                            yield from a.hits()
                        open_ = {}
        if group is not None and chunks is not None:
            compare(open_.values())
        for a in open_.values():
            yield from a.hits()

    tenant, query, chunk = kinds
    return met.mapInArrow(search, f"tenant_id {tenant}, query_id {query}, chunk_id {chunk}, row_key long, distance double")


def kinds_of(queries: DataFrame, chunks: DataFrame) -> tuple[str, str, str]:
    return queries.schema["tenant_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString(), chunks.schema["chunk_id"].dataType.simpleString()


def ranked_hits(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each question, with rank, as a written table; each task drops what it can before they are sent."""
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "chunk_id", "row_key")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    path = scratch_path(hits.sparkSession, "search-hits")
    ranked.write.parquet(path)
    return hits.sparkSession.read.schema(ranked.schema).parquet(path)


def with_texts(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, rank, chunk_id, chunk_text and distance of ranked hits; only here texts are read, and only those chunks' kept.

    Rows of one tenant and chunk_id are told apart by row_key, if any hit has such; of equal agents, documents and vectors too, all have the least text.
    """

    def named(tenant: str, chunk: str) -> Column:
        return (F.col("tenant_id") == F.col(tenant)) & (F.col("chunk_id") == F.col(chunk))

    keys = ranked.select(F.col("tenant_id").alias("k_tenant"), F.col("chunk_id").alias("k_chunk")).distinct()
    wanted = chunks.join(keys, named("k_tenant", "k_chunk"), "left_semi")
    repeated = not wanted.groupBy("tenant_id", "chunk_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    if repeated:
        texts = wanted.groupBy(F.col("tenant_id").alias("t_tenant"), F.col("chunk_id").alias("t_chunk"), row_key().alias("t_key")).agg(F.min("chunk_text").alias("chunk_text"))
        found = ranked.join(texts, named("t_tenant", "t_chunk") & (F.col("row_key") == F.col("t_key")))
    else:
        texts = wanted.select(F.col("tenant_id").alias("t_tenant"), F.col("chunk_id").alias("t_chunk"), "chunk_text")
        found = ranked.join(texts, named("t_tenant", "t_chunk"))
    return found.select("query_id", "rank", "chunk_id", "chunk_text", "distance")


def topk_search(queries: DataFrame, chunks: DataFrame, k: int = DEFAULT_K, pass_bytes: int = PASS_BYTES, compared: Accumulator | None = None) -> DataFrame:
    """The k nearest chunks of each query: query_id, rank, chunk_id, chunk_text, distance.

    queries: query_id, tenant_id, agent_id, query_embedding, and wanted_document (null or empty: any).
    Chunks of the query's tenant, and of its agent if it names one, are ranked by cosine distance. The distance
    is null where either vector is null, lacks a component, or they differ in size, and NaN where one is
    zero; nulls come last, NaN before them, ties by chunk_id. Rows without tenant take no part.

    Questions and chunks are packed into blocks and joined by tenant, so the plan is the same for any number of
    questions, and none of them passes through the driver. Each task keeps the k best of its chunks for each
    question by matrix products and sends their keys on. Texts are joined to the k best of all, last.

    Questions that ask for the same by the same vector are ranked as one, whose hits all of them get. Of chunks with equal agents, documents and
    vectors only the first k can be hits, and only these are compared. compared counts the pairs of question and chunk that are.
    """
    asked = asked_rows(queries)
    path, same = scratch_path(queries.sparkSession, "asked"), [c for c in asked.columns if c != "query_id"]
    asked.write.parquet(path)
    asked = queries.sparkSession.read.schema(asked.schema).parquet(path)
    first = asked.groupBy(*same).agg(F.min("query_id").alias("first_id"), F.count(F.lit(1)).alias("askers"))
    path, counted = scratch_path(queries.sparkSession, "first-asked"), Observation()
    first.observe(counted, F.coalesce(F.max("askers"), F.lit(0)).alias("most")).write.parquet(path)
    first = queries.sparkSession.read.schema(first.schema).parquet(path)
    equal = Window.partitionBy("tenant_id", "row_key", "agent_id", "document_id", "embedding").orderBy("chunk_id")
    rows = chunk_rows(chunks).withColumn("copy", F.row_number().over(equal)).where(F.col("copy") <= k).drop("copy")
    blocks = packed(rows, ["tenant_id", "agent_id"], "embedding", CHUNK_BLOCK)
    blocks = blocks.withColumns({"center": F.lit(None).cast("array<double>"), "radius": F.lit(None).cast("double"), "list_id": F.lit(None).cast("int")})
    hits = met_blocks(first.select(F.col("first_id").alias("query_id"), *same), blocks, k, kinds_of(queries, chunks), pass_bytes, compared)
    ranked = ranked_hits(hits, k)
    if counted.get["most"] > 1:
        members = asked.join(first, reduce(lambda a, b: a & b, [asked[c].eqNullSafe(first[c]) for c in same])).select("first_id", "query_id").distinct()
        ranked = ranked.withColumnRenamed("query_id", "first_id").join(members, "first_id").drop("first_id")
    return with_texts(ranked, chunks)


def topk_search_blocks(queries: DataFrame, chunks: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """topk_search whose questions and chunks meet by shuffles, as they do where there are very many questions."""
    return topk_search(queries, chunks, k, -1)


def nearest_chunks(chunks: DataFrame, query_embedding: list[float], k: int = 3) -> DataFrame:
    """One question, no filters: the k nearest chunks, by one sort that keeps k rows per task."""
    vector = F.array(*[F.lit(float(x)) for x in query_embedding])
    return chunks.select("chunk_id", "chunk_text", cosine_distance(F.col("embedding"), vector).alias("distance")).orderBy(F.asc_nulls_last("distance"), "chunk_id").limit(k)
