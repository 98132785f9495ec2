"""An index of chunks by clusters, of its own for each tenant, saved by tenant and cluster: for searches that read few clusters, and exact ones that skip blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..sources.scratch import scratch_path
from .search import DEFAULT_K, asked_rows, chunk_rows, kinds_of, met_blocks, packed, ranked_hits, with_texts

MAX_LISTS, SAMPLE_PER_LIST, ROUNDS = 4096, 64, 3
GROUP_BYTES = 32 << 20  # of vectors that a task assigns to clusters at once
BLOCK_ROWS = 256
MAX_SALTS, SALT_ROWS = 16, 65_536  # tasks that a list's rows come to: one for so many rows of the tenant, up to the maximum
GROUP = ["tenant_id", "size"]


def measurable(vector: Column) -> Column:
    """The number of components of a vector that has an angle to others, and 0 for one that is null, zero or holds null or non-finite components."""
    x = vector.cast("array<double>")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | ~F.exists(x, lambda v: v != 0)
    return F.when(F.coalesce(~odd, F.lit(False)), F.size(vector)).otherwise(0)


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    x = table[column].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _parts(rows: Column) -> Column:
    """In how many parts so many rows (of each tenant and vector size) are dealt with."""
    return F.greatest(F.lit(1), F.ceil(rows * F.col("size") * 4 / GROUP_BYTES)).cast("int")


def _beside_centers(rows: DataFrame, vector: str, centers: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: StructType, parts: DataFrame | Column | None = None) -> DataFrame:
    """work(rows, centers) for parts of the rows of each tenant and vector size, beside all centers of theirs.

    A part has about GROUP_BYTES of vectors, whatever a tenant's share of all rows. How many parts there are is given, by tenant and size or as an
    expression of the size, or comes from a count.
    """
    spread = [c for c in ("query_id", "chunk_id", "row_key", "place", vector) if c in rows.columns]
    if parts is None:
        parts = _written(rows.groupBy(*GROUP).agg(F.count("*").alias("rows")).select(*GROUP, _parts(F.col("rows")).alias("parts")), "parts")
    if isinstance(parts, DataFrame):
        rows, centers = rows.join(parts, GROUP), centers.join(parts, GROUP)
    else:
        rows, centers = rows.withColumn("parts", parts), centers.withColumn("parts", parts)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(*spread), F.col("parts")).cast("int")).drop("parts")
    there = centers.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    empty = to_arrow_schema(schema)

    def each(own: pa.Table, near: pa.Table) -> pa.Table:
        return work(own, near) if own.num_rows and near.num_rows else empty.empty_table()

    return dealt.groupBy(*GROUP, "part").cogroup(there.groupBy(*GROUP, "part")).applyInArrow(each, schema)


def nearest_lists(rows: DataFrame, vector: str, centers: DataFrame, n: int | None, parts: DataFrame | Column | None = None) -> DataFrame:
    """rows (with tenant_id and size) with list_ids, their tenant's n nearest lists in order of cosine, or all; rows of tenants and sizes without lists are left out."""
    schema = StructType([*rows.schema.fields, StructField("list_ids", ArrayType(IntegerType()))])
    kept = rows.columns

    def near(own: pa.Table, lists: pa.Table) -> pa.Table:
        lists_of = np.concatenate([names[place] for names, place, _ in _places(own, vector, lists, n, True)]).astype(np.int32)
        ends = np.arange(len(lists_of) + 1, dtype=np.int32) * lists_of.shape[1]
        return own.select(kept).append_column("list_ids", pa.ListArray.from_arrays(pa.array(ends), pa.array(lists_of.ravel())))

    return _beside_centers(rows, vector, centers, near, schema, parts)


def asked_lists(rows: DataFrame, vector: str, centers: DataFrame, n: int | None, parts: DataFrame | Column | None = None) -> DataFrame:
    """rows with nearest_list and asked_lists, the n nearest lists or all, a bit for each list of the tenant; else as nearest_lists.

    How many lists must be read grows with their number, so their numbers would take more room than the vectors, and more the more rows there are.
    """
    schema = StructType([*rows.schema.fields, StructField("nearest_list", IntegerType()), StructField("asked_lists", BinaryType())])
    kept = rows.columns

    def near(own: pa.Table, lists: pa.Table) -> pa.Table:
        first, bits = [], []
        for names, place, likeness in _places(own, vector, lists, n, False):
            first.append(names[likeness.argmax(axis=1)])
            asked = np.zeros((len(place), int(names[-1]) + 1), bool)
            np.put_along_axis(asked, names[place], True, axis=1)
            bits.append(np.packbits(asked, axis=1))
        packed_bits = np.concatenate(bits)
        ends = np.arange(len(packed_bits) + 1, dtype=np.int32) * packed_bits.shape[1]
        column = pa.Array.from_buffers(pa.binary(), len(packed_bits), [None, pa.py_buffer(ends), pa.py_buffer(packed_bits)])
        return own.select(kept).append_column("nearest_list", pa.array(np.concatenate(first).astype(np.int32))).append_column("asked_lists", column)

    return _beside_centers(rows, vector, centers, near, schema, parts)


def _places(own: pa.Table, vector: str, lists: pa.Table, n: int | None, ordered: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For some rows at a time: all lists' numbers, ascending, the places among them of the rows' n nearest lists (None: all), and the rows' cosines with all."""
    names = lists["list_id"].to_numpy()
    order = np.argsort(names)
    names, middle = names[order], _matrix(lists, "center")[order]
    x = _matrix(own, vector)
    step = max(1, (16 << 20) // (8 * len(names)))
    for at in range(0, len(x), step):
        likeness = x[at : at + step] @ middle.T
        if n is not None and 1 < n < len(names):
            place = np.argpartition(-likeness, n - 1, axis=1)[:, :n]
            if ordered:
                place = np.take_along_axis(place, np.argsort(-np.take_along_axis(likeness, place, axis=1), axis=1, kind="stable"), axis=1)
        elif n == 1:
            place = likeness.argmax(axis=1)[:, None]
        elif ordered:
            place = np.argsort(-likeness, axis=1, kind="stable")
        else:
            place = np.broadcast_to(np.arange(len(names)), likeness.shape)
        yield names, place, likeness


def _sums(x: np.ndarray, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of middle, the sum of the rows of x that are nearest to it, and their number."""
    total, count = np.zeros_like(middle), np.zeros(len(middle), np.int64)
    step = max(1, (16 << 20) // (8 * len(middle)))
    for at in range(0, len(x), step):
        near = (x[at : at + step] @ middle.T).argmax(axis=1)
        np.add.at(total, near, x[at : at + step])
        count += np.bincount(near, minlength=len(middle))
    return total, count


def _middles(total: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The direction of each sum; where there is none, the center before."""
    length = np.linalg.norm(total, axis=1, keepdims=True)
    return np.where(length > 1e-12, total / np.maximum(length, 1e-300), before)


def _own_centers(sample: DataFrame, rounds: int, schema: StructType) -> DataFrame:
    """Centers after all rounds for tenants and sizes whose sample is one part: each is clustered by one task."""

    def fit(own: pa.Table) -> pa.Table:
        own = own.take(pa.array(np.argsort(own["place"].to_numpy(), kind="stable")))
        x = _matrix(own, "embedding")
        middle, count = x[: own["lists"][0].as_py()], np.zeros(0, np.int64)
        for _ in range(rounds):
            total, count = _sums(x, middle)
            middle = _middles(total, middle)
        n = count if len(count) else np.zeros(len(middle), np.int64)
        return pa.Table.from_arrays([*[own[c].slice(0, len(middle)) for c in GROUP], pa.array(np.arange(len(middle), dtype=np.int32)), pa.array(list(middle), pa.list_(pa.float64())), pa.array(n)], names=schema.names)

    return sample.groupBy(*GROUP).applyInArrow(fit, schema)


def _better(sample: DataFrame, centers: DataFrame, parts: DataFrame) -> DataFrame:
    """The centers after one round of k-means of all tenants: each the middle direction of the sampled vectors nearest to it; one without such stays."""
    sums = _center_schema(centers)

    def add(own: pa.Table, lists: pa.Table) -> pa.Table:
        middle, x = _matrix(lists, "center"), _matrix(own, "embedding")
        total, count = _sums(x, middle)
        return lists.select([*GROUP, "list_id"]).append_column("center", pa.array(list(total), pa.list_(pa.float64()))).append_column("n", pa.array(count, pa.int64()))

    parts = _beside_centers(sample.select(*GROUP, "place", "embedding"), "embedding", centers.select(*GROUP, "list_id", "center"), add, sums, parts)
    before = centers.select(*GROUP, "list_id", "center", F.lit(-1).cast("long").alias("n"))

    def join(rows: pa.Table) -> pa.Table:
        names, place = np.unique(rows["list_id"].to_numpy(), return_inverse=True)
        x, n = rows["center"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1), rows["n"].to_numpy()
        total, count = np.zeros((len(names), x.shape[1])), np.zeros(len(names), np.int64)
        np.add.at(total, place[n > 0], x[n > 0])
        np.add.at(count, place[n > 0], n[n > 0])
        old = np.zeros_like(total)
        old[place[n < 0]] = x[n < 0]
        new = _middles(total, old)
        first = [rows[c].slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(names), np.int64))) for c in GROUP]
        return pa.Table.from_arrays([*first, pa.array(names.astype(np.int32)), pa.array(list(new), pa.list_(pa.float64())), pa.array(count)], names=[*GROUP, "list_id", "center", "n"])

    return _written(parts.unionByName(before).groupBy(*GROUP, F.expr("list_id div 64")).applyInArrow(join, sums), "centers")


def _summed_centers(sample: DataFrame, counts: DataFrame, rounds: int) -> DataFrame:
    """Centers of tenants and sizes whose sample is several parts, by a job for each round."""
    number = F.row_number().over(Window.partitionBy(*GROUP).orderBy("place", "embedding"))
    first = sample.withColumn("list_id", number - 1).where(F.col("list_id") < F.col("lists"))
    centers = _written(first.select(*GROUP, F.col("list_id").cast("int").alias("list_id"), F.col("embedding").cast("array<double>").alias("center"), F.lit(0).cast("long").alias("n")), "centers")
    for _ in range(rounds):
        centers = _better(sample, centers, counts.select(*GROUP, F.col("sample_parts").alias("parts")))
    return centers


def _center_schema(rows: DataFrame) -> StructType:
    return StructType([*[rows.schema[c] for c in GROUP], StructField("list_id", IntegerType()), StructField("center", ArrayType(DoubleType())), StructField("n", LongType())])


def build_index(chunks: DataFrame, path: str, lists: int | None = None, rounds: int = ROUNDS) -> None:
    """Writes an index of chunks (tenant_id, agent_id, document_id, chunk_id, embedding) to path: its centers, and its blocks by tenant and list.

    Each tenant has lists of its own: `lists`, or the root of the number of its chunks, at most MAX_LISTS and as many as it has vectors, for each vector
    size. Their centers come from rounds of k-means by cosine on at most SAMPLE_PER_LIST vectors a list, chosen by hash; all tenants are
    clustered together: one whose sample is a single part by one task, in one job for all of them, larger ones by sums grouped by tenant and list, a
    job a round. Every chunk goes to its nearest list, where chunks of one agent are cut into
    blocks of BLOCK_ROWS with a center and the radius about it. Vectors without an angle (null, zero, null or non-finite
    components) are kept in list -1. Rows without tenant are left out. An index is written once; a new one needs a new path.
    """
    rows = chunk_rows(chunks).withColumn("size", measurable(F.col("embedding")))
    good = rows.where("size > 0")
    wanted = F.lit(lists) if lists else F.ceil(F.sqrt("rows"))
    counts = good.groupBy(*GROUP).agg(F.count("*").alias("rows")).withColumn("lists", F.least(wanted, F.lit(MAX_LISTS), F.col("rows")).cast("int"))
    counts = counts.withColumns({"share": F.col("lists") * SAMPLE_PER_LIST / F.col("rows"), "parts": _parts(F.col("rows"))})
    counts = _written(counts.withColumn("sample_parts", _parts(F.least("rows", F.col("lists") * SAMPLE_PER_LIST))), "counts")
    place = F.xxhash64(F.lit("sample"), "chunk_id", "row_key")
    drawn = good.join(counts, GROUP).withColumn("place", place).where((F.pmod("place", F.lit(1 << 31)) / (1 << 31)) < F.greatest("share", F.lit(0.0)))
    drawn = drawn.select(*GROUP, "lists", "sample_parts", "place", "embedding")
    centers = _own_centers(drawn.where("sample_parts = 1"), rounds, _center_schema(drawn))
    if not counts.where("sample_parts > 1").isEmpty():
        centers = centers.unionByName(_summed_centers(_written(drawn.where("sample_parts > 1"), "sample"), counts, rounds))
    centers.write.parquet(f"{path}/centers")
    centers = chunks.sparkSession.read.schema(centers.schema).parquet(f"{path}/centers")
    listed = nearest_lists(good, "embedding", centers, 1, counts.select(*GROUP, "parts")).withColumn("list_id", F.get("list_ids", 0)).drop("list_ids")
    odd = rows.where("size = 0").withColumn("list_id", F.lit(-1))
    # a list's rows come to one task, or a few where a tenant has many, in order, so that blocks are full however many tasks have read them
    salts = counts.groupBy("tenant_id").agg(F.least(F.lit(MAX_SALTS), F.ceil(F.sum("rows") / SALT_ROWS)).cast("int").alias("salts"))
    salt = F.pmod(F.col("row_key"), F.coalesce("salts", F.lit(MAX_SALTS)))
    dealt = listed.unionByName(odd).join(salts, "tenant_id", "left").repartition("tenant_id", "list_id", salt).drop("salts").sortWithinPartitions("tenant_id", "list_id", "size", "agent_id")
    blocks = packed(dealt, ["tenant_id", "list_id", "size", "agent_id"], "embedding", BLOCK_ROWS, spheres=True)
    blocks.write.partitionBy("tenant_id", "list_id").parquet(f"{path}/blocks")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of an index; a filter on tenant_id or list_id reads those folders only."""
    schema = StructType([
        StructField("size", IntegerType()), StructField("agent_id", StringType()), StructField("block", LongType()), StructField("packed", BinaryType()), StructField("n", IntegerType()),
        StructField("center", ArrayType(DoubleType())), StructField("radius", DoubleType()), StructField("tenant_id", StringType()), StructField("list_id", IntegerType()),
    ])
    return spark.read.schema(schema).parquet(f"{path}/blocks")


def read_centers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/centers")


def _probed_hits(queries: DataFrame, chunks: DataFrame, path: str, k: int, probes: int | None, compared: Accumulator | None, parts: Column | None = None) -> DataFrame:
    spark = queries.sparkSession
    asked = asked_rows(queries).withColumn("size", measurable(F.col("query_embedding"))).where("size > 0")
    listed = asked_lists(asked, "query_embedding", read_centers(spark, path), probes, parts)
    return met_blocks(listed.drop("size"), read_blocks(spark, path), k, kinds_of(queries, chunks), compared=compared)


def index_search(queries: DataFrame, chunks: DataFrame, path: str, k: int = DEFAULT_K, probes: int | None = 1, compared: Accumulator | None = None) -> DataFrame:
    """topk_search among the chunks in the probes nearest lists of the question's tenant (None: all), in an index of these chunks.

    Folders of lists that no question asks for are not read. Agents and documents are chosen after that, so fewer than k may be left.
    Questions without an angle have no lists and no rows. compared counts the pairs of question and chunk that are compared.
    """
    return with_texts(ranked_hits(_probed_hits(queries, chunks, path, k, probes, compared), k), chunks)


def exact_search(queries: DataFrame, chunks: DataFrame, path: str, k: int = DEFAULT_K, probes: int = 2, compared: Accumulator | None = None) -> DataFrame:
    """The rows of topk_search, from an index of these chunks.

    A first search of a few lists gives each question the distance within which k chunks lie. Then all blocks of the tenant are read, but a block is
    not compared with a question whose distance its center and radius keep it beyond, and no hit farther than that is sent on.
    """
    return with_texts(_exact_hits(queries, chunks, path, k, probes, compared), chunks)


def _exact_hits(queries: DataFrame, chunks: DataFrame, path: str, k: int, probes: int = 2, compared: Accumulator | None = None, parts: Column | None = None) -> DataFrame:
    near = ranked_hits(_probed_hits(queries, chunks, path, k, probes, compared, parts), k)
    limits = near.groupBy("query_id").agg(F.count("distance").alias("n"), F.max("distance").alias("limit")).where((F.col("n") >= k) & ~F.isnan("limit"))
    limited = queries.drop("limit").join(limits.select("query_id", "limit"), "query_id", "left")
    hits = met_blocks(asked_rows(limited), read_blocks(queries.sparkSession, path), k, kinds_of(queries, chunks), compared=compared)
    return ranked_hits(hits, k)


def probes_for(chunks: DataFrame, path: str, k: int = DEFAULT_K, recall: float = 0.9, questions: int = 256) -> int:
    """How many lists a search must read so that the share `recall` of the k nearest is found, measured with so many of the chunks' vectors as questions."""
    spark = chunks.sparkSession
    rows = chunk_rows(chunks).withColumn("size", measurable(F.col("embedding"))).where("size > 0")
    drawn = rows.orderBy(F.xxhash64(F.lit("ask"), "chunk_id", "row_key")).limit(questions)
    asked = _written(drawn.select(F.col("row_key").alias("query_id"), "tenant_id", "size", F.lit(None).cast("string").alias("agent_id"), F.lit(None).cast("string").alias("wanted_document"), F.col("embedding").alias("query_embedding")), "probe-questions").dropDuplicates(["query_id"])
    centers = read_centers(spark, path)
    hits = _exact_hits(asked.drop("size"), chunks, path, k, parts=F.lit(1)).where("distance is not null").select("query_id", "chunk_id")
    order = nearest_lists(asked.select("query_id", "tenant_id", "size", "query_embedding"), "query_embedding", centers, None, F.lit(1)).select("query_id", "tenant_id", "list_ids")
    wanted = rows.select("tenant_id", "size", "chunk_id", "embedding").join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")
    lists = nearest_lists(wanted, "embedding", centers, 1, _parts(F.lit(questions * k))).select("tenant_id", "chunk_id", F.get("list_ids", 0).alias("list_id"))
    placed = hits.join(order, "query_id").join(lists, ["tenant_id", "chunk_id"]).select(F.array_position("list_ids", F.col("list_id")).alias("place"))
    counts = placed.groupBy("place").agg(F.count("*").alias("n")).orderBy("place").collect()  # one row per list at most
    total, so_far = sum(r.n for r in counts), 0
    for r in counts:
        so_far += r.n
        if so_far >= recall * total:
            return int(r.place)
    return 1
