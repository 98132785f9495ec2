"""Approximate nearest neighbours: random-projection trees, one priority queue over all of them, exact reranking."""

from __future__ import annotations

import heapq
import math
import pickle
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_few, materialize, slices
from .vectors import exact_dots, matrix, sizes, usable

SEED = 6
#: Rows of a leaf in the sample, and numbers of trees; the fit takes the cheapest. Where vectors have no structure, most leaves must be read, and
#: further trees mean that a row is compared again and again, so few large leaves of fewer trees are better.
SHAPES = {128: (8,), 384: (8,), 1152: (8, 4, 2, 1)}
VISIT = 300  # sending a query to a leaf costs as much as comparing it with so many rows
SAMPLE = 20_000  # rows that the trees are fitted on
TARGET, TRIALS = 0.94, 150  # recall to reach on the sample, and the queries it is measured with
VECTOR_BLOCK, QUERY_BLOCK = 8192, 1024
LEAF_ROWS = 8192  # a leaf with more rows of the table is cut again, by a tree of its own
LEAF_SAMPLE, LEAF_LEAST, LEVELS = 4096, 16, 3  # rows such a tree is fitted on, how few of them may be a leaf, and how often leaves are cut again
FIRST, CHILDREN = 1 << 18, 1 << 12  # numbers of leaves: those of the forest from FIRST on, below it CHILDREN for each
BROADCAST_LEAVES = 200_000  # 5 MB of leaf numbers at most go to every executor; more are joined by a shuffle


@dataclass
class Tree:
    """Inner nodes: normal, offset and two children; a child below zero is leaf number -child-1."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    leaves: int

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.full(len(x), 0 if len(self.normals) else -1)
        while (inner := np.flatnonzero(out >= 0)).size:
            node = out[inner]
            side = (x[inner] * self.normals[node]).sum(axis=1) > self.offsets[node]
            out[inner] = self.children[node, side.astype(int)]
        return -out - 1


def grow(x: np.ndarray, draw: np.random.Generator, leaf: int) -> Tree:
    """Cuts rows in halves along the line between two of them drawn at random, until few are left."""
    normals, offsets, children, leaves = [], [], [], 0
    waiting = [(np.arange(len(x)), None)]
    while waiting:
        rows, above = waiting.pop()
        number = None
        if len(rows) > leaf:
            one, two = draw.choice(rows, 2, replace=False)
            normal = x[one] - x[two]
            if (length := np.linalg.norm(normal)) > 0:
                along = x[rows] @ (normal / length)
                middle = np.median(along)
                over = along > middle
                if over.any() and not over.all():
                    number = len(normals)
                    normals.append(normal / length)
                    offsets.append(middle)
                    children.append([0, 0])
                    waiting += [(rows[~over], (number, 0)), (rows[over], (number, 1))]
        if number is None:
            leaves += 1
            number = -leaves
        if above:
            children[above[0]][above[1]] = number
    return Tree(np.array(normals).reshape(-1, x.shape[1]), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), leaves)


def in_order(ways: list[list], sides: list[list], start: float = 0.0) -> Iterator[tuple[int, int, float]]:
    """Tree, leaf and cost, the nearest leaf first, from one queue for all trees.

    The cost is how far the query lies on the other side of a cut, at most, along the way, and at least start. ways
    holds each tree's children by node, sides the query's distance from each node's cut.
    """
    heap = [(start, t, 0 if way else -1) for t, way in enumerate(ways)]
    while heap:
        cost, t, node = heapq.heappop(heap)
        while node >= 0:
            side = sides[t][node]
            near, far = (1, 0) if side > 0 else (0, 1)
            heapq.heappush(heap, (max(cost, abs(side)), t, ways[t][node][far]))
            node = ways[t][node][near]
        yield t, -node - 1, cost


class Forest:
    def __init__(self, trees: list[Tree], largest_norm: float):
        self.trees, self.largest_norm, self.probes, self.compared = trees, largest_norm, 0, 0.0

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """One more component gives all rows the same length, so that the largest inner product is the nearest row."""
        return np.hstack([x, np.sqrt(np.maximum(0, self.largest_norm**2 - (x * x).sum(axis=1)))[:, None]])

    def place(self, x: np.ndarray) -> np.ndarray:
        lifted = self.lifted(x)
        return np.stack([tree.place(lifted) for tree in self.trees], axis=1)

    def flat(self, queries: np.ndarray) -> np.ndarray:
        """Queries as lifted ones: of the rows' length, with nothing in the last component."""
        return np.hstack([queries / np.linalg.norm(queries, axis=1, keepdims=True) * self.largest_norm, np.zeros((len(queries), 1))])

    def queues(self, queries: np.ndarray) -> Iterator[Iterator[tuple[int, int, float]]]:
        """For each query the leaves of all trees, nearest first."""
        flat = self.flat(queries)
        sides = [flat @ tree.normals.T - tree.offsets for tree in self.trees]
        ways = [tree.children.tolist() for tree in self.trees]
        for k in range(len(queries)):
            yield in_order(ways, [s[k].tolist() for s in sides])

    def probe(self, queries: np.ndarray, probes: int) -> list[list[np.ndarray]]:
        """For each query and tree, the leaves to read: the first probes of the queue."""
        out = []
        for queue in self.queues(queries):
            found: list[list[int]] = [[] for _ in self.trees]
            for t, leaf, _ in islice(queue, probes):
                found[t].append(leaf)
            out.append([np.array(x, np.int64) for x in found])
        return out

    def masks(self, probed: list[list[np.ndarray]]) -> list[np.ndarray]:
        """Per tree, queries by leaves: is the leaf read?"""
        out = [np.zeros((len(probed), tree.leaves), bool) for tree in self.trees]
        for k, own in enumerate(probed):
            for t, leaves in enumerate(own):
                out[t][k, leaves] = True
        return out


def candidates(masks: list[np.ndarray], places: np.ndarray) -> np.ndarray:
    """Queries by rows: do they meet in a leaf of any tree?"""
    out = np.zeros((len(masks[0]), len(places)), bool)
    for t, mask in enumerate(masks):
        out |= mask[:, places[:, t]]
    return out


def fit_forest(sample: np.ndarray, largest_norm: float, k: int, scale: float = 1.0) -> Forest:
    """Grows trees, and finds how many leaves a query must read on the sample to reach the target recall.

    Of several sizes of leaves and numbers of trees that is taken which costs least: leaves read, times the rows of a leaf in the
    whole table (scale times those in the sample) and the cost of a visit. So clustered vectors get small
    leaves of many trees, of which few are read, and vectors without structure large ones of few trees.
    """
    draw = np.random.default_rng(SEED)
    asked = draw.choice(len(sample), min(TRIALS, len(sample)), replace=False)
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :k]
    found: list[tuple[float, Forest]] = []
    for leaf, numbers in SHAPES.items():
        lifted = Forest([], largest_norm).lifted(sample)
        trees = [grow(lifted, draw, leaf) for _ in range(max(numbers))]
        for number in numbers:
            forest = Forest(trees[:number], largest_norm)
            total = sum(tree.leaves for tree in forest.trees)
            places = forest.place(sample)
            steps = np.unique(np.geomspace(min(number, total), total, 32).astype(int)).tolist()

            def enough(probes: int, forest: Forest = forest, places: np.ndarray = places) -> bool:
                met = candidates(forest.masks(forest.probe(sample[asked], probes)), places)
                return np.take_along_axis(met, best, axis=1).mean() >= TARGET

            forest.probes = steps[min(bisect_left(steps[:-1], True, key=enough), len(steps) - 1)]
            forest.compared = forest.probes * number / total  # of the whole table, for each query
            found.append((forest.compared * len(sample) * scale + forest.probes * VISIT, forest))
    return min(found, key=lambda x: x[0])[1]


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Per row of queries (vec_id, embedding) its k nearest rows of vectors: query_id, rank, vec_id, score.

    Nearness is the inner product in double precision, ties go to the smaller vec_id, and rows of the
    query's own vec_id are left out. Trees are fitted on at most SAMPLE rows; every row is placed in them. A
    query is sent to the leaves that its queue names, in whatever tree, and compared with the rows there and no
    others. How many it names comes from recall measured on the sample, so they are few for vectors with structure and
    many for vectors without. Leaves that hold many rows of a large table are cut further in their own tasks, so that leaves
    stay bounded. Of equal vectors only the k + 1 smallest ids are
    placed, since no other can be among the k nearest. A leaf with many rows or many queries is dealt to blocks by
    hash; a task's group is one block of either.

    Rows with null vec_id and unusable vectors take no part as query or candidate; vectors of different sizes
    are searched apart, each size with trees of its own. Of one vec_id with several vectors, each is a
    candidate and each a query; equal rows count once. Empty tables give no rows.
    """
    clean = _usable(vectors)
    copy = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    placed = clean.distinct().withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy")
    placed, asked = materialize(placed, "vectors"), materialize(_usable(queries).distinct(), "queries")
    none = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, [_nearest(placed, asked, size, k) for size in sizes(placed)], none)


def _usable(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").cast("long"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))


def _nearest(vectors: DataFrame, queries: DataFrame, size: int, k: int) -> DataFrame:
    """The search among vectors with size components."""
    spark = vectors.sparkSession
    vectors, queries = vectors.where(F.size("embedding") == size), queries.where(F.size("embedding") == size)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    state = vectors.agg(F.max(norm).alias("norm"), F.count("*").alias("n")).first()
    sample = matrix(vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()["embedding"], size)
    scale = state["n"] / len(sample)
    forest = fit_forest(sample, state["norm"], math.ceil(k / scale), scale)  # so many of the table's k nearest are in the sample
    rows, wanted = _meetings(vectors, queries, forest, size, k)
    here = rows.groupBy("leaf").agg(F.ceil(F.count("*") / VECTOR_BLOCK).cast("int").alias("row_blocks"))
    there = wanted.groupBy("leaf").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("query_blocks"))
    blocks = broadcast_if_few(materialize(here.join(there, "leaf"), "leaf-blocks"), BROADCAST_LEAVES)

    def deal(df: DataFrame, own: str, other: str) -> DataFrame:
        """Gives a row its own block of its leaf, and copies it to each block of the other side."""
        block = F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int")
        dealt = df.join(blocks, "leaf").withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        low, high = ("own", "other") if own == "row_blocks" else ("other", "own")
        return dealt.select("leaf", F.col(low).alias("rb"), F.col(high).alias("qb"), "vec_id", "embedding").groupBy("leaf", "rb", "qb")

    def rerank(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if candidates.num_rows and asked.num_rows:
            ids, x, names = candidates["vec_id"].to_numpy(), matrix(candidates["embedding"], size), asked["vec_id"].to_numpy()
            for at in range(0, len(names), 128):
                name, q = names[at : at + 128], matrix(asked["embedding"].slice(at, 128), size)
                for part, own in zip(out, nearest_rows(name, q, ids, x, k), strict=True):
                    part.append(own)
        cat = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table({"query_id": pa.array(cat[0].astype(np.int64)), "vec_id": pa.array(cat[1].astype(np.int64)), "score": pa.array(cat[2].astype(np.float64))})

    scored = deal(rows, "row_blocks", "query_blocks").cogroup(deal(wanted, "query_blocks", "row_blocks")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    # What was found in several trees has the same score and so the same rank.
    rank = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).dropDuplicates(["query_id", "rank"]).select("query_id", "rank", "vec_id", "score")


def _meetings(vectors: DataFrame, queries: DataFrame, forest: Forest, size: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Which leaves rows lie in and which queries read: two tables of vec_id, embedding and leaf.

    A leaf with more than LEAF_ROWS rows is cut again, by a tree that its own task grows on LEAF_SAMPLE of its rows or about so
    many, level by level. Where that happens, a query reads its queue, on through these trees, up to a cost at which
    TRIALS queries have found enough of their nearest rows in the whole table.
    """
    kind = vectors.schema["embedding"].dataType.simpleString()
    entry = f"vec_id long, embedding {kind}, leaf long"
    forest = vectors.sparkSession.sparkContext.broadcast(forest)

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            leaves = forest.value.place(matrix(batch.column(1), size)) + np.arange(len(forest.value.trees)) * SAMPLE + FIRST
            yield _entries(batch, np.repeat(np.arange(len(leaves)), leaves.shape[1]), leaves.ravel())

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            probed = forest.value.probe(matrix(batch.column(1), size), forest.value.probes)
            leaves = [np.concatenate([leaf + t * SAMPLE + FIRST for t, leaf in enumerate(own)]) for own in probed]
            yield _entries(batch, np.repeat(np.arange(len(leaves)), [len(x) for x in leaves]), np.concatenate(leaves))

    fresh, done, levels = vectors.mapInArrow(index, entry), [], []
    for _ in range(LEVELS):
        full = materialize(fresh.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > LEAF_ROWS), "full-leaves")
        if full.isEmpty():
            break
        drawn = fresh.join(broadcast_if_few(full, BROADCAST_LEAVES), "leaf").where(F.expr(f"pmod(xxhash64(vec_id, embedding), n) < {LEAF_SAMPLE}"))
        trees = materialize(drawn.groupBy("leaf").applyInArrow(_leaf_tree(forest, size), "leaf long, n long, tree binary"), "leaf-trees")
        cut = broadcast_if_few(trees.select("leaf", "n"), BROADCAST_LEAVES)
        done.append(fresh.join(cut, "leaf", "left_anti").select("vec_id", "embedding", "leaf"))
        blocks = F.ceil(F.col("n") / LEAF_ROWS).cast("int")
        dealt = fresh.join(cut, "leaf").withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), blocks).cast("int"))
        sent = trees.select("leaf", "tree", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
        fresh = materialize(dealt.groupBy("leaf", "block").cogroup(sent.groupBy("leaf", "block")).applyInArrow(_lower_leaves(forest, size), entry), "leaf-rows")
        levels.append(trees)
    rows = reduce(DataFrame.unionByName, done, fresh)
    if not levels:
        return rows, queries.mapInArrow(ask, entry)
    bound = _bound(vectors, rows, lambda trials: _reached(trials, forest, levels, size, None), size, k)
    return rows, _reached(queries, forest, levels, size, bound).drop("cost")


def _leaf_tree(forest, size: int):
    def fit(rows: pa.Table) -> pa.Table:
        """Grows the tree of one leaf, in one fixed order of its rows; none if nothing parts them."""
        leaf, n, x = rows["leaf"][0].as_py(), rows["n"][0].as_py(), matrix(rows["embedding"], size)
        x = forest.value.lifted(x[np.lexsort(x.T)])
        tree = grow(x, np.random.default_rng([SEED, leaf]), max(LEAF_LEAST, int(len(x) * LEAF_ROWS * 0.75 / n)))
        found = tree.leaves > 1
        return pa.table({"leaf": pa.array([leaf] * found, pa.int64()), "n": pa.array([n] * found, pa.int64()), "tree": pa.array([pickle.dumps(tree)] * found, pa.binary())})

    return fit


def _lower_leaves(forest, size: int):
    def place(rows: pa.Table, trees: pa.Table) -> pa.Table:
        """One block of a leaf's rows, placed in the leaf's own tree."""
        if not rows.num_rows:
            return _entries(rows, np.zeros(0, np.int64), np.zeros(0, np.int64))
        tree = pickle.loads(trees["tree"][0].as_py())
        leaves = tree.place(forest.value.lifted(matrix(rows["embedding"], size)))
        return _entries(rows, np.arange(len(leaves)), rows["leaf"].to_numpy() * CHILDREN + leaves)

    return place


def _reached(queries: DataFrame, forest, levels: list[DataFrame], size: int, bound: float | None) -> DataFrame:
    """vec_id, embedding, leaf and cost of all leaves that queries reach up to the cost bound, at whatever level; None: all leaves."""
    limit = float("inf") if bound is None else bound
    schema = f"vec_id long, embedding {queries.schema['embedding'].dataType.simpleString()}, leaf long, cost double"

    def listed(rows, found: list[list[tuple[int, float]]]):
        leaves = np.array([leaf for own in found for leaf, _ in own], np.int64)
        return _entries(rows, np.repeat(np.arange(len(found)), [len(own) for own in found]), leaves, np.array([cost for own in found for _, cost in own], np.float64))

    def start(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            queues = forest.value.queues(matrix(batch.column(1), size))
            yield listed(batch, [[(FIRST + t * SAMPLE + leaf, cost) for t, leaf, cost in takewhile(lambda x: x[2] <= limit, queue)] for queue in queues])

    def follow(rows: pa.Table, trees: pa.Table) -> pa.Table:
        """One block of the queries that reach a leaf: their queues go on in the leaf's own tree."""
        if not rows.num_rows or not trees.num_rows:
            return listed(rows.slice(0, 0), [])
        tree = pickle.loads(trees["tree"][0].as_py())
        ways, first = tree.children.tolist(), rows["leaf"][0].as_py() * CHILDREN
        sides = (forest.value.flat(matrix(rows["embedding"], size)) @ tree.normals.T - tree.offsets).tolist()
        queues = [in_order([ways], [own], cost) for own, cost in zip(sides, rows["cost"].to_pylist(), strict=True)]
        return listed(rows, [[(first + leaf, cost) for _, leaf, cost in takewhile(lambda x: x[2] <= limit, queue)] for queue in queues])

    near, done = queries.mapInArrow(start, schema), []
    for trees in levels:
        counted = near.join(broadcast_if_few(trees.select("leaf"), BROADCAST_LEAVES), "leaf").groupBy("leaf").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
        counted = broadcast_if_few(materialize(counted, "leaf-queries"), BROADCAST_LEAVES)
        done.append(near.join(counted, "leaf", "left_anti").select("vec_id", "embedding", "leaf", "cost"))
        dealt = near.join(counted, "leaf").withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("blocks")).cast("int"))
        sent = trees.join(counted, "leaf").select("leaf", "tree", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        near = dealt.groupBy("leaf", "block").cogroup(sent.groupBy("leaf", "block")).applyInArrow(follow, schema)
    return reduce(DataFrame.unionByName, done, near)


def _bound(vectors: DataFrame, rows: DataFrame, reached, size: int, k: int) -> float:
    """The cost up to which TRIALS of the vectors must read leaves to find TARGET of their k nearest among all vectors.

    The nearest come from an exact scan of the vectors for these few queries; a pair's cost is that of the nearest leaf of any tree that holds the row.
    """
    trials = materialize(vectors.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(TRIALS), "trials")
    own = trials.toArrow()
    names, q = own["vec_id"].to_numpy(), matrix(own["embedding"], size)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        for batch in slices(batches, 8192):
            name, ids, score = nearest_rows(names, q, batch.column(0).to_numpy(), matrix(batch.column(1), size), k)
            more = pa.table({"trial": name, "vec_id": ids, "score": score})
            best = pa.concat_tables([best, more]) if best else more
            if best.num_rows > 16 * len(names) * k:
                best = top(best)
        if best:
            yield from top(best).to_batches()

    def top(found: pa.Table) -> pa.Table:
        """The k best of each trial."""
        name, score = found["trial"].to_numpy(), found["score"].to_numpy()
        order = np.lexsort((-score, name))
        held = name[order]
        return found.take(order[np.arange(len(order)) - np.searchsorted(held, held, "left") < k]).combine_chunks()

    best = F.row_number().over(Window.partitionBy("trial").orderBy(F.desc("score"), "vec_id"))
    truth = vectors.mapInArrow(scan, "trial long, vec_id long, score double").withColumn("at", best).where(F.col("at") <= k).select("trial", "vec_id")
    truth = F.broadcast(materialize(truth, "trial-truth"))  # TRIALS * k rows
    held = materialize(rows.select("vec_id", "leaf").join(truth, "vec_id"), "trial-leaves")
    costs = reached(trials).select(F.col("vec_id").alias("trial"), "leaf", "cost")
    pairs = held.join(costs, ["trial", "leaf"]).groupBy("trial", "vec_id").agg(F.min("cost").alias("cost"))
    return pairs.agg(F.expr(f"percentile_disc({TARGET}) WITHIN GROUP (ORDER BY cost)")).first()[0]


def _entries(rows: pa.RecordBatch | pa.Table, at: np.ndarray, leaves: np.ndarray, costs: np.ndarray | None = None) -> pa.RecordBatch | pa.Table:
    """vec_id and embedding of the rows at, with their leaves and, if given, costs."""
    taken = rows.select(["vec_id", "embedding"]).take(pa.array(at, pa.int64()))
    more = [("leaf", pa.array(leaves, pa.int64()))] + ([] if costs is None else [("cost", pa.array(costs, pa.float64()))])
    return type(taken).from_arrays([*taken.columns, *[x for _, x in more]], names=["vec_id", "embedding", *[name for name, _ in more]])


def nearest_rows(names: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query of names the k rows of x with the largest exact inner products, other than those of its own id."""
    scores = np.where(ids[None, :] != names[:, None], q @ x.T, -np.inf)
    low = np.partition(scores, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(names), -np.inf)
    row, column = np.nonzero((scores >= (low - 1e-9 * np.maximum(1, np.abs(low)))[:, None]) & np.isfinite(scores))
    exact = exact_dots(q[row], x[column])
    order = np.lexsort((ids[column], -exact, row))
    row, column, exact = row[order], column[order], exact[order]
    best = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
    return names[row[best]], ids[column[best]], exact[best]
