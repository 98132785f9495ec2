"""Near-duplicate vectors by pivot permutations: ordered nearest reference points, inverted lists, exact cosines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices
from .components import connected_components
from .vectors import exact_dots, matrix, sizes, usable

LEAST_PIVOTS, PER_ROOT = 64, 4  # pivots grow with four times the square root of the vectors
SAMPLE_PER_PIVOT, LEAST_SAMPLE = 4, 20_000  # rows that pivots are chosen from
NEAREST, MOST_NEAREST, SHARED = 8, 24, 2  # length of a description, and pivots that a pair must share
TARGET, TRIALS = 0.998, 2000  # share of pairs at the threshold that must meet, measured on so many
BLOCK, CHUNK = 2048, 64
SLICE_BYTES = 1 << 24  # of rows beside pivots, of which a task holds a few copies
MARGIN = 1e-9


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows of the sample: first some of which none is close to another, so that one group doesn't take
    them all; where these are too few, others that aren't nearly equal."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen = np.empty((min(n, len(unit)), unit.shape[1]))
    k = 0
    for most in (0.8, 0.99):
        for row in unit:
            if k == len(chosen):
                break
            if not k or (chosen[:k] @ row).max() < most:
                chosen[k] = row
                k += 1
    return chosen[:k]


def descriptions(x: np.ndarray, pivots: np.ndarray, near: int) -> np.ndarray:
    """The numbers of each row's nearest pivots, nearest first. Rows are taken so many at a time that their table with all pivots has SLICE_BYTES at most."""
    near = min(near, len(pivots))
    out = np.empty((len(x), near), np.int64)
    step = max(1, SLICE_BYTES // (8 * len(pivots)))
    for at in range(0, len(x), step):
        rows = x[at : at + step]
        closeness = rows / np.linalg.norm(rows, axis=1, keepdims=True) @ pivots.T
        first = np.argpartition(-closeness, near - 1, axis=1)[:, :near]
        order = np.lexsort((first, -np.take_along_axis(closeness, first, axis=1)), axis=1)
        out[at : at + step] = np.take_along_axis(first, order, axis=1)
    return out


def description_length(sample: np.ndarray, pivots: np.ndarray, threshold: float) -> int:
    """The shortest description under which pairs at the threshold share SHARED pivots often enough.

    Measured on rows of the sample, each with a partner turned from it at random to exactly that cosine.
    """
    if len(pivots) <= NEAREST or threshold >= 1 or sample.shape[1] < 2:
        return NEAREST
    draw = np.random.default_rng(9)
    one = sample[draw.integers(0, len(sample), TRIALS)]
    one = one / np.linalg.norm(one, axis=1, keepdims=True)
    aside = draw.standard_normal(one.shape)
    aside -= (aside * one).sum(axis=1, keepdims=True) * one
    two = threshold * one + np.sqrt(1 - threshold**2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)
    for near in range(NEAREST, MOST_NEAREST):
        both = (descriptions(one, pivots, near)[:, :, None] == descriptions(two, pivots, near)[:, None, :]).sum(axis=(1, 2))
        if (both >= SHARED).mean() >= TARGET:
            return near
    return MOST_NEAREST


def _component_minima(names: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The smallest name that each row of a symmetric table of links can reach."""
    low = names.copy()
    while True:
        new = np.concatenate([np.minimum(low[k : k + CHUNK], np.where(linked[k : k + CHUNK], low, np.iinfo(np.int64).max).min(axis=1)) for k in range(0, len(low), CHUNK)])
        if (new == low).all():
            return low
        low = new


def meet(pivot: int, lists: np.ndarray, x: np.ndarray, threshold: float, groups: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """The links in one pivot's list as a symmetric table, and how many pairs were compared.

    Every row of lists has the pivot. Rows are gathered by each further pivot, so that those which
    meet share SHARED pivots at least; their cosines are worked out then. A pair is taken where the
    list's pivot and the further one are the smallest two that it shares; no link is dropped otherwise. With
    groups, pairs within a group are left to another call.
    """
    linked, compared = np.zeros((len(lists), len(lists)), bool), 0
    row = np.repeat(np.arange(len(lists)), lists.shape[1])
    further = lists.ravel()
    later = further > pivot
    row, further = row[later], further[later]
    order = np.argsort(further, kind="stable")
    row, further = row[order], further[order]
    edges = np.append(np.flatnonzero(np.diff(further, prepend=-1)), len(further))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    length = np.sqrt(exact_dots(x, x))
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        run = row[start:end]
        compared += len(run) * (len(run) - 1) // 2
        for at in range(0, len(run) - 1, CHUNK):
            one, two = np.nonzero(unit[run[at : at + CHUNK]] @ unit[run].T >= threshold - MARGIN)
            later = at + one < two
            one, two = run[at + one[later]], run[two[later]]
            if groups is not None:
                apart = groups[one] != groups[two]
                one, two = one[apart], two[apart]
            if len(one):
                both = np.where((lists[one][:, :, None] == lists[two][:, None, :]).any(axis=2), lists[one], np.iinfo(np.int64).max)
                both.sort(axis=1)
                first = (both[:, 0] == pivot) & (both[:, 1] == further[start])
                one, two = one[first], two[first]
                sure = exact_dots(x[one], x[two]) / (length[one] * length[two]) >= threshold
                one, two = one[sure], two[sure]
                linked[one, two] = linked[two, one] = True
    return linked, compared


def _links(classes: DataFrame, size: int, threshold: float) -> DataFrame:
    """Links of classes (label, embedding, rep, weight) whose vectors have size components: a, b, links, compared.

    A row says that class a reaches class b and links with so many rows; the rows of one class add up. compared counts
    the pairs whose cosine was worked out, in the first row of each list.
    """
    own = classes.where(F.size("embedding") == size).select("label", "rep", "weight", "embedding")
    n = own.count()
    wanted = max(LEAST_PIVOTS, int(PER_ROOT * np.sqrt(n)))
    few = own.select("embedding", "rep").orderBy(F.xxhash64("rep"), "rep").limit(max(LEAST_SAMPLE, SAMPLE_PER_PIVOT * wanted)).toArrow()
    sample = matrix(few["embedding"], size)
    pivots = choose_pivots(sample, wanted)
    near = min(description_length(sample, pivots, threshold), len(pivots))
    all_in_one = near < SHARED  # so few different vectors that one list holds them all

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            lists = descriptions(matrix(batch.column(3), size), pivots, near)
            if all_in_one:
                lists = np.tile(np.arange(SHARED), (len(lists), 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(lists.ravel()), lists.shape[1]).cast(pa.list_(pa.int64()))], names=[*batch.schema.names, "pivots"])

    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    listed = materialize(own.mapInArrow(describe, ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", pivots array<long>"), "pivot-lists")
    entries = listed.withColumn("pivot", F.explode("pivots"))
    lengths = entries.groupBy("label", "pivot").agg(F.count("*").alias("length"))
    blocks = materialize(lengths.where("length > 1").select("label", "pivot", F.ceil(F.col("length") / BLOCK).cast("int").alias("blocks")), "list-blocks")
    dealt = entries.join(blocks, ["label", "pivot"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "pivot", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "weight", "embedding", "pivots")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        pivot, low, high = (x.as_py() for x in key[1:])
        rep, weight, block = (table[c].to_numpy() for c in ("rep", "weight", "own"))
        lists = matrix(table["pivots"], max(near, SHARED)).astype(np.int64)
        linked, compared = meet(pivot, lists, matrix(table["embedding"], size), threshold, block if low != high else None)
        there = np.flatnonzero(linked.any(axis=1))
        reach = _component_minima(rep, linked)
        links = np.concatenate([np.where(linked[k : k + CHUNK], weight, 0).sum(axis=1) for k in range(0, len(rep), CHUNK)])
        out = {"a": rep[there], "b": reach[there], "links": links[there], "compared": np.zeros(len(there), np.int64)}
        count = {"a": [None], "b": [None], "links": [0], "compared": [compared]}
        return pa.table({k: pa.concat_arrays([pa.array(count[k], pa.int64()), pa.array(v, pa.int64())]) for k, v in out.items()})

    return dealt.groupBy("label", "pivot", "low", "high").applyInArrow(compare, "a long, b long, links long, compared long")


def vector_links(classes: DataFrame, threshold: float) -> DataFrame:
    """The links of all classes, for each number of components by an index of its own."""
    parts = [_links(classes, size, threshold) for size in sizes(classes)]
    none = classes.sparkSession.createDataFrame([], "a long, b long, links long, compared long")
    return reduce(DataFrame.unionByName, parts, none)


def vector_classes(vectors: DataFrame) -> DataFrame:
    """Rows that take part, one for each different label and vector: label, embedding, rep (smallest vec_id), weight (rows)."""
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))
    classes = vectors.where(fit).groupBy("label", "embedding").agg(F.min(F.col("vec_id").cast("long")).alias("rep"), F.count("*").alias("weight"))
    return materialize(classes, "vector-classes")


def linked_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """Per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows link whose labels are equal and whose cosine, in double precision, is at least the threshold;
    n_links counts the other rows linked directly, component_id is the smallest vec_id reachable.

    Rows of equal label and vector are one class, which is compared once and counts with its size. Each
    class is described by its nearest pivots, whose number grows with the square root of the classes; how many
    describe it is measured, so that pairs at the threshold share SHARED of them. Classes of a label
    are gathered in inverted lists by pivot, and there by a second pivot; the cosines of those which so share
    SHARED pivots are then worked out. Long lists are cut into blocks, and every pair of blocks is a
    task's group, so no list is capped and no group is larger than two blocks. A group gives counts and a
    reachable name for each class, never all pairs.

    Rows with null vec_id, null label or unusable vector link with nothing (a null vec_id has null
    component_id and kept). Vectors of different sizes don't link. Rows of equal
    vec_id count as one node of the components. An empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", "label")
    classes = vector_classes(rows)
    found = materialize(vector_links(classes, threshold), "vector-links").where("a is not null")
    joined = connected_components(found.select("a", "b"))
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    named = classes.join(counts, "rep", "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select("label", "embedding", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))
    full = rows.withColumn("fit", fit).join(materialize(named, "vector-components").withColumn("fit", F.lit(True)), ["label", "embedding", "fit"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return full.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
