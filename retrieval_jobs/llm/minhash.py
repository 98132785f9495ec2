"""Near duplicates by circulant MinHash: banded candidates, exact Jaccard, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, sized_slices, slices
from .components import connected_components
from .shingles import U, mix, shingle_sets

BANDS, ROWS = 22, 5  # at a similarity of 0.8, one pair in 6,000 meets in no band
BLOCK, BLOCK_SHINGLES = 512, 1 << 20  # members of either side of a bucket that a task holds at once, and their shingles (8 MB), by number and by length
BROADCAST_IDS = 1_000_000  # 8 MB of ids at most go to every executor; more are joined by a shuffle


def _permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit numbers: odd multipliers and shifts can be undone."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(a)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(b)
    return x ^ (x >> np.uint32(16))


def signature(shingles: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of a non-empty set: one permutation places the shingles, a second one, shifted
    round by one place for each coordinate, orders them."""
    with np.errstate(over="ignore"):
        places = _permute((shingles >> U(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
        shifts = np.arange(size, dtype=np.uint32)
        low = np.full(size, np.iinfo(np.uint32).max, np.uint32)
        for at in range(0, len(places), 2048):
            low = np.minimum(low, _permute(places[at : at + 2048, None] + shifts, 0x21F0AAAD, 0x735A2D97).min(axis=0))
        return low


def band_keys(low: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.arange(BANDS, dtype=U) + U(1)
        for k in range(ROWS):
            key = mix(key + low.reshape(BANDS, ROWS)[:, k].astype(U))
        return key.view(np.int64)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, two hashes of the whole set, band keys (null for an empty set)."""

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            counts, ones, twos, bands = [], [], [], []
            for own in shingle_sets(batch.column(1).to_pylist(), words):
                counts.append(len(own))
                with np.errstate(over="ignore"):
                    ones.append(int(own.sum().view(np.int64)) if len(own) else 0)
                    twos.append(int(mix(own).sum().view(np.int64)) if len(own) else 0)
                bands.append(band_keys(signature(own)) if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_one", "set_two", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sketch, "doc_id long, n_shingles long, set_one long, set_two long, bands array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of doc ids whose texts' full sets are similar enough.

    Many pairs have one b. Those of a b are dealt to blocks by a hash of a, and its text goes to each block once,
    before the texts of the block's other ends.
    """
    sizes = materialize(pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "pair-blocks")
    dealt = pairs.join(sizes, "b").select(F.col("b").alias("center"), F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("side"), F.col("a").alias("rep"))
    centers = sizes.select(F.col("b").alias("center"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"), F.col("b").alias("rep"))
    dealt = materialize(dealt.unionByName(centers), "dealt-pairs")
    texts = _texts(docs, dealt.select(F.col("rep").alias("doc_id")).distinct())

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []  # the sets of the group's center, of which repeated rows may give several
        for batch in sized_slices(batches, 4, 1 << 20):
            sets = shingle_sets(batch.column(4).to_pylist(), words)
            ids_a, ids_b = [], []
            for center, block, side, rep, own in zip(*[batch.column(k).to_pylist() for k in range(4)], sets, strict=True):
                if (center, block) != group:
                    group, held = (center, block), []
                if side == 0:
                    held.append(own)
                elif any(_alike(own, other, percent) for other in held):
                    ids_a.append(rep)
                    ids_b.append(center)
            if ids_a:
                yield pa.RecordBatch.from_arrays([pa.array(ids_a, pa.int64()), pa.array(ids_b, pa.int64())], names=["a", "b"])

    full = dealt.join(texts, F.col("rep") == F.col("doc_id")).select("center", "block", "side", "rep", "text")
    ordered = full.repartition("center", "block").sortWithinPartitions("center", "block", "side")
    return ordered.mapInArrow(check, "a long, b long").distinct()


def _alike(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(one, two, assume_unique=True))
    return bool(len(one)) and 100 * shared >= percent * (len(one) + len(two) - shared)


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents in ids (doc_id), each id there once."""
    ids = materialize(ids, "wanted-ids")
    small = ids.count() <= BROADCAST_IDS
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")
    return materialize(texts, "wanted-texts")


def _outside_links(placed: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) of members outside their bucket's main component with other members, the smallest one checked already.

    Of buckets with the same members one is taken. Both sides of a bucket are dealt to blocks, more of them where members are long, and a task
    goes through the groups of its blocks one after another, holding their shingles and not their texts. At most one link is given for each member
    and component that it links with, since components are all that links are for.
    """
    sizes = placed.groupBy("bucket").agg(
        F.sum(F.col("outside").cast("long")).alias("out"), F.count("*").alias("size"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who"),
        F.sum(F.when(F.col("outside"), F.col("n_shingles"))).alias("out_shingles"), F.sum("n_shingles").alias("shingles"),
    )
    sizes = sizes.where("out > 0 and size > 2").groupBy("who", "size", "out", "out_shingles", "shingles").agg(F.min("bucket").alias("bucket"))

    def number(members: str, shingles: str):
        return F.ceil(F.greatest(F.col(members) / BLOCK, F.col(shingles) / BLOCK_SHINGLES)).cast("int")

    blocks = materialize(sizes.select("bucket", number("out", "out_shingles").alias("out_blocks"), number("size", "shingles").alias("all_blocks")), "bucket-blocks")
    rows = placed.where("rep <> pivot").join(blocks, "bucket")

    def deal(side: DataFrame, number: int, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("rep"), F.col(own)).cast("int")
        side = side.withColumn("mine", mine).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        group = F.xxhash64("bucket", *(("mine", "theirs") if number == 0 else ("theirs", "mine")))
        return side.select(group.alias("group"), F.lit(number).alias("side"), "rep", "component", "outside")

    dealt = materialize(deal(rows.where("outside"), 0, "out_blocks", "all_blocks").unionByName(deal(rows, 1, "all_blocks", "out_blocks")), "dealt")
    texts = _texts(docs, dealt.select(F.col("rep").alias("doc_id")).distinct())

    def links(members: list[dict]) -> Iterator[tuple[int, int]]:
        sets = [m["shingles"] for m in members]
        many = [k for k, m in enumerate(members) if m["side"] == 1]
        if not many or not any(m["side"] == 0 for m in members):
            return
        sizes = np.array([len(sets[k]) for k in many])
        held = np.concatenate([sets[k] for k in many])
        order = np.argsort(held, kind="stable")
        held, owner = held[order], np.repeat(np.arange(len(many)), sizes)[order]
        reps = np.array([members[k]["rep"] for k in many])
        components = np.array([members[k]["component"] for k in many])
        outside = np.array([members[k]["outside"] for k in many])
        for k, one in enumerate(members):
            if one["side"] == 1 or not len(sets[k]):
                continue
            low, high = np.searchsorted(held, sets[k], "left"), np.searchsorted(held, sets[k], "right")
            n = high - low
            shared = np.bincount(owner[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(many))
            good = (100 * shared >= percent * (len(sets[k]) + sizes - shared)) & (components != one["component"]) & (~outside | (reps < one["rep"]))
            _, first = np.unique(components[good], return_index=True)
            yield from ((one["rep"], int(rep)) for rep in reps[good][first])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members, found = None, [], []
        for batch in sized_slices(batches, 5, 1 << 20):
            sets = shingle_sets(batch.column(5).to_pylist(), words)
            for row, own in zip(batch.select(range(5)).to_pylist(), sets, strict=True):
                if row["group"] != group:
                    found += links(members)
                    group, members = row["group"], []
                members.append({**row, "shingles": own})
        found += links(members)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    full = dealt.join(texts, F.col("rep") == F.col("doc_id")).select("group", "side", "rep", "component", "outside", "text")
    return full.repartition("group").sortWithinPartitions("group").mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Rows link whose sets of distinct word shingles have 100 * intersection >= percent * union;
    component_id is the smallest doc_id reachable by links, kept says whether that is the row's own.

    Equal sets are one class, named by its smallest doc_id, so copies are never paired. Classes that
    share a band are candidates. First each class is held against the smallest one of each of its
    buckets, exactly; most buckets then lie in one component. Where one doesn't, its members outside the
    smallest one's component are held against all other members that they are not yet connected to, in
    blocks. So every candidate pair is either checked or already connected. No bucket is capped, and no
    pairs are written but links.

    A null or blank text has no shingles and links with nothing. Rows of equal doc_id count as one
    document. A null doc_id has null component_id and kept, and doesn't link. An empty table gives none.
    """
    sketch = materialize(sketches(docs, words), "sketches")
    key = ["n_shingles", "set_one", "set_two"]
    classes = materialize(sketch.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    entries = classes.select("rep", "n_shingles", F.explode("bands").alias("bucket"))
    buckets = materialize(entries.groupBy("bucket").agg(F.min(F.struct("rep", "n_shingles")).alias("pivot"), F.count("*").alias("size")).where("size > 1"), "buckets")
    members = materialize(entries.join(buckets.drop("size"), "bucket").select("bucket", "rep", "n_shingles", F.col("pivot.rep").alias("pivot"), F.col("pivot.n_shingles").alias("pivot_n")), "members")

    def fits(one: str, two: str):
        """Sets of more unlike sizes can't be similar enough."""
        return 100 * F.least(one, two) >= percent * F.greatest(one, two)

    stars = materialize(members.where(F.col("rep") != F.col("pivot")).where(fits("n_shingles", "pivot_n")).select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct(), "stars")
    links = materialize(_verified(stars, docs, words, percent), "star-links")
    found = connected_components(links)

    placed = members.join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component_id", "rep")).drop("component_id")
    placed = placed.join(found.select(F.col("id").alias("pivot"), F.col("component_id").alias("pivot_component")), "pivot", "left")
    placed = placed.withColumn("outside", F.col("component") != F.coalesce("pivot_component", "pivot"))
    placed = materialize(placed.select("bucket", "rep", "n_shingles", "pivot", "component", "outside"), "placed")
    more = materialize(_outside_links(placed, docs, words, percent), "outside-links")
    if not more.isEmpty():
        found = connected_components(found.select(F.col("id").alias("a"), F.col("component_id").alias("b")).unionByName(more))

    named = classes.drop("bands").join(found.withColumnRenamed("id", "rep"), "rep", "left").select(*key, F.coalesce("component_id", "rep").alias("component_id"))
    named = materialize(named, "class-components")
    full = sketch.drop("bands").join(named, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return full.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))
