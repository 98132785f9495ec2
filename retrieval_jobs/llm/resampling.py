"""Drawing documents that are like a target text: hashed features, a gain for each bucket, and a distributed quickselect."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import materialize, sized_slices

SEGMENT = 1 << 20  # bytes of a text whose words are held at once
PIVOTS = 32
#: A-Z to lower case; letters, digits and all bytes of other characters stay; the rest ends words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
KEY = ("below", "unnamed", "named", "n_features")


def feature_buckets(text: bytes, grams: int, buckets: int) -> tuple[int, np.ndarray]:
    """The number of words of a text, and the bucket of each of its runs of 1 to grams words."""
    folded, at, tail, n_words = text.translate(FOLD), 0, [], 0
    found = []
    while at < len(folded):
        end = folded.find(b" ", at + SEGMENT)
        end = len(folded) if end < 0 else end
        new = folded[at:end].split()
        n_words += len(new)
        words = tail + new
        for n in range(1, grams + 1):
            own = words[max(0, len(tail) - n + 1) :]
            runs = own if n == 1 else map(b" ".join, zip(*(own[k:] for k in range(n)), strict=False))
            found.append(np.fromiter(map(zlib.crc32, runs), np.uint32) % np.uint32(buckets))
        tail = words[len(words) - grams + 1 :] if grams > 1 else []
        at = end
    return n_words, np.concatenate(found) if found else np.zeros(0, np.uint32)


def _kind(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def bucketed(texts: DataFrame, grams: int, buckets: int) -> DataFrame:
    """texts (one column of any type, then text) with n_words, n_features and features, the buckets as an array of bytes, in place of the text.

    A null text has no words.
    """
    key = texts.columns[0]
    kind = _kind(buckets)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_slices(batches, 1):
            found = [feature_buckets(x or b"", grams, buckets) for x in batch.column(1).to_pylist()]
            columns = [
                batch.column(0),
                pa.array([n for n, _ in found], pa.int64()),
                pa.array([len(x) for _, x in found], pa.int64()),
                pa.array([x.astype(kind).tobytes() for _, x in found], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_words", "n_features", "features"])

    schema = StructType([texts.schema[0], StructField("n_words", LongType()), StructField("n_features", LongType()), StructField("features", BinaryType())])
    return texts.select(F.col(f"`{key}`"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(find, schema)


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all rows each bucket has; summed up in every task, so `buckets` rows at most come from each."""
    kind = _kind(buckets)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in sized_slices(batches, 0):
            for raw in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(raw, kind), minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], names=["bucket", "n"])

    rows = features.select("features").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def bucket_gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(((t + 1) (S + B)) / ((s + 1) (T + B)))) of each bucket, from its counts s and t, their sums S and T, and B buckets."""
    n = len(own)
    all_own, all_target = float(own.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_own / ((s + 1.0) * all_target))) for s, t in zip(own.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """features with weight, the floored mean of the gains of a row's features (0 where it has none), in place of them."""
    names = [c for c in features.columns if c != "features"]
    kind = _kind(len(gains))

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_slices(batches, len(names)):
            sums = [int(gains[np.frombuffer(raw, kind)].sum()) // max(1, len(raw) // kind.itemsize) for raw in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sums, pa.int64())], names=[*names, "weight"])

    ordered = features.select(*names, "features")
    return ordered.mapInArrow(weigh, StructType([*ordered.schema.fields[:-1], StructField("weight", LongType())]))


def noisy_score(weight: Column, doc_id: Column, seed: int) -> Column:
    """weight with Gumbel noise, in thousandths, from a hash of seed and doc_id (a null one as an empty text)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def pivot_counts(rows: DataFrame, pivots: list[tuple]) -> list[tuple[int, int]]:
    """For each pivot key, how many rows are smaller and how many equal; each task sends two numbers for each pivot."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        smaller, equal = np.zeros(len(pivots), np.int64), np.zeros(len(pivots), np.int64)
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            for n, pivot in enumerate(pivots):
                less, same = np.zeros(batch.num_rows, bool), np.ones(batch.num_rows, bool)
                for column, bound in zip(columns, pivot, strict=True):
                    less |= same & (column < bound)
                    same &= column == bound
                smaller[n] += less.sum()
                equal[n] += same.sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pivots)), pa.int32()), pa.array(smaller), pa.array(equal)], names=["pivot", "smaller", "equal"])

    counts = rows.select(*KEY).mapInArrow(count, "pivot int, smaller long, equal long")
    found = {r.pivot: (r.smaller, r.equal) for r in counts.groupBy("pivot").agg(F.sum("smaller").alias("smaller"), F.sum("equal").alias("equal")).collect()}
    return [found[n] for n in range(len(pivots))]


def kth_key(rows: DataFrame, k: int, pivots: int = PIVOTS) -> tuple | None:
    """The k-th smallest key (the columns KEY, none null) of rows, from 1; None where there are fewer.

    Each round draws random pivot keys from the rows still in question, counts exactly how many are smaller and how many equal for
    each pivot, and goes on between the two pivots that enclose the k-th. Only those rows are written for the next round. A pivot leaves
    the rows with all its equals, so it ends, with ties of any number.
    """
    key = F.struct(*KEY)
    if k < 1:
        return None
    turn = 0
    while True:
        drawn = rows.select(*KEY).orderBy(F.xxhash64(F.lit(turn), *KEY)).limit(pivots).collect()
        if not drawn:
            return None
        bounds = sorted({tuple(r) for r in drawn})
        inside, before = F.lit(True), 0
        for bound, (smaller, equal) in zip(bounds, pivot_counts(rows, bounds), strict=True):
            if k <= smaller:
                inside = inside & (key < key_of(bound))
                break
            if k <= smaller + equal:
                return bound
            inside, before = key > key_of(bound), smaller + equal
        rows, k, turn = materialize(rows.select(*KEY).where(inside), "select"), k - before, turn + 1


def key_of(values: tuple) -> Column:
    return F.struct(*[F.lit(x).cast("long").alias(c) for x, c in zip(values, KEY, strict=True)])


def ranked(rows: DataFrame) -> DataFrame:
    """rows with rank, from 1 in order of KEY: dealt out by ranges of the key, numbered in each, and the ranges added up."""
    dealt = materialize(rows.repartitionByRange(*KEY).withColumn("part", F.spark_partition_id()), "winners")
    counts = dealt.groupBy("part").agg(F.count("*").alias("here"))
    # one row per range
    before = F.coalesce(F.sum("here").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.join(F.broadcast(counts.select("part", before.alias("before"))), "part")
    return placed.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*KEY)) + F.col("before")).drop("part", "before")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, grams: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_features, weight, score, and rank for the percent of them that are drawn.

    target has a column text. Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case; features are the runs of 1
    to grams of them, hashed to buckets. A bucket's gain says how much likelier it is in target than in docs, a document's weight is the
    mean gain of its features, and its score adds noise, so that the highest scores are a draw by weight. Of the documents with
    min_words or more, percent of a hundred, rounded down, with the highest scores are drawn; ties go to the smaller doc_id (null
    last), then to fewer features. A null or empty text has no features and weight 0; an empty target has no features either. Of equal rows
    each counts, and any may be the drawn ones. Other columns are not looked at. An empty table gives no rows.

    Texts are read once: their features are written as arrays, which the counts and the weights read.
    """
    features = materialize(bucketed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), grams, buckets), "features")
    wanted = bucketed(target.select(F.lit(0).alias("item"), "text"), grams, buckets)
    gains = bucket_gains(bucket_counts(features, buckets), bucket_counts(wanted, buckets))
    scored = weighed(features, gains).withColumn("score", noisy_score(F.col("weight"), F.col("doc_id"), seed))
    keyed = scored.withColumns({"below": -F.col("score"), "unnamed": F.col("doc_id").isNull().cast("long"), "named": F.coalesce("doc_id", F.lit(0).cast("long"))})
    keyed = materialize(keyed, "scores")
    allowed = F.col("n_words") >= min_words
    k = keyed.where(allowed).count() * percent // 100
    last = kth_key(keyed.where(allowed), k)
    shown = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return keyed.select(*shown, F.lit(None).cast("long").alias("rank"))
    wins = allowed & (F.struct(*KEY) <= key_of(last))
    winners = ranked(keyed.where(wins)).select(*shown, F.when(F.col("rank") <= k, F.col("rank")).cast("long").alias("rank"))
    return winners.unionByName(keyed.where(~wins).select(*shown, F.lit(None).cast("long").alias("rank")))
