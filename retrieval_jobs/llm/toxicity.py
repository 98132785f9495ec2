"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import slices
from .labelled import TRAINING_ROWS, training_sample

BITS = 20  # n-grams are hashed to 2**BITS numbers
SHORTEST, LONGEST = 3, 6
FEATURES = 4096  # the n-grams whose counts differ most surely between the classes
STEPS = 150


def gram_numbers(text: str) -> Iterator[np.ndarray]:
    """Hashes of the character n-grams of a whole text, lower-cased, blanks as one space, one array per length."""
    spaced = " " + " ".join(text.lower().split()) + " "
    codes = np.frombuffer(spaced.encode("utf-32-le", "surrogatepass"), np.uint32)
    rolling = codes
    for n in range(2, LONGEST + 1):
        if len(codes) < n:
            return
        rolling = (rolling[:-1] * np.uint32(0x9E3779B1)) ^ (codes[n - 1 :] * np.uint32(0x85EBCA6B))
        rolling = rolling ^ (rolling >> np.uint32(15))
        if n >= SHORTEST:
            yield (rolling * np.uint32(0xC2B2AE35) + np.uint32(n)) >> np.uint32(32 - BITS)


@dataclass
class ToxicityModel:
    """place: feature of each n-gram number, -1 for most; weights already hold the log-count ratios."""

    place: np.ndarray
    weights: np.ndarray
    bias: float

    def found(self, text: str) -> np.ndarray:
        """The model's features that occur in a text."""
        hits = [places[places >= 0] for places in (self.place[grams] for grams in gram_numbers(text))]
        return np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int16)

    def score(self, text: str) -> float:
        own = self.found(text)
        raw = self.weights[own].sum() / np.sqrt(len(own) + 1) + self.bias
        return float(1 / (1 + np.exp(-np.clip(raw, -30, 30))))


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's rows, in how many documents of either label each n-gram number occurs."""
    seen = np.zeros((2, 1 << BITS), np.int64)
    for batch in slices(batches, 512):
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if grams := list(gram_numbers(text)):
                seen[label, np.unique(np.concatenate(grams))] += 1
    there = np.flatnonzero(seen.any(axis=0))
    for at in range(0, len(there), 100_000):
        part = there[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (part, seen[1, part], seen[0, part])], names=["gram", "ones", "zeros"])


def train_toxicity(docs: DataFrame, labels: DataFrame, allowed: Column, rows: int = TRAINING_ROWS) -> ToxicityModel:
    """Fits on a bounded sample of the labelled rows for which allowed holds.

    N-grams are counted in tasks and summed by Spark; the FEATURES with the most certain log-count ratios
    go to the driver, and of each sampled row the features it has. Logistic regression learns on presence
    times ratio, divided by the root of the number of features present, with the classes weighted 35 to 65. With one class only every score
    is 0 or 1, as that class says; without labels 0.
    """
    sample = training_sample(docs, labels, "toxic", allowed, rows)
    totals = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    place = np.full(1 << BITS, -1, np.int16)
    if len(totals) < 2:
        return ToxicityModel(place, np.zeros(0), 30.0 if 1 in totals else -30.0)
    counts = sample.mapInArrow(_counts, "gram long, ones long, zeros long").groupBy("gram").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    ones, zeros = F.col("ones") + 0.5, F.col("zeros") + 0.5
    ratio = F.log(ones / zeros) - float(np.log((totals[1] + 1) / (totals[0] + 1)))
    best = counts.select("gram", ratio.alias("ratio"), (F.abs(ratio) / F.sqrt(1 / ones + 1 / zeros)).alias("certainty")).where("certainty > 2")
    best = best.orderBy(F.desc("certainty"), "gram").limit(FEATURES).collect()
    place[[r.gram for r in best]] = np.arange(len(best))
    ratios = np.array([r.ratio for r in best], np.float64)
    draft = ToxicityModel(place, ratios, 0.0)

    def present(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            yield pa.RecordBatch.from_arrays([pa.array([draft.found(x) for x in batch.column(0).to_pylist()], pa.list_(pa.int16())), batch.column(1)], names=["found", "label"])

    got = sorted(sample.mapInArrow(present, "found array<smallint>, label int").collect(), key=lambda r: (r.label, r.found))
    label = np.array([r.label for r in got], np.float64)
    sizes = np.array([len(r.found) for r in got])
    row = np.repeat(np.arange(len(got)), sizes)
    feature = np.array([x for r in got for x in r.found], np.int64)
    value = ratios[feature] / np.sqrt(sizes + 1)[row]
    share = np.where(label == 1, 0.35 / label.sum(), 0.65 / (1 - label).sum())  # the rarer class weighs more than its rows
    weights = np.zeros(len(ratios) + 1)  # the last one is the bias
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):  # Adam
        raw = np.bincount(row, value * weights[feature], len(got)) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label) * share
        slope = np.append(np.bincount(feature, value * error[row], len(ratios)) + 1e-4 * weights[:-1], error.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
        weights -= 0.03 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return ToxicityModel(place, weights[:-1] * ratios, float(weights[-1]))


def with_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs with a column ``toxicity_score``, the probability of label 1 from the whole text; a null text counts as empty.

    All other columns stay; one named toxicity_score is replaced.
    """
    kept = [c for c in docs.columns if c != "toxicity_score"]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = StructType([*docs.schema.fields, StructField("toxicity_score", DoubleType())])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([model.score(x or "") for x in texts], pa.float64())], names=[*batch.schema.names, "toxicity_score"])

    return docs.mapInArrow(score, schema)
