"""Quality by preference: a Bradley-Terry model over text statistics, cut at a quantile of its scores."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import slices
from .labelled import TRAINING_ROWS, training_sample
from .vectors import matrix

PAIRS, STEPS, SEED = 20_000, 400, 2
MEASURES, HASHED = 15, 256  # of a text: measures, and shares of byte trigrams by hash
HASHED_SCALE = 0.3  # trigrams are many and each says little, so the penalty holds them back
PUNCTUATION = [ord(x) for x in ".,;:?"]


def text_statistics(text: str) -> np.ndarray:
    """Features of a whole text: MEASURES of lengths, kinds of characters, repetition and lines, then the roots of the
    shares that its byte trigrams have by HASHED hashes."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    count = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    often = Counter(words)
    upper, lower, digits = kinds[65:91].sum(), kinds[97:123].sum(), kinds[48:58].sum()
    usual, wide = kinds[PUNCTUATION].sum(), kinds[128:].sum()
    symbols = n - upper - lower - digits - usual - wide - kinds[32] - kinds[10]
    codes = np.frombuffer(raw, np.uint8).astype(np.uint32)
    trigrams = (codes[:-2] | codes[1:-1] << np.uint32(8) | codes[2:] << np.uint32(16)) * np.uint32(2654435761) >> np.uint32(24)
    hashed = np.sqrt(np.bincount(trigrams, minlength=HASHED) / n)
    measures = [
        np.log(n), np.log(count), n / count, upper / n, digits / n, usual / n, symbols / n, wide / n,
        len(often) / count, max(often.values(), default=0) / count, len(set(lines)) / max(1, len(lines)),
        np.log(n / max(1, len(lines))), len(zlib.compress(raw, 1)) / n,
        sum(len(x) <= 3 for x in words) / count, count / max(1, len(lines)),
    ]
    return np.concatenate([measures, hashed])


@dataclass
class PreferenceModel:
    """raw score = weights . features; the probability of label 1 crosses one half at the threshold."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    constant: float | None = None

    def features(self, statistics: np.ndarray) -> np.ndarray:
        z = np.clip((statistics - self.center) / self.scale, -6, 6)
        own = z[:, :MEASURES]
        return np.concatenate([own, HASHED_SCALE * z[:, MEASURES:], own * own], axis=1)

    def scores(self, statistics: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(statistics), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.features(statistics) @ self.weights - self.threshold, -30, 30)))


def fit_preferences(statistics: np.ndarray, label: np.ndarray) -> PreferenceModel:
    """Learns from pairs of a label-1 and a label-0 text: logistic loss on the difference of their features.

    The threshold is the quantile of the training scores at the share of label 0. With one class only,
    every score is the share of label 1 (one half without any label).
    """
    share = float(label.mean()) if len(label) else 0.5
    size = statistics.shape[1]
    weights = np.zeros(size + MEASURES)
    if share in (0.0, 1.0) or not len(label):
        return PreferenceModel(np.zeros(size), np.ones(size), weights, 0.0, share)
    model = PreferenceModel(statistics.mean(axis=0), statistics.std(axis=0) + 1e-9, weights, 0.0)
    x = model.features(statistics)
    draw = np.random.default_rng(SEED)
    better, worse = (draw.choice(np.flatnonzero(label == k), PAIRS) for k in (1, 0))
    apart = (x[better] - x[worse]).astype(np.float32)
    for _ in range(STEPS):
        doubt = 1 / (1 + np.exp(np.clip(apart @ model.weights.astype(np.float32), -30, 30)))
        model.weights += 0.3 * (apart.T @ doubt / len(apart) - 1e-3 * model.weights)
    model.threshold = float(np.quantile(x @ model.weights, 1 - share))
    return model


def train_quality(docs: DataFrame, labels: DataFrame, allowed: Column, rows: int = TRAINING_ROWS) -> PreferenceModel:
    """Fits on a bounded sample of the labelled rows for which allowed holds; the driver gets their statistics."""
    sample = training_sample(docs, labels, "quality", allowed, rows)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            yield pa.RecordBatch.from_arrays([pa.array([text_statistics(x) for x in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], names=["statistics", "label"])

    got = sample.mapInArrow(measure, "statistics array<double>, label int").toArrow()
    statistics, label = matrix(got["statistics"], MEASURES + HASHED), got["label"].to_numpy().astype(np.float64)
    order = np.lexsort((*statistics[:, :3].T, label))  # however the rows come, the model is the same
    return fit_preferences(statistics[order], label[order])


def with_quality(docs: DataFrame, model: PreferenceModel) -> DataFrame:
    """docs with a column ``quality_score``, the probability of label 1 from the whole text; a null text counts as empty.

    All other columns stay; one named quality_score is replaced.
    """
    kept = [c for c in docs.columns if c != "quality_score"]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = StructType([*docs.schema.fields, StructField("quality_score", DoubleType())])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            got = model.scores(np.array([text_statistics(x or "") for x in texts]).reshape(-1, MEASURES + HASHED))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*batch.schema.names, "quality_score"])

    return docs.mapInArrow(score, schema)
