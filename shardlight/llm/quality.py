"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Features are runs of one and two words, over the words as written and over their shapes (capitals, small
letters, digits, punctuation), hashed into ``2**bits`` slots. A feature's value is its share of the text's
features times ``scale``, so a score is one sparse dot product and doesn't depend on the text's length.

Training reads at most ``max_labelled`` labelled rows, those with the smallest hashes of ``doc_id``; that bound
is the only one. Scoring covers every row and whole texts.

Defined cases: a null text, or one without words, has a null score and isn't kept; a label of null, or of a
document that isn't there or has no words, isn't used; repeated rows are scored one by one; with no labels of
both kinds the model is empty, every text with words scores 0.5 and is kept; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import only, release
from .textkit import RAW, SHAPE, U64, run_hashes, slices, split_words


@dataclass(frozen=True)
class Model:
    """Weights that aren't zero, and the intercept. Its size depends on the bounded sample alone."""

    slots: np.ndarray
    weights: np.ndarray
    intercept: float
    bits: int
    scale: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits)
        out[self.slots] = self.weights
        return out


def _streams(data: np.ndarray, begin: np.ndarray, bits: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(slots, bounds by text) of each kind of feature, and the features of each text."""
    words = split_words(data, begin)
    out, total = [], np.zeros(len(begin) - 1, np.int64)
    for salt, classes in enumerate((RAW, SHAPE)):
        one = words.hashes(classes)
        for n in (1, 2):
            hashed, at = (one, np.arange(len(one))) if n == 1 else run_hashes(one, words.first, n)
            slot = ((hashed + U64((2 * salt + n) * 0x51ED27)) >> U64(64 - bits)).astype(np.int64)
            bounds = np.searchsorted(at, words.first)
            out.append((slot, bounds))
            total += np.diff(bounds)
    return out, total


def examples(texts: pa.Array, bits: int, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slots and values of each text."""
    for _, data, begin in slices(texts):
        streams, total = _streams(data, begin, bits)
        for k, n in enumerate(total):
            slots, counts = np.unique(np.concatenate([s[b[k] : b[k + 1]] for s, b in streams]), return_counts=True)
            yield slots.astype(np.int32), counts * (scale / max(1, n))


def fit(texts: pa.Array, good: np.ndarray, bits: int = 20, scale: float = 30.0, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.3, l2: float = 1.0, epochs: int = 3) -> Model:
    """FTRL-proximal with rates by coordinate; l1 sets most weights to zero."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    z0 = n0 = 0.0

    def weight(z_: np.ndarray, n_: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z_) <= l1, 0.0, (np.sign(z_) * l1 - z_) / ((beta + np.sqrt(n_)) / alpha + l2))

    rows = [(s, v, y) for (s, v), y in zip(examples(texts, bits, scale), good, strict=True) if len(s)]
    if len({y for *_, y in rows}) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, bits, scale)
    for _ in range(epochs):
        for slots, values, y in rows:
            w = weight(z[slots], n[slots])
            w0 = -z0 / ((beta + n0**0.5) / alpha)
            error = 1 / (1 + np.exp(-np.clip(w @ values + w0, -35, 35))) - y
            g = error * values
            z[slots] += g - (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / alpha * w
            n[slots] += g * g
            z0 += error - ((n0 + error * error) ** 0.5 - n0**0.5) / alpha * w0
            n0 += error * error
    w = weight(z, n)
    slots = np.flatnonzero(w)
    return Model(slots, w[slots], float(-z0 / ((beta + n0**0.5) / alpha)), bits, scale)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 6000, **settings: float) -> Model:
    """Fits on the labelled documents with the smallest hashes, at most ``max_labelled``."""
    chosen = (
        only(labels, "doc_id", "quality")
        .where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    rows = (
        only(docs, "doc_id", "text")
        .where("text IS NOT NULL")
        .join(F.broadcast(chosen), "doc_id")  # at most max_labelled rows of two numbers
        .groupBy("doc_id")
        .agg(F.max("text").alias("text"), F.first("quality").alias("quality"))
        .toArrow()
    )
    order = pc.sort_indices(rows["doc_id"])
    shuffled = np.asarray(order)[np.random.default_rng(7).permutation(rows.num_rows)]
    rows = rows.take(pa.array(shuffled))
    try:
        return fit(rows["text"].combine_chunks(), np.asarray(rows["quality"]) > 0, **settings)
    finally:
        del rows
        release()


def score_texts(texts: pa.Array, model: Model, weights: np.ndarray) -> np.ndarray:
    """Probability that each text is good; NaN where there are no words."""
    out = []
    for _, data, begin in slices(texts):
        streams, total = _streams(data, begin, model.bits)
        dot = np.zeros(len(total))
        for slot, bounds in streams:
            sums = np.concatenate([[0.0], np.cumsum(weights[slot])])
            dot += sums[bounds[1:]] - sums[bounds[:-1]]
        with np.errstate(invalid="ignore", divide="ignore"):
            x = np.clip(model.intercept + dot * model.scale / total, -35, 35)
        out.append(np.where(total > 0, 1 / (1 + np.exp(-x)), np.nan))
    return np.concatenate(out) if out else np.zeros(0)


def scored(docs: DataFrame, model: Model, column: str = "quality_score") -> DataFrame:
    """All rows and columns of ``docs`` with the score as ``column``."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = model.dense()
        for texts in batches:
            p = score_texts(texts, model, weights)
            yield pa.array(np.round(p, 9), mask=np.isnan(p))
        release()

    return docs.withColumn(column, score(docs["`text`"]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_labelled: int = 6000) -> DataFrame:
    """``doc_id``, ``score`` and ``keep`` of every document."""
    rows = scored(only(docs, "doc_id", "text"), train(docs, labels, max_labelled), "score")
    return rows.select("doc_id", "score", F.coalesce(F.col("score") >= threshold, F.lit(False)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_labelled: int = 6000) -> DataFrame:
    """The documents that score at least ``threshold``, with all their columns."""
    name = "score"
    while name in docs.columns:
        name += "_"
    rows = scored(docs, train(docs, labels, max_labelled), name)
    return rows.where(F.col(f"`{name}`") >= threshold).drop(name)
