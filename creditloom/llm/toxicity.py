"""Toxicity by FTRL-proximal logistic regression over hashed words.

Features are the presence of words, pairs of neighbours and pairs with one word
between them, hashed to 2**20 places.  Every coordinate has its own learning
rate, and the L1 term keeps the weights of all but telling features at zero, so
the model is a short list that every task gets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.llm.labels import fit_rows
from creditloom.llm.text import mapped, steps, texts_of, with_arrays, with_fields, word_codes

BITS = 20

#: Most labelled documents used for fitting; every word of each counts.
FIT_ROWS = 12_000

_MIX = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93],
    dtype=np.uint64,
)


def features_of(text: bytes) -> np.ndarray:
    """Places of the features in a text, each once."""
    lowered = text.decode("utf-8", "replace").lower().encode()
    codes = word_codes(lowered.translate(_LETTERS).split()) * _MIX[0]
    pairs = (codes[:-1] * _MIX[1]) ^ codes[1:]
    gaps = (codes[:-2] * _MIX[2]) ^ codes[2:]
    mixed = np.concatenate([codes, pairs, gaps])
    mixed ^= mixed >> np.uint64(29)
    return np.unique((mixed * _MIX[3]) >> np.uint64(64 - BITS)).astype(np.int32)


_LETTERS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass
class Model:
    """The features with a weight, and the intercept."""

    places: np.ndarray
    weights: np.ndarray
    intercept: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, dtype=np.float32)
        out[self.places] = self.weights
        return out


class FTRL:
    """Follow the regularised leader, one example at a time."""

    def __init__(self, rate=2.0, smooth=1.0, l1=6.0, l2=0.1):
        self.rate, self.smooth, self.l1, self.l2 = rate, smooth, l1, l2
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, strength = self.z[at], (self.smooth + np.sqrt(self.n[at])) / self.rate + self.l2
        w = -(z - np.sign(z) * self.l1) / strength
        w[np.abs(z) <= self.l1] = 0.0
        return w

    def learn(self, at: np.ndarray, y: float) -> None:
        """One example; the last place, the intercept, is in all of them."""
        at = np.append(at, np.int32(1 << BITS))
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.rate * w
        self.n[at] = n + g * g

    def model(self) -> Model:
        w = self.weights(np.arange(len(self.z)))
        places = np.flatnonzero(w[:-1])
        return Model(places, w[places].astype(np.float32), float(w[-1]))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    text: str = "text",
    key: str = "doc_id",
    most: int = FIT_ROWS,
    rounds: int = 3,
) -> Model:
    """Fit on at most ``most`` labelled documents.

    Tasks hash the texts; the places come to the driver, which learns from them
    one by one (the method is sequential), so ``most`` bounds its memory.
    Without labelled rows nothing is known to be toxic and every score is about 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = [features_of(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("order"), batch.column("y"), pa.array(found, pa.list_(pa.int32()))],
                names=["order", "y", "at"],
            )

    order = F.xxhash64(F.lit("order"), F.col("key").cast("string"), F.col("text")).alias("order")
    rows = fit_rows(docs, labels, label, most, key, text).select(order, "y", "text")
    found = mapped(rows, run, "order long, y double, at array<int>").toArrow()
    if not found.num_rows:
        return Model(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.float32), -35.0)
    examples = []  # views of what was fetched, in an order that depends on ids and texts alone
    for batch in found.to_batches():
        at = batch.column("at")
        ends, values = at.offsets.to_numpy().tolist(), at.values.to_numpy()
        labelled = zip(ends, ends[1:], batch.column("y").to_pylist())
        examples += [(values[a:b], y) for a, b, y in labelled]
    order = np.argsort(found.column("order").to_numpy(), kind="stable")
    learner, shuffled = FTRL(), np.random.default_rng(7)
    for _ in range(rounds):
        for i in order[shuffled.permutation(len(order))]:
            learner.learn(*examples[i])
    return learner.model()


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of being toxic.

    The whole text counts.  A null or empty text has no features and gets the
    intercept's score; equal texts have equal scores; an input column called
    ``name`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**20 weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, start = shared.value.dense(), shared.value.intercept
        for batch in steps(batches, text):
            logits = [start + float(weights[features_of(t)].sum()) for t in texts_of(batch, text)]
            scores = 1.0 / (1.0 + np.exp(-np.clip(np.array(logits), -35, 35)))
            yield with_arrays(batch, {name: pa.array(scores, pa.float64())})

    return mapped(docs, run, with_fields(docs.schema, [T.StructField(name, T.DoubleType())]))
