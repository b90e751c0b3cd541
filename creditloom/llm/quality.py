"""Quality by votes of the nearest labelled documents in a latent space.

A document's terms are its words, runs of four character shapes (capital, small
letter, digit, blank, line end, each mark for itself; repetitions of a shape
count once) and bands of how varied its words are.  Words and runs are hashed,
all terms weighted by log count and rarity, and projected on the leading singular
vectors of the labelled documents.  Every document is compared with all labelled ones, block
by block, and the nearest vote with their similarity as weight.
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
from creditloom.llm.text import (
    mapped, steps, texts_of, with_arrays, with_fields, word_codes, words_of,
)

#: Most labelled documents that are fitted on and vote; bounds the broadcast.
FIT_ROWS = 4_000

BUCKETS, DIMENSIONS, NEIGHBOURS = 512, 48, 15
WORD_BUCKETS, BANDS = 1024, 16

#: Places of a document's counts: runs of shapes, three kinds of bands, words.
_WORDS = BUCKETS + 3 * BANDS
WIDTH = _WORDS + WORD_BUCKETS

_SHAPES = bytes(
    65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 57 if 48 <= c <= 57 else c
    for c in range(256)
)


def terms_of(text: bytes) -> np.ndarray:
    """Counts of a text's terms: shapes, bands of word variety and length, words."""
    out = np.zeros(WIDTH, dtype=np.float32)
    shapes = np.frombuffer(text.translate(_SHAPES), dtype=np.uint8)
    if len(shapes) > 1:
        shapes = shapes[np.concatenate([[True], shapes[1:] != shapes[:-1]])]
    codes = shapes.astype(np.uint32)
    if len(codes) >= 4:
        runs = codes[:-3] << 24 | codes[1:-2] << 16 | codes[2:-1] << 8 | codes[3:]
        at = (runs * np.uint32(2654435761)) >> np.uint32(32 - 9)
        out[:BUCKETS] = np.bincount(at, minlength=BUCKETS)
    words = words_of(text)
    count = len(words)
    if count:
        kinds = len(set(words))
        pairs = len(set(zip(words, words[1:])))
        weight = max(4.0, len(codes) / 8)
        variety = int(kinds / count**0.9 * 8)
        out[BUCKETS + min(BANDS - 1, variety)] = weight
        out[BUCKETS + BANDS + min(BANDS - 1, int(pairs / count * (BANDS - 1)))] = weight
        out[BUCKETS + 2 * BANDS + min(BANDS - 1, int(np.log2(count)))] = weight / 4
        mixed = word_codes(words) * np.uint64(0x9E3779B97F4A7C15)
        at = (mixed >> np.uint64(64 - 10)).astype(np.int64)
        out[_WORDS:] = np.bincount(at, minlength=WORD_BUCKETS)
    return out


@dataclass
class Model:
    """Term weights, projection, and the labelled documents' unit vectors and labels."""

    rarity: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def embed(self, counts: np.ndarray) -> np.ndarray:
        latent = (np.log1p(counts) * self.rarity) @ self.basis
        norm = np.linalg.norm(latent, axis=1, keepdims=True)
        return (latent / np.maximum(norm, 1e-9)).astype(np.float32)

    def vote(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Share of the similarity that the nearest labelled documents give to label 1.

        Equal similarities at the border are all counted, so ties have no order.
        """
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        near = self.embed(counts) @ self.vectors.T
        border = np.partition(near, max(0, near.shape[1] - neighbours), axis=1)
        border = border[:, max(0, near.shape[1] - neighbours)][:, None]
        weight = np.where(near >= border, np.maximum(near, 0.0) ** 8, 0.0)
        total = weight.sum(axis=1)
        share = (weight @ self.labels) / np.maximum(total, 1e-12)
        return np.where(total > 0, share, self.labels.mean())


def learned(counts: np.ndarray, labels: np.ndarray) -> Model:
    """Latent space and votes from term counts and labels."""
    seen = (counts > 0).sum(axis=0)
    rarity = np.log((1.0 + len(counts)) / (1.0 + seen)).astype(np.float32)
    weighted = np.log1p(counts) * rarity
    weighted /= np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-9)
    _, vectors = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
    model = Model(rarity, vectors[:, ::-1][:, :DIMENSIONS].astype(np.float32), None, labels)
    model.vectors = model.embed(counts)
    return model


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    text: str = "text",
    key: str = "doc_id",
    most: int = FIT_ROWS,
) -> Model:
    """Learn from at most ``most`` labelled documents, a bound on what is broadcast.

    Counting terms is done by tasks; the counts (``most`` short rows) meet in
    the driver.  Without labelled rows every score is one half.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            counts = [terms_of(t).tobytes() for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("order"), batch.column("y"), pa.array(counts, pa.binary())],
                names=["order", "y", "counts"],
            )

    order = F.xxhash64(F.lit("order"), F.col("key").cast("string"), F.col("text")).alias("order")
    rows = fit_rows(docs, labels, label, most, key, text).select(order, "y", "text")
    found = mapped(rows, run, "order long, y double, counts binary").toArrow().sort_by("order")
    counts = np.frombuffer(b"".join(found.column("counts").to_pylist()), dtype=np.float32)
    y = found.column("y").to_numpy().astype(np.float32)
    return learned(counts.reshape(-1, WIDTH), y)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the share of votes for label 1, from 0 to 1.

    The whole text counts.  A null or empty text has no direction and gets the
    labelled documents' mean; equal texts have equal scores; an input column
    called ``name`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FIT_ROWS vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text, 1 << 20):
            texts, scores = texts_of(batch, text), []
            for start in range(0, len(texts), 256):
                block = np.stack([terms_of(t) for t in texts[start : start + 256]])
                scores.append(shared.value.vote(block))
            values = np.clip(np.concatenate(scores), 0.0, 1.0).astype(np.float64)
            yield with_arrays(batch, {name: pa.array(values, pa.float64())})

    return mapped(docs, run, with_fields(docs.schema, [T.StructField(name, T.DoubleType())]))
