"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A run of three letters is bound
into one vector: the letters' vectors, rotated by their place in the run, are
multiplied.  A text's profile is the sum (bundle) of the vectors of all its
runs, a language's prototype the sum over its documents, and a document gets the
language whose prototype has the largest cosine with its profile.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.llm.text import mapped, steps, with_arrays, with_fields

SIZE, RUN = 1024, 3

#: Runs whose vectors a task keeps at most, and runs bundled at a time.
KEPT, BLOCK = 30_000, 2_048

UNKNOWN = "und"

FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


class Bundler:
    """Profiles of texts.  Letter vectors follow from the letter alone, so all tasks agree."""

    def __init__(self, size: int = SIZE):
        self.size = size
        self.letters: dict[int, np.ndarray] = {}
        self.places: dict[int, int] = {}
        self.vectors = np.zeros((KEPT, size), dtype=np.int8)
        self.classes = np.full(0x110000, -1, dtype=np.int32)  # filled as letters are met

    def letter(self, code: int) -> np.ndarray:
        known = self.letters.get(code)
        if known is None:
            bits = np.random.default_rng([20, code]).integers(0, 2, self.size, dtype=np.int8)
            known = self.letters[code] = bits * 2 - 1
        return known

    def run_vector(self, run: int) -> np.ndarray:
        """Bound vector of three code points packed into one integer."""
        codes = (run >> 42, run >> 21 & 0x1FFFFF, run & 0x1FFFFF)
        out = np.roll(self.letter(codes[0]), 2) * np.roll(self.letter(codes[1]), 1)
        return out * self.letter(codes[2])

    def _simple(self, codes: np.ndarray) -> np.ndarray:
        """Lower-case letters stay, everything else becomes a blank (0)."""
        kinds = self.classes[codes]
        if (kinds < 0).any():
            for code in np.unique(codes[kinds < 0]).tolist():
                lowered = chr(code).lower()
                letter = unicodedata.category(lowered[0])[0] == "L"
                self.classes[code] = ord(lowered[0]) if letter else 0
            kinds = self.classes[codes]
        return kinds

    def runs(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct runs of a text and how often each occurs; none if it has no letter."""
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
        kinds = self._simple(codes)
        if not kinds.any():
            return np.empty(0, dtype=np.int64), np.empty(0)
        padded = np.concatenate([[0], kinds, [0]]).astype(np.int64)
        keep = np.concatenate([[True], (padded[1:] != 0) | (padded[:-1] != 0)])
        padded = padded[keep]  # one blank between words
        packed = padded[:-2] << 42 | padded[1:-1] << 21 | padded[2:]
        return np.unique(packed, return_counts=True)

    def profiles(self, texts: list[str]) -> np.ndarray:
        """One bundle per text, all zero for a text without letters."""
        found = [self.runs(t) for t in texts]
        out = np.zeros((len(texts), self.size), dtype=np.float32)
        every = [r for r, _ in found if len(r)]
        if not every:
            return out
        distinct = np.unique(np.concatenate(every))
        for start in range(0, len(distinct), BLOCK):
            block = distinct[start : start + BLOCK]
            counts = np.zeros((len(texts), len(block)), dtype=np.float32)
            for row, (runs, times) in enumerate(found):
                low, high = np.searchsorted(runs, [block[0], block[-1] + 1])
                counts[row, np.searchsorted(block, runs[low:high])] = times[low:high]
            out += counts @ self._rows(block).astype(np.float32)
        return out

    def _rows(self, runs: np.ndarray) -> np.ndarray:
        places = self.places
        if len(places) + len(runs) > KEPT:
            places.clear()
        at = []
        for run in runs.tolist():
            place = places.get(run)
            if place is None:
                place = places[run] = len(places)
                self.vectors[place] = self.run_vector(run)
            at.append(place)
        return self.vectors[at]


@dataclass
class Prototypes:
    """One vector per language."""

    names: list[str]
    vectors: np.ndarray


def _strings(batch: pa.RecordBatch, column: str) -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", size: int = SIZE) -> Prototypes:
    """Prototypes from all rows of ``docs`` with a language.

    Each task bundles its documents per language; the sums of the tasks are
    added by place, so what is shuffled and fetched is languages times ``size``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler, sums = Bundler(size), {}
        for batch in steps(batches, text, 1 << 20):
            names = np.array(batch.column(lang).to_pylist(), dtype=object)
            profiles = bundler.profiles(_strings(batch, text))
            for name in set(names):
                part = profiles[names == name].sum(axis=0, dtype=np.float64)
                sums[name] = sums.get(name, 0.0) + part
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * size), pa.array(range(size), pa.int32()), pa.array(total)],
                names=["lang", "place", "value"],
            )

    rows = docs.where(F.col(lang).isNotNull()).select(
        F.col(lang).cast("string").alias(lang), text
    )
    parts = mapped(rows, run, "lang string, place int, value double")
    sums = parts.groupBy("lang", "place").agg(F.sum("value").alias("value")).toArrow()
    names = sorted(set(sums.column("lang").to_pylist()))
    vectors = np.zeros((len(names), size))
    at = {name: i for i, name in enumerate(names)}
    rows_at = [at[n] for n in sums.column("lang").to_pylist()]
    vectors[rows_at, sums.column("place").to_numpy()] = sums.column("value").to_numpy()
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    kept = norms[:, 0] > 0  # a language without any letter teaches nothing
    names = [n for n, k in zip(names, kept) if k]
    return Prototypes(names, (vectors[kept] / norms[kept]).astype(np.float32))


def predict(docs: DataFrame, prototypes: Prototypes, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the cosine with the chosen prototype.

    The whole text counts.  Null, empty and letterless texts, and all texts if no
    language was learned, get ``und`` and 0.  At equal cosine the language first
    in the alphabet is taken.  Input columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(prototypes)  # languages times SIZE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        bundler = Bundler(known.vectors.shape[1] if len(known.names) else SIZE)
        for batch in steps(batches, text, 1 << 20):
            profiles = bundler.profiles(_strings(batch, text))
            norms = np.linalg.norm(profiles, axis=1)
            if known.names:
                near = (profiles @ known.vectors.T) / np.maximum(norms, 1e-9)[:, None]
                best = near.argmax(axis=1)
                names = [known.names[i] if n > 0 else UNKNOWN for i, n in zip(best, norms)]
                scores = np.where(norms > 0, np.clip(near.max(axis=1), 0.0, 1.0), 0.0)
            else:
                names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            yield with_arrays(
                batch,
                {
                    "lang_pred": pa.array(names, pa.string()),
                    "score": pa.array(scores.astype(np.float64), pa.float64()),
                },
            )

    return mapped(docs, run, with_fields(docs.schema, FIELDS))

