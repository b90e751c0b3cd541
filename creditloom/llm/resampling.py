"""Target-distribution importance resampling over hashed runs of words.

An Aho-Corasick automaton over delimiter-bounded words carries a payload for
each: its CRC-32 and its length in bytes.  One scan of a text emits the payloads
of its words in order.  Payloads of neighbouring words are composed (the CRC of a
concatenation follows from the parts' CRCs and the second part's length), which
gives the CRC of every run of words without building its text, and from it the
bucket of the run.

Bucket counts of the documents and of the target texts give each bucket a gain,
the mean gain of its runs gives a document its weight, and the weight plus a
Gumbel number drawn from a hash of the id orders the documents; the first of
that order are the draw.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.llm.tables import written
from creditloom.llm.text import STEP_BYTES, WORD_BYTES, mapped, steps, texts_of

BUCKETS, RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024

#: Words that a task's automaton keeps from earlier batches.  Beyond it the task
#: begins a new one; no result depends on what it holds.
WORDS = 200_000

#: Words of more code points get their payload directly: the automaton's memory
#: grows with the length of its patterns.
LONG = 256
LONG_WORD = re.compile(f"[^ ]{{{LONG + 1},}}")

BLANK = crc32(b" ")


def _bytes(word: str) -> bytes:
    return word.encode("utf-8", "surrogateescape")


@cache
def _appended(length: int) -> np.ndarray:
    """Four tables of 256: what ``length`` more bytes make of each byte of a CRC."""
    zeros = bytes(length)
    none = crc32(zeros)
    bits = [crc32(zeros, 1 << k) ^ none for k in range(32)]
    tables = np.zeros((4, 256), dtype=np.uint32)
    for byte, value in itertools.product(range(4), range(256)):
        for k in range(8):
            if value >> k & 1:
                tables[byte, value] ^= np.uint32(bits[8 * byte + k])
    return tables


def composed(
    left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """Payloads (CRC-32, length) of the concatenations of two rows of payloads."""
    (crc, size), (then, more) = left, right
    out = then.copy()
    for length in np.unique(more):
        at = more == length
        tables, x = _appended(int(length)), crc[at]
        for byte in range(4):
            out[at] ^= tables[byte][(x >> np.uint32(8 * byte)) & np.uint32(255)]
    return out, size + more


def runs(crc: np.ndarray, size: np.ndarray, counts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """CRCs of all runs of 1 to ``longest`` words of each text, and the number of runs per text.

    ``counts`` are words per text.  Runs are ordered by text, then length, then place.
    """
    owner = np.repeat(np.arange(len(counts)), counts)
    blank = np.full(len(crc), BLANK, np.uint32), np.ones(len(crc), np.int64)
    owners, crcs, now = [owner], [crc], (crc, size)
    for length in range(2, longest + 1):
        n = max(0, len(crc) - length + 1)
        left = composed(tuple(x[:n] for x in now), tuple(x[:n] for x in blank))
        now = composed(left, (crc[length - 1 :][:n], size[length - 1 :][:n]))
        inside = owner[:n] == owner[length - 1 :][:n]
        owners.append(owner[:n][inside])
        crcs.append(now[0][inside])
    if longest == 1:
        return crc, counts
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(crcs)[order], np.bincount(owners, minlength=len(counts))


class Dictionary:
    """An automaton over ``" word "`` patterns that learns the words it meets."""

    def __init__(self, most: int = WORDS):
        self.most = most
        self._begin()

    def _begin(self) -> None:
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.known: set[str] = set()
        self.crc = np.zeros(0, np.uint32)
        self.bytes = np.zeros(0, np.int64)
        self.chars = np.zeros(0, np.int64)

    def _learn(self, words: set[str]) -> None:
        new = words - self.known
        if len(self.known) + len(new) > self.most and self.known:
            self._begin()
            new = words
        for at, word in enumerate(new, len(self.known)):
            self.automaton.add_word(f" {word} ", at)
        self.known |= new
        self.automaton.make_automaton()
        self.crc = np.append(self.crc, np.array([crc32(_bytes(w)) for w in new], np.uint32))
        self.bytes = np.append(self.bytes, np.array([len(_bytes(w)) for w in new], np.int64))
        self.chars = np.append(self.chars, np.array([len(w) for w in new], np.int64))

    def _matches(self, text: str) -> np.ndarray:
        """End and word number of every match, in order of the ends."""
        if not self.known:
            return np.zeros((0, 2), np.int64)
        found = itertools.chain.from_iterable(self.automaton.iter(text))
        return np.fromiter(found, np.int64).reshape(-1, 2)

    def scan(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """End, CRC-32 and byte length of the words of a text of words and blanks, in order.

        Matches overlap in blanks alone, so they are complete if their lengths
        add up to the text without its blanks; if not, the text's new words are
        learned and it is scanned again.
        """
        long = [(m.end(), m.group()) for m in LONG_WORD.finditer(text)]
        wanted = len(text) - text.count(" ") - sum(len(word) for _, word in long)
        found = self._matches(text)
        if self.chars[found[:, 1]].sum() != wanted:
            self._learn({w for w in text.split() if len(w) <= LONG})
            found = self._matches(text)
        ends, crc, size = found[:, 0], self.crc[found[:, 1]], self.bytes[found[:, 1]]
        if long:
            ends = np.append(ends, [end for end, _ in long])
            crc = np.append(crc, np.array([crc32(_bytes(w)) for _, w in long], np.uint32))
            size = np.append(size, [len(_bytes(w)) for _, w in long])
            order = np.argsort(ends)
            ends, crc, size = ends[order], crc[order], size[order]
        return ends, crc, size

    def payloads(self, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CRC-32 and byte length of the words of all bodies, and words per body."""
        crc, size, counts = [], [], np.zeros(len(bodies), np.int64)
        for owners, pieces in _pieces(bodies):
            text = f" {' '.join(pieces)} "
            ends, crcs, sizes = self.scan(text)
            borders = np.cumsum([len(p) + 1 for p in pieces])  # the blank behind each piece
            upto = np.searchsorted(ends, borders, side="right")
            np.add.at(counts, owners, np.diff(upto, prepend=0))
            crc.append(crcs)
            size.append(sizes)
        if not crc:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), counts
        return np.concatenate(crc), np.concatenate(size), counts


def _pieces(bodies: list[bytes], most: int = STEP_BYTES) -> Iterator[tuple[list[int], list[str]]]:
    """The bodies in lower case, only words and blanks, in lists of about ``most`` bytes.

    A body longer than that is cut at blanks; a longer single word is not.
    """
    owners, pieces, total = [], [], 0
    for owner, body in enumerate(bodies):
        plain, start = body.translate(WORD_BYTES), 0
        while start < len(plain) or not start:
            end = len(plain)
            if end - start > most:
                cut = plain.find(b" ", start + most)
                end = cut if cut >= 0 else end
            owners.append(owner)
            pieces.append(plain[start:end].decode("utf-8", "surrogateescape"))
            total += end - start
            if total >= most:
                yield owners, pieces
                owners, pieces, total = [], [], 0
            start = max(end, 1)
    if owners:
        yield owners, pieces


def marked(docs: DataFrame, key: str | None, text: str, longest: int, buckets: int) -> DataFrame:
    """``key``, ``n_words`` and ``buckets``, the bucket of every run of each text."""
    id_column = F.col(key) if key else F.lit(0).cast("long")
    rows = docs.select(id_column.alias("key"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("key", rows.schema["key"].dataType),
        T.StructField("n_words", T.LongType()),
        T.StructField("buckets", T.ArrayType(T.IntegerType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Dictionary()
        for batch in steps(batches):
            crc, size, counts = words.payloads(texts_of(batch))
            crcs, sizes = runs(crc, size, counts, longest)
            places = pa.array((crcs % np.uint32(buckets)).astype(np.int32))
            ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.ListArray.from_arrays(pa.array(ends), places)],
                names=["key", "n_words", "buckets"],
            )

    return mapped(rows, run, schema)


def _counts(marks: DataFrame) -> DataFrame:
    """Runs per bucket; as many rows as there are buckets at most."""
    return marks.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count()


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of every bucket from two :func:`marked` tables; ``buckets`` whole numbers."""
    s, t = (_counts(x).withColumnRenamed("count", n) for x, n in ((source, "s"), (target, "t")))
    both = s.join(t, "bucket", "full").na.fill(0).collect()  # at most ``buckets`` rows
    of_source, of_target = np.zeros(buckets), np.zeros(buckets)
    for row in both:
        of_source[row.bucket], of_target[row.bucket] = row.s, row.t
    ratio = (of_target + 1) * (of_source.sum() + buckets)
    ratio /= (of_source + 1) * (of_target.sum() + buckets)
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weighed(marks: DataFrame, gain: np.ndarray) -> DataFrame:
    """``key``, ``n_words``, ``n_features`` and ``weight``, the floored mean gain."""
    shared = marks.sparkSession.sparkContext.broadcast(gain)  # one number per bucket
    schema = T.StructType(
        marks.schema.fields[:2]
        + [T.StructField(n, T.LongType()) for n in ("n_features", "weight")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            ends = lists.offsets.to_numpy().astype(np.int64)
            sums = np.append(0, np.cumsum(shared.value[lists.values.to_numpy()]))
            n, total = np.diff(ends), sums[ends[1:]] - sums[ends[:-1]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(n), pa.array(total // np.maximum(n, 1))],
                names=["key", "n_words", "n_features", "weight"],
            )

    return mapped(marks, run, schema)


def gumbel(key: str, seed: int) -> Column:
    """A whole number of thousandths, Gumbel-distributed, from a hash of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """``rank`` of the drawn rows.  One exchange of short rows, no window over all of them.

    Rows are dealt into ranges of the order, written with the number of their
    range, and numbered from the count of the ranges before.
    """
    enough = F.col("n_words") >= least_words
    numbered = written(scored.withColumn("_row", F.monotonically_increasing_id()))
    order = [(~enough).asc(), F.col("score").desc(), F.col("key").asc_nulls_last(), F.col("_row").asc()]
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(
        numbered.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    )
    drawn = placed.where(enough).count() * percent // 100
    sizes = placed.groupBy("_part").count()  # a row per range: both stay small
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    ranked = placed.join(F.broadcast(offsets), "_part")
    rank = (F.col("_before") + inside).cast("long")
    ranked = ranked.withColumn("rank", rank)
    return ranked.withColumn("rank", F.when(enough & (F.col("rank") <= drawn), F.col("rank")))


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    longest: int = RUN,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: ``key``, ``n_words``, ``n_features``, ``weight``, ``score``, ``rank``.

    Features are all runs of 1 to ``longest`` words, repeats counted.  ``rank``
    counts the draw from 1: of the documents with ``least_words`` words or more,
    the ``percent`` of a hundred with the highest scores, ties to the smaller id.
    Undrawn documents have none.

    A null or empty text, or one of marks alone, has no feature and weight 0.
    Very long texts are scanned in parts.  Without target texts every bucket
    counts as empty there.  Rows of one id are ranked by themselves, one after
    the other; rows without an id hash like an empty one and come last among
    equals.  An empty table gives an empty one.  Other columns are ignored.
    """
    marks = written(marked(docs, key, text, longest, buckets))
    wanted = written(marked(target, None, target_text, longest, buckets))
    weighed = _weighed(marks, gains(marks, wanted, buckets))
    scored = weighed.withColumn("score", F.col("weight") + gumbel("key", seed))
    return _ranked(scored, percent, least_words).select(
        F.col("key").alias(key), "n_words", "n_features", "weight", "score", "rank"
    )
