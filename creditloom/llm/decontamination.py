"""Benchmark decontamination by Wu-Manber search over words.

Every run of 13 words of a benchmark text is a pattern (a shorter text is one
pattern).  Patterns of one length share a table that maps each block of two
words to the distance a reader may jump ahead, so most of a document is never
looked at: a block that occurs in no pattern skips twelve words.  Where the
distance is zero, the patterns ending in that block are chosen by their first
block and compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.llm.text import mapped, steps, texts_of, with_arrays, with_fields, words_of
from creditloom.session import scratch_dir

WINDOW = 13
BLOCK = 2

#: Most bytes of benchmark text whose tables are broadcast at once.  A larger
#: benchmark is searched in several passes, each with a part of its items.
BROADCAST_BYTES = 8 << 20

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_starts", T.ArrayType(T.IntegerType())),
    T.StructField("hit_lengths", T.ArrayType(T.IntegerType())),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
]


def windows_of(words: list[bytes], size: int = WINDOW) -> Iterator[tuple[bytes, ...]]:
    """All runs of ``size`` words; all words as one run if there are fewer."""
    if words:
        for i in range(max(1, len(words) - size + 1)):
            yield tuple(words[i : i + size])


class Patterns:
    """Shift table and suffix buckets of patterns of one length."""

    def __init__(self, patterns: Iterable[tuple[bytes, ...]], length: int):
        self.length, self.block = length, min(BLOCK, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict] = {}
        for pattern in patterns:
            for end in range(self.block, length + 1):
                block = pattern[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.far), length - end)
            chosen = self.buckets.setdefault(pattern[-self.block :], {})
            chosen.setdefault(pattern[: self.block], set()).add(pattern)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """Start and pattern of every occurrence."""
        length, block, far, shift = self.length, self.block, self.far, self.shift
        end, last = length, len(words)
        while end <= last:
            suffix = tuple(words[end - block : end])
            jump = shift.get(suffix, far)
            if jump:
                end += jump
                continue
            start = end - length
            tested = self.buckets[suffix].get(tuple(words[start : start + block]))
            if tested and (run := tuple(words[start:end])) in tested:
                yield start, run
            end += 1


class Searcher:
    """All patterns of a set of benchmark items, by length."""

    def __init__(self, items: Iterable[tuple[str, bytes]], size: int = WINDOW):
        self.owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            for window in windows_of(words_of(text), size):
                self.owners.setdefault(window, set()).add(item)
        lengths = sorted({len(w) for w in self.owners})
        self.tables = [Patterns((w for w in self.owners if len(w) == n), n) for n in lengths]

    def search(self, words: list[bytes]) -> tuple[list[int], list[int], set[str]]:
        """Starts and lengths of the occurrences, and the items they belong to."""
        starts, lengths, items = [], [], set()
        for patterns in self.tables:
            for start, run in patterns.find(words):
                starts.append(start)
                lengths.append(len(run))
                items |= self.owners[run]
        return starts, lengths, items


def _item_parts(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str, bytes]]]:
    """The items in parts of about BROADCAST_BYTES each."""
    rows = items.select(
        F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")
    ).where("item is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // BROADCAST_BYTES))
    for part in range(parts):
        mine = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        yield [(r.item, r.text.encode()) for r in mine.collect()]  # bounded by the part's size


def find_benchmark(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """``docs`` with ``n_words``, the hit runs of words and the items they come from.

    ``hit_starts`` and ``hit_lengths`` are word positions, in order of length
    and start; runs may overlap.  ``hit_items`` are the item ids as sorted
    text.  A null or empty text has no words and no hits; items without id or
    text are ignored; equal items share their occurrences.  Input columns with
    the names of the new ones are replaced.
    """
    spark = docs.sparkSession
    schema = with_fields(docs.schema, FIELDS)
    out = docs
    for part, pairs in enumerate(_item_parts(items, item_id, item_text)):
        shared = spark.sparkContext.broadcast(pairs)  # at most BROADCAST_BYTES of text
        if part:
            path = scratch_dir(spark)
            out.write.parquet(path)
            out = spark.read.parquet(path)
        out = mapped(out, _search_batches(shared, text, window, part > 0), schema)
    return out


def _search_batches(shared, text: str, window: int, more: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(shared.value, window)
        for batch in steps(batches, text):
            counts, starts, lengths, items = [], [], [], []
            for body in texts_of(batch, text):
                words = words_of(body)
                s, n, i = searcher.search(words)
                counts.append(len(words))
                starts.append(s)
                lengths.append(n)
                items.append(sorted(i))
            if more:  # hits of the parts before
                before = [batch.column(f.name).to_pylist() for f in FIELDS[1:]]
                starts = [a + b for a, b in zip(before[0], starts)]
                lengths = [a + b for a, b in zip(before[1], lengths)]
                items = [sorted({*a, *b}) for a, b in zip(before[2], items)]
            yield with_arrays(
                batch,
                {
                    "n_words": pa.array(counts, pa.int64()),
                    "hit_starts": pa.array(starts, pa.list_(pa.int32())),
                    "hit_lengths": pa.array(lengths, pa.list_(pa.int32())),
                    "hit_items": pa.array(items, pa.list_(pa.string())),
                },
            )

    return run


def n_hit() -> F.Column:
    """Words inside any hit run: the runs in order of start, each counted from where the last ended."""
    runs = F.array_sort(F.arrays_zip("hit_starts", "hit_lengths"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def step(acc, run):
        end = run["hit_starts"] + run["hit_lengths"]
        fresh = end - F.greatest(run["hit_starts"], acc["end"])
        return F.struct(
            (acc["n"] + F.greatest(fresh, F.lit(0))).alias("n"),
            F.greatest(end, acc["end"]).alias("end"),
        )

    return F.aggregate(runs, none, step, lambda acc: acc["n"])


def judged(docs: DataFrame, items: DataFrame, share: int = 20, **names) -> DataFrame:
    """:func:`find_benchmark` with ``n_hit`` and ``contaminated``.

    A document is contaminated if at least one word in ``share`` is hit; a text
    without words never is.
    """
    found = find_benchmark(docs, items, **names).withColumn("n_hit", n_hit())
    rule = (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
    return found.withColumn("contaminated", rule)
