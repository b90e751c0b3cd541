"""Document fingerprints from closed syncmers.

A run of 20 code points is an anchor if the smallest hash among its inner runs of
8 code points is the first or the last of them.  The choice depends on the run
alone, not on what surrounds it, so an unchanged passage has the same anchors in
every text, and there is one among any 12 runs.  Texts of every length are taken
alike: each code point ends a run, the first ones together with fixed marks before
the text, and the first run is always an anchor, so that short texts have some,
too.  A fingerprint holds all anchors with their positions; two are compared by
the anchors they share at one common shift.
"""

from __future__ import annotations

from base64 import b64decode, b64encode
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.llm.text import STEP_BYTES, mapped, steps, with_arrays, with_fields

#: Code points of an anchor and of its inner runs.
SIZE, INNER = 20, 8

#: What stands before a text: numbers that are no code points.
_BEFORE = np.arange(SIZE - 1, dtype=np.uint64) + np.uint64(0x110000)

#: Positions may differ by this much from the common shift.
SLACK = 16

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def _run_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` codes, from those of its halves."""
    if size == 1:
        return _mixed(codes * _A)
    low = size // 2
    parts = _run_hashes(codes, low)
    n = len(codes) - size + 1
    if size == 2 * low:
        return _mixed(parts[:n] * _A + parts[low : low + n])
    rest = _mixed(codes * _A)[size - 1 : size - 1 + n]
    return _mixed((parts[:n] * _A + parts[low : low + n]) * _A + rest)


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values."""
    reach, out = 1, values
    while reach < width:
        step = min(reach, width - reach)
        out = np.minimum(out[:-step], out[step:])
        reach += step
    return out


@dataclass
class Fingerprint:
    """Hashes, ascending and distinct, with the positions of the anchors in a text."""

    hashes: np.ndarray
    places: np.ndarray

    def __str__(self) -> str:
        """Base 64 of the hashes in order of their places, and of the steps between those."""
        order = np.argsort(self.places)
        steps = np.diff(self.places[order], prepend=0)
        wide = bool(len(steps)) and int(steps.max()) > 255
        body = self.hashes[order].astype("<u4").tobytes(), steps.astype("<u4" if wide else "u1").tobytes()
        return ("+" if wide else "") + ".".join(b64encode(x).decode() for x in body) if len(order) else ""


def fingerprint(text: str) -> Fingerprint:
    """Anchors of a text; an empty one has none."""
    if not text:
        return Fingerprint(np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64))
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    inner = _run_hashes(np.concatenate([_BEFORE, codes]), INNER)
    width = SIZE - INNER + 1
    least = _smallest(inner, width)
    at_edge = (inner[: len(least)] == least) | (inner[width - 1 :] == least)
    at_edge[0] = True
    places = np.flatnonzero(at_edge)
    # the anchor's own hash: its first, middle and last inner runs cover it
    mixed = _mixed(inner[places] * _A + inner[places + (width - 1)])
    mixed = _mixed(mixed * _A + inner[places + (SIZE - INNER) // 2])
    order = np.argsort(mixed, kind="stable")
    ordered = mixed[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    before = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    mixed[order] = _mixed(ordered + before.astype(np.uint64) * _B)  # repeated anchors differ
    hashes = (mixed >> np.uint64(32)).astype(np.uint32)
    order = np.argsort(hashes, kind="stable")
    order = order[np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])]
    return Fingerprint(hashes[order], places[order].astype(np.int64))


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Share of the two texts' anchors that both have at one common shift, from 0 to 1.

    That is twice the shared ones over all of either.  Equal texts give 1; two
    empty texts too; an empty and another text give 0.
    """
    if not len(a.hashes) or not len(b.hashes):
        return float(len(a.hashes) == len(b.hashes))
    shared, i, j = np.intersect1d(a.hashes, b.hashes, assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    shifts = np.sort(a.places[i] - b.places[j])
    upto = np.searchsorted(shifts, shifts + 2 * SLACK, side="right")
    agreed = int((upto - np.arange(len(shifts))).max())
    return 2 * agreed / (len(a.hashes) + len(b.hashes))


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as a string.

    See :func:`parse`.  Null counts as empty, which has the empty fingerprint.
    An input column called ``name`` is replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text):
            found = [str(fingerprint(x or "")) for x in batch.column(text).to_pylist()]
            yield with_arrays(batch, {name: pa.array(found, pa.string())})

    return mapped(docs, run, with_fields(docs.schema, [T.StructField(name, T.StringType())]))


def parse(value: str) -> Fingerprint:
    """The fingerprint a string stands for."""
    if not value:
        return fingerprint("")
    hashes, steps_ = (b64decode(x) for x in value.lstrip("+").split("."))
    kind = "<u4" if value.startswith("+") else "u1"
    places = np.cumsum(np.frombuffer(steps_, kind).astype(np.int64))
    found = np.frombuffer(hashes, "<u4").astype(np.uint32)
    order = np.argsort(found)
    return Fingerprint(found[order], places[order])


# --- each document beside the next one ---------------------------------------


#: Ranges of keys per partition; several even out how many rows a partition gets.
RANGES = 3


def key_ranges(keys: DataFrame, key: str, parts: int) -> tuple[DataFrame, dict[int, int]]:
    """``keys`` with the number of its range as ``part``, and each range's smallest key.

    Only the key column is read for it; what is fetched is as long as ``parts``.
    """
    cuts = keys.approxQuantile(key, [i / parts for i in range(1, parts)], 0.2 / parts)
    bounds = sorted(set(cuts))
    if not bounds:
        placed = keys.withColumn("part", F.lit(0))
    else:
        placed = Bucketizer(
            splits=[float("-inf"), *bounds, float("inf")],
            inputCol="_place", outputCol="_part", handleInvalid="keep",
        ).transform(keys.withColumn("_place", F.col(key).cast("double")))
        placed = placed.withColumn("part", F.col("_part").cast("int")).drop("_place", "_part")
    firsts = placed.groupBy("part").agg(F.min(key).alias("first")).collect()
    return placed, {r.part: r.first for r in firsts}


def beside_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's fingerprint beside those of its edited text and of the next document.

    The edited text is the document with its last quarter (``n_chars // 4`` code
    points) replaced by the first as many of the next document in ascending
    ``key`` (after the last: the first).  Texts are moved once, into ranges of
    keys; each range also gets the first document of the range after it, so that
    all pairs are made inside tasks.  Null texts are empty.  Null keys come first,
    in an order by hashes of their texts, so they spread over ranges like others;
    whole-number keys below -2**62 count as -2**62.  Rows of equal key are ordered
    by text and share a task; a document alone is its own next.  Returns ``key``,
    ``n_chars``, ``edited_text``, both fingerprints, ``near_edited`` and
    ``near_next``; other columns are left out.
    """
    number = F.greatest(F.col(key).cast("long"), F.lit(-(2**62)))
    unnamed = F.pmod(F.xxhash64(F.col(text)), F.lit(2**61)) - F.lit(2**62) - F.lit(2**61)
    rows = docs.select(
        F.col(key).cast("long").alias("key"),
        F.coalesce(number, unnamed).alias("place"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed, firsts = key_ranges(rows, "place", RANGES * partitions)
    order = sorted(firsts)
    # the first document of a range goes to the range before, too; the first's is the last
    before = [(firsts[p], order[i - 1]) for i, p in enumerate(order)]
    starts = F.broadcast(spark.createDataFrame(before, "first long, before int"))  # a row per range
    sent = placed.join(starts, F.col("place") == F.col("first"), "left")
    own = F.struct(F.col("part"), F.lit(False).alias("extra"))
    extra = F.struct(F.col("before").alias("part"), F.lit(True).alias("extra"))
    targets = F.when(F.col("before").isNotNull(), F.array(own, extra)).otherwise(F.array(own))
    sent = sent.select("key", "place", "text", F.explode(targets).alias("to"))
    grouped = (
        sent.select("to.part", "to.extra", "key", "place", "text")
        .repartition(partitions, "part")
        .sortWithinPartitions("part", "extra", "place", "text")
    )
    schema = (
        "key long, n_chars long, edited_text string, fingerprint string,"
        " edited_fingerprint string, near_edited double, near_next double"
    )
    return mapped(grouped, _pairs, schema).withColumnRenamed("key", key)


@dataclass
class _Row:
    key: int | None
    text: str
    print_: Fingerprint


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a part in order, each with the one after it; extra rows only come second."""
    out: list[tuple] = []
    part, held, first, closed, size = None, None, None, False, 0
    for batch in steps(batches):
        columns = [batch.column(c).to_pylist() for c in ("part", "extra", "key", "text")]
        for to, extra, key, text in zip(*columns):
            if to != part:
                if held is not None and not closed:
                    out.append(_pair(held, first))
                part, held, first, closed = to, None, None, False
            if closed:
                continue
            row = _Row(key, text, fingerprint(text))
            if held is not None:
                out.append(_pair(held, row))
                size += len(held.text)
                if size >= STEP_BYTES:
                    yield _batch(out)
                    out, size = [], 0
            if extra:
                closed = True
            held = row
            first = first or row
    if held is not None and not closed:
        out.append(_pair(held, first))
    yield _batch(out)


def _pair(row: _Row, after: _Row) -> tuple:
    moved = len(row.text) // 4
    edited = row.text[: len(row.text) - moved] + after.text[:moved]
    other = fingerprint(edited)
    return (
        row.key,
        len(row.text),
        edited,
        str(row.print_),
        str(other),
        likeness(row.print_, other),
        likeness(row.print_, after.print_),
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
    names = ["key", "n_chars", "edited_text", "fingerprint", "edited_fingerprint"]
    names += ["near_edited", "near_next"]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=names)
