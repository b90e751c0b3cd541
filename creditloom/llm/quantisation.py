"""Product codes of vectors: each part of a vector becomes the number of its nearest entry.

The entries of a part are kept in a geometric near-neighbour access tree: some
entries are split points, every other entry goes to the child of its nearest
split point, and for each split point and child the smallest and the largest
distance between them is stored.  A query that measures its distance to a split
point can rule out every child whose range lies further away than the best entry
so far.  Distances are squared whole numbers; the triangle inequality needs
roots, so a child is ruled out only if it is further by more than rounding can
explain, and what remains is compared in whole numbers, ties to the lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.llm.tables import written
from creditloom.llm.text import mapped
from creditloom.operators.lookup import lookup_join

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256

#: Whole-number components are limited to this size, so that squared distances of
#: vectors with up to 8,192 components stay below 2**63.
LARGEST = 1 << 24

#: Split points of a tree node.
DEGREE = 8

#: Relative room for the rounding of three roots and their sums.
ROOM = 1e-14


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all rows of ``y``, whole numbers."""
    out = np.zeros((len(x), len(y)), np.int64)
    for at in range(x.shape[1]):
        step = x[:, at, None] - y[None, :, at]
        out += step * step
    return out


@dataclass
class Node:
    """Split points (numbers of entries), ranges of squared distances, children."""

    splits: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    children: list[Node | None] = field(default_factory=list)


def tree(entries: np.ndarray, members: np.ndarray | None = None, degree: int = DEGREE) -> Node:
    """The access tree over the rows of ``entries`` that ``members`` names."""
    members = np.arange(len(entries)) if members is None else members
    if len(members) <= degree:
        return Node(members)
    apart = distances(entries[members], entries[members])
    chosen, nearest = [0], apart[0].copy()
    while len(chosen) < degree:  # the entry furthest from all split points so far
        nearest[chosen] = -1
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, apart[chosen[-1]])
    home = apart[:, chosen].argmin(1)
    home[chosen] = -1
    low, high = np.zeros((2, degree, degree), np.int64)
    children = []
    for j in range(degree):
        at = np.flatnonzero(home == j)
        children.append(tree(entries, members[at], degree) if len(at) else None)
        if len(at):
            between = apart[np.ix_(chosen, at)]
            low[:, j], high[:, j] = between.min(1), between.max(1)
    return Node(members[chosen], low, high, children)


class Search:
    """Nearest entries of many queries at once; ``tested`` counts measured distances."""

    def __init__(self, entries: np.ndarray, degree: int = DEGREE):
        self.entries, self.root, self.tested = entries, tree(entries, degree=degree), 0

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry (ties: the lower one) and its squared distance."""
        self.best = np.full(len(queries), np.iinfo(np.int64).max)
        self.number = np.full(len(queries), len(self.entries))
        self._visit(self.root, queries, np.arange(len(queries)))
        return self.number, self.best

    def _visit(self, node: Node, queries: np.ndarray, at: np.ndarray) -> None:
        if not len(at):
            return
        far = distances(queries[at], self.entries[node.splits])
        self.tested += far.size
        least = far.min(1)
        number = np.where(far == least[:, None], node.splits, len(self.entries)).min(1)
        old, best = self.number[at], self.best[at]
        better = (least < best) | ((least == best) & (number < old))
        self.best[at] = np.where(better, least, best)
        self.number[at] = np.where(better, number, old)
        if not node.children:
            return
        home, roots = far.argmin(1), np.sqrt(far)
        for first in (True, False):  # the child of the nearest split point bounds the others
            for j, child in enumerate(node.children):
                if child is None:
                    continue
                mine = (home == j) if first else (home != j) & ~self._ruled_out(node, j, roots, at)
                self._visit(child, queries, at[mine])

    def _ruled_out(self, node: Node, j: int, roots: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Queries from which every entry of child ``j`` is strictly further than the best one."""
        low, high = np.sqrt(node.low[:, j]), np.sqrt(node.high[:, j])
        bound = np.sqrt(self.best[at])[:, None]
        room = ROOM * (roots + high + bound)
        return ((np.maximum(low - roots, roots - high) - bound) > room).any(1)


def whole(lists: pa.ListArray, width: int, parts: int) -> np.ndarray:
    """The vectors of a list column as whole numbers: rows x parts x width, zeros behind the end."""
    starts = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    n = starts[1:] - starts[:-1]
    numbers = np.floor(SCALE * np.clip(values, -LARGEST / SCALE, LARGEST / SCALE)).astype(np.int64)
    out = np.zeros((len(n), parts * width), np.int64)
    if len(n) and n[0] and (n == n[0]).all():
        out[:, : n[0]] = numbers[starts[0] : starts[-1]].reshape(len(n), -1)
    return out.reshape(len(n), parts, width)


def finite(vector: str) -> Column:
    """Whether a vector and all of its components are there and finite."""
    inside = F.forall(
        vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))
    )
    return F.coalesce(inside, F.lit(False))


def _searches(books: np.ndarray) -> list[Search]:
    return [Search(book) for book in books]


def _sums(rows: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and component sums per part position and entry.

    Tasks add up their own parts and return one row per number of the
    codebooks, whose size is fixed, so the shuffle and the result are small.
    """
    parts, entries, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)  # parts x entries x width numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = _searches(shared.value)
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            vectors = whole(batch.column("vector"), width, parts)
            for part, search in enumerate(searches):
                number, _ = search.nearest(vectors[:, part])
                np.add.at(total[part, :, :width], number, vectors[:, part])
                total[part, :, width] += np.bincount(number, minlength=entries)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells), pa.array(total.ravel()[cells])], names=["cell", "total"]
        )

    found = mapped(rows.select("vector"), run, "cell long, total long")
    total = np.zeros(parts * entries * (width + 1), np.int64)
    for row in found.groupBy("cell").agg(F.sum("total").alias("total")).collect():
        total[row.cell] = row.total
    total = total.reshape(parts, entries, width + 1)
    return total[:, :, width], total[:, :, :width]


def fit(
    rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> np.ndarray | None:
    """Codebooks, parts x entries x width, from all rows (``id``, ``vector``); None without rows.

    They start as the parts of the vectors with the smallest ids.  Each round
    assigns every part and replaces an entry by the floored mean of its parts;
    unused entries stay.
    """
    seeds = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    if not seeds:
        return None
    width = max(1, -(-len(seeds[0].vector) // parts))
    lists = pa.array([r.vector for r in seeds], pa.list_(pa.float64()))
    books = whole(lists, width, parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        count, total = _sums(rows, books)
        used = count > 0
        books[used] = total[used] // count[used][:, None]
    return books


def _coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``rows`` with ``code`` and ``error`` in place of the vector."""
    parts, _, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)  # parts x entries x width numbers
    kept = [f for f in rows.schema.fields if f.name != "vector"]
    schema = T.StructType(
        [*kept, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = _searches(shared.value)
        for batch in batches:
            vectors = whole(batch.column("vector"), width, parts)
            codes = np.zeros((len(vectors), parts), np.uint8)
            error = np.zeros(len(vectors), np.int64)
            for part, search in enumerate(searches):
                number, far = search.nearest(vectors[:, part])
                codes[:, part] = number
                error += far
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(f.name) for f in kept),
                    pa.array([row.tobytes().hex() for row in codes], pa.string()),
                    pa.array(error),
                ],
                names=schema.names,
            )

    return mapped(rows, run, schema)


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The vector a code stands for, in whole numbers."""
    return np.concatenate([books[part, entry] for part, entry in enumerate(bytes.fromhex(code))])


def compress(
    docs: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray | None]:
    """Codes of all vectors, and the codebooks (None if no vector is kept).

    One row per kept vector: ``key``, ``code`` (two hex digits per part),
    ``error`` (squared distances summed over the parts), ``label_error`` (errors
    summed over equal labels, nulls together) and ``codebooks_sha256``.

    Vectors that are null or hold null or non-finite components are left out, and
    so are those of another length than the vector with the smallest id, which
    cannot be compared.  A length that is no multiple of ``parts`` is filled up
    with zeros.  Components beyond ``LARGEST / SCALE`` count as that.  Equal rows
    are coded alike, each by itself; rows without an id come last where the
    entries are begun.  An empty table gives an empty one.  Other columns are
    ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits per part: 1 to 256 entries")
    rows = docs.select(
        F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector")
    ).where(finite("vector"))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(1).collect()
    if first:
        rows = rows.where(F.size("vector") == len(first[0].vector))
    books = fit(rows, parts, entries, rounds)
    digest = ""
    if books is None:
        coded = rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        digest = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
        coded = _coded(rows, books)
    coded = written(coded)
    # null labels are one group: their sum is a constant, the others are looked up
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    totals = written(totals)
    unlabelled = totals.where("label is null").first()
    named = lookup_join(
        coded.where("label is not null"), totals.where("label is not null"), ["label"]
    )
    rest = coded.where("label is null").withColumn(
        "label_error", F.lit(unlabelled.label_error if unlabelled else None).cast("long")
    )
    found = named.unionByName(rest).withColumn("codebooks_sha256", F.lit(digest))
    return found.select(
        F.col("id").alias(key), "code", "error", "label_error", "codebooks_sha256"
    ), books
