"""Groups of nearly parallel vectors by an inverted multi-index.

Each half of the (normed) vectors has a codebook of its own; a vector lives in
the cell of the product grid that its halves' nearest codewords name.  A vector
looks for partners in the cells around it, nearest first: two sequences of
codewords, ordered by how far each half would have to move to get into their
region, are traversed together until the target recall is reached.  What shares
a cell is verified with the vectors themselves.

How far a half must move into the region of a codeword is bounded below by its
distance to the planes between that codeword and the others.  Two vectors at the
threshold are ``sqrt(2 - 2 threshold)`` apart.  With recall 1 every cell that this
distance can reach is visited, so no pair is lost.  Below 1, the difference of
two vectors is taken to point anywhere with equal chance: the part of it that
lies in the two directions which lead into a cell is then rarely long, and cells
that would need a longer one are not visited.

Equal vectors are merged first.  Large cells are cut into blocks, two of which
meet in a task; tasks return sums and spanning links instead of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.llm.quantisation import finite
from creditloom.llm.tables import components, written
from creditloom.llm.text import mapped
from creditloom.operators.lookup import lookup_join

THRESHOLD, RECALL = 0.98, 0.999

#: Distinct vectors the codebooks are fitted on at most, and rounds of the fit.
FIT_ROWS, FIT_ROUNDS = 16_384, 8

#: Distinct vectors per cell that the number of codewords aims at, and its bounds.
CELL_ROWS, CODEWORDS = 512, (2, 256)

#: Most components of all vectors in a block of a cell, and most rows of a block.
BLOCK_NUMBERS, BLOCK_ROWS = 1 << 21, 4096

#: Rows of a strip of cosines.
STRIP = 512


def reach(threshold: float, recall: float, size: int) -> float:
    """Squared distance that a pair at the threshold covers in two fixed directions.

    Of a random direction in ``size`` dimensions the share ``s`` of the squared
    length that lies in a plane is exceeded with probability (1 - s)^((size - 2) / 2).
    """
    apart = 2 - 2 * threshold
    if recall >= 1 or size <= 2:
        return apart + 1e-9
    return apart * (1 - (1 - recall) ** (2 / (size - 2))) + 1e-9


def lengths(lists: pa.ListArray) -> np.ndarray:
    starts = lists.offsets.to_numpy().astype(np.int64)
    return starts[1:] - starts[:-1]


def vectors_of(lists: pa.ListArray) -> np.ndarray:
    """Vectors of one length as doubles, each divided by a power of two near its largest component."""
    starts = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    rows = values[starts[0] : starts[-1]].reshape(len(lists), -1) + 0.0
    largest = np.abs(rows).max(1, initial=0)
    return rows / np.exp2(np.floor(np.log2(np.where(largest > 0, largest, 1))))[:, None]


class Grid:
    """Codewords of both halves and the bounds that order the cells around a vector."""

    def __init__(self, sample: np.ndarray, words: int, seed: int = 13):
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.size = unit.shape[1]
        self.cut = (self.size + 1) // 2
        draw = np.random.default_rng(seed)
        self.halves = [
            _centres(half, words, draw) for half in (unit[:, : self.cut], unit[:, self.cut :])
        ]

    def fitted(self, vectors: np.ndarray) -> np.ndarray:
        """Unit vectors cut or filled with zeros to the grid's length, which lengthens no distance."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        out = np.zeros((len(unit), self.size))
        width = min(self.size, unit.shape[1])
        out[:, :width] = unit[:, :width]
        return out

    def places(self, vectors: np.ndarray, limit: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """Home cell of every vector and the cells it visits, nearest first, home left out."""
        unit = self.fitted(vectors)
        home, bounds = [], []
        for centres, half in zip(self.halves, (unit[:, : self.cut], unit[:, self.cut :])):
            far = (half**2).sum(1)[:, None] - 2 * half @ centres.T + (centres**2).sum(1)
            mine = far.argmin(1)
            home.append(mine)
            bounds.append(_moves(far, centres) ** 2)
        words = len(self.halves[1])
        cells = home[0] * words + home[1]
        return cells, [_traversal(a, b, limit, words, cell) for a, b, cell in zip(*bounds, cells)]


def _centres(half: np.ndarray, words: int, draw: np.random.Generator) -> np.ndarray:
    """Codewords by Lloyd's rounds from distinct rows of a bounded sample."""
    distinct = np.unique(half, axis=0)
    centres = distinct[draw.permutation(len(distinct))[:words]]
    for _ in range(FIT_ROUNDS):
        far = (centres**2).sum(1) - 2 * half @ centres.T
        mine = far.argmin(1)
        count = np.bincount(mine, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, mine, half)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def _moves(far: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """How far each row must move at least until each centre is its nearest one.

    The largest distance to a plane half way between that centre and another one.
    """
    out = np.zeros_like(far)
    for i in range(len(centres)):
        between = np.sqrt(((centres - centres[i]) ** 2).sum(1))
        between[i] = np.inf
        out[:, i] = ((far[:, i, None] - far) / (2 * between)).max(1)
    return np.maximum(out, 0)


def _traversal(a: np.ndarray, b: np.ndarray, limit: float, words: int, home: int) -> np.ndarray:
    """Cells in order of the sum of both halves' bounds, as far as ``limit``, without ``home``."""
    left, right = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    left, right = left[a[left] <= limit], right[b[right] <= limit]
    sums = a[left][:, None] + b[right][None, :]
    i, j = np.nonzero(sums <= limit)
    order = np.argsort(sums[i, j], kind="stable")
    cells = left[i[order]] * words + right[j[order]]
    return cells[cells != home]


def _marked(docs: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``id``, ``label``, ``vector`` and ``same``, a digest that equal vectors of a label share.

    ``same`` is null for rows that link with nothing.
    """
    usable = F.col(label).isNotNull() & finite(vector)
    usable &= F.exists(F.coalesce(vector, F.array()), lambda x: x != 0)
    rows = docs.select(
        F.col(key).alias("id"),
        F.col(label).alias("label"),
        F.when(usable, F.col(vector)).alias("vector"),
    )
    schema = T.StructType([*rows.schema.fields, T.StructField("same", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            starts = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0
            valid = lists.is_valid().to_numpy(zero_copy_only=False)
            same = [
                blake2b(values[i:j].tobytes(), digest_size=16).digest() if v else None
                for i, j, v in zip(starts, starts[1:], valid)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(same, pa.binary())], names=schema.names
            )

    return mapped(rows, run, schema)


def _grid(marks: DataFrame, count: int) -> Grid:
    """Codebooks from at most FIT_ROWS vectors drawn by their digests, of the commonest length."""
    rows = marks.where("same is not null")
    wanted = max(1, int(0.9 * FIT_ROWS / count * 1_000_000))
    drawn = F.pmod(F.xxhash64("same", "label"), F.lit(1_000_000)) < wanted
    sample = rows.where(drawn).select("same", "vector").dropDuplicates(["same"])
    found = [r.vector for r in sample.orderBy("same").limit(FIT_ROWS).collect()]
    if not found:  # few distinct vectors, none of them drawn
        found = [r.vector for r in rows.select("vector").limit(1).collect()]
    sizes = [len(v) for v in found]
    size = max(set(sizes), key=lambda n: (sizes.count(n), n))
    least, most = CODEWORDS
    words = min(most, max(least, int(np.ceil(np.sqrt(count / CELL_ROWS)))))
    picked = pa.array([v for v in found if len(v) == size], pa.list_(pa.float64()))
    return Grid(vectors_of(picked), words)


def _placed(nodes: DataFrame, grid: Grid, threshold: float, recall: float) -> DataFrame:
    """Nodes with ``size`` (components), ``home`` and ``visits``, the cells of higher number.

    Of two vectors in different cells, the one in the lower cell visits the other.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(grid)  # at most 2 x 256 codewords
    schema = T.StructType([
        *nodes.schema.fields,
        T.StructField("size", T.LongType()),
        T.StructField("home", T.LongType()),
        T.StructField("visits", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            sizes = lengths(column)
            home = np.zeros(batch.num_rows, np.int64)
            visits: list[np.ndarray] = [np.zeros(0, np.int64)] * batch.num_rows
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                limit = reach(threshold, recall, int(size))
                cells, found = shared.value.places(vectors_of(column.take(pa.array(at))), limit)
                home[at] = cells
                for row, cell, more in zip(at, cells, found):
                    visits[row] = more[more > cell]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sizes), pa.array(home), pa.array(visits, pa.list_(pa.int64()))],
                names=schema.names,
            )

    return mapped(nodes, run, schema)


CELL = ["label", "size", "cell"]


def _meetings(placed: DataFrame) -> DataFrame:
    """Every node once for each pair of blocks it takes part in: ``cell``, ``i``, ``j``, ``block``.

    The residents of a cell are dealt into blocks 0, 1, ...; its visitors into
    blocks -1, -2, ...  All pairs of resident blocks meet, and all residents'
    blocks meet all visitors'.  A cell without residents has no meeting.
    """
    own = ["node", "copies", "vector", "label", "size"]
    homes = placed.select(*own, F.col("home").alias("cell"), F.lit(True).alias("lives"))
    guests = placed.select(*own, F.explode("visits").alias("cell"), F.lit(False).alias("lives"))
    stays = homes.union(guests)
    rows = F.least(F.lit(BLOCK_ROWS), F.greatest(F.lit(1), F.lit(BLOCK_NUMBERS) / F.greatest("size", F.lit(1))))
    counts = written(
        stays.groupBy(*CELL)
        .agg(F.count_if("lives").alias("residents"), F.count_if(~F.col("lives")).alias("visitors"))
        .where("residents > 0 and residents + visitors > 1")
        .withColumn("blocks", F.ceil(F.col("residents") / rows).cast("int"))
        .withColumn("guest_blocks", F.ceil(F.col("visitors") / rows).cast("int"))
        .drop("residents", "visitors")
    )
    known = lookup_join(stays, counts, CELL).where("blocks is not null")
    number = F.xxhash64("node")
    block = F.when(F.col("lives"), F.pmod(number, F.col("blocks").cast("long"))).otherwise(
        -1 - F.pmod(number, F.greatest("guest_blocks", F.lit(1)).cast("long"))
    )
    known = known.withColumn("block", block.cast("int"))
    # a resident meets every block of the cell, a visitor the residents' blocks
    first = F.when(F.col("lives"), -F.col("guest_blocks")).otherwise(F.lit(0))
    other = known.withColumn("other", F.explode(F.sequence(first, F.col("blocks") - 1)))
    i, j = F.greatest("block", "other").alias("i"), F.least("block", "other").alias("j")
    return other.select("node", "copies", "vector", *CELL, "block", i, j)


def _alike(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosine of each row of ``x`` and each of ``y`` reaches the threshold."""
    norm = np.sqrt((y * y).sum(1))
    out = np.empty((len(x), len(y)), bool)
    for at in range(0, len(x), STRIP):
        strip = x[at : at + STRIP]
        cosine = (strip @ y.T) / (np.sqrt((strip * strip).sum(1))[:, None] * norm)
        out[at : at + STRIP] = cosine >= threshold
    return out


def _spanning(alike: np.ndarray) -> np.ndarray:
    """A number per row and column (in this order) that those connected by ``alike`` share.

    Breadth first, so every row and column of the matrix is read once.  Rows and
    columns without a link get -1.
    """
    n, m = alike.shape
    root = np.full(n + m, -1)
    for start in np.flatnonzero(alike.any(1)):
        if root[start] >= 0:
            continue
        root[start], rows = start, np.array([start])
        while len(rows):
            columns = np.flatnonzero(alike[rows].any(0) & (root[n:] < 0))
            root[n + columns] = start
            rows = np.flatnonzero(alike[:, columns].any(1) & (root[:n] < 0)) if len(columns) else columns
            root[rows] = start
    return root


def _links(meetings: DataFrame, threshold: float) -> DataFrame:
    """``node``, ``links`` and ``other``: links summed per node and meeting, and a node it is connected with.

    A node may have several rows.
    """
    parts = int(meetings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a fixed number of parts: adaptive execution would merge meetings by their few bytes
    rows = meetings.repartition(parts, *CELL, "i", "j")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node = group["node"].to_numpy()
        copies = group["copies"].to_numpy()
        block = group["block"].to_numpy()
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        x = vectors_of(group["vector"].combine_chunks())
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        alike = _alike(x[left], x[right], threshold)
        root = _spanning(alike)  # in a block with itself, each row is also its own column
        if i == j:
            np.fill_diagonal(alike, False)
            names, links = node[left], alike @ copies[right]
        else:
            names = np.concatenate([node[left], node[right]])
            links = np.concatenate([alike @ copies[right], copies[left] @ alike])
        some = np.flatnonzero(links > 0)
        other = node[left][root[some]]
        return pa.table({"node": names[some], "links": links[some], "other": other})

    return rows.groupBy(*CELL, "i", "j").applyInArrow(run, "node long, links long, other long")


def near_duplicates(
    docs: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """One row per vector: ``key``, ``n_links``, ``component_id`` and ``kept``.

    Two vectors of one label (not null) link if their cosine in double precision
    is ``threshold`` or more.  ``n_links`` counts the other vectors linked
    directly, ``component_id`` is the smallest id reachable by links, and
    ``kept`` says whether that is the vector's own id.  No link is wrong; of
    those there are, a share of ``recall`` is found (all of them with 1).

    Vectors that are null, zero, empty or hold null or non-finite components
    link with nothing, nor do vectors of different lengths.  Rows of one id are
    different vectors.  A row without an id counts as a partner, but its id is
    not the smallest of a group unless all are null; ``kept`` is true for it
    only then.  Very long vectors meet in smaller blocks.  An empty table gives
    an empty one.  Other columns are ignored.
    """
    marks = written(_marked(docs, key, vector, label))
    usable = marks.where("same is not null")
    count = usable.count()
    if not count:
        return _idle(marks).withColumnRenamed("id", key)
    nodes = usable.groupBy("label", "same").agg(
        F.min("id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector")
    )
    nodes = nodes.withColumn("node", F.monotonically_increasing_id())
    placed = written(_placed(nodes, _grid(marks, count), threshold, recall))
    found = written(_links(_meetings(placed), threshold))
    edges = found.select(F.col("node").alias("a"), F.col("other").alias("b")).where("a <> b")
    roots = components(edges).select("node", "root")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    facts = placed.select("label", "same", "node", "least", "copies")
    facts = facts.join(links, "node", "left").join(roots, "node", "left")
    facts = written(facts.where("copies > 1 or links is not null"))
    group = facts.select(F.coalesce("root", "node").alias("root"), "least")
    group = group.groupBy("root").agg(F.min("least").alias("component"))
    facts = facts.withColumn("root", F.coalesce("root", "node")).join(group, "root").select(
        "label",
        "same",
        "component",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
    )
    linked = lookup_join(usable.select("id", "label", "same"), written(facts), ["label", "same"])
    linked = linked.select(
        "id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    linked = linked.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    return linked.union(_idle(marks.where("same is null"))).withColumnRenamed("id", key)


def _idle(rows: DataFrame) -> DataFrame:
    return rows.select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")
    )
