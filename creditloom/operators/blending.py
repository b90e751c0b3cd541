"""Weighted blends of several models' scores and the search for the weights."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain
from operator import add, sub

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.operators.metrics import NEGATIVES, POSITIVES, auc_of_counts, rated
from creditloom.operators.ordered import MOST_PARTS
from creditloom.session import materialised
from creditloom.sources.schemas import LABEL

#: Score levels of the first bounding pass of the search, and of later ones at most.
FIRST_LEVELS, MOST_LEVELS = 1024, 1 << 18
#: Counts that a task keeps per class in later passes (16 MB).
CELLS = 1 << 21
#: Scores of all combinations that a task of the exact ranking merges.
TASK_SCORES = 2_000_000
#: Bounding passes at most, and open combinations that are ranked without a further one.
PASSES, FEW_OPEN = 4, 4


def steps(start: float, stop: float, step: float) -> list[float]:
    """Evenly spaced values below ``stop``, each ``start + i * step``."""
    return [start + i * step for i in range(max(0, math.ceil((stop - start) / step)))]


def weight_grid(
    lows: list[float], high: float, step: float, floor: float = 0.0
) -> list[tuple[float, ...]]:
    """Weights that sum to one: all but the last on a grid from their lower bound.

    Together they stay below ``high``; what is left is the last weight, which is
    at least ``floor``.
    """
    out: list[tuple[float, ...]] = [()]
    for low in lows:
        out = [w + (x,) for w in out for x in steps(low, reduce(sub, w, high), step)]
    whole = [(*w, reduce(sub, w, 1.0)) for w in out]
    return [w for w in whole if w[-1] >= floor]


def weights_2() -> list[tuple[float, ...]]:
    return weight_grid([0.3], 0.71, 0.01)


def weights_3(step: float = 0.02) -> list[tuple[float, ...]]:
    return weight_grid([0.2, 0.1], 0.71, step, 0.05)


def weights_4(step: float = 0.04) -> list[tuple[float, ...]]:
    return weight_grid([0.1, 0.05, 0.05], 0.61, step, 0.05)


def blended(scores: list[str], weights: list[Column] | tuple[float, ...]) -> Column:
    """Weighted sum of score columns."""
    terms = (
        (w if isinstance(w, Column) else F.lit(w)) * F.col(s)
        for s, w in zip(scores, weights, strict=True)
    )
    return reduce(lambda a, b: a + b, terms)


def blend_scores(tables: list[DataFrame], weights: tuple[float, ...], key: str, score: str) -> DataFrame:
    """Blend separate score tables, matched by key; a key without one of the scores is an error."""
    named = [t.select(key, F.col(score).alias(f"_s{i}")) for i, t in enumerate(tables)]
    wide = reduce(lambda a, b: a.join(b, key, "full"), named)
    names = [f"_s{i}" for i in range(len(tables))]
    whole = reduce(lambda a, b: a & b, (F.col(n).isNotNull() for n in names))
    lost = F.raise_error(F.concat(F.lit("a model has no score for "), F.col(key).cast("string")))
    return wide.select(key, F.when(whole, blended(names, weights)).otherwise(lost).alias(score))


Grid = list[tuple[float, ...]]


#: One combination's number, its blended scores of some rows, and which of them are positive.
Blends = Iterator[tuple[int, np.ndarray, np.ndarray]]


def _in_tasks(
    df: DataFrame, scores: list[str], grid: Grid, label: str, schema: str,
    gather: Callable[[Iterator[Blends]], Iterator[dict[str, np.ndarray]]],
) -> DataFrame:
    """What ``gather`` makes of a task's rows, whose batches it gets under every combination.

    Rows are blended one combination after the other: none is repeated in a table.
    """
    ready = rated(df, *scores).select(
        (F.col(label) == 1).alias("_y"), *(F.col(s).cast("double") for s in scores)
    ).where("_y is not null")

    def blends(batch: pa.RecordBatch) -> Blends:
        positive = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
        values = [batch.column(i + 1).to_numpy() for i in range(len(scores))]
        for position, weights in enumerate(grid):
            # from the left, as a sum of columns adds up
            yield position, reduce(add, (w * v for w, v in zip(weights, values))), positive

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gather(blends(batch) for batch in batches):
            yield pa.RecordBatch.from_pydict(part)

    return ready.mapInArrow(run, schema)


def grid_auc(df: DataFrame, scores: list[str], grid: Grid, label: str = LABEL) -> DataFrame:
    """Exact AUC of every weight combination: ``position`` in the grid, ``auc``.

    Tasks merge the equal scores of a batch before anything is shuffled; equal scores
    meet in as many tasks as the counted rows and combinations need.  Merging before
    the shuffle too would have one task keep the scores of all its rows.
    """
    parts = min(MOST_PARTS, -(-df.count() * len(grid) // TASK_SCORES))
    if parts > 1:  # few columns: what is moved is small beside the scores
        df = df.select(label, *scores).repartition(parts)

    def gather(batches: Iterator[Blends]) -> Iterator[dict[str, np.ndarray]]:
        for position, blend, positive in chain.from_iterable(batches):
            value, at = np.unique(blend, return_inverse=True)
            yield {
                "position": np.full(len(value), position, np.int32),
                "_score": value,
                POSITIVES: np.bincount(at[positive], minlength=len(value)),
                NEGATIVES: np.bincount(at[~positive], minlength=len(value)),
            }

    schema = f"position int, _score double, {POSITIVES} long, {NEGATIVES} long"
    cells = _in_tasks(df, scores, grid, label, schema, gather)
    if parts > 1:
        cells = cells.repartition(parts, "position", "_score")
    counts = cells.groupBy("position", "_score").agg(
        F.sum(POSITIVES).alias(POSITIVES), F.sum(NEGATIVES).alias(NEGATIVES)
    )
    return auc_of_counts(counts, "_score", ["position"])


def best_blend(df: DataFrame, scores: list[str], grid: Grid, label: str = LABEL) -> DataFrame:
    """The weights with the highest AUC, the first in the grid on a tie.

    Passes over the rows count the classes per level of the blended score, in
    arrays inside the tasks.  Only pairs within one level are left open, which
    bounds each combination's AUC from both sides; combinations whose upper bound
    stays below the best lower bound drop out.  The first pass has even levels,
    later ones have levels with about as many rows each, more of them the fewer
    combinations are open.  The few that are left are ranked exactly.

    A row without one of the scores is an error.
    """
    open_ = list(range(len(grid)))
    shapes = [np.linspace(0.0, 1.0, FIRST_LEVELS + 1)] * len(grid)
    levels = FIRST_LEVELS
    for _ in range(PASSES):
        counts = level_counts(df, scores, [grid[i] for i in open_], shapes, levels, label)
        counts = materialised(counts)  # at most combinations x levels rows
        bounds = auc_bounds(counts).collect()  # one row per combination
        if not bounds:
            return _weights_of(grid, [], len(scores), counts)
        best = max(row["low"] for row in bounds)
        left = sorted(r["position"] for r in bounds if r["high"] >= best)
        shapes = _evened(counts.where(F.col("position").isin(left)), left, shapes, levels)
        open_ = [open_[position] for position in left]
        levels = max(FIRST_LEVELS, min(MOST_LEVELS, CELLS // len(open_)))
        if len(open_) <= FEW_OPEN:
            break
    exact = grid_auc(df, scores, [grid[i] for i in open_], label)
    return _weights_of(grid, open_, len(scores), exact)


def _weights_of(grid: Grid, open_: list[int], count: int, exact: DataFrame) -> DataFrame:
    names = [f"w{i + 1}" for i in range(count)]
    if not open_:
        return exact.sparkSession.createDataFrame([], ", ".join(f"{n} double" for n in [*names, "auc"]))
    chosen = exact.orderBy(F.col("auc").desc(), "position").limit(1)
    weights = F.array(
        *(F.struct(*(F.lit(w).alias(n) for n, w in zip(names, grid[p]))) for p in open_)
    )
    return chosen.withColumn("_w", F.get(weights, F.col("position"))).select("_w.*", "auc")


def _level(score: np.ndarray, shape: np.ndarray, levels: int) -> np.ndarray:
    """Level of each score: ``shape`` gives the share of all levels below evenly spaced scores.

    Never falls with the score, whatever the rounding; scores outside 0..1 fall
    into the end levels.
    """
    steps = len(shape) - 1
    scaled = np.clip(score, 0.0, 1.0) * steps
    at = np.minimum(scaled.astype(np.int64), steps - 1)
    share = shape[at] + (scaled - at) * (shape[at + 1] - shape[at])
    share = np.minimum(np.maximum(share, shape[at]), shape[at + 1])
    return np.minimum((share * levels).astype(np.int64), levels - 1)


def level_counts(
    df: DataFrame, scores: list[str], grid: Grid, shapes: list[np.ndarray], levels: int,
    label: str = LABEL,
) -> DataFrame:
    """``position``, ``_level``, ``p`` and ``n``: rows of both classes per level of the blend.

    A task keeps two numbers per combination and level and returns them once.
    """
    shared = df.sparkSession.sparkContext.broadcast(shapes)  # combinations x FIRST_LEVELS numbers

    def gather(batches: Iterator[Blends]) -> Iterator[dict[str, np.ndarray]]:
        counts = np.zeros((2, len(grid), levels), np.int64)
        for position, blend, positive in chain.from_iterable(batches):
            level = _level(blend, shared.value[position], levels)
            counts[0, position] += np.bincount(level[positive], minlength=levels)
            counts[1, position] += np.bincount(level[~positive], minlength=levels)
        for position in range(len(grid)):
            at = np.flatnonzero(counts[:, position].any(0))
            yield {
                "position": np.full(len(at), position, np.int32),
                "_level": at.astype(np.int32),
                "p": counts[0, position, at],
                "n": counts[1, position, at],
            }

    schema = "position int, _level int, p long, n long"
    cells = _in_tasks(df, scores, grid, label, schema, gather)
    return cells.groupBy("position", "_level").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))


def _evened(
    counts: DataFrame, left: list[int], shapes: list[np.ndarray], levels: int
) -> list[np.ndarray]:
    """For each open combination the share of rows below evenly spaced scores."""
    sums = counts.groupBy("position", "_level").agg(F.sum(F.col("p") + F.col("n")).alias("rows"))
    rows = sums.toPandas()  # at most open combinations x levels
    out = []
    for position in left:
        mine = rows[rows["position"] == position]
        held = np.zeros(levels + 1)
        held[mine["_level"].to_numpy() + 1] = mine["rows"].to_numpy()
        below = np.cumsum(held) / held.sum()
        # where the even scores lie among the levels, and how many rows are below
        out.append(np.interp(shapes[position] * levels, np.arange(levels + 1), below))
    return out


def auc_bounds(counts: DataFrame) -> DataFrame:
    """Lower and upper AUC per ``position`` from :func:`level_counts`."""
    # a row per level of a position at most
    below = Window.partitionBy("position").orderBy("_level").rowsBetween(
        Window.unboundedPreceding, -1
    )
    p, n = F.col("p").cast("double"), F.col("n").cast("double")
    summed = counts.withColumn("_below", F.coalesce(F.sum(n).over(below), F.lit(0.0)))
    pairs = F.sum(p) * F.sum(n)
    slack = 1e-12
    return summed.groupBy("position").agg(
        (F.try_divide(F.sum(p * F.col("_below")), pairs) - slack).alias("low"),
        (F.try_divide(F.sum(p * (F.col("_below") + n)), pairs) + slack).alias("high"),
    ).where("low is not null")
