"""Boosted trees over binned features, every fit in one task.

The trees are those of Spark's ``GBTClassifier`` (logistic loss, first tree on the
labels, variance gain, up to ``BINS`` bins a feature, features drawn per node, rows per
tree), grown round by round until patience ends the search: no round is fitted twice and
no job is started per level.  Bins are found and rows are binned once for all fits, in
all tasks.  Statistics of a node are sums of whole numbers, so they do not depend on the
order of rows.  Models come out in Spark's own format.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.modeling.matrix import VECTOR
from creditloom.session import scratch_dir
from creditloom.sources.schemas import APPLICANT, LABEL

#: Bins of a feature, as many as Spark's trees have by default.
BITS = 5
BINS = 1 << BITS
#: Settings that are known here; a fit with others is left to Spark's learner.
KNOWN = {
    "maxDepth", "stepSize", "maxIter", "subsamplingRate", "featureSubsetStrategy",
    "minInstancesPerNode", "seed",
}
DEEPEST = 10
#: Numbers that a task keeps, a byte each: more rows are fitted by Spark's learner.
MOST_TASK_CELLS = 400_000_000
#: Values of a feature that a summary has, and summaries that are merged at a time.
SUMMARY, MERGED = 512, 16
CODES = "_codes"


# --- bins -------------------------------------------------------------------


def summary(values: np.ndarray, counts: np.ndarray, most: int = SUMMARY) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with their counts; of more than ``most``, the last of as many equal shares."""
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    ends = np.flatnonzero(np.append(values[1:] != values[:-1], True))
    values, upto = values[ends], counts.cumsum()[ends]
    if len(values) > most:
        wanted = upto[-1] * np.arange(1, most + 1) / most
        at = np.unique(np.searchsorted(upto, wanted, side="left"))
        values, upto = values[at], upto[at]
    return values, np.diff(upto, prepend=0)


def thresholds(values: np.ndarray, counts: np.ndarray, bins: int = BINS) -> list[float]:
    """Bounds between bins as Spark sets them: between all values, or after equal shares of the rows."""
    with np.errstate(over="ignore", invalid="ignore"):
        middle = (values[:-1] + values[1:]) / 2
    middle = np.where(np.isfinite(middle) & (middle < values[1:]), middle, values[:-1])
    if len(middle) < bins:
        return middle.tolist()
    out, step, upto = [], counts.sum() / bins, counts.cumsum()
    target = step
    for i in range(1, len(values)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(float(middle[i - 1]))
            target += step
    return out[: bins - 1]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def bin_bounds(vectors: DataFrame) -> list[list[float]]:
    """Bounds of every feature of the vector column, from one pass over all rows."""
    def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list] = []

        def merged() -> None:
            for parts in found:
                parts[:] = [summary(*(np.concatenate(x) for x in zip(*parts)))]

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0))
            ones = np.ones(len(x), np.int64)
            found = found or [[] for _ in range(x.shape[1])]
            for parts, values in zip(found, x.T):
                parts.append(summary(values, ones))
            if len(found[0]) >= MERGED:
                merged()
        merged()
        if found:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(len(found)), pa.int32()),
                    pa.array([p[0][0].tolist() for p in found], pa.list_(pa.float64())),
                    pa.array([p[0][1].tolist() for p in found], pa.list_(pa.int64())),
                ],
                names=["at", "values", "counts"],
            )

    def bounds(parts: pd.DataFrame) -> pd.DataFrame:
        values, counts = np.concatenate(parts["values"].tolist()), np.concatenate(parts["counts"].tolist())
        found = thresholds(*summary(values, counts, len(values)))
        return pd.DataFrame({"at": parts["at"][:1], "bounds": [found]})

    numbers = vectors.select(vector_to_array(VECTOR).alias("x"))
    parts = numbers.mapInArrow(summarised, "at int, values array<double>, counts array<long>")
    rows = parts.groupBy("at").applyInPandas(bounds, "at int, bounds array<double>").collect()
    return [r["bounds"] for r in sorted(rows)]  # at most BINS - 1 numbers per feature


def binned(vectors: DataFrame, bounds: list[list[float]]) -> DataFrame:
    """Key, label, fold and the number of each feature's bin, a byte each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(3))
            codes = np.empty(x.shape, np.uint8)
            for i, found in enumerate(bounds):
                codes[:, i] = np.searchsorted(np.array(found), x[:, i], side="left")
            ends = np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)
            packed = pa.Array.from_buffers(
                pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(codes)]
            )
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed], names=names)

    names = [APPLICANT, LABEL, "fold", CODES]
    ready = vectors.select(
        F.col(APPLICANT).cast("long"), F.col(LABEL).cast("double"), F.col("fold").cast("int"),
        vector_to_array(VECTOR).alias("x"),
    )
    return ready.mapInArrow(run, f"{APPLICANT} long, {LABEL} double, fold int, {CODES} binary")


# --- trees ------------------------------------------------------------------

#: Whole numbers below 2**19 stand for residuals; a sum over ``PIECE`` rows stays below
#: 2**35, beside a count in the bits above: both are exact in one double.
LEVELS, COUNT = float((1 << 19) - 1), float(1 << 36)
PIECE = 1 << 15


def drawn_features(strategy: str, features: int) -> int:
    """Features that are looked at per node, as Spark reads its setting."""
    named = {
        "all": features, "auto": features, "onethird": features / 3,
        "sqrt": math.sqrt(features), "log2": max(1.0, math.log2(max(1, features))),
    }
    if strategy in named:
        return math.ceil(named[strategy])
    share = float(strategy)
    if strategy.isdigit():
        return min(int(strategy), features)
    return math.ceil(min(1.0, share) * features)


class Rows:
    """Bins of all rows of a fit, two features a number, one line of numbers per pair."""

    def __init__(self, pairs: np.ndarray, features: int):
        self.pairs, self.features = pairs, features

    def codes(self, feature: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The bin of ``feature[i]`` in row ``rows[i]``."""
        found = self.pairs[feature >> 1, rows]
        return np.where(feature & 1, found & (BINS - 1), found >> BITS)

    def sums(self, rows: np.ndarray, slot: np.ndarray, packed: np.ndarray, slots: int) -> list[np.ndarray]:
        """Counts and sums by slot, feature and bin; ``packed`` has both of each row."""
        count = np.zeros((slots, self.features, BINS))
        total = np.zeros_like(count)
        for start in range(0, len(rows), PIECE):
            piece = slice(start, start + PIECE)
            found = self._piece(rows[piece], slot[piece], packed[piece], slots)
            n = np.floor((found + COUNT / 2) / COUNT)
            count += n
            total += found - n * COUNT
        return [count, total]

    def _piece(self, rows: np.ndarray, slot: np.ndarray, packed: np.ndarray, slots: int) -> np.ndarray:
        pairs = len(self.pairs)
        out = np.empty((slots, 2 * pairs, BINS))
        both = len(rows) >= slots << (2 * BITS)  # else the table of two features is larger than the rows
        bits = 2 * BITS if both else BITS
        base = slot.astype(np.int64) << bits
        at_once = max(1, PIECE // max(1, len(rows)))
        for first in range(0, pairs, at_once):
            found = self.pairs[first : first + at_once].take(rows, axis=1)
            n = len(found)
            if not both:
                found = np.concatenate([found >> BITS, found & (BINS - 1)])
            index = found + base
            if len(found) > 1:
                index += (np.arange(len(found)) * (slots << bits))[:, None]
            weights = packed if len(found) == 1 else np.tile(packed, len(found))
            table = np.bincount(index.ravel(), weights, len(found) * (slots << bits))
            if both:
                table = table.reshape(n, slots, BINS, BINS)
                halves = table.sum(3), table.sum(2)
            else:
                halves = table.reshape(2, n, slots, BINS)
            for half, sums in enumerate(halves):
                out[:, 2 * first + half : 2 * (first + n) : 2] = sums.transpose(1, 0, 2)
        return out[:, : self.features]


def best_splits(
    sums: list[np.ndarray], chosen: np.ndarray, least: int, positive: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node: the largest drop of the squared error, its feature and its bin.

    ``sums`` are counts and sums by node, feature and bin, and the counts of the
    positive class if these have a weight of their own.  ``chosen`` are the features looked at.
    """
    upto = [s.cumsum(2) for s in sums]
    left = [u[..., :-1] for u in upto]
    right = [u[..., -1:] - u[..., :-1] for u in upto]

    def error(part: list[np.ndarray]) -> np.ndarray:
        weight = part[0] if len(part) < 3 else part[0] + (positive - 1.0) * part[2]
        out = np.square(part[1])
        out /= np.maximum(weight, 1e-9)  # an empty part has no sum either
        return out

    gain = error(left)
    gain += error(right)
    gain -= error([u[..., -1:] for u in upto])
    gain[(left[0] < least) | (right[0] < least) | ~chosen[..., None]] = -np.inf
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(1)
    return flat[np.arange(len(flat)), at], at // (BINS - 1), at % (BINS - 1)


def grow(
    rows: Rows, used: np.ndarray, residual: np.ndarray, weight: np.ndarray, largest: float,
    depth: int, least: int, n_drawn: int, rng: np.random.Generator, positive: float,
) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """One tree on the ``used`` rows, and the node that every row of all ends in.

    Nodes are numbered by level; ``left`` is -1 in leaves.
    """
    n = rows.pairs.shape[1]
    scaled = np.rint(residual[used] * weight[used] * (LEVELS / largest)) + COUNT
    ones = (weight[used] != 1.0).astype(float) if positive != 1.0 else None
    node = np.zeros(n, np.int64)
    left, right, feature, code = [-1], [-1], [-1], [-1]
    level, before, slots = [0], None, {0: 0}  # nodes of the level, sums of their parents
    for at_depth in range(depth):
        size = len(left)
        slot_of = np.full(size, -1, np.int64)
        for number, slot in slots.items():
            slot_of[number] = slot
        slot = slot_of[node[used]]
        inside = np.flatnonzero(slot >= 0)
        some, slot = used[inside], slot[inside]
        fresh = rows.sums(some, slot, scaled[inside], len(slots))
        if ones is not None:
            fresh.append(rows.sums(some, slot, ones[inside] * COUNT, len(slots))[0])
        if before is None:
            sums = fresh
        else:  # the larger child of each pair is the parent without the smaller one
            sums = [np.empty((len(level), *f.shape[1:])) for f in fresh]
            for i in range(0, len(level), 2):
                small, large = (i, i + 1) if level[i] in slots else (i + 1, i)
                for s, f, b in zip(sums, fresh, before):
                    s[small] = f[slots[level[small]]]
                    np.subtract(b[i // 2], s[small], out=s[large])
        chosen = np.ones((len(level), rows.features), bool)
        if n_drawn < rows.features:
            order = rng.random(chosen.shape).argpartition(n_drawn - 1, axis=1)
            chosen[:] = False
            np.put_along_axis(chosen, order[:, :n_drawn], True, axis=1)
        gain, best, bound = best_splits(sums, chosen, least, positive)
        noise = 1e-12 * LEVELS**2 * sums[0][:, 0].sum(1)
        split = np.flatnonzero(gain > noise)
        if not len(split):
            break
        for i in split:
            number = level[i]
            left[number], right[number] = len(left), len(left) + 1
            feature[number], code[number] = int(best[i]), int(bound[i])
            for names in (left, right, feature, code):
                names += [-1, -1]
        # move all rows, also those that are only scored
        of, at, to = np.array(feature), np.array(code), np.array(left)
        moving = np.flatnonzero(to[node] >= 0)
        was = node[moving]
        node[moving] = to[was] + (rows.codes(of[was], moving) > at[was])
        before = [s[split] for s in sums]
        level = [child for i in split for child in (left[level[i]], right[level[i]])]
        sizes = np.bincount(node[used], minlength=len(left))
        small = [a if sizes[a] <= sizes[b] else b for a, b in zip(level[::2], level[1::2])]
        slots = {number: slot for slot, number in enumerate(small)}
    tree = {"left": np.array(left), "right": np.array(right), "feature": np.array(feature), "code": np.array(code)}
    at, r, w, size = node[used], residual[used], weight[used], len(left)
    stats = np.stack([np.bincount(at, x, size) for x in (np.ones(len(at)), w, w * r, w * r * r)])
    for number in range(size - 1, -1, -1):  # children come after their parents
        if left[number] >= 0:
            stats[:, number] = stats[:, left[number]] + stats[:, right[number]]
    tree["stats"] = stats
    return tree, node


def area(scores: np.ndarray, label: np.ndarray) -> float:
    """AUC with ties counted half; 0.5 where there is one class only."""
    order = np.argsort(scores)
    ends = np.flatnonzero(np.append(np.diff(scores[order]) != 0, True)) if len(order) else order
    ones = np.diff(label[order].cumsum()[ends], prepend=0.0)
    zeros = np.diff(ends, prepend=-1) - ones
    pairs = ones.sum() * zeros.sum()
    below = zeros.cumsum() - zeros
    return float((ones * (below + zeros / 2)).sum() / pairs) if pairs else 0.5


def boosted(
    rows: Rows, label: np.ndarray, n_train: int, settings: dict, positive: float, patience: int
) -> tuple[list[dict[str, np.ndarray]], list[float]]:
    """Trees and held-out AUC of every round, until ``patience`` rounds brought no larger one.

    The first ``n_train`` rows are fitted, the others are held out.
    """
    sign = 2.0 * label - 1.0
    weight = np.where(label == 1.0, positive, 1.0)
    n_drawn = drawn_features(str(settings["featureSubsetStrategy"]), rows.features)
    margin, trees, aucs, best = np.zeros(len(label)), [], [], 0
    for number in range(settings["maxIter"]):
        rng = np.random.default_rng([settings["seed"], number])
        share = settings["subsamplingRate"]
        used = np.flatnonzero(rng.random(n_train) < share) if share < 1.0 else np.arange(n_train)
        if not len(used):
            used = np.arange(n_train)
        # the first tree is one of the labels, any other of the loss's gradient
        residual = 4.0 * sign / (1.0 + np.exp(np.minimum(2.0 * sign * margin, 700.0))) if number else sign
        tree, node = grow(
            rows, used, residual, weight, 4.0 * max(1.0, positive), settings["maxDepth"],
            settings["minInstancesPerNode"], n_drawn, rng, positive,
        )
        value = tree["stats"][2] / tree["stats"][1]
        margin += (settings["stepSize"] if number else 1.0) * value[node]
        trees.append(tree)
        aucs.append(area(margin[n_train:], label[n_train:]))
        if aucs[-1] > aucs[best]:
            best = number
        elif number - best >= patience:
            break
    return trees[: best + 1], aucs


# --- models -----------------------------------------------------------------

_SPLIT = pa.struct([
    ("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())),
    ("numCategories", pa.int32()),
])
_NODE = pa.struct([
    ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()),
    ("impurityStats", pa.list_(pa.float64())), ("rawCount", pa.int64()), ("gain", pa.float64()),
    ("leftChild", pa.int32()), ("rightChild", pa.int32()), ("split", _SPLIT),
])
_NODE_SQL = (
    "struct<id: int, prediction: double, impurity: double, impurityStats: array<double>,"
    " rawCount: bigint, gain: double, leftChild: int, rightChild: int,"
    " split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)
#: What a fit returns: nodes of the kept trees, and a last row with the AUC of all rounds.
FITTED = f"treeID int, nodeData {_NODE_SQL}, aucs array<double>"


def tree_nodes(tree: dict[str, np.ndarray], bounds: list[list[float]]) -> list[dict]:
    """The nodes as Spark saves them, numbered from the root down, left before right."""
    count, weight, total, squares = tree["stats"]
    impurity = np.maximum(squares / weight - (total / weight) ** 2, 0.0)
    order, stack = [], [0]
    while stack:
        at = stack.pop()
        order.append(at)
        if tree["left"][at] >= 0:
            stack += [tree["right"][at], tree["left"][at]]
    number = {at: i for i, at in enumerate(order)}
    out = []
    for at in order:
        l, r, f = tree["left"][at], tree["right"][at], int(tree["feature"][at])
        inner = l >= 0
        gain = -1.0
        if inner:
            children = weight[l] * impurity[l] + weight[r] * impurity[r]
            gain = float(max(0.0, impurity[at] - children / weight[at]))
        bound = [bounds[f][tree["code"][at]]] if inner else []
        out.append({
            "id": number[at], "prediction": float(total[at] / weight[at]), "impurity": float(impurity[at]),
            "impurityStats": [float(weight[at]), float(total[at]), float(squares[at])],
            "rawCount": int(count[at]), "gain": gain,
            "leftChild": number[l] if inner else -1, "rightChild": number[r] if inner else -1,
            "split": {"featureIndex": f, "leftCategoriesOrThreshold": bound, "numCategories": -1},
        })
    return out


def fitted(
    table: DataFrame, fold: int, positions: list[int], bounds: list[list[float]], count: int,
    settings: dict, positive: float, patience: int, keep: bool = True,
) -> DataFrame:
    """``FITTED`` rows of the model without ``fold``, from the features at ``positions``.

    ``count`` is the number of rows of the :func:`binned` ``table``, which are read by one task.
    """
    own = [bounds[i] for i in positions]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = positions[::2], positions[1::2]
        pairs = np.zeros((len(high), count), np.uint16)
        told, marks, done = [], np.empty(count, np.uint64), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            column = batch.column(3)
            first, last = column.offset, column.offset + n
            ends = np.frombuffer(column.buffers()[1], np.int32)[first : last + 1]
            codes = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(n, -1)
            part = pairs[:, done : done + n]
            part[:] = codes[:, high].T.astype(np.uint16) << BITS
            part[: len(low)] |= codes[:, low].T
            marks[done : done + n] = _marks(part)
            told.append([c.to_numpy(zero_copy_only=False) for c in batch.columns[:3]])
            done += n
        if done != count:
            raise RuntimeError(f"{done} of {count} rows read")
        key, label, folds = (np.concatenate(c) for c in zip(*told))
        if not np.isin(label, (0.0, 1.0)).all():
            raise ValueError("a label is neither 0 nor 1")
        key = pd.to_numeric(pd.Series(key)).fillna(-1).to_numpy(np.int64)
        held = folds == fold
        # held-out rows last; the order of all others does not depend on files
        order = np.lexsort((marks, label, key, held))
        for i in range(len(pairs)):
            pairs[i] = pairs[i][order]
        n_train = int(count - held.sum())
        if not n_train:
            raise ValueError(f"no rows outside of fold {fold}")
        rows = Rows(pairs, len(positions))
        trees, aucs = boosted(rows, label[order], n_train, settings, positive, patience)
        names = ["treeID", "nodeData", "aucs"]
        types = [pa.int32(), _NODE, pa.list_(pa.float64())]
        for number, tree in enumerate(trees if keep else []):
            nodes = tree_nodes(tree, own)
            columns = [[number] * len(nodes), nodes, [None] * len(nodes)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
        last = [pa.array(c, t) for c, t in zip(([None], [None], [aucs]), types)]
        yield pa.RecordBatch.from_arrays(last, names=names)

    return table.coalesce(1).mapInArrow(run, FITTED)


def _marks(pairs: np.ndarray) -> np.ndarray:
    """A number per row that tells rows with different bins apart."""
    odd = np.random.default_rng(7).integers(1, 2**63, len(pairs), np.uint64) | np.uint64(1)
    out = np.zeros(pairs.shape[1], np.uint64)
    for line, factor in zip(pairs, odd):
        out ^= (line.astype(np.uint64) + np.uint64(1)) * factor
        out = (out << np.uint64(7)) | (out >> np.uint64(57))
    return out


def model_of(spark: SparkSession, nodes: pa.Table, features: int, columns: dict, settings: dict) -> GBTClassificationModel:
    """Spark's model of the trees in ``nodes``, by way of the files it would save."""
    path = f"{scratch_dir(spark)}/model"
    count = 1 + max(nodes.column("treeID").to_pylist())

    def about(kind: str, **more) -> str:
        name = kind.rsplit(".", 1)[1]
        return json.dumps({
            "class": f"org.apache.spark.ml.{kind}", "timestamp": 0, "sparkVersion": spark.version,
            "uid": f"{name}_{uuid.uuid4().hex[:12]}", "defaultParamMap": {"impurity": "variance"}, **more,
        })

    own = {**columns, **settings}
    whole = about("classification.GBTClassificationModel", paramMap=own, numFeatures=features, numTrees=count)
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    one = {k: settings[k] for k in ("maxDepth", "minInstancesPerNode", "seed")}
    trees = [
        (i, about("regression.DecisionTreeRegressionModel", paramMap=one), settings["stepSize"] if i else 1.0)
        for i in range(count)
    ]
    spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(nodes, f"treeID int, nodeData {_NODE_SQL}").coalesce(1).write.parquet(f"{path}/data")
    return GBTClassificationModel.load(path)
