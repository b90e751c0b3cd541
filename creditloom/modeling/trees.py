"""Boosted ensembles as tables of nodes: scores after every round, gains, a shorter ensemble."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creditloom.modeling.matrix import VECTOR
from creditloom.operators.metrics import auc_exact
from creditloom.session import scratch_dir
from creditloom.sources.schemas import LABEL

MARGINS = "_margins"


def node_table(model: Model, spark: SparkSession) -> DataFrame:
    """One row per node: ``tree, id, value, cover, gain, left, right, feature, threshold``.

    Read from the table that Spark saves with a tree model.  ``cover`` is the
    weight of the training rows in the node, ``gain`` the drop in impurity of its
    split; a leaf has no ``feature`` and a negative ``left``.
    """
    path = f"{scratch_dir(spark)}/trees"
    model.write().overwrite().save(path)
    data, stats = F.col("nodeData"), F.col("nodeData.impurityStats")
    split = data.getField("leftChild") >= 0
    cover = F.aggregate(stats, F.lit(0.0), lambda total, x: total + x)
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        F.col("nodeData.id").alias("id"),
        F.col("nodeData.prediction").alias("value"),
        # regression trees keep (weight, sum, sum of squares), classifiers a weight per class
        F.when(F.size(stats) == 3, F.get(stats, F.lit(0))).otherwise(cover).alias("cover"),
        F.col("nodeData.gain").alias("gain"),
        F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.when(split, F.col("nodeData.split.featureIndex")).alias("feature"),
        F.when(split, F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
    )


class Trees:
    """All trees of an ensemble in arrays, one row per tree; as large as the model."""

    def __init__(self, nodes: DataFrame, weights: list[float]):
        rows = nodes.select("tree", "id", "value", "left", "right", "feature", "threshold").collect()
        size = 1 + max(r["id"] for r in rows)
        self.weights = np.array(weights)
        shape = (len(weights), size)
        self.value, self.threshold = np.zeros(shape), np.full(shape, np.inf)
        self.left, self.right, self.feature = (np.zeros(shape, np.int64) for _ in range(3))
        for r in rows:
            at = r["tree"], r["id"]
            self.value[at] = r["value"]
            self.left[at] = self.right[at] = r["id"]  # a leaf leads to itself
            if r["feature"] is not None:
                self.left[at], self.right[at] = r["left"], r["right"]
                self.feature[at], self.threshold[at] = r["feature"], r["threshold"]

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Rows x rounds: the margin after each round, half the log-odds."""
        out, rows = np.empty((len(x), len(self.weights))), np.arange(len(x))
        for tree, weight in enumerate(self.weights):
            at = np.zeros(len(x), np.int64)
            while True:
                smaller = x[rows, self.feature[tree, at]] <= self.threshold[tree, at]
                after = np.where(smaller, self.left[tree, at], self.right[tree, at])
                if (after == at).all():
                    break
                at = after
            out[:, tree] = weight * self.value[tree, at]
        return out.cumsum(1)


def round_margins(model: GBTClassificationModel, rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and ``_margins``, each row's margin after every round of boosting."""
    trees = Trees(node_table(model, rows.sparkSession), list(model.treeWeights))
    shared = rows.sparkSession.sparkContext.broadcast(trees)  # as large as the model
    ready = rows.select(*keep, vector_to_array(VECTOR).alias("_x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keep))
            if not len(lists):
                continue
            x = lists.flatten().to_numpy().reshape(len(lists), -1)
            margins = shared.value.margins(x)
            ends = np.arange(0, margins.size + 1, margins.shape[1], dtype=np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(ends), pa.array(margins.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], arrays], names=[*keep, MARGINS])

    types = {f.name: f.dataType.simpleString() for f in ready.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"{MARGINS} array<double>"])
    return ready.mapInArrow(run, schema)


def round_aucs(model: GBTClassificationModel, held: DataFrame, label: str = LABEL) -> list[float]:
    """Exact AUC on ``held`` after every round; 0.5 where only one class is held out.

    The rows' margins of all rounds are laid out below each other and ranked by
    one grouped prefix sum.
    """
    margins = round_margins(model, held, [label])
    long = margins.select(label, F.posexplode(MARGINS).alias("_round", "_margin"))
    found = auc_exact(long, "_margin", label, by=["_round"]).collect()  # one row per round
    aucs = {r["_round"]: r["auc"] for r in found}
    return [0.5 if aucs.get(i) is None else aucs[i] for i in range(len(model.treeWeights))]


def cut(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The ensemble of the first ``rounds`` trees; nothing is fitted."""
    java, context = model._java_obj, SparkContext._active_spark_context
    if rounds >= java.getNumTrees():
        return model
    ml = context._jvm.org.apache.spark.ml
    trees = context._gateway.new_array(ml.regression.DecisionTreeRegressionModel, rounds)
    weights = context._gateway.new_array(context._jvm.double, rounds)
    for i, (tree, weight) in enumerate(zip(java.trees()[:rounds], java.treeWeights()[:rounds])):
        trees[i], weights[i] = tree, weight
    shorter = ml.classification.GBTClassificationModel(
        java.uid(), trees, weights, java.numFeatures(), java.numClasses()
    )
    return model._copyValues(GBTClassificationModel(shorter))


def node_importance(nodes: DataFrame, names: list[str], per_tree: bool = False) -> DataFrame:
    """``feature`` and ``importance`` from a node table, all names of the model included.

    A split counts with its gain times the rows of its node, summed per feature
    and scaled to a sum of one.  ``per_tree`` scales every tree by itself
    first, as forests do; in a boosted ensemble early trees weigh more.
    ``nodes`` may hold several models, told apart by ``model``: the mean of
    their importances counts, zero where a model does not use a feature.
    """
    models = nodes if "model" in nodes.columns else nodes.withColumn("model", F.lit(0))
    keys = ["model", "tree"] if per_tree else ["model"]
    parts = models.where("feature is not null").groupBy(*keys, "feature").agg(
        F.sum(F.col("gain") * F.col("cover")).alias("_part")
    )
    # at most features x trees rows per model
    for scale in ([keys] if not per_tree else [keys, ["model"]]):
        share = F.try_divide("_part", F.sum("_part").over(Window.partitionBy(*scale)))
        shares = parts.withColumn("_share", share)
        parts = shares.groupBy("model", "feature").agg(F.sum("_share").alias("_part"))
    count = models.select(F.count_distinct("model")).scalar()
    mean = parts.groupBy(F.col("feature").alias("_at")).agg(F.sum("_part").alias("_sum"))
    known = nodes.sparkSession.createDataFrame(list(enumerate(names)), "_at int, feature string")
    joined = known.join(F.broadcast(mean), "_at", "left")  # a row per feature
    return joined.select("feature", F.coalesce(F.col("_sum") / count, F.lit(0.0)).alias("importance"))
