"""Model training, search, attribution and scoring over the wide feature table.

Scores of fitted models have no SQL twin.  The queries named after an operator
return what any engine can check: keys, labels, folds, drawn settings, and
whether the operator's numbers agree with a second computation of them.
``cv_scores``, ``model_importance`` and ``test_scores`` return the numbers
themselves.  Learners run with their defaults, the search too; the screening runs
``SCREENING_ROUNDS`` rounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.modeling import scoring, selection, training
from creditloom.modeling.attribution import cv_contributions
from creditloom.modeling.trees import node_table
from creditloom.operators.lookup import join_features
from creditloom.plans import hypotheses as hyp
from creditloom.plans.feature_table import PREFIXES, feature_table, numeric_feature_columns
from creditloom.queries.common import Inputs, published
from creditloom.session import scratch_dir, written
from creditloom.sources.schemas import APPLICANT, LABEL

#: Rounds per fold and trial of the registered search (the default) and screening (the
#: default is 1,000): 30 trials and 8 runs of five folds each.
SEARCH_ROUNDS, SCREENING_ROUNDS = 1500, 4
#: Two computations of one AUC, score or importance differ by less.
SAME = 1e-9

_kept: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, build: Callable[[], object]):
    """A result that several queries of a session share, computed by the first of them."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _kept:
        _kept[key] = build()
    return _kept[key]


def _wide(spark: SparkSession, sf_dir: str, part: str = "train") -> DataFrame:
    """The wide feature table, written once."""
    def build() -> DataFrame:
        inputs = Inputs(spark, sf_dir, shared=True)
        return written(feature_table(inputs[f"application_{part}"], inputs.all()))

    return _once(spark, sf_dir, f"wide {part}", build)


def _ready(spark: SparkSession, sf_dir: str) -> training.Prepared:
    return _once(spark, sf_dir, "ready", lambda: training.prepared(_wide(spark, sf_dir)))


def _fitted(spark: SparkSession, sf_dir: str, learner: str) -> training.CvResult:
    def build() -> training.CvResult:
        ready = _ready(spark, sf_dir)
        return training.cross_validated(ready, learner, parallel=5)

    return _once(spark, sf_dir, learner, build)


def _saved(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Folder and version of the boosted model, saved once."""
    def build() -> tuple[str, str]:
        path = scratch_dir(spark)
        return path, scoring.save_model(_fitted(spark, sf_dir, "boosted"), path)

    return _once(spark, sf_dir, "saved", build)


def _inside(score: str) -> F.Column:
    return F.coalesce(F.col(score).between(0.0, 1.0), F.lit(False)).alias("in_range")


def _folds(learner: str):
    """Fold of every training row, and whether its fold's AUC agrees with Spark's evaluator."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = _fitted(spark, sf_dir, learner)
        area = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol=LABEL, numBins=0)
        agrees = [
            abs(area.evaluate(result.scores.where(F.col("fold") == k)) - auc) < SAME
            for k, auc in enumerate(result.fold_auc)
        ]
        told = F.get(F.array(*map(F.lit, agrees)), F.col("fold"))
        return result.scores.select(APPLICANT, LABEL, "fold", _inside("score"), told.alias("auc_agrees"))

    return query


def _cv_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _fitted(spark, sf_dir, "boosted")
    aucs = F.array(*map(F.lit, result.fold_auc))
    return result.scores.withColumn("fold_auc", F.get(aucs, F.col("fold")))


def _against(loaded: DataFrame, result: training.CvResult) -> DataFrame:
    """Key, label, fold, and whether a loaded model's held-out score is the trained one's."""
    known = result.scores.select(APPLICANT, "fold", F.col("score").alias("_trained"))
    both = loaded.join(known, [APPLICANT, "fold"], "left")
    same = F.abs(F.col("score") - F.col("_trained")) < SAME
    return both.select(APPLICANT, LABEL, "fold", F.coalesce(same, F.lit(False)).alias("same_score"))


def _oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    about, models = scoring.load_model(spark, _saved(spark, sf_dir)[0])
    again = scoring.held_out_scores(_wide(spark, sf_dir), about, models)
    return _against(again, _fitted(spark, sf_dir, "boosted"))


def _save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second save is lost before its commit: the first version is what loads."""
    result, (path, version) = _fitted(spark, sf_dir, "boosted"), _saved(spark, sf_dir)
    result.models[0].write().overwrite().save(f"{path}/unfinished/fold_0")
    about, models = scoring.load_model(spark, path)
    finished = [r["version"] for r in scoring.versions(spark, path).collect()]
    ready = _ready(spark, sf_dir)
    parts = None
    for k, model in enumerate(models):
        rows = training.model_rows(ready.rows, k, about["numeric"], about["encoded"], about["fills"])
        held = training.with_score(model, rows.where(F.col("fold") == k))
        parts = held if parts is None else parts.unionByName(held)
    return _against(parts, result).withColumn("first_version", F.lit(finished == [version]))


def _test_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    about, models = scoring.load_model(spark, _saved(spark, sf_dir)[0])
    return scoring.score_rows(_wide(spark, sf_dir, "test"), about, models, _wide(spark, sf_dir))


def _score_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _test_scores(spark, sf_dir).select(APPLICANT, _inside(LABEL))


def _submission_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.submission_check(_test_scores(spark, sf_dir))


def _importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(spark, sf_dir, "boosted").importance


def _node_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the gains summed over the node tables are the importances the models report."""
    result = _fitted(spark, sf_dir, "boosted")
    vectors = [m.featureImportances.toArray() for m in result.models]
    told = [float(sum(v)) / len(vectors) for v in zip(*vectors)]
    rows = list(zip(result.features, told, strict=True))
    own = spark.createDataFrame(rows, "feature string, _told double")  # one row per feature
    agrees = F.abs(F.col("importance") - F.col("_told")) < SAME
    return result.importance.join(own, "feature").select("feature", agrees.alias("agrees"))


def _prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.prune_features(_importance(spark, sf_dir))


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.top_features(_importance(spark, sf_dir))


def _by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.importance_by_group(_importance(spark, sf_dir), [*PREFIXES, "TE_"])


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _fitted(spark, sf_dir, "boosted")
    parts = None
    for k, model in enumerate(result.models):
        nodes = node_table(model, spark).withColumn("fold", F.lit(k))
        parts = nodes if parts is None else parts.unionByName(nodes)
    return parts


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every fit is a task: as many trials at a time as occupy the cores
    at_once = -(-spark.sparkContext.defaultParallelism // 5)
    found = training.random_search(
        _wide(spark, sf_dir), rounds=SEARCH_ROUNDS, parallel=5, at_once=at_once
    )[1]
    drawn = published(found.drop("auc"), "trial", "max_depth", "min_rows")
    return drawn.join(found.select("trial", F.col("auc").between(0.0, 1.0).alias("rated")), "trial")


def _ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = Inputs(spark, sf_dir)
    more = [  # the wide table has the families kept after screening
        hyp.h1_variance(
            inputs["installments_payments"], inputs["credit_card_balance"], inputs["POS_CASH_balance"]
        ),
        hyp.h6_velocity(inputs["previous_application"], inputs["bureau"]),
    ]
    wide = join_features(_wide(spark, sf_dir), more, APPLICANT)
    numeric = numeric_feature_columns(wide)
    groups = hyp.hypothesis_columns(wide)
    own = {c for columns in groups.values() for c in columns}
    base = [c for c in numeric if c not in own]
    found = training.ablation(
        wide, base, groups, learner="boosted", params={"maxIter": SCREENING_ROUNDS}, parallel=5
    )
    first = found.where("name = 'baseline'").select(F.max("auc")).scalar()
    delta = F.abs(F.col("delta_bps") - (F.col("auc") - first) * 10_000) < SAME
    return found.select(
        "name",
        (F.col("n_features") - len(base)).alias("n_added"),
        delta.alias("delta_agrees"),
        (F.col("winner") == (F.col("delta_bps") > 0)).alias("winner_agrees"),
    )


def _contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv_contributions(_fitted(spark, sf_dir, "boosted"), _ready(spark, sf_dir))


QUERIES = {
    "train_cv": _folds("boosted"),
    "train_cv_second": _folds("forest"),
    "train_cv_third": _folds("linear"),
    "cv_scores": _cv_scores,
    "model_nodes": _nodes,
    "model_importance": _importance,
    "node_importance": _node_importance,
    "model_prune": _prune,
    "model_top_features": _top,
    "model_importance_by_group": _by_group,
    "random_search": _search,
    "ablation": _ablation,
    "oof_scores": _oof,
    "save_load_model": _save_load,
    "contribution_importance": _contributions,
    "score_test": _score_test,
    "test_scores": _test_scores,
    "submission_check": _submission_check,
}
