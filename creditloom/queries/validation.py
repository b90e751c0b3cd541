"""Folds, encodings, metrics, blends, selection and score bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.modeling import selection as sel
from creditloom.modeling.logs import score_gap, score_merge
from creditloom.operators import blending as bl
from creditloom.operators import metrics as m
from creditloom.operators.folds import (
    ENCODED, category_statistics, encode_folds, encode_full, present_encoded, stratified_folds,
)
from creditloom.operators.grouped import distinct_counts
from creditloom.plans.application import application_features
from creditloom.plans.feature_table import PREFIXES, numeric_feature_columns
from creditloom.queries.common import SCORES, Inputs, published, with_scores
from creditloom.sources.mapped import sample
from creditloom.sources.schemas import APPLICANT, LABEL


def _train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Inputs(spark, sf_dir)["application_train"]


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_scores(_train(spark, sf_dir))


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stratified_folds(_train(spark, sf_dir).select(APPLICANT, LABEL))
    return published(out, APPLICANT, LABEL, "fold")


def _te_names(df: DataFrame) -> list[str]:
    return [f"TE_{c}" for c in ENCODED if f"TE_{c}" in df.columns]


def _te_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_folds(stratified_folds(_train(spark, sf_dir)))
    return published(out.select(APPLICANT, "fold", *_te_names(out)), APPLICANT, "fold")


def _te_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_full(_train(spark, sf_dir), Inputs(spark, sf_dir)["application_test"])
    return published(out.select(APPLICANT, *_te_names(out)), APPLICANT)


def _te_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded columns present, with their number of categories."""
    train = _train(spark, sf_dir).withColumn("_all", F.lit(1))
    names = present_encoded(train)
    counts = distinct_counts(train, "_all", {c: c for c in names})
    long = counts.unpivot("_all", names, "column", "n_categories").drop("_all")
    return published(long, "column", "n_categories")


def _category_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = _train(spark, sf_dir)
    out = category_statistics(train, present_encoded(train)).drop("cat_sum")
    return published(out, "column", "category", "cat_count")


def _auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(m.auc_exact(_scored(spark, sf_dir), "score_a"), "n_pos", "n_neg")


def _auc_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = stratified_folds(_scored(spark, sf_dir))
    return published(m.auc_exact(folds, "score_b", by=["fold"]), "fold", "n_pos", "n_neg")


def _roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(m.roc_points(_scored(spark, sf_dir), "score_a"))


def _thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = m.threshold_table(_scored(spark, sf_dir), "score_a")
    return published(table, "true_positives", "false_positives")


def _threshold_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = m.threshold_lookup(m.threshold_table(_scored(spark, sf_dir), "score_a"))
    return published(table, "true_positives", "false_positives")


def _blend(count: int, grid):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = list(SCORES)[:count]
        return published(bl.best_blend(_scored(spark, sf_dir), names, grid()))

    return query


def _grid_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bl.grid_auc(_scored(spark, sf_dir), ["score_a", "score_b"], bl.weights_2())
    return published(out.drop("n_pos", "n_neg"), "position")


def _blend_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    tables = [scored.select(APPLICANT, F.col(s).alias("score")) for s in SCORES]
    out = bl.blend_scores(tables, (0.4, 0.17, 0.33, 0.1), APPLICANT, "score")
    return published(out, APPLICANT)


def _importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of the applicant columns, on a grid so that equal ones tie."""
    app = application_features(_train(spark, sf_dir))
    table = sel.correlation_importance(app, numeric_feature_columns(app))
    return published(table, "feature")


def _feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over the folds of the importance within each fold."""
    app = stratified_folds(application_features(_train(spark, sf_dir)))
    columns = [c for c in numeric_feature_columns(app) if c.startswith("APP_")]
    per_fold = sel.correlation_importance(app, columns, by=["fold"])
    return published(sel.mean_importance(per_fold), "feature")


def _prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(sel.prune_features(_importance(spark, sf_dir)), "feature", "encoded")


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(sel.top_features(_importance(spark, sf_dir)), "feature")


def _by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sel.importance_by_group(_importance(spark, sf_dir), PREFIXES)
    return published(out, "prefix", "used", "feature", "place")


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = _train(spark, sf_dir).select(APPLICANT, LABEL)
    fixed = sel.class_weights(train, 2.5).withColumnRenamed("weight", "fixed_weight")
    both = sel.class_weights(fixed).withColumnRenamed("weight", "balanced_weight")
    return published(both, APPLICANT, LABEL)


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = sel.sample_rows(_train(spark, sf_dir), 1000, APPLICANT)
    return published(part.select(APPLICANT, LABEL), APPLICANT, LABEL)


def _log_and_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A log and later scores, both read off the event stream."""
    events = sample(spark, sf_dir, "events")
    log = events.where("event_id % 2 = 0").selectExpr(
        "event_id", "concat('run ', cast(user_id as string)) AS message",
        "value AS cv_score", "CASE WHEN event_id % 4 = 0 THEN '' ELSE '0.5' END AS public_score",
    )
    scores = events.where("event_id % 3 = 0").selectExpr(
        "event_id AS seq",
        "CASE WHEN user_id % 5 = 0 THEN '' ELSE concat('run ', cast(user_id as string)) END"
        " AS description",
        "cast(event_id % 1000 as string) AS public_score",
        "cast(event_id % 77 as string) AS private_score",
    )
    return log, scores


def _score_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, scores = _log_and_scores(spark, sf_dir)
    out = score_merge(log, scores, "seq")
    return published(out, "event_id", "message", "public_score", "private_score")


def _score_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, scores = _log_and_scores(spark, sf_dir)
    out = score_gap(score_merge(log, scores, "seq"))
    return published(out, "event_id", "message", "public_score", "private_score")


QUERIES = {
    "stratified_folds": _folds,
    "target_encode_fold": _te_fold,
    "target_encode_full": _te_full,
    "te_columns": _te_columns,
    "category_stats": _category_stats,
    "auc_exact": _auc,
    "auc_by_fold": _auc_by_fold,
    "roc_points": _roc,
    "threshold_table": _thresholds,
    "threshold_lookup": _threshold_lookup,
    "blend_2": _blend(2, bl.weights_2),
    "blend_3": _blend(3, bl.weights_3),
    "blend_4": _blend(4, bl.weights_4),
    "blend_grid": _grid_auc,
    "blend_scores": _blend_scores,
    "feature_importance": _feature_importance,
    "prune_features": _prune,
    "top_features": _top,
    "importance_by_group": _by_group,
    "class_weight": _weights,
    "sample_rows": _sample,
    "score_merge": _score_merge,
    "score_gap": _score_gap,
}
