"""Readers, narrowing, sinks and profiles over the derived tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.modeling.logs import append_run, append_submission, read_runs, read_submissions
from creditloom.operators.folds import stratified_folds
from creditloom.operators.grouped import count_values, rows_per_key
from creditloom.operators.metrics import auc_exact
from creditloom.operators.profiling import (
    SKETCH_ERROR, null_report, prefix_report, profile_all, profile_table, table_overview,
)
from creditloom.plans.application import application_features
from creditloom.plans.bureau import balance_features
from creditloom.plans.feature_table import PREFIXES
from creditloom.plans.history import pos_features
from creditloom.plans.hypotheses import experimental_winning
from creditloom.queries.common import Inputs, published, with_scores
from creditloom.session import scratch_dir
from creditloom.sources import tables as io
from creditloom.sources.mapped import NOT_EXPLORED
from creditloom.sources.schemas import APPLICANT, CREDIT, LOAN, TABLES

_BUREAU_TEXT = ("CREDIT_ACTIVE", "CREDIT_TYPE", "AMT_ANNUITY")


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bureau as a CSV file, read back with declared types."""
    folder = scratch_dir(spark)
    io.write_csv(Inputs(spark, sf_dir)["bureau"], f"{folder}/bureau.csv")
    return published(io.scan_table(spark, "bureau", folder), APPLICANT, CREDIT, *_BUREAU_TEXT)


def _load(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark)
    io.write_parquet(
        Inputs(spark, sf_dir)["installments_payments"], f"{folder}/installments_payments.parquet"
    )
    return published(io.load_table(spark, "installments_payments", folder), APPLICANT, LOAN)


def _loaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, inputs = scratch_dir(spark), Inputs(spark, sf_dir)
    for name in TABLES:
        io.write_parquet(inputs[name], f"{folder}/{name}.parquet")
    loaded = {name: load(spark, folder) for name, load in io.LOADERS.items()}
    return published(table_overview(loaded), "table", "n_rows", "n_columns")


def _partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = io.partial_read(Inputs(spark, sf_dir)["bureau"], [CREDIT, "DAYS_CREDIT"])
    return published(part, CREDIT, "DAYS_CREDIT")


def _partial_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and columns of partial reads of every table: all rows, seven of them, none."""
    parts = []
    for name, df in Inputs(spark, sf_dir).all().items():
        for rows in (None, 7, 0):
            part = io.partial_read(df, rows=rows)
            wanted = F.lit(-1 if rows is None else rows).alias("wanted")
            width = F.lit(len(part.columns)).cast("long").alias("n_columns")
            parts.append(part.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), wanted, "n_rows", width))
    return reduce(DataFrame.unionByName, parts)


def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = Inputs(spark, sf_dir)["bureau_balance"]
    kept = io.parquet_cache(
        spark, "balance_features", lambda: balance_features(balance), scratch_dir(spark)
    )
    return published(kept, CREDIT)


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = balance_features(Inputs(spark, sf_dir)["bureau_balance"])
    path = f"{scratch_dir(spark)}/balance_features"
    io.write_csv(features, path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in features.schema)
    return published(io.read_csv(spark, path, schema), CREDIT)


def _parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/pos_features"
    io.write_parquet(pos_features(Inputs(spark, sf_dir)["POS_CASH_balance"]), path)
    return published(spark.read.parquet(path), APPLICANT)


def _fold_scores(spark: SparkSession, sf_dir: str, score: str) -> list[float]:
    folds = stratified_folds(with_scores(Inputs(spark, sf_dir)["application_train"]))
    rows = auc_exact(folds, score, by=["fold"]).orderBy("fold").collect()  # one row per fold
    return [row["auc"] for row in rows]


def _run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/runs"
    for score in ("score_a", "score_b"):
        params = {"score": score}
        append_run(spark, path, score, _fold_scores(spark, sf_dir, score), 1, params)
    runs = read_runs(spark, path)
    kept = runs.select("name", "mean_auc", "std_auc", "n_features", "params")
    return published(kept, "name", "n_features", "params")


def _submission_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/submissions"
    scored = with_scores(Inputs(spark, sf_dir)["application_train"])
    for score in ("score_a", "score_b"):
        auc = auc_exact(scored, score).first()["auc"]
        append_submission(spark, path, f"blend, {score}", auc, 1)
    kept = read_submissions(spark, path).select("message", "cv_score", "n_features", "public_score")
    return published(kept, "message", "n_features", "public_score")


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile_table(Inputs(spark, sf_dir)["bureau"], "bureau").drop("dtype")
    return published(out, "table", "column", "n_rows", "n_unique")


def _profile_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile_all(Inputs(spark, sf_dir).all()).drop("dtype")
    return published(out, "table", "column", "n_rows", "n_unique")


def _estimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile by sketches, and whether its distinct counts are as near as they should be."""
    tables = Inputs(spark, sf_dir).all()
    keys = ["table", "column"]
    exact = profile_all(tables).select(*keys, F.col("n_unique").alias("_exact"))
    out = profile_all(tables, exact=False).drop("dtype").join(exact, keys)
    near = F.abs(F.col("n_unique") - F.col("_exact")) <= 4 * SKETCH_ERROR * F.col("_exact")
    kept = out.select(*keys, "n_rows", "null_pct", "min", "max", "mean", near.alias("near"))
    return published(kept, *keys, "n_rows", "near")


def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = io.type_report(Inputs(spark, sf_dir)["previous_application"], exact=True)
    return published(out, "column", "narrow_type", "n_unique")


def _overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(table_overview(Inputs(spark, sf_dir).all()), "table", "n_rows", "n_columns")


def _describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(rows_per_key(Inputs(spark, sf_dir)["bureau"], APPLICANT), "keys", "min", "max")


def _value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = count_values(Inputs(spark, sf_dir)["previous_application"], "PRODUCT_COMBINATION")
    return published(out.orderBy(F.col("n").desc(), "value"), "value", "n")


def _experimental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experimental_winning(Inputs(spark, sf_dir, shared=True, without=NOT_EXPLORED).all())


def _null_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(null_report(_experimental(spark, sf_dir), above=5.0), "column")


def _prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    app = application_features(Inputs(spark, sf_dir)["application_train"])
    return published(prefix_report(app, PREFIXES), "prefix", "n_columns")


QUERIES = {
    "scan_table": _scan,
    "load_table": _load,
    "named_loaders": _loaders,
    "narrow_types": _types,
    "partial_read": _partial,
    "partial_read_rows": _partial_rows,
    "parquet_cache": _cached,
    "write_csv": _csv,
    "write_parquet": _parquet,
    "run_log_append": _run_log,
    "submission_log_append": _submission_log,
    "profile_table": _profile,
    "profile_all": _profile_all,
    "profile_estimated": _estimated,
    "table_overview": _overview,
    "describe": _describe,
    "value_counts": _value_counts,
    "null_report": _null_report,
    "prefix_counts": _prefixes,
}
