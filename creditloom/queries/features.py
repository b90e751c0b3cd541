"""Feature sets and the wide table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from creditloom.plans import application, bureau, history
from creditloom.plans import hypotheses as hyp
from creditloom.plans.feature_table import (
    CROSSED, PARTS, PREFIXES, build_feature_tables, feature_table,
)
from creditloom.queries.common import Inputs, published
from creditloom.session import in_threads, scratch_dir
from creditloom.sources.mapped import NOT_EXPLORED
from creditloom.sources.schemas import APPLICANT, CREDIT, LABEL
from creditloom.sources.tables import write_parquet


def engineered(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(tuple(PREFIXES))]


def _by_applicant(build, shared: bool = False, **form):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return published(build(Inputs(spark, sf_dir, shared, **form)), APPLICANT)

    return query


def _app(t: Inputs) -> DataFrame:
    out = application.application_features(t["application_train"])
    return out.select(APPLICANT, *engineered(out), "DAYS_EMPLOYED")


def _balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(bureau.balance_features(Inputs(spark, sf_dir)["bureau_balance"]), CREDIT)


def _wide(t: Inputs, part: str, only: tuple[str, ...] | None = None) -> DataFrame:
    out = feature_table(t[f"application_{part}"], t.all(), only)
    label = [LABEL] if LABEL in out.columns else []
    return out.select(APPLICANT, *label, *engineered(out), "DAYS_EMPLOYED")


def _five(t: Inputs) -> list[DataFrame]:
    return [t[n] for n in ("installments_payments", "bureau_balance", "bureau",
                           "POS_CASH_balance", "credit_card_balance")]


def _pipeline(part: str):
    """From table files to the two written feature tables, of which one is returned."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = scratch_dir(spark)
        tables = Inputs(spark, sf_dir, shared=True, dealt=False).all()
        in_threads(spark, [
            lambda n=n, table=table: write_parquet(table, f"{folder}/data/{n}.parquet")
            for n, table in tables.items()
        ], PARTS)
        train, test = build_feature_tables(spark, f"{folder}/data", f"{folder}/features")
        out = train if part == "train" else test
        label = [LABEL] if part == "train" else []
        return published(out.select(APPLICANT, *label, *engineered(out), "DAYS_EMPLOYED"), APPLICANT)

    return query


QUERIES = {
    "app_features": _by_applicant(_app),
    "bureau_balance_features": _balance,
    "bureau_features": _by_applicant(
        lambda t: bureau.bureau_features(t["bureau"], t["bureau_balance"])
    ),
    "previous_features": _by_applicant(
        lambda t: history.previous_features(t["previous_application"])
    ),
    "installment_features": _by_applicant(
        lambda t: history.instalment_features(t["installments_payments"]), shared=True
    ),
    "pos_features": _by_applicant(lambda t: history.pos_features(t["POS_CASH_balance"])),
    "card_features": _by_applicant(lambda t: history.card_features(t["credit_card_balance"])),
    "h1_variance": _by_applicant(
        lambda t: hyp.h1_variance(
            t["installments_payments"], t["credit_card_balance"], t["POS_CASH_balance"]
        )
    ),
    "h2_trajectory": _by_applicant(lambda t: hyp.h2_trajectory(*_five(t)), shared=True),
    "h3_recency": _by_applicant(lambda t: hyp.h3_recency(*_five(t))),
    "h4_untapped": _by_applicant(
        lambda t: hyp.h4_untapped(t["bureau"], t["previous_application"])
    ),
    "h5_credit_type": _by_applicant(lambda t: hyp.h5_credit_type(t["bureau"])),
    "h6_velocity": _by_applicant(
        lambda t: hyp.h6_velocity(t["previous_application"], t["bureau"])
    ),
    "experimental_all": _by_applicant(
        lambda t: hyp.experimental_all(t.all()), shared=True, without=NOT_EXPLORED
    ),
    "experimental_winning": _by_applicant(
        lambda t: hyp.experimental_winning(t.all()), shared=True, without=NOT_EXPLORED
    ),
    "cross_features": _by_applicant(
        lambda t: (w := _wide(t, "train", CROSSED)).select(
            APPLICANT, *(c for c in w.columns if c.startswith("CROSS_"))
        ),
        shared=True, dealt=False,
    ),
    "feature_table_train": _by_applicant(lambda t: _wide(t, "train"), shared=True),
    "feature_table_test": _by_applicant(lambda t: _wide(t, "test"), shared=True),
    "feature_pipeline": _pipeline("train"),
    "feature_pipeline_test": _pipeline("test"),
}
