"""The wide feature table: one row per applicant with every feature set joined."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.functions.aggregates import top
from creditloom.operators.grouped import FeatureGroup, roll_up
from creditloom.operators.lookup import is_small, join_features
from creditloom.plans import bureau as b
from creditloom.plans import history as h
from creditloom.plans import hypotheses as hyp
from creditloom.plans.application import application_features
from creditloom.plans.cross import cross_features
from creditloom.session import in_threads, scratch_dir
from creditloom.sources.bucketed import bucketed_cache, fingerprint
from creditloom.sources.schemas import APPLICANT, LABEL, TABLES
from creditloom.sources.tables import scan_table, table_path

#: Name prefixes of the engineered columns.
PREFIXES = ["APP_", "BUR_", "PREV_", "INS_", "POS_", "CC_", "H1_", "H2_", "H3_", "H4_", "H5_",
            "H6_", "CROSS_"]


def _events(conditions: dict[str, tuple[Column, str]]) -> FeatureGroup:
    """Last-event columns as part of a grouped pass."""
    return FeatureGroup(aggregates=[top(t, cond).alias(n) for n, (cond, t) in conditions.items()])


def supplements(tables: dict[str, DataFrame]) -> dict[str, Callable[[], DataFrame]]:
    """The per-applicant tables shared by training and test rows.

    Feature families over the same table are computed in the same grouped pass:
    bureau with H4 and H5, earlier applications with H4, and the last bad event
    (H3) with its source table.  Joined to applicants this equals building every
    family on its own.
    """
    days = F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")
    month = "MONTHS_BALANCE"
    bureau, balance = tables["bureau"], tables["bureau_balance"]
    previous, instalments = tables["previous_application"], tables["installments_payments"]
    pos, card = tables["POS_CASH_balance"], tables["credit_card_balance"]
    h3_ins = _events({
        "H3_DAYS_SINCE_LAST_LATE_INS": (days > 0, "DAYS_INSTALMENT"),
        "H3_DAYS_SINCE_LAST_SEVERE_LATE_INS": (days > 30, "DAYS_INSTALMENT"),
    })
    h3_bureau = _events({
        "H3_DAYS_SINCE_LAST_BUREAU_OVERDUE": (F.col("CREDIT_DAY_OVERDUE") > 0, "DAYS_CREDIT"),
    })
    h3_pos = _events({
        "H3_MONTHS_SINCE_LAST_POS_DPD": (h.is_late(), month),
        "H3_MONTHS_SINCE_LAST_POS_DPD_DEF": (h.is_late_tolerant(), month),
    })
    h3_card = _events({
        "H3_MONTHS_SINCE_LAST_CC_DPD": (h.is_late(), month),
        "H3_MONTHS_SINCE_LAST_HIGH_CC_UTIL": (h.is_high_use(), month),
    })
    return {
        "bureau": lambda: roll_up(
            b.credits_with_balances(bureau, balance), APPLICANT,
            b.credit_group(), hyp.h4_bureau_group(), hyp.h5_group(), h3_bureau,
        ),
        "previous": lambda: roll_up(
            previous, APPLICANT, h.previous_group(), hyp.h4_previous_group()
        ),
        "instalments": lambda: h.instalment_features(instalments, h3_ins),
        "pos": lambda: roll_up(pos, APPLICANT, h.pos_group(), h3_pos),
        "card": lambda: roll_up(card, APPLICANT, h.card_group(), h3_card),
        "balance_events": lambda: hyp.h3_balances(balance, bureau),
        "instalment_halves": lambda: hyp.h2_instalments(instalments),
        "balance_halves": lambda: hyp.h2_balances(balance, bureau),
        "pos_halves": lambda: hyp.h2_pos(pos),
        "card_halves": lambda: hyp.h2_cards(card),
    }


#: The input tables of each supplement.
SUPPLEMENT_SOURCES = {
    "bureau": ["bureau", "bureau_balance"],
    "previous": ["previous_application"],
    "instalments": ["installments_payments"],
    "pos": ["POS_CASH_balance"],
    "card": ["credit_card_balance"],
    "balance_events": ["bureau", "bureau_balance"],
    "instalment_halves": ["installments_payments"],
    "balance_halves": ["bureau", "bureau_balance"],
    "pos_halves": ["POS_CASH_balance"],
    "card_halves": ["credit_card_balance"],
}


#: Applicants up to which their keys are sent to every executor (some 30 MB).
KEYS = 2_000_000


def of_applicants(tables: dict[str, DataFrame], app: DataFrame, most: int = KEYS) -> dict[str, DataFrame]:
    """The history tables without the rows of other applicants, if there are at most ``most``.

    A test set is a small part of all applicants: the others' rows would be moved and
    grouped only to meet nobody in the end.  Beyond ``most`` the tables stay as they are.
    """
    keys = app.select(APPLICANT)
    if not is_small(keys, most):
        return tables
    keys = F.broadcast(keys)
    return {
        name: table.join(keys, APPLICANT, "left_semi") if APPLICANT in table.columns else table
        for name, table in tables.items()
    }


#: The supplements that have inputs of the interactions.
CROSSED = ("bureau", "previous", "instalments", "pos", "card")


#: Parts of a feature table that are planned, or built and written, at a time.
PARTS = 4


def feature_table(
    app: DataFrame, tables: dict[str, DataFrame], only: Iterable[str] | None = None
) -> DataFrame:
    """Applicants with all 304 engineered columns, as one plan, or those of ``only`` some supplements.

    Parts that look for large keys first start a counting job, hence the threads.
    """
    scratch_dir(app.sparkSession)
    tables = of_applicants(tables, app)
    builds = supplements(tables)
    parts = in_threads(app.sparkSession, [builds[n] for n in only or builds], PARTS)
    return cross_features(join_features(application_features(app), parts, APPLICANT))


def build_feature_tables(
    spark: SparkSession, data_dir: str, out_dir: str, overwrite: bool = False, buckets: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Training and test feature tables, every part written to ``out_dir``.

    All parts have a row per applicant and are bucketed by applicant, so the
    final joins read them in place: no exchange, and no sort beyond the files'
    own order.  The shared parts are built once for both tables.  A part is built
    again when one of the files it is made of changes, or with ``overwrite``.  Parts
    are built ``PARTS`` at a time: one by one, the last tasks of each and its
    planning leave cores idle.
    """
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables = {name: scan_table(spark, name, data_dir) for name in TABLES}
    marks = {name: fingerprint(spark, [table_path(spark, name, data_dir)]) for name in TABLES}
    run = uuid.uuid4().hex if overwrite else ""

    def kept(name: str, build: Callable[[], DataFrame], sources: Iterable[str]) -> DataFrame:
        mark = hashlib.sha256("".join([run, *(marks[s] for s in sorted(sources))]).encode()).hexdigest()
        return bucketed_cache(spark, name, build, out_dir, mark, APPLICANT, buckets)

    applicants = ["application_train", "application_test"]
    shared_tables = set(TABLES) - set(applicants)
    scratch_dir(spark)  # names the checkpoint folder before threads start
    wanted = [
        lambda n=n, build=build: kept(f"features_{n}", build, SUPPLEMENT_SOURCES[n])
        for n, build in supplements(tables).items()
    ]
    wanted += [lambda n=n: kept(n, lambda: application_features(tables[n]), [n]) for n in applicants]
    *shared, app_train, app_test = in_threads(spark, wanted, PARTS)

    def final(app: DataFrame, part: str) -> DataFrame:
        # sorted buckets meet: a broadcast would send whole feature tables around
        parts = [features.hint("merge") for features in shared]
        return kept(
            f"{part}_final", lambda: cross_features(join_features(app, parts, APPLICANT)),
            [f"application_{part}", *shared_tables],
        )

    both = [lambda: final(app_train, "train"), lambda: final(app_test, "test")]
    train, test = in_threads(spark, both, PARTS)
    return train, test


def feature_columns(df: DataFrame) -> list[str]:
    """All columns but the key and the label."""
    return [c for c in df.columns if c not in (APPLICANT, LABEL)]


def numeric_feature_columns(df: DataFrame) -> list[str]:
    """The feature columns a model can take as they are."""
    types = {f.name: f.dataType for f in df.schema}
    return [c for c in feature_columns(df) if isinstance(types[c], T.NumericType)]


def ensure_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Add the columns a model knows but ``df`` lacks, as zeros."""
    return df.withColumns({c: F.lit(0.0) for c in wanted if c not in df.columns})
