"""Each relational operator on its own, over the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.functions import aggregates as agg
from creditloom.functions import scalar as sc
from creditloom.operators import grouped as g
from creditloom.operators import lookup as lk
from creditloom.operators import ordered as o
from creditloom.operators.folds import category_statistics
from creditloom.operators.profiling import null_shares
from creditloom.plans import bureau as b
from creditloom.plans import history as h
from creditloom.plans import hypotheses as hyp
from creditloom.plans.application import application_features
from creditloom.plans.feature_table import (
    ensure_columns, feature_columns, numeric_feature_columns,
)
from creditloom.queries.common import Inputs, published
from creditloom.sources.mapped import NOT_EXPLORED
from creditloom.sources.schemas import APPLICANT, CREDIT, LABEL, LOAN


def over(table: str, *keys: str):
    """Register ``build(df)`` over one derived table, published with ``keys`` exact."""
    def wrap(build):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return published(build(Inputs(spark, sf_dir)[table]), *keys)

        return query

    return wrap


def across(*keys: str, shared: bool = False, **form):
    """The same over several tables."""
    def wrap(build):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return published(build(Inputs(spark, sf_dir, shared, **form)), *keys)

        return query

    return wrap


# --- projections and predicates ---------------------------------------------


@over("installments_payments", APPLICANT, LOAN, "NUM_INSTALMENT_NUMBER")
def with_columns(df: DataFrame) -> DataFrame:
    return df.withColumns(h.instalment_rows()).select(
        APPLICANT, LOAN, "NUM_INSTALMENT_NUMBER", *h.instalment_rows()
    )


@over("previous_application", APPLICANT, LOAN, "NAME_CONTRACT_STATUS")
def select(df: DataFrame) -> DataFrame:
    return df.select(APPLICANT, LOAN, "NAME_CONTRACT_STATUS", "AMT_APPLICATION")


@over("POS_CASH_balance", APPLICANT, LOAN, "MONTHS_BALANCE", "SK_DPD")
def filter_(df: DataFrame) -> DataFrame:
    recent = F.col("MONTHS_BALANCE") >= -12
    return df.where((h.is_late() & recent) | F.col("CNT_INSTALMENT_FUTURE").isNull()).select(
        APPLICANT, LOAN, "MONTHS_BALANCE", "SK_DPD"
    )


@over("application_train", APPLICANT)
def case_when(df: DataFrame) -> DataFrame:
    return application_features(df).select(APPLICANT, "DAYS_EMPLOYED")


@over("application_train", APPLICANT)
def fill_null(df: DataFrame) -> DataFrame:
    names = ("AMT_ANNUITY", "CNT_FAM_MEMBERS", "EXT_SOURCE_1", "EXT_SOURCE_3")
    return df.select(APPLICANT, *(sc.filled(c, 0).alias(c) for c in names))


@over("application_train", APPLICANT)
def null_flags(df: DataFrame) -> DataFrame:
    names = ("EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "OCCUPATION_TYPE")
    return df.select(
        APPLICANT,
        *(sc.missing(c).alias(f"{c}_MISSING") for c in names),
        *(sc.present(c).alias(f"{c}_PRESENT") for c in names),
    )


@over("credit_card_balance", APPLICANT, LOAN, "MONTHS_BALANCE")
def is_between(df: DataFrame) -> DataFrame:
    paid = h.card_rows()["CC_PAYMENT_TO_MIN_RATIO"]
    return df.withColumn("ratio", paid).where(F.col("ratio").between(0.95, 1.05)).select(
        APPLICANT, LOAN, "MONTHS_BALANCE", "ratio"
    )


@over("bureau", APPLICANT, CREDIT, "CREDIT_TYPE", "CREDIT_ACTIVE")
def is_in(df: DataFrame) -> DataFrame:
    listed = F.col("CREDIT_TYPE").isin("Mortgage", "Car loan")
    return df.where(listed & F.col("CREDIT_ACTIVE").contains("os")).select(
        APPLICANT, CREDIT, "CREDIT_TYPE", "CREDIT_ACTIVE"
    )


def _filled_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """Column name and number of values, for queries about sets of columns."""
    cells = [F.struct(F.lit(c).alias("column"), F.count(F.col(c)).alias("n")) for c in names]
    return df.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))


@over("application_train", "column", "n")
def feature_columns_(df: DataFrame) -> DataFrame:
    return _filled_counts(df, feature_columns(df))


@over("application_train", "column", "n")
def numeric_feature_columns_(df: DataFrame) -> DataFrame:
    return _filled_counts(df, numeric_feature_columns(df))


@across("hypothesis", "column", shared=True, without=NOT_EXPLORED)
def hypothesis_columns(t: Inputs) -> DataFrame:
    wide = hyp.experimental_all(t.all())
    names = [
        F.struct(F.lit(family).alias("hypothesis"), F.lit(c).alias("column"))
        for family, columns in hyp.hypothesis_columns(wide).items()
        for c in columns
    ]
    listed = null_shares(wide).withColumn("_names", F.array(*names))
    return listed.select("column", "null_pct", F.inline("_names").alias("hypothesis", "_name")).where(
        F.col("column") == F.col("_name")
    ).drop("_name")


@over("application_test", APPLICANT)
def ensure_columns_(df: DataFrame) -> DataFrame:
    some = df.select(APPLICANT, "AMT_CREDIT", "EXT_SOURCE_2")
    return ensure_columns(some, ["AMT_CREDIT", "BUR_COUNT", "TE_ORGANIZATION_TYPE"])


@over("application_train", APPLICANT, LABEL)
def feature_matrix(df: DataFrame) -> DataFrame:
    """The numeric features as the learners see them, unpacked again from the vector."""
    from pyspark.ml.functions import vector_to_array

    from creditloom.modeling.matrix import assembled, column_fills

    names = ["AMT_CREDIT", "AMT_ANNUITY", "EXT_SOURCE_1", "EXT_SOURCE_3", "DAYS_BIRTH"]
    matrix = assembled(df, names, column_fills(df, names))
    values = vector_to_array("features")
    return matrix.select(APPLICANT, LABEL, *(values[i].alias(c) for i, c in enumerate(names)))


# --- joins ------------------------------------------------------------------


@across(APPLICANT)
def left_join_features(t: Inputs) -> DataFrame:
    parts = [h.pos_features(t["POS_CASH_balance"]), h.card_features(t["credit_card_balance"])]
    kept = [p.select(APPLICANT, c) for p, c in zip(parts, ("POS_COUNT", "CC_COUNT"))]
    return lk.join_features(t["application_train"].select(APPLICANT), kept, APPLICANT)


@over("bureau", APPLICANT)
def left_join_subsets(df: DataFrame) -> DataFrame:
    year = F.col("DAYS_CREDIT") > -365
    return df.groupBy(APPLICANT).agg(
        agg.rows().alias("n"),
        agg.subset(b.is_active(), agg.total("AMT_CREDIT_SUM", b.is_active())).alias("active_total"),
        agg.subset(year, agg.rows(year)).alias("year_n"),
        agg.mean("AMT_CREDIT_SUM", year).alias("year_mean"),
    )


@across(CREDIT, APPLICANT)
def left_join_child(t: Inputs) -> DataFrame:
    joined = b.credits_with_balances(t["bureau"], t["bureau_balance"])
    return joined.select(CREDIT, APPLICANT, "BB_MONTHS_COUNT", "BB_DPD_RATE")


@across(APPLICANT, CREDIT, "MONTHS_BALANCE", "STATUS")
def left_join_parent_key(t: Inputs) -> DataFrame:
    """Every monthly balance with its credit's applicant, null where there is no such credit."""
    owners = t["bureau"].select(CREDIT, APPLICANT)
    return t["bureau_balance"].join(owners, CREDIT, "left").select(
        APPLICANT, CREDIT, "MONTHS_BALANCE", "STATUS"
    )


@over("POS_CASH_balance", APPLICANT)
def inner_join_halves(df: DataFrame) -> DataFrame:
    return hyp.h2_pos(df)


@across(APPLICANT)
def full_join_features(t: Inputs) -> DataFrame:
    parts = [hyp.h3_pos(t["POS_CASH_balance"]), hyp.h3_bureau(t["bureau"])]
    return lk.outer_join_features(parts, APPLICANT)


@across(APPLICANT, "ORGANIZATION_TYPE", "n")
def left_join_encoding(t: Inputs) -> DataFrame:
    train = t["application_train"]
    stats = category_statistics(train, ["ORGANIZATION_TYPE"]).select(
        F.col("category").alias("ORGANIZATION_TYPE"), F.col("cat_count").alias("n"), "cat_mean"
    )
    rows = t["application_test"].select(APPLICANT, "ORGANIZATION_TYPE")
    return lk.lookup_join(rows, stats, ["ORGANIZATION_TYPE"])


@across(APPLICANT, LABEL)
def left_join_screening(t: Inputs) -> DataFrame:
    base = t["application_train"].select(APPLICANT, LABEL)
    return lk.join_features(base, [hyp.h5_credit_type(t["bureau"])], APPLICANT)


# --- aggregations -----------------------------------------------------------


@over("credit_card_balance", APPLICANT)
def group_agg(df: DataFrame) -> DataFrame:
    return df.groupBy(APPLICANT).agg(
        agg.rows().alias("n"),
        *agg.stats("balance", "AMT_BALANCE", "MEAN MAX"),
        agg.total("AMT_DRAWINGS_CURRENT").alias("drawn"),
    )


@over("previous_application", APPLICANT)
def agg_basic(df: DataFrame) -> DataFrame:
    return df.groupBy(APPLICANT).agg(
        agg.rows().alias("n_rows"),
        F.count("AMT_DOWN_PAYMENT").alias("n_values"),
        *agg.stats("down", "AMT_DOWN_PAYMENT", "SUM MEAN MIN MAX STD"),
    )


@over("previous_application", APPLICANT)
def agg_distinct_null(df: DataFrame) -> DataFrame:
    named = {"products": "PRODUCT_COMBINATION", "purposes": "NAME_CASH_LOAN_PURPOSE"}
    return g.distinct_counts(df, APPLICANT, named)


@over("installments_payments", APPLICANT)
def count_condition(df: DataFrame) -> DataFrame:
    late = h.instalment_rows()["INS_DAYS_DIFF"]
    return df.groupBy(APPLICANT).agg(
        agg.rows(late > 0).alias("late"), agg.rows(late < -15).alias("very_early")
    )


@over("previous_application", APPLICANT)
def rate_condition(df: DataFrame) -> DataFrame:
    return df.groupBy(APPLICANT).agg(
        agg.share(F.col("NAME_CLIENT_TYPE") == "Repeater").alias("repeater"),
        agg.share(F.col("NFLAG_INSURED_ON_APPROVAL") == 1).alias("insured"),
    )


@over("bureau_balance", CREDIT)
def status_counts(df: DataFrame) -> DataFrame:
    codes = {c: c for c in b.STATUS_CODES}
    return df.groupBy(CREDIT).agg(*agg.tally("STATUS", codes, "STATUS_{}"))


@over("installments_payments", APPLICANT)
def filtered_agg(df: DataFrame) -> DataFrame:
    missing = h.instalment_rows()["INS_UNDERPAYMENT"]
    return df.groupBy(APPLICANT).agg(*agg.stats("missing", missing, "MEAN MAX", missing > 0))


@over("POS_CASH_balance", APPLICANT)
def subset_agg(df: DataFrame) -> DataFrame:
    return df.where(F.col("MONTHS_BALANCE") >= -12).groupBy(APPLICANT).agg(
        *agg.stats("dpd", "SK_DPD", "MAX MEAN"), agg.rows(h.is_late()).alias("late")
    )


@across(APPLICANT)
def two_level_agg(t: Inputs) -> DataFrame:
    joined = b.credits_with_balances(t["bureau"], t["bureau_balance"])
    return joined.groupBy(APPLICANT).agg(
        agg.total("BB_DPD_MONTHS").alias("late_months"), agg.mean("BB_DPD_RATE").alias("late_rate")
    )


@over("installments_payments", APPLICANT)
def per_loan_variance(df: DataFrame) -> DataFrame:
    return hyp.h1_instalments(df)


@over("bureau", APPLICANT)
def per_category_agg(df: DataFrame) -> DataFrame:
    return hyp.h5_credit_type(df)


@over("installments_payments", APPLICANT)
def last_event(df: DataFrame) -> DataFrame:
    return hyp.h3_instalments(df)


@over("previous_application", APPLICANT)
def velocity(df: DataFrame) -> DataFrame:
    return hyp.velocity(
        df, "DAYS_DECISION", "H6_PREV_APPS_PER_YEAR", "H6_PREV_APPLICATION_ACCELERATION"
    )


# --- windows and order ------------------------------------------------------


def _ranked(df: DataFrame) -> DataFrame:
    return o.ranked(
        df.select(APPLICANT, LOAN, "MONTHS_BALANCE", "SK_DPD"),
        APPLICANT, "MONTHS_BALANCE", [LOAN, "SK_DPD"],
    )


@over("POS_CASH_balance", APPLICANT, LOAN, "MONTHS_BALANCE", "SK_DPD", "rank")
def ordinal_rank(df: DataFrame) -> DataFrame:
    return _ranked(df).select(
        APPLICANT, LOAN, "MONTHS_BALANCE", "SK_DPD", (F.col(o.RANK) + 1).alias("rank")
    )


@over("POS_CASH_balance", APPLICANT, LOAN, "MONTHS_BALANCE", "total")
def group_total(df: DataFrame) -> DataFrame:
    return _ranked(df).select(APPLICANT, LOAN, "MONTHS_BALANCE", F.col(o.SIZE).alias("total"))


@over("POS_CASH_balance", APPLICANT, LOAN, "MONTHS_BALANCE", "SK_DPD", "recent")
def split_half(df: DataFrame) -> DataFrame:
    halves = o.split_halves(
        df.select(APPLICANT, LOAN, "MONTHS_BALANCE", "SK_DPD"),
        APPLICANT, "MONTHS_BALANCE", [LOAN, "SK_DPD"],
    )
    return halves.select(
        APPLICANT, LOAN, "MONTHS_BALANCE", "SK_DPD", F.col(o.RECENT).alias("recent")
    )


@over("previous_application", APPLICANT, "DAYS_DECISION", "gap")
def lag_gap(df: DataFrame) -> DataFrame:
    return o.with_gaps(df.select(APPLICANT, "DAYS_DECISION"), APPLICANT, "DAYS_DECISION").where(
        F.col("gap").isNotNull()
    )


@over("installments_payments", APPLICANT, LOAN, "DAYS_INSTALMENT", "rn")
def last_n(df: DataFrame) -> DataFrame:
    rows = df.withColumns(h.instalment_rows())
    latest = o.last_rows(rows, APPLICANT, "DAYS_INSTALMENT", h.INSTALMENT_TIES, 12)
    return latest.select(APPLICANT, LOAN, "DAYS_INSTALMENT", "INS_PAYMENT_RATIO", "rn")


@over("bureau", APPLICANT, CREDIT, "DAYS_CREDIT")
def sort(df: DataFrame) -> DataFrame:
    order = (F.col("AMT_CREDIT_SUM_DEBT").desc_nulls_first(), APPLICANT, CREDIT)
    return df.select(APPLICANT, CREDIT, "DAYS_CREDIT", "AMT_CREDIT_SUM_DEBT").orderBy(*order)


@over("bureau", CREDIT)
def limit_head(df: DataFrame) -> DataFrame:
    known = df.where(F.col("AMT_CREDIT_SUM_DEBT").isNotNull())
    return known.orderBy(F.col("AMT_CREDIT_SUM_DEBT").desc(), CREDIT).select(
        CREDIT, "AMT_CREDIT_SUM_DEBT"
    ).limit(50)


# --- scalar functions -------------------------------------------------------


@over("application_train", APPLICANT)
def scalar_functions(df: DataFrame) -> DataFrame:
    """Arithmetic, powers, bounds, replacement, horizontal sums, casts, rounding."""
    age = sc.years_back("DAYS_BIRTH")
    return df.select(
        APPLICANT,
        age.alias("age"),
        (-F.col("AMT_CREDIT")).alias("negated"),
        F.pow(sc.filled("EXT_SOURCE_2"), F.lit(2)).alias("squared"),
        F.sqrt(F.col("AMT_INCOME_TOTAL")).alias("root"),
        F.abs(F.col("DAYS_REGISTRATION")).alias("absolute"),
        F.log1p(F.col("CNT_CHILDREN")).alias("logged"),
        sc.clipped(age, 30.0, 50.0).alias("clipped"),
        sc.ratio("DAYS_EMPLOYED", sc.nonzero("DAYS_BIRTH")).alias("replaced"),
        sc.filled_sum(["AMT_REQ_CREDIT_BUREAU_MON", "AMT_REQ_CREDIT_BUREAU_QRT"]).alias("summed"),
        F.col("AMT_CREDIT").cast("long").alias("whole"),
        F.round(sc.filled("EXT_SOURCE_3") * 7.3, 1).alias("rounded"),
    )


@over("bureau", CREDIT)
def try_cast(df: DataFrame) -> DataFrame:
    return b.repaired(df).select(CREDIT, "AMT_ANNUITY")


@over("bureau", CREDIT, "doc")
def json_text(df: DataFrame) -> DataFrame:
    doc = F.to_json(F.struct(F.col("CREDIT_TYPE").alias("type"), F.col("DAYS_CREDIT").alias("days")))
    return df.select(CREDIT, doc.alias("doc"))


QUERIES = {
    "with_columns": with_columns,
    "select": select,
    "filter": filter_,
    "case_when": case_when,
    "fill_null": fill_null,
    "null_flags": null_flags,
    "is_between": is_between,
    "is_in": is_in,
    "feature_columns": feature_columns_,
    "numeric_feature_columns": numeric_feature_columns_,
    "hypothesis_columns": hypothesis_columns,
    "ensure_columns": ensure_columns_,
    "feature_matrix": feature_matrix,
    "left_join_features": left_join_features,
    "left_join_subsets": left_join_subsets,
    "left_join_child": left_join_child,
    "left_join_parent_key": left_join_parent_key,
    "inner_join_halves": inner_join_halves,
    "full_join_features": full_join_features,
    "left_join_encoding": left_join_encoding,
    "left_join_screening": left_join_screening,
    "group_agg": group_agg,
    "agg_basic": agg_basic,
    "agg_distinct_null": agg_distinct_null,
    "count_condition": count_condition,
    "rate_condition": rate_condition,
    "status_counts": status_counts,
    "filtered_agg": filtered_agg,
    "subset_agg": subset_agg,
    "two_level_agg": two_level_agg,
    "per_loan_variance": per_loan_variance,
    "per_category_agg": per_category_agg,
    "last_event": last_event,
    "velocity": velocity,
    "ordinal_rank": ordinal_rank,
    "group_total": group_total,
    "split_half": split_half,
    "lag_gap": lag_gap,
    "last_n": last_n,
    "sort": sort,
    "limit_head": limit_head,
    "scalar_functions": scalar_functions,
    "try_cast": try_cast,
    "json_text": json_text,
}
