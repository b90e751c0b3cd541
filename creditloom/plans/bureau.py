"""Credit-bureau features (``BUR_``) from credits and their monthly balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.aggregates import low, mean, rows, stats, subset, tally, top, total
from creditloom.functions.scalar import as_number, filled, flag, per, total_of
from creditloom.operators.grouped import FeatureGroup, roll_up
from creditloom.sources.schemas import APPLICANT, CREDIT

#: Monthly status codes: on time, five overdue classes, closed, unknown.
STATUS_CODES = ("0", "1", "2", "3", "4", "5", "C", "X")
OVERDUE_CODES = ("1", "2", "3", "4", "5")
#: Counted credit types by short name.
CREDIT_TYPES = {
    "CONSUMER": "Consumer credit",
    "CREDIT_CARD": "Credit card",
    "MORTGAGE": "Mortgage",
    "CAR_LOAN": "Car loan",
    "MICROLOAN": "Microloan",
}
CREDIT_STATES = {"ACTIVE": "Active", "CLOSED": "Closed", "BAD_DEBT": "Bad debt"}


def is_overdue() -> Column:
    return F.col("STATUS").isin(*OVERDUE_CODES)


def is_active() -> Column:
    return F.col("CREDIT_ACTIVE") == "Active"


def repaired(bureau: DataFrame) -> DataFrame:
    """Bureau with its instalment amount as a number."""
    return bureau.withColumn("AMT_ANNUITY", as_number("AMT_ANNUITY"))


def balance_group() -> FeatureGroup:
    """Per credit: months by status, overdue months, their recent share."""
    recent, late = F.col("MONTHS_BALANCE") >= -6, is_overdue()
    return FeatureGroup(
        aggregates=[
            rows().alias("BB_MONTHS_COUNT"),
            *tally("STATUS", {c: c for c in STATUS_CODES}, "BB_STATUS_{}_COUNT"),
            rows(late).alias("BB_DPD_MONTHS"),
            *stats("BB_MONTHS_BALANCE", "MONTHS_BALANCE", "MIN MAX"),
            rows(recent & late).alias("BB_RECENT_6M_DPD"),
            rows(recent).alias("BB_RECENT_6M_COUNT"),
        ],
        derived={
            "BB_DPD_RATE": per("BB_DPD_MONTHS", "BB_MONTHS_COUNT"),
            "BB_RECENT_6M_DPD_RATE": per("BB_RECENT_6M_DPD", "BB_RECENT_6M_COUNT"),
        },
    )


def balance_features(balance: DataFrame) -> DataFrame:
    return roll_up(balance, CREDIT, balance_group())


def credit_group() -> FeatureGroup:
    """Per applicant, over credits joined with their balance features."""
    year, two_years = F.col("DAYS_CREDIT") > -365, F.col("DAYS_CREDIT") > -730
    overdue, open_ = F.col("AMT_CREDIT_SUM_OVERDUE") > 0, is_active()
    amounts = [
        *stats("BUR_AMT_CREDIT", "AMT_CREDIT_SUM", "MEAN TOTAL MAX"),
        *stats("BUR_DEBT", "AMT_CREDIT_SUM_DEBT", "MEAN TOTAL MAX"),
        *stats("BUR_OVERDUE", "AMT_CREDIT_SUM_OVERDUE", "TOTAL MAX"),
        rows(overdue).alias("BUR_OVERDUE_COUNT"),
        *stats("BUR_CREDIT_LIMIT", "AMT_CREDIT_SUM_LIMIT", "MEAN"),
        top("AMT_CREDIT_MAX_OVERDUE").alias("BUR_MAX_OVERDUE_EVER"),
        *stats("BUR_MAX_OVERDUE", "AMT_CREDIT_MAX_OVERDUE", "MEAN"),
        *stats("BUR_ANNUITY", "AMT_ANNUITY", "TOTAL MEAN"),
    ]
    times = [
        top("DAYS_CREDIT").alias("BUR_MOST_RECENT_CREDIT_DAYS"),
        low("DAYS_CREDIT").alias("BUR_OLDEST_CREDIT_DAYS"),
        top("DAYS_CREDIT_ENDDATE").alias("BUR_LATEST_ENDDATE"),
        top("DAYS_CREDIT_UPDATE").alias("BUR_MOST_RECENT_UPDATE"),
        rows(year).alias("BUR_INQUIRIES_LAST_YEAR"),
    ]
    balances = [
        total("BB_DPD_MONTHS").alias("BUR_BB_DPD_MONTHS_TOTAL"),
        total("BB_MONTHS_COUNT").alias("BUR_BB_MONTHS_TOTAL"),
        *(total(f"BB_STATUS_{c}_COUNT").alias(f"BUR_BB_STATUS_{c}_TOTAL") for c in "CX"),
        *stats("BUR_BB_RECENT_6M_DPD", "BB_RECENT_6M_DPD", "TOTAL"),
        *stats("BUR_BB_DPD_RATE", "BB_DPD_RATE", "MEAN"),
        *stats("BUR_BB_RECENT_6M_DPD_RATE", "BB_RECENT_6M_DPD_RATE", "MEAN"),
    ]
    active = {
        "CREDIT": "AMT_CREDIT_SUM",
        "DEBT": "AMT_CREDIT_SUM_DEBT",
        "OVERDUE": "AMT_CREDIT_SUM_OVERDUE",
        "ANNUITY": "AMT_ANNUITY",
    }
    subsets = [
        *(
            subset(open_, total(source, open_)).alias(f"BUR_ACTIVE_{name}_TOTAL")
            for name, source in active.items()
        ),
        subset(year, rows(year)).alias("BUR_RECENT_1Y_COUNT"),
        mean("AMT_CREDIT_SUM", year).alias("BUR_RECENT_1Y_CREDIT_MEAN"),
        subset(year, total("AMT_CREDIT_SUM_OVERDUE", year)).alias("BUR_RECENT_1Y_OVERDUE"),
        subset(year, rows(year & open_)).alias("BUR_RECENT_1Y_ACTIVE"),
        subset(two_years, rows(two_years)).alias("BUR_RECENT_2Y_COUNT"),
        subset(two_years, total("AMT_CREDIT_SUM_DEBT", two_years)).alias("BUR_RECENT_2Y_DEBT"),
        subset(two_years, rows(two_years & overdue)).alias("BUR_RECENT_2Y_OVERDUE_COUNT"),
    ]
    kinds = [F.col(f"BUR_{short}_COUNT") for short in CREDIT_TYPES]
    return FeatureGroup(
        aggregates=[
            rows().alias("BUR_COUNT"),
            *tally("CREDIT_TYPE", CREDIT_TYPES, "BUR_{}_COUNT"),
            *tally("CREDIT_ACTIVE", CREDIT_STATES, "BUR_{}_COUNT"),
            *amounts,
            *times,
            *balances,
            *subsets,
        ],
        derived={
            "BUR_ACTIVE_RATIO": per("BUR_ACTIVE_COUNT", "BUR_COUNT"),
            "BUR_DEBT_TO_CREDIT_RATIO": per("BUR_DEBT_TOTAL", "BUR_AMT_CREDIT_TOTAL"),
            "BUR_OVERDUE_RATE": per("BUR_OVERDUE_COUNT", "BUR_COUNT"),
            "BUR_CREDIT_HISTORY_LENGTH": F.col("BUR_MOST_RECENT_CREDIT_DAYS")
            - F.col("BUR_OLDEST_CREDIT_DAYS"),
            "BUR_ACTIVE_DEBT_TO_CREDIT_RATIO": per(
                filled("BUR_ACTIVE_DEBT_TOTAL"), filled("BUR_ACTIVE_CREDIT_TOTAL")
            ),
            "BUR_CREDIT_TYPE_DIVERSITY": total_of(flag(kind > 0) for kind in kinds),
        },
    )


def credits_with_balances(bureau: DataFrame, balance: DataFrame) -> DataFrame:
    """Credits with the features of their monthly balances, where there are any."""
    return repaired(bureau).join(balance_features(balance), CREDIT, "left")


def bureau_features(bureau: DataFrame, balance: DataFrame) -> DataFrame:
    return roll_up(credits_with_balances(bureau, balance), APPLICANT, credit_group())
