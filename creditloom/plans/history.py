"""Earlier applications, instalments, POS/cash loans and credit cards per applicant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.aggregates import low, mean, rows, stats, subset, tally, top, total
from creditloom.functions.scalar import filled, per
from creditloom.operators.grouped import FeatureGroup, roll_up
from creditloom.operators.ordered import last_rows
from creditloom.sources.schemas import APPLICANT, LOAN

# --- earlier applications ---------------------------------------------------

#: Day offsets averaged as they are, placeholder days included.
_LOAN_DAYS = {
    "FIRST_DRAWING": "DAYS_FIRST_DRAWING",
    "FIRST_DUE": "DAYS_FIRST_DUE",
    "LAST_DUE": "DAYS_LAST_DUE_1ST_VERSION",
    "TERMINATION": "DAYS_TERMINATION",
}


def previous_group() -> FeatureGroup:
    year = F.col("DAYS_DECISION") > -365
    approved = F.col("NAME_CONTRACT_STATUS") == "Approved"
    refused = F.col("NAME_CONTRACT_STATUS") == "Refused"
    status = {"APPROVED": "Approved", "REFUSED": "Refused", "CANCELED": "Canceled"}
    return FeatureGroup(
        aggregates=[
            rows().alias("PREV_COUNT"),
            *tally("NAME_CONTRACT_STATUS", status, "PREV_{}_COUNT"),
            *tally(
                "NAME_CONTRACT_TYPE",
                {"CASH_LOAN": "Cash loans", "REVOLVING": "Revolving loans"},
                "PREV_{}_COUNT",
            ),
            *tally("NAME_YIELD_GROUP", {"HIGH": "high", "LOW": "low_normal"}, "PREV_{}_YIELD_COUNT"),
            *tally(
                "WEEKDAY_APPR_PROCESS_START",
                {"WEEKEND": "SATURDAY", "SUNDAY": "SUNDAY"},  # "weekend" is Saturday alone
                "PREV_{}_APP_COUNT",
            ),
            rows(F.col("NFLAG_INSURED_ON_APPROVAL") == 1).alias("PREV_INSURED_COUNT"),
            *stats("PREV_AMT_APPLICATION", "AMT_APPLICATION", "MEAN MAX TOTAL"),
            *stats("PREV_AMT_CREDIT", "AMT_CREDIT", "MEAN TOTAL"),
            *stats("PREV_APP_CREDIT_DIFF", F.col("AMT_APPLICATION") - F.col("AMT_CREDIT"), "MEAN"),
            *stats("PREV_ANNUITY", "AMT_ANNUITY", "MEAN MAX"),
            *stats("PREV_DOWN_PAYMENT", "AMT_DOWN_PAYMENT", "MEAN MAX"),
            *stats("PREV_PAYMENT_TERM", "CNT_PAYMENT", "MEAN MAX"),
            top("DAYS_DECISION").alias("PREV_MOST_RECENT_DECISION"),
            low("DAYS_DECISION").alias("PREV_OLDEST_DECISION"),
            *(mean(c).alias(f"PREV_DAYS_{name}_MEAN") for name, c in _LOAN_DAYS.items()),
            *stats("PREV_APPROVED_CREDIT", "AMT_CREDIT", "MEAN MAX", approved),
            *stats("PREV_APPROVED_ANNUITY", "AMT_ANNUITY", "MEAN", approved),
            *stats("PREV_APPROVED_DOWN_PAYMENT", "AMT_DOWN_PAYMENT", "MEAN", approved),
            top("DAYS_DECISION", approved).alias("PREV_LAST_APPROVED_DAYS"),
            *stats("PREV_REFUSED_AMT", "AMT_APPLICATION", "MEAN", refused),
            top("DAYS_DECISION", refused).alias("PREV_LAST_REFUSED_DAYS"),
            subset(year, rows(year)).alias("PREV_RECENT_1Y_COUNT"),
            subset(year, rows(year & approved)).alias("PREV_RECENT_1Y_APPROVED"),
            subset(year, rows(year & refused)).alias("PREV_RECENT_1Y_REFUSED"),
        ],
        distinct={
            "PREV_PRODUCT_VARIETY": "PRODUCT_COMBINATION",
            "PREV_CHANNEL_VARIETY": "CHANNEL_TYPE",
        },
        derived={
            "PREV_APPROVAL_RATE": per("PREV_APPROVED_COUNT", "PREV_COUNT"),
            "PREV_REFUSAL_RATE": per("PREV_REFUSED_COUNT", "PREV_COUNT"),
            "PREV_CASH_LOAN_RATIO": per("PREV_CASH_LOAN_COUNT", "PREV_COUNT"),
            "PREV_HISTORY_SPAN": F.col("PREV_MOST_RECENT_DECISION") - F.col("PREV_OLDEST_DECISION"),
            "PREV_RECENT_1Y_APPROVAL_RATE": per(
                filled("PREV_RECENT_1Y_APPROVED", 0), filled("PREV_RECENT_1Y_COUNT", 0)
            ),
        },
    )


def previous_features(previous: DataFrame) -> DataFrame:
    return roll_up(previous, APPLICANT, previous_group())


# --- instalments ------------------------------------------------------------

#: Order of instalments due on the same day.
INSTALMENT_TIES = [LOAN, "NUM_INSTALMENT_NUMBER", "INS_DAYS_DIFF", "INS_PAYMENT_RATIO"]
_LAST = 12


def instalment_rows() -> dict[str, Column]:
    """Row-wise measures: days late, part paid, amount missing."""
    return {
        "INS_DAYS_DIFF": F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT"),
        "INS_PAYMENT_RATIO": per("AMT_PAYMENT", "AMT_INSTALMENT"),
        "INS_UNDERPAYMENT": F.col("AMT_INSTALMENT") - F.col("AMT_PAYMENT"),
    }


def instalment_group() -> FeatureGroup:
    late, missing_amount = F.col("INS_DAYS_DIFF"), F.col("INS_UNDERPAYMENT")
    limits = {
        "LATE": late > 0,
        "LATE_7DAYS": late > 7,
        "LATE_30DAYS": late > 30,
        "EARLY": late < 0,
        "VERY_EARLY": late < -15,
        "UNDERPAYMENT": missing_amount > 0,
    }
    return FeatureGroup(
        rows=instalment_rows(),
        aggregates=[
            rows().alias("INS_COUNT"),
            *stats("INS_DAYS_DIFF", "INS_DAYS_DIFF", "MEAN MAX STD"),
            *stats("INS_PAYMENT_RATIO", "INS_PAYMENT_RATIO", "MEAN MIN STD"),
            *stats("INS_UNDERPAYMENT", missing_amount, "MEAN MAX", missing_amount > 0),
            *(rows(limit).alias(f"INS_{name}_COUNT") for name, limit in limits.items()),
            total("AMT_INSTALMENT").alias("INS_TOTAL_EXPECTED"),
            total("AMT_PAYMENT").alias("INS_TOTAL_PAID"),
            top("NUM_INSTALMENT_VERSION").alias("INS_MAX_VERSION"),
        ],
        distinct={"INS_NUM_PREV_LOANS": LOAN, "INS_VERSION_VARIETY": "NUM_INSTALMENT_VERSION"},
        derived={
            "INS_LATE_RATE": per("INS_LATE_COUNT", "INS_COUNT"),
            "INS_OVERALL_PAYMENT_RATIO": per("INS_TOTAL_PAID", "INS_TOTAL_EXPECTED"),
            "INS_AVG_PER_LOAN": per("INS_COUNT", "INS_NUM_PREV_LOANS"),
        },
    )


def recent_instalments(instalments: DataFrame) -> DataFrame:
    """Lateness and payment over each applicant's latest twelve instalments."""
    latest = last_rows(
        instalments.withColumns(instalment_rows()), APPLICANT, "DAYS_INSTALMENT", INSTALMENT_TIES, _LAST
    )
    newest = F.col("rn") == 1
    late = F.col("INS_DAYS_DIFF")
    prefix = f"INS_RECENT_{_LAST}"
    return latest.groupBy(APPLICANT).agg(
        *stats(f"{prefix}_DAYS_DIFF", late, "MEAN STD"),
        rows(late > 0).alias(f"{prefix}_LATE_COUNT"),
        rows(late > 30).alias(f"{prefix}_LATE_30_COUNT"),
        mean("INS_PAYMENT_RATIO").alias(f"{prefix}_PAYMENT_RATIO"),
        low("INS_PAYMENT_RATIO").alias(f"{prefix}_PAYMENT_RATIO_MIN"),
        top(late, newest).alias("INS_LAST_DAYS_DIFF"),
        top("INS_PAYMENT_RATIO", newest).alias("INS_LAST_PAYMENT_RATIO"),
        (rows(late > 0) / F.lit(float(_LAST))).alias(f"{prefix}_LATE_RATE"),
    )


def instalment_features(instalments: DataFrame, *more: FeatureGroup) -> DataFrame:
    whole = roll_up(instalments, APPLICANT, instalment_group(), *more)
    return whole.join(recent_instalments(instalments), APPLICANT, "left")


# --- POS and cash loans -----------------------------------------------------


def is_late() -> Column:
    """Days past due."""
    return F.col("SK_DPD") > 0


def is_late_tolerant() -> Column:
    """Days past due, small debts ignored."""
    return F.col("SK_DPD_DEF") > 0


def _since(months: int) -> Column:
    return F.col("MONTHS_BALANCE") >= -months


def pos_group() -> FeatureGroup:
    half, year = _since(6), _since(12)
    active = F.col("NAME_CONTRACT_STATUS") == "Active"
    states = {"ACTIVE": "Active", "COMPLETED": "Completed", "SIGNED": "Signed"}
    return FeatureGroup(
        aggregates=[
            rows().alias("POS_COUNT"),
            *stats("POS_DPD", "SK_DPD", "MEAN MAX SUM"),
            rows(is_late()).alias("POS_DPD_MONTHS_COUNT"),
            *stats("POS_DPD_DEF", "SK_DPD_DEF", "MEAN MAX"),
            rows(is_late_tolerant()).alias("POS_DPD_DEF_COUNT"),
            *tally("NAME_CONTRACT_STATUS", states, "POS_{}_MONTHS"),
            top("CNT_INSTALMENT").alias("POS_MAX_INSTALMENTS"),
            *stats("POS_REMAINING_INSTALMENTS", "CNT_INSTALMENT_FUTURE", "MEAN MAX"),
            *stats("POS_MONTHS_BALANCE", "MONTHS_BALANCE", "MIN"),
            *stats("POS_RECENT_6M_DPD", "SK_DPD", "MAX MEAN", half),
            subset(half, rows(half & is_late())).alias("POS_RECENT_6M_DPD_COUNT"),
            subset(half, rows(half & active)).alias("POS_RECENT_6M_ACTIVE"),
            *stats("POS_RECENT_12M_DPD", "SK_DPD", "MAX", year),
            subset(year, rows(year & is_late())).alias("POS_RECENT_12M_DPD_COUNT"),
            subset(year, rows(year & is_late_tolerant())).alias("POS_RECENT_12M_DPD_DEF_COUNT"),
        ],
        distinct={"POS_NUM_LOANS": LOAN},
        derived={
            "POS_DPD_RATE": per("POS_DPD_MONTHS_COUNT", "POS_COUNT"),
            "POS_COMPLETION_RATE": per("POS_COMPLETED_MONTHS", "POS_COUNT"),
            "POS_AVG_MONTHS_PER_LOAN": per("POS_COUNT", "POS_NUM_LOANS"),
            "POS_RECENT_6M_DPD_RATE": filled("POS_RECENT_6M_DPD_COUNT", 0) / 6.0,
        },
    )


def pos_features(pos: DataFrame) -> DataFrame:
    return roll_up(pos, APPLICANT, pos_group())


# --- credit cards -----------------------------------------------------------


def card_rows() -> dict[str, Column]:
    """Row-wise measures against the limit or the minimum payment."""
    return {
        "CC_UTILIZATION": per("AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL"),
        "CC_PAYMENT_TO_MIN_RATIO": per("AMT_PAYMENT_CURRENT", "AMT_INST_MIN_REGULARITY"),
        "CC_DRAWING_RATIO": per("AMT_DRAWINGS_CURRENT", "AMT_CREDIT_LIMIT_ACTUAL"),
    }


def is_high_use() -> Column:
    return F.col("CC_UTILIZATION") > 0.9


def card_group() -> FeatureGroup:
    quarter, year = _since(3), _since(12)
    minimum_paid = F.col("CC_PAYMENT_TO_MIN_RATIO").between(0.95, 1.05)
    return FeatureGroup(
        rows=card_rows(),
        aggregates=[
            rows().alias("CC_COUNT"),
            *stats("CC_UTILIZATION", "CC_UTILIZATION", "MEAN MAX STD"),
            rows(is_high_use()).alias("CC_HIGH_UTIL_MONTHS"),
            *stats("CC_BALANCE", "AMT_BALANCE", "MEAN MAX"),
            *stats("CC_PAYMENT_TO_MIN", "CC_PAYMENT_TO_MIN_RATIO", "MEAN MIN"),
            rows(minimum_paid).alias("CC_MIN_PAYMENT_MONTHS"),
            *stats("CC_DRAWINGS", "AMT_DRAWINGS_CURRENT", "MEAN MAX TOTAL"),
            *stats("CC_DRAWING_RATIO", "CC_DRAWING_RATIO", "MEAN"),
            *stats("CC_ATM_DRAWINGS", "AMT_DRAWINGS_ATM_CURRENT", "TOTAL MEAN"),
            total("CNT_DRAWINGS_ATM_CURRENT").alias("CC_ATM_DRAWINGS_COUNT"),
            *stats("CC_POS_DRAWINGS", "AMT_DRAWINGS_POS_CURRENT", "TOTAL"),
            *stats("CC_DPD", "SK_DPD", "MEAN MAX"),
            rows(is_late()).alias("CC_DPD_MONTHS"),
            *stats("CC_DPD_DEF", "SK_DPD_DEF", "MAX"),
            *stats("CC_CREDIT_LIMIT", "AMT_CREDIT_LIMIT_ACTUAL", "MAX MEAN"),
            *stats("CC_RECEIVABLE", "AMT_RECEIVABLE_PRINCIPAL", "MEAN"),
            *stats("CC_TOTAL_RECEIVABLE", "AMT_TOTAL_RECEIVABLE", "MEAN"),
            *stats("CC_MONTHS_BALANCE", "MONTHS_BALANCE", "MIN"),
            *tally("NAME_CONTRACT_STATUS", {"ACTIVE": "Active"}, "CC_{}_MONTHS"),
            *stats("CC_RECENT_3M_UTIL", "CC_UTILIZATION", "MEAN", quarter),
            *stats("CC_RECENT_3M_BALANCE", "AMT_BALANCE", "MEAN", quarter),
            *stats("CC_RECENT_3M_DPD", "SK_DPD", "MAX", quarter),
            mean("CC_PAYMENT_TO_MIN_RATIO", quarter).alias("CC_RECENT_3M_PAY_MIN_RATIO"),
            *stats("CC_RECENT_12M_UTIL", "CC_UTILIZATION", "MEAN", year),
            subset(year, rows(year & is_high_use())).alias("CC_RECENT_12M_HIGH_UTIL_MONTHS"),
            subset(year, rows(year & is_late())).alias("CC_RECENT_12M_DPD_COUNT"),
            subset(year, total("AMT_DRAWINGS_ATM_CURRENT", year)).alias("CC_RECENT_12M_ATM_TOTAL"),
        ],
        distinct={"CC_NUM_CARDS": LOAN},
        derived={
            "CC_DPD_RATE": per("CC_DPD_MONTHS", "CC_COUNT"),
            "CC_ATM_DRAWING_SHARE": per("CC_ATM_DRAWINGS_TOTAL", "CC_DRAWINGS_TOTAL"),
            "CC_HIGH_UTIL_RATE": per("CC_HIGH_UTIL_MONTHS", "CC_COUNT"),
            "CC_AVG_MONTHS_PER_CARD": per("CC_COUNT", "CC_NUM_CARDS"),
            **{
                f"CC_UTIL_TREND_{m}M": filled(f"CC_RECENT_{m}M_UTIL_MEAN")
                - filled("CC_UTILIZATION_MEAN")
                for m in (3, 12)
            },
        },
    )


def card_features(card: DataFrame) -> DataFrame:
    return roll_up(card, APPLICANT, card_group())
