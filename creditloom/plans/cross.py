"""Interactions between the applicant row and the joined feature sets (``CROSS_``)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.scalar import clipped, filled, missing, per, total_of, years_back


@dataclass(frozen=True)
class Interaction:
    """A column built from ``inputs``.

    It is left out when an input is absent.  With ``at_least`` set, ``build`` is
    a part made per input, the present parts are added up, and at least that
    many must be present.
    """

    inputs: tuple[str, ...]
    build: Callable[..., Column]
    at_least: int | None = None

    def over(self, columns: set[str]) -> Column | None:
        if self.at_least is None:
            return self.build() if columns.issuperset(self.inputs) else None
        present = [c for c in self.inputs if c in columns]
        return total_of(map(self.build, present)) if len(present) >= self.at_least else None


def _recent_part(name: str) -> Column:
    """Recent lateness as a rate; the card input is a count over twelve months."""
    return filled(name) / 12.0 if name.endswith("_COUNT") else filled(name)


def interactions() -> dict[str, Interaction]:
    income, credit = "AMT_INCOME_TOTAL", F.col("AMT_CREDIT")
    years_employed = clipped(years_back(filled("DAYS_EMPLOYED", 0)), low=0.0, high=50.0)
    return {
        "EXISTING_DEBT_TO_NEW_CREDIT": Interaction(
            ("BUR_DEBT_TOTAL", "AMT_CREDIT"), lambda: per(filled("BUR_DEBT_TOTAL"), credit)
        ),
        "TOTAL_CREDIT_TO_INCOME": Interaction(
            ("BUR_AMT_CREDIT_TOTAL", income),
            lambda: per(filled("BUR_AMT_CREDIT_TOTAL") + credit, income),
        ),
        "TOTAL_ANNUITY_TO_INCOME": Interaction(
            ("BUR_ACTIVE_ANNUITY_TOTAL", "AMT_ANNUITY"),
            lambda: per(filled("BUR_ACTIVE_ANNUITY_TOTAL") + filled("AMT_ANNUITY"), income),
        ),
        "ACTIVE_DEBT_TO_INCOME": Interaction(
            ("BUR_ACTIVE_DEBT_TOTAL", income), lambda: per(filled("BUR_ACTIVE_DEBT_TOTAL"), income)
        ),
        "REFUSAL_RATE_x_CREDIT": Interaction(
            ("PREV_REFUSAL_RATE",), lambda: filled("PREV_REFUSAL_RATE") * credit
        ),
        "CREDIT_VS_PREV_APPROVED": Interaction(
            ("PREV_APPROVED_CREDIT_MEAN",), lambda: per(credit, filled("PREV_APPROVED_CREDIT_MEAN"))
        ),
        "EXT2_x_LATE_RATE": Interaction(
            ("INS_LATE_RATE", "EXT_SOURCE_2"),
            lambda: filled("EXT_SOURCE_2") * filled("INS_LATE_RATE"),
        ),
        "EXT2_ADJUSTED_BY_OVERDUE": Interaction(
            ("EXT_SOURCE_2", "BUR_OVERDUE_RATE"),
            lambda: filled("EXT_SOURCE_2") * (1 - filled("BUR_OVERDUE_RATE")),
        ),
        "EXT3_ADJUSTED_BY_DPD": Interaction(
            ("EXT_SOURCE_3", "BUR_BB_DPD_RATE_MEAN"),
            lambda: filled("EXT_SOURCE_3") * (1 - filled("BUR_BB_DPD_RATE_MEAN")),
        ),
        "CC_UTIL_PER_AGE": Interaction(
            ("CC_UTILIZATION_MEAN", "DAYS_BIRTH"),
            lambda: per(filled("CC_UTILIZATION_MEAN"), years_back("DAYS_BIRTH")),
        ),
        "LATE_RATE_x_EMPLOYMENT": Interaction(
            ("INS_LATE_RATE", "DAYS_EMPLOYED"), lambda: filled("INS_LATE_RATE") * years_employed
        ),
        "EXPERIENCE_x_SCORE": Interaction(
            ("PREV_COUNT", "APP_EXT_SOURCE_MEAN"),
            lambda: F.log1p(filled("PREV_COUNT")) * filled("APP_EXT_SOURCE_MEAN"),
        ),
        "WORSENING_BEHAVIOR_SCORE": Interaction(
            ("CC_UTIL_TREND_12M", "INS_RECENT_12_PAYMENT_RATIO"),
            lambda: filled("CC_UTIL_TREND_12M") - filled("INS_RECENT_12_PAYMENT_RATIO", 1.0) + 1,
        ),
        "FIRST_TIME_APPLICANT": Interaction(("PREV_COUNT",), lambda: missing("PREV_COUNT")),
        "NO_BUREAU_HISTORY": Interaction(("BUR_COUNT",), lambda: missing("BUR_COUNT")),
        "THIN_FILE_SCORE": Interaction(
            tuple(f"{t}_COUNT" for t in ("BUR", "PREV", "INS", "POS", "CC")), missing, at_least=1
        ),
        "COMBINED_DPD_SCORE": Interaction(
            ("BUR_BB_DPD_RATE_MEAN", "POS_DPD_RATE", "CC_DPD_RATE", "INS_LATE_RATE"),
            filled,
            at_least=2,
        ),
        "RECENT_DPD_SCORE": Interaction(
            (
                "BUR_BB_RECENT_6M_DPD_RATE_MEAN", "POS_RECENT_6M_DPD_RATE",
                "INS_RECENT_12_LATE_RATE", "CC_RECENT_12M_DPD_COUNT",
            ),
            _recent_part,
            at_least=2,
        ),
    }


def cross_features(joined: DataFrame) -> DataFrame:
    """Add every interaction whose inputs ``joined`` has, in one projection."""
    columns = set(joined.columns)
    built = {name: item.over(columns) for name, item in interactions().items()}
    return joined.withColumns({f"CROSS_{n}": expr for n, expr in built.items() if expr is not None})
