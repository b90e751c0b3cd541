"""Declared column types of the eight input tables.

Types follow the naming convention of the data: the prefix (or suffix) of a
column says whether it is a key, an amount, an offset, a count, a flag or a
label.  A declared type saves the inference pass over the text files, and the
same rule covers columns that no feature reads.
"""

from __future__ import annotations

from pyspark.sql import types as T

TABLES = (
    "application_train",
    "application_test",
    "bureau",
    "bureau_balance",
    "previous_application",
    "installments_payments",
    "POS_CASH_balance",
    "credit_card_balance",
)

APPLICANT, CREDIT, LOAN, LABEL = "SK_ID_CURR", "SK_ID_BUREAU", "SK_ID_PREV", "TARGET"

_KEYS = ("SK_ID_",)
_REALS = ("AMT_", "EXT_SOURCE_", "RATE_", "OWN_CAR_AGE", "REGION_POPULATION_")
_REAL_ENDS = ("_AVG", "_MEDI", "_MODE")
_WHOLES = (
    "CNT_", "DAYS_", "MONTHS_", "NUM_", "FLAG_", "NFLAG_", "REG_", "LIVE_", "OBS_", "DEF_",
    "SK_DPD", "HOUR_", "REGION_RATING_", "SELLERPLACE_", "TARGET", "CREDIT_DAY_",
)
#: Text and counting columns the prefixes would place wrongly.
_EXCEPTIONS = {
    "FLAG_OWN_CAR": T.StringType(),
    "FLAG_OWN_REALTY": T.StringType(),
    "FLAG_LAST_APPL_PER_CONTRACT": T.StringType(),
    "FONDKAPREMONT_MODE": T.StringType(),
    "HOUSETYPE_MODE": T.StringType(),
    "WALLSMATERIAL_MODE": T.StringType(),
    "EMERGENCYSTATE_MODE": T.StringType(),
    "SK_ID_CURR": T.LongType(),
}


def column_type(table: str, column: str) -> T.DataType:
    """Spark type of ``column`` in ``table``; unknown names are text."""
    if column in _EXCEPTIONS:
        return _EXCEPTIONS[column]
    if column.startswith("AMT_REQ_CREDIT_BUREAU_"):
        return T.IntegerType()
    if table == "bureau" and column == "AMT_ANNUITY":
        return T.StringType()  # holds unparsable entries; repaired by ``as_number``
    if column.startswith(_KEYS):
        return T.LongType()
    if column.startswith(_REALS) or column.endswith(_REAL_ENDS):
        return T.DoubleType()
    if column.startswith(_WHOLES):
        return T.IntegerType()
    return T.StringType()

#: The building measurements of the applicant table.
BUILDING_PARTS = [
    "APARTMENTS",
    "BASEMENTAREA",
    "YEARS_BEGINEXPLUATATION",
    "YEARS_BUILD",
    "COMMONAREA",
    "ELEVATORS",
    "ENTRANCES",
    "FLOORSMAX",
    "FLOORSMIN",
    "LANDAREA",
    "LIVINGAPARTMENTS",
    "LIVINGAREA",
    "NONLIVINGAPARTMENTS",
    "NONLIVINGAREA",
]
