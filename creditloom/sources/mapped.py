"""Credit-history tables derived from the star-schema sample data.

The engine's own inputs (applicants, bureau credits, monthly balances, earlier
applications, instalments) are not part of the sample data, so each is a view
over ``customer``, ``orders`` and ``lineitem``.  A view is declared once as
expressions that mean the same in Spark SQL and DuckDB and is rendered for
both.  Literals carry an exponent so that both dialects read them as doubles;
``DAYS(x)`` and ``MONTHS(x)`` are offsets from 2002-01-01 and are replaced per
dialect.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.operators.ordered import HOT_ROWS, hot_keys
from creditloom.session import scratch_dir, written
from creditloom.sources.bucketed import read_bucketed, write_bucketed
from creditloom.sources.schemas import BUILDING_PARTS

_APPLICATION = """
c_custkey AS SK_ID_CURR
cast(c_acctbal < 0 OR c_custkey % 17 = 0 as int) AS TARGET
27000.0e0 + (c_custkey * 7919 % 1000) * 300.0e0 AS AMT_INCOME_TOTAL
45000.0e0 + (c_custkey * 104729 % 997) * 1500.0e0 AS AMT_CREDIT
CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE (45000.0e0 + (c_custkey * 104729 % 997) * 1500.0e0) / 20.0e0 END AS AMT_ANNUITY
CASE WHEN c_custkey % 89 = 0 THEN NULL ELSE (45000.0e0 + (c_custkey * 104729 % 997) * 1500.0e0) * 0.9e0 END AS AMT_GOODS_PRICE
c_custkey % 4 AS CNT_CHILDREN
CASE WHEN c_custkey % 101 = 0 THEN NULL ELSE c_custkey % 4 + c_custkey % 3 END AS CNT_FAM_MEMBERS
CASE WHEN c_custkey % 499 = 0 THEN 0 ELSE -(7500 + c_custkey * 31 % 17500) END AS DAYS_BIRTH
CASE WHEN c_custkey % 6 = 0 THEN 365243 ELSE -(c_custkey * 13 % 9000) END AS DAYS_EMPLOYED
-(c_custkey * 17 % 12000) AS DAYS_REGISTRATION
-(c_custkey * 19 % 6000) AS DAYS_ID_PUBLISH
-(c_custkey * 23 % 3000) AS DAYS_LAST_PHONE_CHANGE
CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE (c_custkey * 613 % 1000) / 1000.0e0 END AS EXT_SOURCE_1
CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE 0.3e0 * (c_acctbal + 1000.0e0) / 11000.0e0 + 0.7e0 * (c_custkey * 7177 % 1000) / 1000.0e0 END AS EXT_SOURCE_2
CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_custkey * 373 % 1000) / 1000.0e0 END AS EXT_SOURCE_3
1 AS FLAG_CONT_MOBILE
cast(c_custkey % 9 = 0 as int) AS FLAG_EMAIL
cast(c_custkey % 3 = 0 as int) AS FLAG_PHONE
cast(c_custkey % 5 = 0 as int) AS FLAG_WORK_PHONE
cast(c_custkey % 31 = 0 as int) AS REG_REGION_NOT_LIVE_REGION
cast(c_custkey % 7 = 0 as int) AS REG_REGION_NOT_WORK_REGION
cast(c_custkey % 11 = 0 as int) AS LIVE_REGION_NOT_WORK_REGION
cast(c_custkey % 13 = 0 as int) AS REG_CITY_NOT_LIVE_CITY
cast(c_custkey % 4 = 0 as int) AS REG_CITY_NOT_WORK_CITY
cast(c_custkey % 6 = 0 as int) AS LIVE_CITY_NOT_WORK_CITY
CASE WHEN c_custkey % 211 = 0 THEN NULL ELSE c_custkey % 7 END AS OBS_30_CNT_SOCIAL_CIRCLE
CASE WHEN c_custkey % 211 = 0 THEN NULL ELSE c_custkey % 3 END AS DEF_30_CNT_SOCIAL_CIRCLE
CASE WHEN c_custkey % 211 = 0 THEN NULL ELSE c_custkey % 6 END AS OBS_60_CNT_SOCIAL_CIRCLE
CASE WHEN c_custkey % 211 = 0 THEN NULL ELSE c_custkey % 2 END AS DEF_60_CNT_SOCIAL_CIRCLE
CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_custkey % 2 END AS AMT_REQ_CREDIT_BUREAU_HOUR
CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_custkey % 2 END AS AMT_REQ_CREDIT_BUREAU_DAY
CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_custkey % 3 END AS AMT_REQ_CREDIT_BUREAU_WEEK
CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_custkey % 5 END AS AMT_REQ_CREDIT_BUREAU_MON
CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_custkey % 4 END AS AMT_REQ_CREDIT_BUREAU_QRT
CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_custkey % 9 END AS AMT_REQ_CREDIT_BUREAU_YEAR
concat('Org ', cast(c_nationkey as string)) AS ORGANIZATION_TYPE
CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS OCCUPATION_TYPE
concat('Inc ', cast(c_custkey % 8 as string)) AS NAME_INCOME_TYPE
concat('Edu ', cast(c_custkey % 5 as string)) AS NAME_EDUCATION_TYPE
concat('Hou ', cast(c_custkey % 6 as string)) AS NAME_HOUSING_TYPE
concat('Fam ', cast(c_custkey % 7 as string)) AS NAME_FAMILY_STATUS
"""

_BUREAU = """
o_custkey AS SK_ID_CURR
o_orderkey AS SK_ID_BUREAU
CASE o_orderstatus WHEN 'O' THEN 'Active' WHEN 'F' THEN 'Closed' ELSE 'Bad debt' END AS CREDIT_ACTIVE
CASE o_orderpriority WHEN '1-URGENT' THEN 'Consumer credit' WHEN '2-HIGH' THEN 'Credit card' WHEN '3-MEDIUM' THEN 'Mortgage' WHEN '5-LOW' THEN 'Car loan' ELSE 'Microloan' END AS CREDIT_TYPE
DAYS(o_orderdate) AS DAYS_CREDIT
DAYS(o_orderdate) + o_orderkey % 1500 AS DAYS_CREDIT_ENDDATE
DAYS(o_orderdate) + o_orderkey % 90 AS DAYS_CREDIT_UPDATE
o_totalprice AS AMT_CREDIT_SUM
CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice * (o_orderkey % 10) / 10.0e0 END AS AMT_CREDIT_SUM_DEBT
CASE WHEN o_orderkey % 8 = 0 THEN o_totalprice / 100.0e0 ELSE 0.0e0 END AS AMT_CREDIT_SUM_OVERDUE
CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice * 1.5e0 END AS AMT_CREDIT_SUM_LIMIT
CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_totalprice / 50.0e0 END AS AMT_CREDIT_MAX_OVERDUE
CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 10 = 0 THEN 'XNA' ELSE cast(o_orderkey % 5000 as string) END AS AMT_ANNUITY
CASE WHEN o_orderkey % 8 = 0 THEN o_orderkey % 60 ELSE 0 END AS CREDIT_DAY_OVERDUE
CASE WHEN o_orderkey % 20 = 0 THEN 2 WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS CNT_CREDIT_PROLONG
"""

_BUREAU_BALANCE = """
l_orderkey AS SK_ID_BUREAU
MONTHS(l_shipdate) AS MONTHS_BALANCE
CASE WHEN l_returnflag = 'R' THEN cast(l_linenumber % 6 as string) WHEN l_returnflag = 'A' THEN 'C' WHEN l_linenumber % 3 = 0 THEN 'X' ELSE '0' END AS STATUS
"""

_PREVIOUS_APPLICATION = """
o_orderkey AS SK_ID_PREV
o_custkey AS SK_ID_CURR
CASE o_orderkey % 4 WHEN 0 THEN 'Refused' WHEN 1 THEN 'Canceled' ELSE 'Approved' END AS NAME_CONTRACT_STATUS
CASE o_orderkey % 3 WHEN 0 THEN 'Cash loans' WHEN 1 THEN 'Consumer loans' ELSE 'Revolving loans' END AS NAME_CONTRACT_TYPE
o_totalprice AS AMT_APPLICATION
o_totalprice * 1.1e0 AS AMT_CREDIT
CASE WHEN o_orderkey % 12 = 0 THEN NULL ELSE o_totalprice / 24.0e0 END AS AMT_ANNUITY
CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_totalprice * 0.1e0 END AS AMT_DOWN_PAYMENT
DAYS(o_orderdate) AS DAYS_DECISION
CASE WHEN o_orderkey % 5 = 0 THEN 365243 ELSE DAYS(o_orderdate) + 10 END AS DAYS_FIRST_DRAWING
CASE WHEN o_orderkey % 7 = 0 THEN 365243 ELSE DAYS(o_orderdate) + 30 END AS DAYS_FIRST_DUE
CASE WHEN o_orderkey % 9 = 0 THEN 365243 ELSE DAYS(o_orderdate) + 300 END AS DAYS_LAST_DUE_1ST_VERSION
CASE WHEN o_orderkey % 6 = 0 THEN 365243 ELSE DAYS(o_orderdate) + 330 END AS DAYS_TERMINATION
CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS PRODUCT_COMBINATION
CASE o_orderkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'low_normal' WHEN 2 THEN 'middle' ELSE 'XNA' END AS NAME_YIELD_GROUP
concat('Channel ', cast(o_orderkey % 8 as string)) AS CHANNEL_TYPE
CASE o_orderkey % 7 WHEN 0 THEN 'SATURDAY' WHEN 1 THEN 'SUNDAY' ELSE 'MONDAY' END AS WEEKDAY_APPR_PROCESS_START
CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 2 END AS NFLAG_INSURED_ON_APPROVAL
CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderkey % 60 END AS CNT_PAYMENT
CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey % 100) / 100.0e0 ELSE NULL END AS RATE_INTEREST_PRIMARY
CASE o_orderkey % 3 WHEN 0 THEN 'Repeater' WHEN 1 THEN 'New' ELSE 'Refreshed' END AS NAME_CLIENT_TYPE
CASE o_orderkey % 8 WHEN 0 THEN 'HC' WHEN 4 THEN 'SCOFR' ELSE 'XAP' END AS CODE_REJECT_REASON
CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE concat('Purpose ', cast(o_orderkey % 6 as string)) END AS NAME_CASH_LOAN_PURPOSE
"""

_INSTALLMENTS_PAYMENTS = """
l_orderkey AS SK_ID_PREV
o_custkey AS SK_ID_CURR
l_linenumber AS NUM_INSTALMENT_NUMBER
CASE WHEN l_suppkey % 29 = 0 THEN NULL ELSE l_suppkey % 4 END AS NUM_INSTALMENT_VERSION
DAYS(l_shipdate) AS DAYS_INSTALMENT
CASE WHEN l_partkey % 41 = 0 THEN NULL ELSE DAYS(l_shipdate) + l_partkey % 80 - 40 END AS DAYS_ENTRY_PAYMENT
l_extendedprice AS AMT_INSTALMENT
CASE WHEN l_partkey % 41 = 0 THEN NULL WHEN l_partkey % 3 = 0 THEN l_extendedprice * (1 - l_discount) ELSE l_extendedprice END AS AMT_PAYMENT
"""

_POS_CASH_BALANCE = """
l_orderkey AS SK_ID_PREV
o_custkey AS SK_ID_CURR
MONTHS(l_shipdate) AS MONTHS_BALANCE
cast(l_quantity as int) AS CNT_INSTALMENT
CASE WHEN l_partkey % 37 = 0 THEN NULL ELSE cast(l_quantity as int) - l_linenumber END AS CNT_INSTALMENT_FUTURE
CASE l_returnflag WHEN 'R' THEN 'Completed' WHEN 'A' THEN 'Active' ELSE 'Signed' END AS NAME_CONTRACT_STATUS
CASE WHEN l_partkey % 10 = 0 THEN l_suppkey ELSE 0 END AS SK_DPD
CASE WHEN l_partkey % 20 = 0 THEN l_suppkey ELSE 0 END AS SK_DPD_DEF
"""

_CREDIT_CARD_BALANCE = """
l_orderkey AS SK_ID_PREV
o_custkey AS SK_ID_CURR
MONTHS(l_shipdate) AS MONTHS_BALANCE
l_extendedprice AS AMT_BALANCE
CASE WHEN l_suppkey % 10 = 0 THEN 0.0e0 ELSE 5000.0e0 * (1 + l_suppkey % 20) END AS AMT_CREDIT_LIMIT_ACTUAL
l_extendedprice * l_discount AS AMT_DRAWINGS_CURRENT
CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_extendedprice * l_discount / 2.0e0 END AS AMT_DRAWINGS_ATM_CURRENT
CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_linenumber END AS CNT_DRAWINGS_ATM_CURRENT
CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_extendedprice * l_discount / 4.0e0 END AS AMT_DRAWINGS_POS_CURRENT
CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE 100.0e0 + l_partkey % 200 END AS AMT_PAYMENT_CURRENT
CASE WHEN l_partkey % 15 = 0 THEN NULL ELSE 100.0e0 + l_suppkey END AS AMT_INST_MIN_REGULARITY
l_extendedprice * 0.95e0 AS AMT_RECEIVABLE_PRINCIPAL
l_extendedprice * 0.98e0 AS AMT_TOTAL_RECEIVABLE
CASE WHEN l_partkey % 12 = 0 THEN l_suppkey ELSE 0 END AS SK_DPD
CASE WHEN l_partkey % 24 = 0 THEN l_suppkey ELSE 0 END AS SK_DPD_DEF
CASE l_returnflag WHEN 'R' THEN 'Completed' ELSE 'Active' END AS NAME_CONTRACT_STATUS
"""

_APPLICATION_LINES = [
    *_APPLICATION.strip().splitlines(),
    *(f"cast(c_custkey % {n + 1} = 0 as int) AS FLAG_DOCUMENT_{n}" for n in range(2, 22)),
    *(
        f"CASE WHEN (c_custkey + {i}) % 3 = 0 THEN NULL ELSE ((c_custkey * {i}) % 100) / 1e2 END"
        f" AS {part}_AVG"
        for i, part in enumerate(BUILDING_PARTS, start=1)
    ),
]


@dataclass(frozen=True)
class MappedView:
    """One derived table: source, optional row condition, ``expr AS name`` lines."""

    source: str
    lines: list[str]
    where: str | None = None


_DETAIL = "lineitem JOIN orders ON l_orderkey = o_orderkey"


def _lines(text: str) -> list[str]:
    return text.strip().splitlines()


VIEWS = {
    "application": MappedView("customer", _APPLICATION_LINES),
    "bureau": MappedView("orders", _lines(_BUREAU), "o_custkey % 5 <> 0"),
    "bureau_balance": MappedView("lineitem", _lines(_BUREAU_BALANCE), "l_orderkey % 3 <> 0"),
    "previous_application": MappedView(
        "orders", _lines(_PREVIOUS_APPLICATION), "o_custkey % 7 <> 0"
    ),
    "installments_payments": MappedView(
        _DETAIL, _lines(_INSTALLMENTS_PAYMENTS), "o_custkey % 11 <> 0"
    ),
    "POS_CASH_balance": MappedView(
        _DETAIL, _lines(_POS_CASH_BALANCE), "l_linestatus = 'F' AND o_custkey % 13 <> 0"
    ),
    "credit_card_balance": MappedView(
        _DETAIL, _lines(_CREDIT_CARD_BALANCE), "l_linestatus = 'O' AND o_custkey % 3 = 0"
    ),
}

#: Applicants whose key leaves this remainder modulo 8 form the test set.
TEST_REMAINDER = 7

_SPARK = {
    "DAYS": r"datediff(\1, DATE'2002-01-01')",
    "MONTHS": r"((year(\1) - 2002) * 12 + month(\1) - 1)",
}
_DUCK = {
    "DAYS": r"date_diff('day', DATE '2002-01-01', cast(\1 as date))",
    "MONTHS": r"((year(\1) - 2002) * 12 + month(\1) - 1)",
}


def _render(line: str, dialect: dict[str, str]) -> str:
    for call, text in dialect.items():
        line = re.sub(call + r"\((\w+)\)", text, line)
    return line


#: What the views of single lines read of the joined lines and orders.
_DETAIL_COLUMNS = (
    "l_orderkey o_custkey l_linenumber l_suppkey l_partkey l_shipdate l_extendedprice l_discount"
    " l_quantity l_returnflag l_linestatus"
).split()


def detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their orders, from which three of the derived tables come."""
    return sample(spark, sf_dir, "lineitem").join(
        sample(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )


#: Joined lines in a bucket at least, as long as there are more buckets than one.
BUCKET_LINES = 50_000


#: Columns of the joined lines that the exploratory families do without.
NOT_EXPLORED = ("l_quantity", "l_returnflag")


def written_detail(
    spark: SparkSession, sf_dir: str, hot_rows: int = HOT_ROWS, dealt: bool = True,
    without: tuple[str, ...] = (),
) -> DataFrame:
    """:func:`detail` joined once for all who read it, in buckets by applicant.

    Every reader groups or orders by applicant: in buckets the lines move once, for all
    of them.  Days are kept without their time, which no view uses; columns ``without``
    are left out, and with them the columns of the views that need them.  Where an
    applicant may have ``hot_rows`` lines (ten an order), or for few readers (not
    ``dealt``), the lines stay as the join leaves them: no task has all of an applicant's.
    """
    day = F.col("l_shipdate").cast("date").alias("l_shipdate")
    kept = [c for c in _DETAIL_COLUMNS if c not in without]
    lines = detail(spark, sf_dir).select(*(day if c == "l_shipdate" else c for c in kept))
    if not dealt or hot_keys(sample(spark, sf_dir, "orders"), "o_custkey", hot_rows // 10) is not None:
        return written(lines)
    most = 1 + sample(spark, sf_dir, "lineitem").count() // BUCKET_LINES
    buckets = min(most, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = scratch_dir(spark)
    write_bucketed(lines, path, "o_custkey", buckets)
    return read_bucketed(spark, path, "o_custkey", buckets)


def mapped_table(
    spark: SparkSession, sf_dir: str, name: str, lines: DataFrame | None = None
) -> DataFrame:
    """The derived table ``name`` over the sample parquet files in ``sf_dir``.

    ``lines`` is a :func:`detail` made before.
    """
    if name in ("application_train", "application_test"):
        whole = mapped_table(spark, sf_dir, "application")
        held = F.col("SK_ID_CURR") % 8 == TEST_REMAINDER
        return whole.where(held).drop("TARGET") if name.endswith("test") else whole.where(~held)
    view = VIEWS[name]
    if view.source == _DETAIL:
        base = detail(spark, sf_dir) if lines is None else lines
    else:
        base = sample(spark, sf_dir, view.source)
    if view.where:
        base = base.where(view.where)
    lost = set(_DETAIL_COLUMNS) - set(base.columns) if view.source == _DETAIL else set()
    kept = (line for line in view.lines if not lost.intersection(re.findall(r"\w+", line)))
    return base.selectExpr(*(_render(line, _SPARK) for line in kept))


def sample(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A sample table as it is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oracle_view(name: str) -> str:
    """``SELECT`` text of a derived table for the SQL check."""
    if name == "application_train":
        return f"SELECT * FROM ({oracle_view('application')}) a WHERE SK_ID_CURR % 8 <> 7"
    if name == "application_test":
        return (
            f"SELECT * EXCLUDE (TARGET) FROM ({oracle_view('application')}) a"
            " WHERE SK_ID_CURR % 8 = 7"
        )
    view = VIEWS[name]
    where = f" WHERE {view.where}" if view.where else ""
    columns = ", ".join(_render(line, _DUCK) for line in view.lines)
    return f"SELECT {columns} FROM {view.source}{where}"
