"""SQL twins of the feature sets, in the form of filtered copies joined back."""

from __future__ import annotations

from creditloom.oracle import formulas as f
from creditloom.oracle.text import (
    columns, extended, fully_joined, grouped, joined, names, settled, with_views,
)

KEY = "SK_ID_CURR"
OVERDUE = "STATUS IN ('1','2','3','4','5')"

CREDITS = (
    "SELECT b.* REPLACE (try_cast(AMT_ANNUITY as double) AS AMT_ANNUITY),"
    " bb.* EXCLUDE (SK_ID_BUREAU) FROM bureau b LEFT JOIN ("
    + extended(grouped("bureau_balance", "SK_ID_BUREAU", f.BALANCE), f.BALANCE_RATIOS)
    + ") bb USING (SK_ID_BUREAU)"
)
BALANCE = extended(grouped("bureau_balance", "SK_ID_BUREAU", f.BALANCE), f.BALANCE_RATIOS)


def app() -> str:
    return (
        f"SELECT {KEY}, {columns(f.APP)},"
        " CASE WHEN DAYS_EMPLOYED = 365243 THEN NULL ELSE DAYS_EMPLOYED END AS DAYS_EMPLOYED"
    )


def bureau() -> str:
    source = f"({CREDITS}) c"
    return extended(
        joined(
            KEY,
            grouped(source, KEY, f.BUREAU),
            grouped(source, KEY, f.BUREAU_ACTIVE, "CREDIT_ACTIVE = 'Active'"),
            grouped(source, KEY, f.BUREAU_1Y, "DAYS_CREDIT > -365"),
            grouped(source, KEY, f.BUREAU_2Y, "DAYS_CREDIT > -730"),
        ),
        f.BUREAU_RATIOS,
    )


def previous() -> str:
    source = "previous_application"
    return extended(
        joined(
            KEY,
            grouped(source, KEY, f.PREVIOUS),
            grouped(source, KEY, f.PREVIOUS_APPROVED, "NAME_CONTRACT_STATUS = 'Approved'"),
            grouped(source, KEY, f.PREVIOUS_REFUSED, "NAME_CONTRACT_STATUS = 'Refused'"),
            grouped(source, KEY, f.PREVIOUS_1Y, "DAYS_DECISION > -365"),
        ),
        f.PREVIOUS_RATIOS,
    )


INSTALMENTS = f"SELECT *, {columns(f.INSTALMENT_ROWS)} FROM installments_payments"
INSTALMENT_ORDER = "SK_ID_PREV, NUM_INSTALMENT_NUMBER, INS_DAYS_DIFF, INS_PAYMENT_RATIO"
NUMBERED = (
    f"SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY DAYS_INSTALMENT DESC NULLS FIRST,"
    + ", ".join(f" {c} NULLS FIRST" for c in INSTALMENT_ORDER.split(", "))
    + f") AS rn FROM ({INSTALMENTS}) i"
)


def instalments() -> str:
    return extended(
        joined(
            KEY,
            grouped(f"({INSTALMENTS}) i", KEY, f.INSTALMENTS),
            grouped(f"({NUMBERED}) n", KEY, f.INSTALMENTS_LAST),
        ),
        f.INSTALMENT_RATIOS,
    )


def pos() -> str:
    source = "POS_CASH_balance"
    return extended(
        joined(
            KEY,
            grouped(source, KEY, f.POS),
            grouped(source, KEY, f.POS_6M, "MONTHS_BALANCE >= -6"),
            grouped(source, KEY, f.POS_12M, "MONTHS_BALANCE >= -12"),
        ),
        f.POS_RATIOS,
    )


CARD = f"SELECT *, {columns(f.CARD_ROWS)} FROM credit_card_balance"


def card() -> str:
    source = f"({CARD}) c"
    return extended(
        joined(
            KEY,
            grouped(source, KEY, f.CARD),
            grouped(source, KEY, f.CARD_3M, "MONTHS_BALANCE >= -3"),
            grouped(source, KEY, f.CARD_12M, "MONTHS_BALANCE >= -12"),
        ),
        f.CARD_RATIOS,
    )


# --- exploratory families ---------------------------------------------------


def _loans(source: str, measures: str, across: str) -> str:
    return (
        f"SELECT {KEY}, {across} FROM (SELECT {KEY}, SK_ID_PREV, {measures} FROM {source}"
        f" GROUP BY {KEY}, SK_ID_PREV) l GROUP BY {KEY}"
    )


def h1_parts() -> list[str]:
    return [
        _loans(
            f"({INSTALMENTS}) i",
            "avg(cast(INS_DAYS_DIFF > 0 as double)) AS lr, avg(INS_PAYMENT_RATIO) AS pr,"
            " avg(INS_DAYS_DIFF) AS dd",
            "stddev_samp(lr) AS H1_INS_PERLOAN_LATE_RATE_STD, max(lr) AS H1_INS_WORST_LOAN_LATE_RATE,"
            " min(lr) AS H1_INS_BEST_LOAN_LATE_RATE,"
            " max(lr) - min(lr) AS H1_INS_LOAN_LATE_RATE_SPREAD,"
            " stddev_samp(pr) AS H1_INS_PERLOAN_PAY_RATIO_STD, min(pr) AS H1_INS_WORST_LOAN_PAY_RATIO,"
            " stddev_samp(dd) AS H1_INS_PERLOAN_DAYS_DIFF_STD",
        ),
        _loans(
            f"({CARD}) c",
            "avg(CC_UTILIZATION) AS um, max(CC_UTILIZATION) AS ux,"
            " avg(cast(SK_DPD > 0 as double)) AS dr",
            "stddev_samp(um) AS H1_CC_PERLOAN_UTIL_STD, max(um) AS H1_CC_WORST_CARD_UTIL,"
            " max(um) - min(um) AS H1_CC_CARD_UTIL_SPREAD, max(ux) AS H1_CC_WORST_CARD_PEAK_UTIL,"
            " stddev_samp(dr) AS H1_CC_PERLOAN_DPD_RATE_STD, max(dr) AS H1_CC_WORST_CARD_DPD_RATE",
        ),
        _loans(
            "POS_CASH_balance",
            "avg(cast(SK_DPD > 0 as double)) AS dr, max(SK_DPD) AS dm",
            "stddev_samp(dr) AS H1_POS_PERLOAN_DPD_RATE_STD, max(dr) AS H1_POS_WORST_LOAN_DPD_RATE,"
            " max(dr) - min(dr) AS H1_POS_LOAN_DPD_SPREAD, max(dm) AS H1_POS_WORST_LOAN_DPD_MAX,"
            " stddev_samp(dm) AS H1_POS_PERLOAN_DPD_MAX_STD",
        ),
    ]


def ranked(source: str, order: str) -> str:
    ties = ", ".join(f"{c} NULLS FIRST" for c in order.split(", "))
    return (
        f"SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY {ties}) AS rk,"
        f" count(*) OVER (PARTITION BY {KEY}) AS total FROM {source}"
    )


def _halves(source: str, order: str, measures: dict[str, str], out: str) -> str:
    rows = f"SELECT * FROM ({ranked(source, order)}) r WHERE total >= 4"
    older = ", ".join(f"{m} AS older_{n}" for n, m in measures.items())
    recent = ", ".join(f"{m} AS recent_{n}" for n, m in measures.items())
    return (
        f"SELECT {KEY}, {out} FROM"
        f" (SELECT {KEY}, {recent} FROM ({rows}) a WHERE rk > total / 2 GROUP BY {KEY}) n"
        f" JOIN (SELECT {KEY}, {older} FROM ({rows}) b WHERE rk <= total / 2 GROUP BY {KEY}) o"
        f" USING ({KEY})"
    )


def _worse(name: str, floor: str) -> str:
    return f"cast(recent_{name} > older_{name} * 2 AND recent_{name} > {floor} as int)"


LATE = "avg(cast(SK_DPD > 0 as double))"
OWNED = (
    "(SELECT bb.*, b.SK_ID_CURR FROM bureau_balance bb JOIN bureau b USING (SK_ID_BUREAU)"
    " WHERE b.SK_ID_CURR IS NOT NULL) w"
)


def h2_parts() -> list[str]:
    return [
        _halves(
            f"({INSTALMENTS}) i",
            "DAYS_INSTALMENT, " + INSTALMENT_ORDER,
            {"l": "avg(cast(INS_DAYS_DIFF > 0 as double))", "p": "avg(INS_PAYMENT_RATIO)"},
            "recent_l - older_l AS H2_INS_LATE_RATE_TRAJECTORY,"
            " recent_p - older_p AS H2_INS_PAY_RATIO_TRAJECTORY,"
            f" {_worse('l', '0.1')} AS H2_INS_WORSENING_FLAG",
        ),
        _halves(
            OWNED,
            "MONTHS_BALANCE, SK_ID_BUREAU, STATUS",
            {"d": f"avg(cast({OVERDUE} as double))", "c": "avg(cast(STATUS = 'C' as double))"},
            "recent_d - older_d AS H2_BUR_BB_DPD_TRAJECTORY,"
            " recent_c - older_c AS H2_BUR_BB_CLOSED_TRAJECTORY,"
            f" {_worse('d', '0.05')} AS H2_BUR_BB_WORSENING_FLAG",
        ),
        _halves(
            "POS_CASH_balance",
            "MONTHS_BALANCE, SK_ID_PREV, SK_DPD",
            {"d": LATE, "m": "max(SK_DPD)"},
            "recent_d - older_d AS H2_POS_DPD_TRAJECTORY,"
            " recent_m - older_m AS H2_POS_DPD_MAX_TRAJECTORY,"
            f" {_worse('d', '0.05')} AS H2_POS_WORSENING_FLAG",
        ),
        _halves(
            f"({CARD}) c",
            "MONTHS_BALANCE, SK_ID_PREV, CC_UTILIZATION, SK_DPD, CC_DRAWING_RATIO",
            {"u": "avg(CC_UTILIZATION)", "d": LATE, "w": "avg(CC_DRAWING_RATIO)"},
            "recent_u - older_u AS H2_CC_UTIL_TRAJECTORY,"
            " recent_d - older_d AS H2_CC_DPD_TRAJECTORY,"
            " recent_w - older_w AS H2_CC_DRAWING_TRAJECTORY",
        ),
    ]


def _last(source: str, where: str, time: str, name: str) -> str:
    return f"SELECT {KEY}, max({time}) AS {name} FROM {source} WHERE {where} GROUP BY {KEY}"


def h3_parts() -> list[str]:
    ins, card_, month = f"({INSTALMENTS}) i", f"({CARD}) c", "MONTHS_BALANCE"
    since = "H3_MONTHS_SINCE_LAST"
    return [
        _last(ins, "INS_DAYS_DIFF > 0", "DAYS_INSTALMENT", "H3_DAYS_SINCE_LAST_LATE_INS"),
        _last(ins, "INS_DAYS_DIFF > 30", "DAYS_INSTALMENT", "H3_DAYS_SINCE_LAST_SEVERE_LATE_INS"),
        _last("bureau", "CREDIT_DAY_OVERDUE > 0", "DAYS_CREDIT", "H3_DAYS_SINCE_LAST_BUREAU_OVERDUE"),
        _last(OWNED, OVERDUE, month, f"{since}_BB_DPD"),
        _last("POS_CASH_balance", "SK_DPD > 0", month, f"{since}_POS_DPD"),
        _last("POS_CASH_balance", "SK_DPD_DEF > 0", month, f"{since}_POS_DPD_DEF"),
        _last(card_, "SK_DPD > 0", month, f"{since}_CC_DPD"),
        _last(card_, "CC_UTILIZATION > 0.9", month, f"{since}_HIGH_CC_UTIL"),
    ]


def h4_parts() -> list[str]:
    return [
        grouped("bureau", KEY, f.H4_BUREAU),
        grouped("previous_application", KEY, f.H4_PREVIOUS),
    ]


def h5_parts() -> list[str]:
    out = []
    for short, kind in (("CONSUMER", "Consumer credit"), ("CARD", "Credit card"), ("CAR", "Car loan")):
        out.append(
            f"SELECT {KEY}, coalesce(sum(AMT_CREDIT_SUM_DEBT), 0) AS H5_BUR_{short}_DEBT_TOTAL,"
            f" coalesce(sum(AMT_CREDIT_SUM_OVERDUE), 0) AS H5_BUR_{short}_OVERDUE_TOTAL,"
            f" count(*) FILTER (WHERE CREDIT_ACTIVE = 'Active') AS H5_BUR_{short}_ACTIVE_COUNT"
            f" FROM bureau WHERE CREDIT_TYPE = '{kind}' GROUP BY {KEY}"
        )
    return out


GAPS = (
    f"SELECT *, DAYS_DECISION - lag(DAYS_DECISION) OVER (PARTITION BY {KEY}"
    " ORDER BY DAYS_DECISION) AS gap FROM previous_application"
)


def h6_parts() -> list[str]:
    years = "(abs(max({t}) - min({t})) / 365.25 + 1)"
    prev, bur = years.format(t="DAYS_DECISION"), years.format(t="DAYS_CREDIT")
    return [
        f"SELECT {KEY}, count(*) / {prev} AS H6_PREV_APPS_PER_YEAR,"
        f" count(*) FILTER (WHERE DAYS_DECISION > -365) / (count(*) / {prev} + 0.1)"
        f" AS H6_PREV_APPLICATION_ACCELERATION FROM previous_application GROUP BY {KEY}",
        f"SELECT {KEY}, min(gap) AS H6_PREV_MIN_APP_GAP_DAYS, avg(gap) AS H6_PREV_MEAN_APP_GAP_DAYS,"
        f" stddev_samp(gap) AS H6_PREV_APP_GAP_STD FROM ({GAPS}) g WHERE gap IS NOT NULL"
        f" GROUP BY {KEY}",
        f"SELECT {KEY}, count(*) / {bur} AS H6_BUR_CREDITS_PER_YEAR FROM bureau GROUP BY {KEY}",
    ]


FAMILIES = {
    "H1": h1_parts, "H2": h2_parts, "H3": h3_parts,
    "H4": h4_parts, "H5": h5_parts, "H6": h6_parts,
}
SUPPLEMENTARY = [
    "bureau", "bureau_balance", "previous_application", "installments_payments",
    "POS_CASH_balance", "credit_card_balance",
]


def experimental(*families: str) -> str:
    return fully_joined(KEY, *(part for h in families for part in FAMILIES[h]()))


def wide(view: str, label: str) -> str:
    """All engineered columns of an applicant view; ``label`` is ``, TARGET`` or empty."""
    base = (
        f"SELECT * EXCLUDE (DAYS_EMPLOYED), {columns(f.APP)},"
        " CASE WHEN DAYS_EMPLOYED = 365243 THEN NULL ELSE DAYS_EMPLOYED END AS DAYS_EMPLOYED"
        f" FROM {view}"
    )
    main = {  # only the feature columns, since helper and source names repeat
        bureau: (f.BUREAU, f.BUREAU_ACTIVE, f.BUREAU_1Y, f.BUREAU_2Y, f.BUREAU_RATIOS),
        previous: (
            f.PREVIOUS, f.PREVIOUS_APPROVED, f.PREVIOUS_REFUSED, f.PREVIOUS_1Y, f.PREVIOUS_RATIOS,
        ),
        instalments: (f.INSTALMENTS, f.INSTALMENTS_LAST, f.INSTALMENT_RATIOS),
        pos: (f.POS, f.POS_6M, f.POS_12M, f.POS_RATIOS),
        card: (f.CARD, f.CARD_3M, f.CARD_12M, f.CARD_RATIOS),
    }
    parts = [f"SELECT {KEY}, {names(*blocks)} FROM ({build()}) x" for build, blocks in main.items()]
    whole = joined(KEY, base, *parts, experimental("H2", "H3", "H4", "H5"))
    kept = ", ".join(
        [names(f.APP), "DAYS_EMPLOYED", *(names(*blocks) for blocks in main.values())]
    )
    families = "COLUMNS('^H[2-5]_')"
    return f"SELECT {KEY}{label}, {kept}, {families}, {columns(f.CROSS)} FROM ({whole}) w"


def twin(sql: str, views: list[str]) -> str:
    return settled(with_views(views, sql), KEY)


def oracles() -> dict[str, str]:
    detail = ["installments_payments", "credit_card_balance", "POS_CASH_balance"]
    events = ["bureau", "bureau_balance", *detail]
    train = [*SUPPLEMENTARY, "application_train"]
    test = [*SUPPLEMENTARY, "application_test"]
    return {
        "app_features": twin(app() + " FROM application_train", ["application_train"]),
        "bureau_balance_features": settled(
            with_views(["bureau_balance"], BALANCE), "SK_ID_BUREAU"
        ),
        "bureau_features": twin(bureau(), ["bureau", "bureau_balance"]),
        "previous_features": twin(previous(), ["previous_application"]),
        "installment_features": twin(instalments(), ["installments_payments"]),
        "pos_features": twin(pos(), ["POS_CASH_balance"]),
        "card_features": twin(card(), ["credit_card_balance"]),
        "h1_variance": twin(experimental("H1"), detail),
        "h2_trajectory": twin(experimental("H2"), events),
        "h3_recency": twin(experimental("H3"), events),
        "h4_untapped": twin(experimental("H4"), ["bureau", "previous_application"]),
        "h5_credit_type": twin(experimental("H5"), ["bureau"]),
        "h6_velocity": twin(experimental("H6"), ["bureau", "previous_application"]),
        "experimental_all": twin(experimental(*FAMILIES), SUPPLEMENTARY),
        "experimental_winning": twin(experimental("H2", "H3", "H4", "H5"), SUPPLEMENTARY),
        "cross_features": twin(
            f"SELECT {KEY}, COLUMNS('^CROSS_') FROM ({wide('application_train', ', TARGET')}) x",
            train,
        ),
        "feature_table_train": (whole := twin(wide("application_train", ", TARGET"), train)),
        "feature_table_test": (scored := twin(wide("application_test", ""), test)),
        "feature_pipeline": whole,
        "feature_pipeline_test": scored,
    }
