"""SQL twins of the relational operators."""

from __future__ import annotations

from creditloom.oracle import features as feat
from creditloom.oracle import formulas as f
from creditloom.oracle.sources import _TEXT, view_columns
from creditloom.oracle.text import columns, grouped, joined, lines, settled, with_views

KEY = "SK_ID_CURR"
INS, POS, CARD, PREV = (
    "installments_payments", "POS_CASH_balance", "credit_card_balance", "previous_application",
)


def _one(table: str, sql: str, *keys: str) -> str:
    return settled(with_views([table], sql), *keys)


def _counts(names: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n FROM application_train" for c in names
    )


def _families() -> str:
    import re

    names: list[str] = []
    for build in feat.FAMILIES.values():
        for part in build():
            names += [n for n in re.findall(r" AS (H[1-6]_\w+)", part) if n not in names]
    cells = " UNION ALL ".join(
        f"SELECT '{n[:2]}' AS hypothesis, '{n}' AS \"column\","
        f" count(*) FILTER (WHERE {n} IS NULL) * 100.0 / count(*) AS null_pct FROM _x"
        for n in names
    )
    return with_views(feat.SUPPLEMENTARY, f"_x AS ({feat.experimental(*feat.FAMILIES)}) {cells}")


def _matrix() -> str:
    out = []
    for c in ("AMT_CREDIT", "AMT_ANNUITY", "EXT_SOURCE_1", "EXT_SOURCE_3", "DAYS_BIRTH"):
        low = f"cast(min({c}) OVER () as double)"
        fill = f"{low} - 1 - abs({low}) * 0.1e0"
        out.append(f"cast(cast(coalesce(cast({c} as double), {fill}) as float) as double) AS {c}")
    return f"SELECT {KEY}, cast(TARGET as bigint) AS TARGET, {', '.join(out)} FROM application_train"


def oracles() -> dict[str, str]:
    year = "DAYS_CREDIT > -365"
    status = ", ".join(f"count(*) FILTER (WHERE STATUS = '{c}') AS STATUS_{c}" for c in "012345CX")
    raw = [c for c in view_columns("application_train") if c not in (KEY, "TARGET")]
    ranked = feat.ranked(POS, "MONTHS_BALANCE, SK_ID_PREV, SK_DPD")
    pos_keys = (KEY, "SK_ID_PREV", "MONTHS_BALANCE", "SK_DPD")
    exact = "cast(MONTHS_BALANCE as bigint) AS MONTHS_BALANCE, cast(SK_DPD as bigint) AS SK_DPD"
    return {
        "with_columns": _one(
            INS,
            f"SELECT {KEY}, SK_ID_PREV, cast(NUM_INSTALMENT_NUMBER as bigint) AS NUM_INSTALMENT_NUMBER,"
            f" {columns(f.INSTALMENT_ROWS)} FROM {INS}",
            KEY, "SK_ID_PREV", "NUM_INSTALMENT_NUMBER",
        ),
        "select": _one(
            PREV, f"SELECT {KEY}, SK_ID_PREV, NAME_CONTRACT_STATUS, AMT_APPLICATION FROM {PREV}",
            KEY, "SK_ID_PREV", "NAME_CONTRACT_STATUS",
        ),
        "filter": with_views(
            [POS],
            f"SELECT {KEY}, SK_ID_PREV, {exact} FROM {POS} WHERE (SK_DPD > 0 AND"
            " MONTHS_BALANCE >= -12) OR CNT_INSTALMENT_FUTURE IS NULL",
        ),
        "case_when": _one(
            "application_train",
            f"SELECT {KEY}, nullif(DAYS_EMPLOYED, 365243) AS DAYS_EMPLOYED FROM application_train", KEY,
        ),
        "fill_null": _one(
            "application_train",
            f"SELECT {KEY}, "
            + ", ".join(
                f"coalesce({c}, 0) AS {c}"
                for c in ("AMT_ANNUITY", "CNT_FAM_MEMBERS", "EXT_SOURCE_1", "EXT_SOURCE_3")
            )
            + " FROM application_train", KEY,
        ),
        "null_flags": _one(
            "application_train",
            f"SELECT {KEY}, "
            + ", ".join(
                f"cast({c} IS NULL as int) AS {c}_MISSING, cast({c} IS NOT NULL as int) AS {c}_PRESENT"
                for c in ("EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "OCCUPATION_TYPE")
            )
            + " FROM application_train", KEY,
        ),
        "is_between": _one(
            CARD,
            f"SELECT * FROM (SELECT {KEY}, SK_ID_PREV, cast(MONTHS_BALANCE as bigint) AS MONTHS_BALANCE,"
            " AMT_PAYMENT_CURRENT / nullif(AMT_INST_MIN_REGULARITY + 1, 0) AS ratio"
            f" FROM {CARD}) c WHERE ratio >= 0.95e0 AND ratio <= 1.05e0",
            KEY, "SK_ID_PREV", "MONTHS_BALANCE",
        ),
        "is_in": with_views(
            ["bureau"],
            f"SELECT {KEY}, SK_ID_BUREAU, CREDIT_TYPE, CREDIT_ACTIVE FROM bureau"
            " WHERE CREDIT_TYPE IN ('Mortgage', 'Car loan') AND CREDIT_ACTIVE LIKE '%os%'",
        ),
        "feature_columns": with_views(["application_train"], _counts(raw)),
        "numeric_feature_columns": with_views(
            ["application_train"], _counts([c for c in raw if c not in _TEXT])
        ),
        "hypothesis_columns": settled(_families(), "hypothesis", "\"column\""),
        "ensure_columns": _one(
            "application_test",
            f"SELECT {KEY}, AMT_CREDIT, EXT_SOURCE_2, 0 AS BUR_COUNT, 0 AS TE_ORGANIZATION_TYPE"
            " FROM application_test", KEY,
        ),
        "feature_matrix": _one("application_train", _matrix(), KEY, "TARGET"),
        "left_join_features": settled(
            with_views(
                ["application_train", POS, CARD],
                f"SELECT a.{KEY}, p.n AS POS_COUNT, c.n AS CC_COUNT FROM application_train a"
                f" LEFT JOIN (SELECT {KEY}, count(*) AS n FROM {POS} GROUP BY {KEY}) p USING ({KEY})"
                f" LEFT JOIN (SELECT {KEY}, count(*) AS n FROM {CARD} GROUP BY {KEY}) c USING ({KEY})",
            ),
            KEY,
        ),
        "left_join_subsets": _one(
            "bureau",
            joined(
                KEY,
                f"SELECT {KEY}, count(*) AS n FROM bureau GROUP BY {KEY}",
                f"SELECT {KEY}, sum(AMT_CREDIT_SUM) AS active_total FROM bureau"
                f" WHERE CREDIT_ACTIVE = 'Active' GROUP BY {KEY}",
                f"SELECT {KEY}, count(*) AS year_n, avg(AMT_CREDIT_SUM) AS year_mean FROM bureau"
                f" WHERE {year} GROUP BY {KEY}",
            ),
            KEY,
        ),
        "left_join_child": settled(
            with_views(
                ["bureau", "bureau_balance"],
                f"SELECT SK_ID_BUREAU, {KEY}, BB_MONTHS_COUNT, BB_DPD_RATE FROM ({feat.CREDITS}) c",
            ),
            "SK_ID_BUREAU", KEY,
        ),
        "left_join_parent_key": with_views(
            ["bureau", "bureau_balance"],
            "SELECT SK_ID_CURR, m.SK_ID_BUREAU, cast(MONTHS_BALANCE as bigint) AS MONTHS_BALANCE,"
            " STATUS FROM bureau_balance m LEFT JOIN bureau c ON c.SK_ID_BUREAU = m.SK_ID_BUREAU",
        ),
        "inner_join_halves": _one(POS, feat.h2_parts()[2], KEY),
        "full_join_features": settled(
            with_views(
                ["bureau", POS],
                f"SELECT {KEY}, H3_MONTHS_SINCE_LAST_POS_DPD, H3_MONTHS_SINCE_LAST_POS_DPD_DEF,"
                " H3_DAYS_SINCE_LAST_BUREAU_OVERDUE FROM ("
                + " FULL JOIN ".join(
                    f"({p}) p{i}" + (f" USING ({KEY})" if i else "")
                    for i, p in enumerate(feat.h3_parts()[j] for j in (4, 5, 2))
                )
                + ")",
            ),
            KEY,
        ),
        "left_join_encoding": settled(
            with_views(
                ["application_train", "application_test"],
                f"SELECT {KEY}, ORGANIZATION_TYPE, n, cat_mean FROM application_test LEFT JOIN"
                " (SELECT ORGANIZATION_TYPE, count(TARGET) AS n, avg(TARGET) AS cat_mean"
                " FROM application_train GROUP BY 1) s USING (ORGANIZATION_TYPE)",
            ),
            KEY, "ORGANIZATION_TYPE", "n",
        ),
        "left_join_screening": settled(
            with_views(
                ["application_train", "bureau"],
                joined(
                    KEY,
                    f"SELECT {KEY}, cast(TARGET as bigint) AS TARGET FROM application_train",
                    feat.experimental("H5"),
                ),
            ),
            KEY, "TARGET",
        ),
        "group_agg": _one(
            CARD,
            f"SELECT {KEY}, count(*) AS n, avg(AMT_BALANCE) AS balance_MEAN,"
            " max(AMT_BALANCE) AS balance_MAX, coalesce(sum(AMT_DRAWINGS_CURRENT), 0) AS drawn"
            f" FROM {CARD} GROUP BY {KEY}", KEY,
        ),
        "agg_basic": _one(
            PREV,
            f"SELECT {KEY}, count(*) AS n_rows, count(AMT_DOWN_PAYMENT) AS n_values, "
            + ", ".join(
                f"{sql} AS down_{name}"
                for name, sql in (
                    ("SUM", "coalesce(sum(AMT_DOWN_PAYMENT), 0)"), ("MEAN", "avg(AMT_DOWN_PAYMENT)"),
                    ("MIN", "min(AMT_DOWN_PAYMENT)"), ("MAX", "max(AMT_DOWN_PAYMENT)"),
                    ("STD", "stddev_samp(AMT_DOWN_PAYMENT)"),
                )
            )
            + f" FROM {PREV} GROUP BY {KEY}", KEY,
        ),
        "agg_distinct_null": _one(
            PREV,
            f"SELECT {KEY}, count(DISTINCT PRODUCT_COMBINATION)"
            " + max(cast(PRODUCT_COMBINATION IS NULL as int)) AS products,"
            " count(DISTINCT NAME_CASH_LOAN_PURPOSE)"
            f" + max(cast(NAME_CASH_LOAN_PURPOSE IS NULL as int)) AS purposes FROM {PREV} GROUP BY {KEY}",
            KEY,
        ),
        "count_condition": _one(
            INS,
            f"SELECT {KEY}, count(*) FILTER (WHERE INS_DAYS_DIFF > 0) AS late,"
            f" count(*) FILTER (WHERE INS_DAYS_DIFF < -15) AS very_early FROM ({feat.INSTALMENTS}) i GROUP BY {KEY}",
            KEY,
        ),
        "rate_condition": _one(
            PREV,
            f"SELECT {KEY}, avg(cast(NAME_CLIENT_TYPE = 'Repeater' as double)) AS repeater,"
            " avg(cast(NFLAG_INSURED_ON_APPROVAL = 1 as double)) AS insured"
            f" FROM {PREV} GROUP BY {KEY}", KEY,
        ),
        "status_counts": _one(
            "bureau_balance",
            f"SELECT SK_ID_BUREAU, {status} FROM bureau_balance GROUP BY SK_ID_BUREAU", "SK_ID_BUREAU",
        ),
        "filtered_agg": _one(
            INS,
            f"SELECT {KEY}, avg(INS_UNDERPAYMENT) FILTER (WHERE INS_UNDERPAYMENT > 0) AS missing_MEAN,"
            " max(INS_UNDERPAYMENT) FILTER (WHERE INS_UNDERPAYMENT > 0) AS missing_MAX"
            f" FROM ({feat.INSTALMENTS}) i GROUP BY {KEY}", KEY,
        ),
        "subset_agg": _one(
            POS,
            f"SELECT {KEY}, max(SK_DPD) AS dpd_MAX, avg(SK_DPD) AS dpd_MEAN,"
            f" count(*) FILTER (WHERE SK_DPD > 0) AS late FROM {POS} WHERE MONTHS_BALANCE >= -12 GROUP BY {KEY}",
            KEY,
        ),
        "two_level_agg": settled(
            with_views(
                ["bureau", "bureau_balance"],
                f"SELECT {KEY}, coalesce(sum(BB_DPD_MONTHS), 0) AS late_months,"
                f" avg(BB_DPD_RATE) AS late_rate FROM ({feat.CREDITS}) c GROUP BY {KEY}",
            ),
            KEY,
        ),
        "per_loan_variance": _one(INS, feat.h1_parts()[0], KEY),
        "per_category_agg": _one("bureau", feat.experimental("H5"), KEY),
        "last_event": _one(
            INS, f"SELECT * FROM ({feat.h3_parts()[0]}) a FULL JOIN ({feat.h3_parts()[1]}) b USING ({KEY})",
            KEY,
        ),
        "velocity": _one(PREV, feat.h6_parts()[0], KEY),
        "ordinal_rank": with_views(
            [POS], f"SELECT {KEY}, SK_ID_PREV, {exact}, rk AS rank FROM ({ranked}) r"
        ),
        "group_total": with_views(
            [POS],
            f"SELECT {KEY}, SK_ID_PREV, cast(MONTHS_BALANCE as bigint) AS MONTHS_BALANCE, total"
            f" FROM ({ranked}) r",
        ),
        "split_half": with_views(
            [POS],
            f"SELECT {KEY}, SK_ID_PREV, {exact}, cast(rk > total / 2 as bigint) AS recent"
            f" FROM ({ranked}) r WHERE total >= 4",
        ),
        "lag_gap": with_views(
            [PREV],
            f"SELECT {KEY}, cast(DAYS_DECISION as bigint) AS DAYS_DECISION, cast(gap as bigint) AS gap"
            f" FROM ({feat.GAPS}) g WHERE gap IS NOT NULL",
        ),
        "last_n": _one(
            INS,
            f"SELECT {KEY}, SK_ID_PREV, cast(DAYS_INSTALMENT as bigint) AS DAYS_INSTALMENT,"
            f" INS_PAYMENT_RATIO, rn FROM ({feat.NUMBERED}) n WHERE rn <= 12",
            KEY, "SK_ID_PREV", "DAYS_INSTALMENT", "rn",
        ),
        "sort": _one(
            "bureau",
            f"SELECT {KEY}, SK_ID_BUREAU, cast(DAYS_CREDIT as bigint) AS DAYS_CREDIT,"
            " AMT_CREDIT_SUM_DEBT FROM bureau", KEY, "SK_ID_BUREAU", "DAYS_CREDIT",
        ),
        "limit_head": _one(
            "bureau",
            "SELECT SK_ID_BUREAU, AMT_CREDIT_SUM_DEBT FROM bureau WHERE AMT_CREDIT_SUM_DEBT IS NOT NULL"
            " ORDER BY AMT_CREDIT_SUM_DEBT DESC, SK_ID_BUREAU LIMIT 50", "SK_ID_BUREAU",
        ),
        "scalar_functions": _one(
            "application_train",
            f"SELECT {KEY}, DAYS_BIRTH / -365.25e0 AS age, -AMT_CREDIT AS negated,"
            " pow(coalesce(EXT_SOURCE_2, 0), 2) AS squared, sqrt(AMT_INCOME_TOTAL) AS root,"
            " abs(DAYS_REGISTRATION) AS absolute, ln(1 + CNT_CHILDREN) AS logged,"
            " least(greatest(DAYS_BIRTH / -365.25e0, 30), 50) AS clipped,"
            " DAYS_EMPLOYED / nullif(DAYS_BIRTH, 0) AS replaced,"
            " coalesce(AMT_REQ_CREDIT_BUREAU_MON, 0) + coalesce(AMT_REQ_CREDIT_BUREAU_QRT, 0) AS summed,"
            " cast(trunc(AMT_CREDIT) as bigint) AS whole,"
            " round(coalesce(EXT_SOURCE_3, 0) * 7.3e0, 1) AS rounded FROM application_train", KEY,
        ),
        "try_cast": _one(
            "bureau",
            "SELECT SK_ID_BUREAU, try_cast(AMT_ANNUITY as double) AS AMT_ANNUITY FROM bureau",
            "SK_ID_BUREAU",
        ),
        "json_text": with_views(
            ["bureau"],
            "SELECT SK_ID_BUREAU, '{\"type\":\"' || CREDIT_TYPE || '\",\"days\":' ||"
            " cast(DAYS_CREDIT as varchar) || '}' AS doc FROM bureau",
        ),
    }
