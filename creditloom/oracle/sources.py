"""SQL twins of readers, sinks and profiles."""

from __future__ import annotations

from creditloom.oracle import features as feat
from creditloom.oracle import formulas as f
from creditloom.oracle.text import columns, lines, settled, with_views
from creditloom.oracle.validation import auc_by_fold, auc_of
from creditloom.sources.mapped import VIEWS
from creditloom.sources.schemas import TABLES

_TEXT = {  # text columns of the derived tables
    "CREDIT_ACTIVE", "CREDIT_TYPE", "STATUS", "NAME_CONTRACT_STATUS", "NAME_CONTRACT_TYPE",
    "PRODUCT_COMBINATION", "NAME_YIELD_GROUP", "CHANNEL_TYPE", "WEEKDAY_APPR_PROCESS_START",
    "NAME_CLIENT_TYPE", "CODE_REJECT_REASON", "NAME_CASH_LOAN_PURPOSE", "ORGANIZATION_TYPE",
    "OCCUPATION_TYPE", "NAME_INCOME_TYPE", "NAME_EDUCATION_TYPE", "NAME_HOUSING_TYPE",
    "NAME_FAMILY_STATUS",
}


def view_columns(name: str) -> list[str]:
    base = "application" if name.startswith("application_") else name
    out = [line.rsplit(" AS ", 1)[1] for line in VIEWS[base].lines]
    return [c for c in out if c != "TARGET"] if name == "application_test" else out


def is_text(table: str, column: str) -> bool:
    return column in _TEXT or (table == "bureau" and column == "AMT_ANNUITY")


def _unique(column: str) -> str:
    return f"count(DISTINCT {column}) + max(cast({column} IS NULL as int))"


def profile(name: str) -> str:
    rows = []
    for c in view_columns(name):
        numbers = ", ".join(
            f"cast(NULL as double) AS {n}" if is_text(name, c) else f"cast({fn}({c}) as double) AS {n}"
            for n, fn in (("min", "min"), ("max", "max"), ("mean", "avg"))
        )
        rows.append(
            f"SELECT '{name}' AS \"table\", '{c}' AS \"column\", count(*) AS n_rows,"
            f" count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*) AS null_pct,"
            f" cast({_unique(c)} as bigint) AS n_unique, {numbers} FROM {name}"
        )
    return " UNION ALL ".join(rows)


def _type_report(name: str) -> str:
    reals = {
        "AMT_APPLICATION", "AMT_CREDIT", "AMT_ANNUITY", "AMT_DOWN_PAYMENT", "RATE_INTEREST_PRIMARY",
    }
    rows = []
    for c in view_columns(name):
        if is_text(name, c):
            kind = f"CASE WHEN {_unique(c)} < count(*) * 0.5 THEN 'dictionary' ELSE 'string' END"
            low = high = "cast(NULL as double)"
        else:
            low, high = f"cast(min({c}) as double)", f"cast(max({c}) as double)"
            kind = (
                "'float'" if c in reals else
                f"CASE WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint'"
                f" WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint'"
                f" WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int'"
                " ELSE 'bigint' END"
            )
        rows.append(
            f"SELECT '{c}' AS \"column\", {kind} AS narrow_type, {low} AS min, {high} AS max,"
            f" cast({_unique(c)} as bigint) AS n_unique FROM {name}"
        )
    return " UNION ALL ".join(rows)


def _overview() -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS \"table\", count(*) AS n_rows,"
        f" cast({len(view_columns(n))} as bigint) AS n_columns FROM {n}"
        for n in TABLES
    )


def _partial_rows() -> str:
    """Of the tables' rows all (-1), seven at most, and none."""
    wanted = "(VALUES (-1), (7), (0)) AS w(wanted)"
    return (
        f"SELECT \"table\", wanted, CASE WHEN wanted < 0 THEN n_rows ELSE least(n_rows, wanted) END"
        f" AS n_rows, n_columns FROM ({_overview()}) o, {wanted}"
    )


def _null_report() -> str:
    names = _winning_columns()
    shares = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*) AS null_pct FROM _x"
        for c in names
    )
    body = f"_x AS ({feat.experimental('H2', 'H3', 'H4', 'H5')}) {shares}"
    report = with_views(feat.SUPPLEMENTARY, body)
    return (
        f"SELECT * FROM ({report}) r WHERE null_pct > 5 ORDER BY null_pct DESC, \"column\" LIMIT 10"
    )


def _winning_columns() -> list[str]:
    import re

    out = ["SK_ID_CURR"]
    for family in ("H2", "H3", "H4", "H5"):
        for part in feat.FAMILIES[family]():
            out += [n for n in re.findall(r" AS (H[2-5]_\w+)", part) if n not in out]
    return out


def _prefixes() -> str:
    features = [n for n, _ in lines(f.APP)]
    raw = view_columns("application_train")
    cells = [f"SELECT 'APP_' AS prefix, count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*) AS p FROM _x"
             for c in features]
    cells += [f"SELECT 'raw' AS prefix, count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*) AS p FROM _x"
              for c in raw]
    app = (
        f"SELECT * EXCLUDE (DAYS_EMPLOYED), {columns(f.APP)},"
        " CASE WHEN DAYS_EMPLOYED = 365243 THEN NULL ELSE DAYS_EMPLOYED END AS DAYS_EMPLOYED"
        " FROM application_train"
    )
    body = f"_x AS ({app}) SELECT prefix, count(*) AS n_columns, avg(p) AS mean_null_pct FROM (" \
           f"{' UNION ALL '.join(cells)}) c GROUP BY prefix"
    return with_views(["application_train"], body)


def _runs() -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{s}' AS name, round(avg(auc), 6) AS mean_auc, round(stddev_pop(auc), 6) AS std_auc,"
        f" cast(1 as bigint) AS n_features, '{{\"score\": \"{s}\"}}' AS params"
        f" FROM ({auc_by_fold(s)}) x"
        for s in ("score_a", "score_b")
    )
    return settled(rows, "name", "n_features", "params")


def _submissions() -> str:
    rows = " UNION ALL ".join(
        f"SELECT 'blend, {s}' AS message, round(auc, 6) AS cv_score,"
        f" cast(1 as bigint) AS n_features, '' AS public_score FROM ({auc_of(s)}) x"
        for s in ("score_a", "score_b")
    )
    return settled(rows, "message", "n_features", "public_score")


def oracles() -> dict[str, str]:
    keyed = ("\"table\"", "\"column\"", "n_rows", "n_unique")
    balances = settled(with_views(["bureau_balance"], feat.BALANCE), "SK_ID_BUREAU")
    loaded = ", ".join(
        f"cast({c} as float) AS {c}" for c in ("AMT_INSTALMENT", "AMT_PAYMENT")
    )
    return {
        "scan_table": settled(
            with_views(
                ["bureau"], "SELECT * REPLACE (nullif(AMT_ANNUITY, '') AS AMT_ANNUITY) FROM bureau"
            ),
            "SK_ID_CURR", "SK_ID_BUREAU", "CREDIT_ACTIVE", "CREDIT_TYPE", "AMT_ANNUITY",
        ),
        "load_table": settled(
            with_views(
                ["installments_payments"],
                f"SELECT * EXCLUDE (AMT_INSTALMENT, AMT_PAYMENT), {loaded} FROM installments_payments",
            ),
            "SK_ID_CURR", "SK_ID_PREV",
        ),
        "named_loaders": with_views(list(TABLES), _overview()),
        "narrow_types": settled(
            with_views(["previous_application"], _type_report("previous_application")),
            "\"column\"", "narrow_type", "n_unique",
        ),
        "partial_read": with_views(["bureau"], "SELECT SK_ID_BUREAU, DAYS_CREDIT FROM bureau"),
        "partial_read_rows": with_views(list(TABLES), _partial_rows()),
        "profile_estimated": "SELECT * EXCLUDE (n_unique), true AS near FROM ("
        + settled(with_views(list(TABLES), " UNION ALL ".join(profile(n) for n in TABLES)), *keyed)
        + ") p",
        "parquet_cache": balances,
        "write_csv": balances,
        "write_parquet": feat.twin(feat.pos(), ["POS_CASH_balance"]),
        "run_log_append": _runs(),
        "submission_log_append": _submissions(),
        "profile_table": settled(with_views(["bureau"], profile("bureau")), *keyed),
        "profile_all": settled(
            with_views(list(TABLES), " UNION ALL ".join(profile(n) for n in TABLES)), *keyed
        ),
        "table_overview": with_views(list(TABLES), _overview()),
        "describe": settled(
            with_views(
                ["bureau"],
                "SELECT count(*) AS keys, avg(n) AS mean, stddev_samp(n) AS std, min(n) AS min,"
                " quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS q50,"
                " quantile_cont(n, 0.75) AS q75, max(n) AS max FROM"
                " (SELECT SK_ID_CURR, count(*) AS n FROM bureau GROUP BY SK_ID_CURR) s",
            ),
            "keys", "min", "max",
        ),
        "value_counts": settled(
            with_views(
                ["previous_application"],
                "SELECT PRODUCT_COMBINATION AS value, count(*) AS n,"
                " count(*) / (SELECT count(*) FROM previous_application) AS share"
                " FROM previous_application GROUP BY 1",
            ),
            "value", "n",
        ),
        "null_report": settled(_null_report(), "\"column\""),
        "prefix_counts": settled(_prefixes(), "prefix", "n_columns"),
    }
