"""SQL twins of what any engine can check of the model queries."""

from __future__ import annotations

from creditloom.oracle.features import SUPPLEMENTARY, wide
from creditloom.oracle.text import settled, with_views
from creditloom.oracle.validation import ENCODED, TRAIN, folded, numeric_columns

#: Columns of each screened family (fixed values).
FAMILY_SIZES = {"H1": 18, "H2": 12, "H3": 8, "H4": 12, "H5": 9, "H6": 6}

LABELLED = f"SELECT SK_ID_CURR, cast(TARGET as bigint) AS TARGET, fold FROM ({folded('SELECT * FROM application_train')}) f"


def _labelled(*told: str) -> str:
    flags = ", ".join(f"true AS {name}" for name in told)
    return with_views(TRAIN, f"SELECT *, {flags} FROM ({LABELLED}) x")


def _drawn(name: str) -> str:
    """A number from 0 to 1 by the first 12 hex digits of a hash."""
    return f"(('0x' || substr(md5('42:' || trial || ':{name}'), 1, 12))::BIGINT / 281474976710656e0)"


def _between(name: str, low: float, high: float) -> str:
    if isinstance(low, int):
        return f"cast({low} + floor({_drawn(name)} * {high - low + 1}) as bigint) AS {name}"
    return f"{low}e0 + {_drawn(name)} * ({high}e0 - {low}e0) AS {name}"


def _search() -> str:
    rate = f"exp(ln(0.01e0) + {_drawn('step_size')} * (ln(0.15e0) - ln(0.01e0))) AS step_size"
    columns = [
        "cast(trial as bigint) AS trial", _between("max_depth", 3, 8), rate,
        _between("row_share", 0.6, 0.95), _between("column_share", 0.5, 0.9),
        _between("min_rows", 5, 100), _between("positive_weight", 1.0, 5.0),
    ]
    drawn = f"SELECT {', '.join(columns)} FROM range(30) AS _(trial)"
    keys = ("trial", "max_depth", "min_rows")
    return f"SELECT *, true AS rated FROM ({settled(drawn, *keys)}) d"


def _ablation() -> str:
    sizes = {"baseline": 0, **FAMILY_SIZES, "all": sum(FAMILY_SIZES.values())}
    rows = ", ".join(f"('{name}', cast({n} as bigint))" for name, n in sizes.items())
    return f"SELECT *, true AS delta_agrees, true AS winner_agrees FROM (VALUES {rows}) AS _(name, n_added)"


def _features() -> str:
    """The model's features: the wide table's numbers and the encoded columns."""
    one = (
        f"SELECT COLUMNS('^(BUR|PREV|INS|POS|CC|H[2-5]|CROSS)_')::DOUBLE"
        f" FROM ({wide('application_train', ', TARGET')}) w LIMIT 1"
    )
    joined = with_views(
        [*SUPPLEMENTARY, *TRAIN],
        f"_one AS ({one}) SELECT name FROM _one UNPIVOT INCLUDE NULLS (v FOR name IN (COLUMNS(*)))",
    )
    known = ", ".join(f"('{c}')" for c in [*numeric_columns(), *(f"TE_{c}" for c in ENCODED)])
    return f"SELECT name AS feature, true AS agrees FROM ({joined} UNION ALL VALUES {known}) f"


def oracles() -> dict[str, str]:
    held = _labelled("in_range", "auc_agrees")
    return {
        "train_cv": held,
        "train_cv_second": held,
        "train_cv_third": held,
        "random_search": _search(),
        "ablation": _ablation(),
        "node_importance": _features(),
        "oof_scores": _labelled("same_score"),
        "save_load_model": _labelled("same_score", "first_version"),
        "score_test": with_views(
            ["application_test"], "SELECT SK_ID_CURR, true AS in_range FROM application_test"
        ),
        "submission_check": with_views(
            ["application_test"],
            "SELECT true AS columns_ok, true AS range_ok, true AS keys_unique,"
            " count(*) > 40000 AS enough_rows, count(*) AS n_rows FROM application_test",
        ),
    }
