"""SQL twins of folds, encodings, metrics, blends and selection."""

from __future__ import annotations

from creditloom.oracle import formulas as f
from creditloom.oracle.text import columns, grid, lines, settled, with_views
from creditloom.sources.mapped import VIEWS

ENCODED = [
    "ORGANIZATION_TYPE",
    "OCCUPATION_TYPE",
    "NAME_INCOME_TYPE",
    "NAME_EDUCATION_TYPE",
    "NAME_HOUSING_TYPE",
    "NAME_FAMILY_STATUS",
]
TRAIN = ["application_train"]
SCORED = (
    "SELECT SK_ID_CURR, TARGET, 1e0 - coalesce(EXT_SOURCE_2, 0.5e0) AS score_a,"
    " coalesce(EXT_SOURCE_3, 0.5e0) AS score_b, coalesce(EXT_SOURCE_1, 0.5e0) AS score_c,"
    " (SK_ID_CURR * 7919 % 1000) / 1e3 AS score_d FROM application_train"
)


def folded(sql: str) -> str:
    return (
        "SELECT *, (row_number() OVER (PARTITION BY TARGET ORDER BY"
        f" md5('42:' || cast(SK_ID_CURR as varchar)), SK_ID_CURR) - 1) % 5 AS fold FROM ({sql}) z"
    )


def _area(source: str, score: str, by: str = "") -> str:
    """AUC by counting pairs of distinct scores; ties count half."""
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return (
        f"SELECT {keys}sum(p * (2 * below + n)) / (2.0 * sum(p) * sum(n)) AS auc,"
        f" cast(sum(p) as bigint) AS n_pos, cast(sum(n) as bigint) AS n_neg FROM ("
        f"SELECT *, coalesce(sum(n) OVER ({part}ORDER BY {score}"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ("
        f"SELECT {keys}{score}, count(*) FILTER (WHERE TARGET = 1) AS p, count(*) FILTER (WHERE TARGET = 0) AS n"
        f" FROM ({source}) a GROUP BY {keys}{score}) b) c{group}"
    )


def auc_of(score: str) -> str:
    return with_views(TRAIN, _area(SCORED, score))


def auc_by_fold(score: str) -> str:
    return with_views(TRAIN, _area(folded(SCORED), score, "fold"))


def _fold_encoding() -> str:
    """The direct form: for every fold, statistics of the rows outside it."""
    joins, out = "", []
    for i, c in enumerate(ENCODED):
        joins += (
            f" LEFT JOIN (SELECT k.fold, t.{c} AS cat, sum(t.TARGET) AS s, count(*) AS n"
            f" FROM _k k JOIN _f t ON t.fold <> k.fold WHERE t.{c} IS NOT NULL"
            f" GROUP BY k.fold, t.{c}) s{i} ON s{i}.fold = r.fold AND s{i}.cat = r.{c}"
        )
        out.append(f"coalesce((s{i}.s + 10 * k.g) / (s{i}.n + 10), k.g) AS TE_{c}")
    return (
        f"_f AS ({folded('SELECT * FROM application_train')}),"
        " _k AS (SELECT a.fold, avg(b.TARGET) AS g FROM (SELECT DISTINCT fold FROM _f) a"
        " JOIN _f b ON b.fold <> a.fold GROUP BY a.fold)"
        f" SELECT r.SK_ID_CURR, r.fold, {', '.join(out)} FROM _f r JOIN _k k ON k.fold = r.fold{joins}"
    )


def _full_encoding() -> str:
    joins, out = "", []
    for i, c in enumerate(ENCODED):
        joins += (
            f" LEFT JOIN (SELECT {c} AS cat, sum(TARGET) AS s, count(*) AS n FROM application_train"
            f" WHERE {c} IS NOT NULL GROUP BY {c}) s{i} ON s{i}.cat = r.{c}"
        )
        out.append(f"coalesce((s{i}.s + 10 * g.g) / (s{i}.n + 10), g.g) AS TE_{c}")
    return (
        f"SELECT r.SK_ID_CURR, {', '.join(out)} FROM application_test r"
        f" CROSS JOIN (SELECT avg(TARGET) AS g FROM application_train) g{joins}"
    )


def _thresholds() -> str:
    steps = ", ".join(f"({i}, {0.05 + i * 0.05!r}e0)" for i in range(18))
    return (
        "SELECT round(t, 2) AS threshold, round(pr, 4) AS precision, round(re, 4) AS recall,"
        " round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 4) AS f1,"
        " round((n - d) / n, 4) AS approval_rate, round(d / n, 4) AS decline_rate,"
        " cast(tp as bigint) AS true_positives, cast(fp as bigint) AS false_positives FROM ("
        "SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr,"
        " CASE WHEN p > 0 THEN tp / p ELSE 0 END AS re FROM ("
        "SELECT t, count(*) FILTER (WHERE score_a >= t AND TARGET = 1) AS tp,"
        " count(*) FILTER (WHERE score_a >= t AND TARGET = 0) AS fp, count(*) FILTER (WHERE TARGET = 1) AS p,"
        " count(*) FILTER (WHERE score_a >= t) AS d, count(*) AS n"
        f" FROM ({SCORED}) s CROSS JOIN (VALUES {steps}) v(i, t) GROUP BY t) a) b"
    )


def _steps(start: float, stop: float, step: float) -> list[float]:
    out, i = [], 0
    while start + i * step < stop - 1e-9:
        out.append(start + i * step)
        i += 1
    return out


#: Lower bounds of all weights but the last, their common bound and step.
_GRIDS = {2: ([0.3], 0.71, 0.01), 3: ([0.2, 0.1], 0.71, 0.02), 4: ([0.1, 0.05, 0.05], 0.61, 0.04)}


def _grid(count: int) -> list[tuple[float, ...]]:
    lows, high, step = _GRIDS[count]

    def left(of: float, chosen: tuple[float, ...]) -> float:
        for w in chosen:
            of -= w
        return of

    def extended(chosen: tuple[float, ...]) -> list[tuple[float, ...]]:
        if len(chosen) == len(lows):
            return [(*chosen, left(1.0, chosen))]
        values = _steps(lows[len(chosen)], left(high, chosen), step)
        return [w for x in values for w in extended((*chosen, x))]

    return [w for w in extended(()) if count == 2 or w[-1] >= 0.05]


def _blend_grid(count: int) -> str:
    scores = [f"score_{c}" for c in "abcd"[:count]]
    names = [f"w{i + 1}" for i in range(count)]
    values = ", ".join(
        f"({i}, {', '.join(f'{w!r}e0' for w in ws)})" for i, ws in enumerate(_grid(count))
    )
    blend = " + ".join(f"{w} * {s}" for w, s in zip(names, scores))
    rows = (
        f"SELECT g.*, TARGET, {blend} AS score FROM ({SCORED}) s"
        f" CROSS JOIN (VALUES {values}) g(position, {', '.join(names)})"
    )
    areas = _area(rows, "score", "position")
    weights = f"(VALUES {values}) h(position, {', '.join(names)})"
    return f"SELECT position, {', '.join(names)}, auc FROM ({areas}) a JOIN {weights} USING (position)"


def _best_blend(count: int) -> str:
    sql = f"SELECT * EXCLUDE (position) FROM ({_blend_grid(count)}) b ORDER BY auc DESC, position LIMIT 1"
    return f"SELECT {grid_all(count)} FROM ({with_views(TRAIN, sql)}) x"


def grid_all(count: int) -> str:
    names = [*(f"w{i + 1}" for i in range(count)), "auc"]
    return ", ".join(f"{grid(n)} AS {n}" for n in names)


APP = (
    f"SELECT * EXCLUDE (DAYS_EMPLOYED), {columns(f.APP)},"
    " CASE WHEN DAYS_EMPLOYED = 365243 THEN NULL ELSE DAYS_EMPLOYED END AS DAYS_EMPLOYED"
    " FROM application_train"
)


def numeric_columns() -> list[str]:
    raw = [line.rsplit(" AS ", 1)[1] for line in VIEWS["application"].lines]
    return [c for c in raw if c not in ("SK_ID_CURR", "TARGET", *ENCODED)] + [
        n for n, _ in lines(f.APP)
    ]


def _corr(c: str) -> str:
    r = f"corr(cast({c} as double), cast(TARGET as double))"
    return f"CASE WHEN {r} IS NULL OR isnan({r}) THEN 0 ELSE abs({r}) END"


def importance(extra: str = "") -> str:
    """Absolute correlation per column, on the comparison grid."""
    one = "SELECT " + ", ".join(f"{_corr(c)} AS {c}" for c in numeric_columns())
    cells = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {grid(c)} AS importance FROM _i" for c in numeric_columns()
    )
    return with_views(TRAIN, f"_i AS ({one} FROM ({APP}) a) {cells}")


def _fold_importance() -> str:
    names = [n for n, _ in lines(f.APP)]
    one = "SELECT fold, " + ", ".join(f"{_corr(c)} AS {c}" for c in names)
    cells = " UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) AS importance FROM _i" for c in names)
    return with_views(TRAIN, f"_i AS ({one} FROM ({folded(APP)}) a GROUP BY fold) {cells}")


def _prune() -> str:
    return (
        f"WITH _x AS ({importance()}), _p AS (SELECT * FROM _x WHERE importance > 0)"
        " SELECT feature, importance, false AS encoded FROM _p WHERE importance >"
        " (SELECT quantile_cont(importance, 0.1) FROM _p)"
    )


def _by_group() -> str:
    return (
        f"WITH _x AS (SELECT *, CASE WHEN feature LIKE 'APP\\_%' ESCAPE '\\' THEN 'APP_' ELSE 'raw' END"
        f" AS prefix FROM ({importance()}) i),"
        " _t AS (SELECT prefix, sum(importance) AS total, count(*) FILTER (WHERE importance > 0) AS used"
        " FROM _x GROUP BY prefix),"
        " _b AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY importance DESC, feature)"
        " AS place FROM _x)"
        " SELECT prefix, total, cast(used as bigint) AS used, feature, importance, place FROM _t"
        " LEFT JOIN (SELECT * FROM _b WHERE place <= 5 AND importance > 0) b USING (prefix)"
    )


LOG = (
    "SELECT event_id, 'run ' || cast(user_id as varchar) AS message, value AS cv_score,"
    " CASE WHEN event_id % 4 = 0 THEN '' ELSE '0.5' END AS public_score"
    " FROM events WHERE event_id % 2 = 0"
)
LATER = (
    "SELECT * FROM (SELECT event_id, 'run ' || cast(user_id as varchar) AS message,"
    " cast(event_id % 1000 as varchar) AS pub, cast(event_id % 77 as varchar) AS priv,"
    " row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS late"
    " FROM events WHERE event_id % 3 = 0 AND user_id % 5 <> 0) q WHERE late = 1"
)
MERGED = (
    f"SELECT l.event_id, l.message, cv_score, coalesce(pub, public_score) AS public_score,"
    f" coalesce(priv, '') AS private_score FROM ({LOG}) l LEFT JOIN ({LATER}) s USING (message)"
)


def oracles() -> dict[str, str]:
    counted = ("n_pos", "n_neg")
    told = ("true_positives", "false_positives")
    table = with_views(TRAIN, _thresholds())
    merged_keys = ("event_id", "message", "public_score", "private_score")
    sizes = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", cast(count(DISTINCT {c}) + max(cast({c} IS NULL as int))"
        f" as bigint) AS n_categories FROM application_train"
        for c in ENCODED
    )
    stats = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS category, count(TARGET) AS cat_count,"
        f" avg(TARGET) AS cat_mean FROM application_train GROUP BY {c}"
        for c in ENCODED
    )
    return {
        "stratified_folds": with_views(
            TRAIN,
            f"SELECT SK_ID_CURR, cast(TARGET as bigint) AS TARGET, fold"
            f" FROM ({folded('SELECT * FROM application_train')}) f",
        ),
        "target_encode_fold": settled(with_views(TRAIN, _fold_encoding()), "SK_ID_CURR", "fold"),
        "target_encode_full": settled(
            with_views([*TRAIN, "application_test"], _full_encoding()), "SK_ID_CURR"
        ),
        "te_columns": with_views(TRAIN, sizes),
        "category_stats": settled(
            with_views(TRAIN, stats), "\"column\"", "category", "cat_count"
        ),
        "auc_exact": settled(auc_of("score_a"), *counted),
        "auc_by_fold": settled(auc_by_fold("score_b"), "fold", *counted),
        "roc_points": "SELECT "
        + ", ".join(f"{grid(c)} AS {c}" for c in ("threshold", "fpr", "tpr"))
        + " FROM ("
        + with_views(
            TRAIN,
            "SELECT score_a AS threshold, sum(n) OVER w / sum(n) OVER () AS fpr,"
            " sum(p) OVER w / sum(p) OVER () AS tpr FROM (SELECT score_a,"
            f" count(*) FILTER (WHERE TARGET = 1) AS p, count(*) FILTER (WHERE TARGET = 0) AS n FROM ({SCORED}) s"
            " GROUP BY score_a) c WINDOW w AS (ORDER BY score_a DESC)",
        )
        + ") r",
        "threshold_table": settled(table, *told),
        "threshold_lookup": settled(
            f"SELECT * FROM ({table}) t WHERE cast(round(threshold * 100) as int) IN (10, 20, 30, 50)",
            *told,
        ),
        "blend_2": _best_blend(2),
        "blend_3": _best_blend(3),
        "blend_4": _best_blend(4),
        "blend_grid": settled(
            f"SELECT cast(position as bigint) AS position, auc FROM ({with_views(TRAIN, _blend_grid(2))}) b",
            "position",
        ),
        "blend_scores": settled(
            with_views(
                TRAIN,
                "SELECT SK_ID_CURR, 0.4e0 * score_a + 0.17e0 * score_b + 0.33e0 * score_c"
                f" + 0.1e0 * score_d AS score FROM ({SCORED}) s",
            ),
            "SK_ID_CURR",
        ),
        "feature_importance": settled(_fold_importance(), "feature"),
        "prune_features": settled(_prune(), "feature", "encoded"),
        "top_features": settled(
            f"SELECT * FROM ({importance()}) i ORDER BY importance DESC, feature LIMIT 30", "feature"
        ),
        "importance_by_group": settled(_by_group(), "prefix", "used", "feature", "place"),
        "class_weight": settled(
            with_views(
                TRAIN,
                "SELECT SK_ID_CURR, cast(TARGET as bigint) AS TARGET,"
                " CASE WHEN TARGET = 1 THEN 2.5 ELSE 1 END AS fixed_weight,"
                " CASE WHEN TARGET = 1 THEN n / (2 * p) ELSE n / (2 * (n - p)) END AS balanced_weight"
                " FROM application_train CROSS JOIN (SELECT count(*) AS n, sum(TARGET) AS p"
                " FROM application_train) c",
            ),
            "SK_ID_CURR", "TARGET",
        ),
        "sample_rows": with_views(
            TRAIN,
            "SELECT SK_ID_CURR, cast(TARGET as bigint) AS TARGET FROM application_train"
            " ORDER BY md5('42:' || cast(SK_ID_CURR as varchar)), SK_ID_CURR LIMIT 1000",
        ),
        "score_merge": settled(MERGED, *merged_keys),
        "score_gap": settled(
            f"SELECT *, try_cast(public_score as double) - cv_score AS gap FROM ({MERGED}) m"
            " WHERE try_cast(public_score as double) IS NOT NULL",
            *merged_keys,
        ),
    }
