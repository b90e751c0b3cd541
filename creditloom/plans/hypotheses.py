"""The six exploratory feature families H1 to H6, one row per applicant each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.aggregates import low, mean, rows, share, spread, stats, subset, top, total
from creditloom.functions.scalar import YEAR, flag, ratio
from creditloom.operators.grouped import FeatureGroup, roll_up
from creditloom.operators.lookup import outer_join_features
from creditloom.operators.ordered import (
    COPIES, COUNT, HOT_ROWS, OLDER, RECENT, compare_halves, gap_statistics, half_max, half_mean,
    hot_keys, most_rows, split_halves,
)
from creditloom.plans.bureau import is_active, is_overdue
from creditloom.plans.history import (
    INSTALMENT_TIES, card_rows, instalment_rows, is_high_use, is_late, is_late_tolerant,
)
from creditloom.session import in_threads, scratch_dir
from creditloom.sources.schemas import APPLICANT, CREDIT, LOAN

#: Column prefix of each family.
FAMILIES = {h: f"{h}_" for h in ("H1", "H2", "H3", "H4", "H5", "H6")}
#: Families kept after screening.
WINNING = ("H2", "H3", "H4", "H5")


def hypothesis_columns(df: DataFrame) -> dict[str, list[str]]:
    """The columns of each family present in ``df``."""
    return {h: [c for c in df.columns if c.startswith(p)] for h, p in FAMILIES.items()}


# --- H1: how much an applicant's loans differ -------------------------------


def per_loan_variance(
    df: DataFrame, measures: dict[str, Column], across: list[Column], rows_: dict[str, Column]
) -> DataFrame:
    """Loan-level measures first, then their statistics over the applicant's loans."""
    loans = df.withColumns(rows_).groupBy(APPLICANT, LOAN).agg(
        *(expr.alias(name) for name, expr in measures.items())
    )
    return loans.groupBy(APPLICANT).agg(*across)


def h1_instalments(instalments: DataFrame) -> DataFrame:
    late, paid, days = "late_rate", "paid", "days"
    return per_loan_variance(
        instalments,
        {
            late: share(F.col("INS_DAYS_DIFF") > 0),
            paid: mean("INS_PAYMENT_RATIO"),
            days: mean("INS_DAYS_DIFF"),
        },
        [
            spread(late).alias("H1_INS_PERLOAN_LATE_RATE_STD"),
            top(late).alias("H1_INS_WORST_LOAN_LATE_RATE"),
            low(late).alias("H1_INS_BEST_LOAN_LATE_RATE"),
            (top(late) - low(late)).alias("H1_INS_LOAN_LATE_RATE_SPREAD"),
            spread(paid).alias("H1_INS_PERLOAN_PAY_RATIO_STD"),
            low(paid).alias("H1_INS_WORST_LOAN_PAY_RATIO"),
            spread(days).alias("H1_INS_PERLOAN_DAYS_DIFF_STD"),
        ],
        instalment_rows(),
    )


def h1_cards(card: DataFrame) -> DataFrame:
    use, peak, late = "use", "peak", "late_rate"
    return per_loan_variance(
        card,
        {use: mean("CC_UTILIZATION"), peak: top("CC_UTILIZATION"), late: share(is_late())},
        [
            spread(use).alias("H1_CC_PERLOAN_UTIL_STD"),
            top(use).alias("H1_CC_WORST_CARD_UTIL"),
            (top(use) - low(use)).alias("H1_CC_CARD_UTIL_SPREAD"),
            top(peak).alias("H1_CC_WORST_CARD_PEAK_UTIL"),
            spread(late).alias("H1_CC_PERLOAN_DPD_RATE_STD"),
            top(late).alias("H1_CC_WORST_CARD_DPD_RATE"),
        ],
        card_rows(),
    )


def h1_pos(pos: DataFrame) -> DataFrame:
    late, most = "late_rate", "most"
    return per_loan_variance(
        pos,
        {late: share(is_late()), most: top("SK_DPD")},
        [
            spread(late).alias("H1_POS_PERLOAN_DPD_RATE_STD"),
            top(late).alias("H1_POS_WORST_LOAN_DPD_RATE"),
            (top(late) - low(late)).alias("H1_POS_LOAN_DPD_SPREAD"),
            top(most).alias("H1_POS_WORST_LOAN_DPD_MAX"),
            spread(most).alias("H1_POS_PERLOAN_DPD_MAX_STD"),
        ],
        {},
    )


def h1_variance(instalments: DataFrame, card: DataFrame, pos: DataFrame) -> DataFrame:
    parts = [h1_instalments(instalments), h1_cards(card), h1_pos(pos)]
    return outer_join_features(parts, APPLICANT)


# --- H2: recent half of the history against the older half ------------------


def _worsening(rate: str, floor: float) -> Column:
    """The recent rate is above twice the older one and above ``floor``."""
    recent, older = F.col(f"recent_{rate}"), F.col(f"older_{rate}")
    return flag((recent > older * 2) & (recent > floor))


def _change(measure: str) -> Column:
    return F.col(f"recent_{measure}") - F.col(f"older_{measure}")


def _trajectory(
    df: DataFrame, time: str, ties: list[str], means: dict[str, Column],
    out: dict[str, Column], maxima: dict[str, Column] | None = None, hot_rows: int = HOT_ROWS,
    hot: DataFrame | str | None = COUNT,
) -> DataFrame:
    halves = split_halves(df, APPLICANT, time, ties, hot_rows=hot_rows, hot=hot)

    def side(prefix: str, half: str) -> list[Column]:
        return [
            *(half_mean(v, half).alias(f"{prefix}_{n}") for n, v in means.items()),
            *(half_max(v, half).alias(f"{prefix}_{n}") for n, v in (maxima or {}).items()),
        ]

    both = compare_halves(halves, APPLICANT, side("older", OLDER), side("recent", RECENT))
    return both.select(APPLICANT, *(expr.alias(name) for name, expr in out.items()))


def h2_instalments(instalments: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    used = instalments.withColumns(instalment_rows()).select(
        APPLICANT, "DAYS_INSTALMENT", *INSTALMENT_TIES
    )
    return _trajectory(
        used,
        "DAYS_INSTALMENT",
        INSTALMENT_TIES,
        {"late_rate": F.col("INS_DAYS_DIFF") > 0, "pay_ratio": F.col("INS_PAYMENT_RATIO")},
        {
            "H2_INS_LATE_RATE_TRAJECTORY": _change("late_rate"),
            "H2_INS_PAY_RATIO_TRAJECTORY": _change("pay_ratio"),
            "H2_INS_WORSENING_FLAG": _worsening("late_rate", 0.1),
        },
        hot_rows=hot_rows,
    )


def balance_cells(balance: DataFrame, bureau: DataFrame) -> DataFrame:
    """Monthly balances with their applicant; equal months of a credit are one counted row.

    Counting first shrinks the table before it meets the bureau, and leaves a
    credit with very many rows only as many as it has months and statuses.
    Balances without a bureau credit have no applicant and are left out.
    """
    cells = balance.groupBy(CREDIT, "MONTHS_BALANCE", "STATUS").agg(
        F.count(F.lit(1)).alias(COPIES)
    )
    return cells.join(_owners(bureau), CREDIT)


def _owners(bureau: DataFrame) -> DataFrame:
    return bureau.select(CREDIT, APPLICANT).where(F.col(APPLICANT).isNotNull())


def balances_per_applicant(balance: DataFrame, bureau: DataFrame) -> DataFrame:
    """``_rows`` of each applicant: counted per credit, so that no balance is moved for it."""
    counts = balance.groupBy(CREDIT).agg(F.count(F.lit(1)).alias("_rows"))
    owned = counts.join(_owners(bureau), CREDIT)
    return owned.groupBy(APPLICANT).agg(F.sum("_rows").alias("_rows"))


def h2_balances(balance: DataFrame, bureau: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Equal months of a credit are counted first only where an applicant has very many rows:
    as a rule none has, and counting moves the whole table twice more."""
    hot = None
    if most_rows(balance, CREDIT) * most_rows(_owners(bureau), APPLICANT) >= hot_rows:
        hot = hot_keys(balance, APPLICANT, hot_rows, balances_per_applicant(balance, bureau))
    if hot is None:
        used = balance.select(CREDIT, "MONTHS_BALANCE", "STATUS").join(_owners(bureau), CREDIT)
    else:
        used = balance_cells(balance, bureau)
    return _trajectory(
        used,
        "MONTHS_BALANCE",
        [CREDIT, "STATUS"],
        {"dpd_rate": is_overdue(), "closed_rate": F.col("STATUS") == "C"},
        {
            "H2_BUR_BB_DPD_TRAJECTORY": _change("dpd_rate"),
            "H2_BUR_BB_CLOSED_TRAJECTORY": _change("closed_rate"),
            "H2_BUR_BB_WORSENING_FLAG": _worsening("dpd_rate", 0.05),
        },
        hot_rows=hot_rows,
        hot=hot,
    )


def h2_pos(pos: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    return _trajectory(
        pos.select(APPLICANT, LOAN, "MONTHS_BALANCE", "SK_DPD"),
        "MONTHS_BALANCE",
        [LOAN, "SK_DPD"],
        {"dpd_rate": is_late()},
        {
            "H2_POS_DPD_TRAJECTORY": _change("dpd_rate"),
            "H2_POS_DPD_MAX_TRAJECTORY": _change("dpd_max"),
            "H2_POS_WORSENING_FLAG": _worsening("dpd_rate", 0.05),
        },
        maxima={"dpd_max": F.col("SK_DPD")},
        hot_rows=hot_rows,
    )


def h2_cards(card: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    measures = ["CC_UTILIZATION", "SK_DPD", "CC_DRAWING_RATIO"]
    used = card.withColumns(card_rows()).select(APPLICANT, LOAN, "MONTHS_BALANCE", *measures)
    return _trajectory(
        used,
        "MONTHS_BALANCE",
        [LOAN, *measures],
        {
            "util": F.col("CC_UTILIZATION"),
            "dpd_rate": is_late(),
            "draw_ratio": F.col("CC_DRAWING_RATIO"),
        },
        {
            "H2_CC_UTIL_TRAJECTORY": _change("util"),
            "H2_CC_DPD_TRAJECTORY": _change("dpd_rate"),
            "H2_CC_DRAWING_TRAJECTORY": _change("draw_ratio"),
        },
        hot_rows=hot_rows,
    )


def h2_trajectory(
    instalments: DataFrame, balance: DataFrame, bureau: DataFrame, pos: DataFrame, card: DataFrame
) -> DataFrame:
    spark = bureau.sparkSession
    scratch_dir(spark)
    parts = in_threads(  # each looks for large keys first, which is a Spark job
        spark,
        [
            lambda: h2_instalments(instalments),
            lambda: h2_balances(balance, bureau),
            lambda: h2_pos(pos),
            lambda: h2_cards(card),
        ],
        4,
    )
    return outer_join_features(parts, APPLICANT)


# --- H3: time of the last bad event -----------------------------------------


def last_events(df: DataFrame, key: str, events: dict[str, tuple[Column, str]]) -> DataFrame:
    """Latest time of each event per key; keys without any event have no row.

    ``events`` maps an output column to a condition and a time column.  Offsets
    are negative, so the largest is the latest.
    """
    any_event = None
    for condition, _ in events.values():
        any_event = condition if any_event is None else any_event | condition
    return (
        df.where(any_event & F.col(key).isNotNull())
        .groupBy(key)
        .agg(*(top(time, cond).alias(name) for name, (cond, time) in events.items()))
    )


def h3_instalments(instalments: DataFrame) -> DataFrame:
    days = F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")
    return last_events(
        instalments,
        APPLICANT,
        {
            "H3_DAYS_SINCE_LAST_LATE_INS": (days > 0, "DAYS_INSTALMENT"),
            "H3_DAYS_SINCE_LAST_SEVERE_LATE_INS": (days > 30, "DAYS_INSTALMENT"),
        },
    )


def h3_bureau(bureau: DataFrame) -> DataFrame:
    late = F.col("CREDIT_DAY_OVERDUE") > 0
    events = {"H3_DAYS_SINCE_LAST_BUREAU_OVERDUE": (late, "DAYS_CREDIT")}
    return last_events(bureau, APPLICANT, events)


def h3_balances(balance: DataFrame, bureau: DataFrame) -> DataFrame:
    """Per credit first, so that one row per credit meets the bureau."""
    name = "H3_MONTHS_SINCE_LAST_BB_DPD"
    credits = last_events(balance, CREDIT, {name: (is_overdue(), "MONTHS_BALANCE")})
    owned = credits.join(bureau.select(CREDIT, APPLICANT), CREDIT)
    return owned.where(F.col(APPLICANT).isNotNull()).groupBy(APPLICANT).agg(top(name).alias(name))


def h3_pos(pos: DataFrame) -> DataFrame:
    month = "MONTHS_BALANCE"
    return last_events(
        pos,
        APPLICANT,
        {
            "H3_MONTHS_SINCE_LAST_POS_DPD": (is_late(), month),
            "H3_MONTHS_SINCE_LAST_POS_DPD_DEF": (is_late_tolerant(), month),
        },
    )


def h3_cards(card: DataFrame) -> DataFrame:
    month = "MONTHS_BALANCE"
    return last_events(
        card.withColumns(card_rows()),
        APPLICANT,
        {
            "H3_MONTHS_SINCE_LAST_CC_DPD": (is_late(), month),
            "H3_MONTHS_SINCE_LAST_HIGH_CC_UTIL": (is_high_use(), month),
        },
    )


def h3_recency(
    instalments: DataFrame, balance: DataFrame, bureau: DataFrame, pos: DataFrame, card: DataFrame
) -> DataFrame:
    parts = [
        h3_instalments(instalments), h3_bureau(bureau), h3_balances(balance, bureau),
        h3_pos(pos), h3_cards(card),
    ]
    return outer_join_features(parts, APPLICANT)


# --- H4: columns the main feature sets leave out ----------------------------


def h4_bureau_group() -> FeatureGroup:
    return FeatureGroup(
        aggregates=[
            *stats("H4_BUR_PROLONG", "CNT_CREDIT_PROLONG", "TOTAL MAX"),
            rows(F.col("CNT_CREDIT_PROLONG") > 0).alias("H4_BUR_PROLONG_COUNT"),
            *stats("H4_BUR_CURRENT_OVERDUE", "CREDIT_DAY_OVERDUE", "MAX SUM"),
        ]
    )


def h4_previous_group() -> FeatureGroup:
    client, reason = F.col("NAME_CLIENT_TYPE"), F.col("CODE_REJECT_REASON")
    return FeatureGroup(
        aggregates=[
            *stats("H4_PREV_INTEREST_RATE", "RATE_INTEREST_PRIMARY", "MEAN MAX"),
            share(client == "Repeater").alias("H4_PREV_REPEATER_RATE"),
            share(client == "New").alias("H4_PREV_NEW_CLIENT_RATE"),
            *(rows(reason == r).alias(f"H4_PREV_REJECT_{r}_COUNT") for r in ("HC", "SCOFR")),
        ],
        distinct={"H4_PREV_LOAN_PURPOSE_DIVERSITY": "NAME_CASH_LOAN_PURPOSE"},
    )


def h4_untapped(bureau: DataFrame, previous: DataFrame) -> DataFrame:
    parts = [
        roll_up(bureau, APPLICANT, h4_bureau_group()),
        roll_up(previous, APPLICANT, h4_previous_group()),
    ]
    return outer_join_features(parts, APPLICANT)


# --- H5: debt by credit type ------------------------------------------------

H5_TYPES = {"CONSUMER": "Consumer credit", "CARD": "Credit card", "CAR": "Car loan"}


def h5_group() -> FeatureGroup:
    """The same three aggregates per credit type; null where an applicant has none of it."""
    aggregates = []
    for short, kind in H5_TYPES.items():
        here = F.col("CREDIT_TYPE") == kind
        prefix = f"H5_BUR_{short}"
        aggregates += [
            subset(here, total("AMT_CREDIT_SUM_DEBT", here)).alias(f"{prefix}_DEBT_TOTAL"),
            subset(here, total("AMT_CREDIT_SUM_OVERDUE", here)).alias(f"{prefix}_OVERDUE_TOTAL"),
            subset(here, rows(here & is_active())).alias(f"{prefix}_ACTIVE_COUNT"),
        ]
    return FeatureGroup(aggregates=aggregates)


def h5_credit_type(bureau: DataFrame) -> DataFrame:
    """One row per applicant with a credit of any listed type."""
    listed = bureau.where(F.col("CREDIT_TYPE").isin(*H5_TYPES.values()))
    return roll_up(listed, APPLICANT, h5_group())


# --- H6: pace of applications -----------------------------------------------


def _velocity_group(time: str, pace: str, acceleration: str | None = None) -> FeatureGroup:
    years = F.abs(F.col("_newest") - F.col("_oldest")) / F.lit(YEAR) + 1
    yearly = F.col("_n") / years
    derived = {pace: yearly}
    if acceleration:
        derived[acceleration] = ratio("_in_year", yearly + 0.1)
    return FeatureGroup(
        aggregates=[
            rows().alias("_n"),
            rows(F.col(time) > -365).alias("_in_year"),
            top(time).alias("_newest"),
            low(time).alias("_oldest"),
        ],
        derived=derived,
    )


def velocity(df: DataFrame, time: str, pace: str, acceleration: str | None = None) -> DataFrame:
    """Records per year of history and, if asked, the last year against that pace."""
    group = _velocity_group(time, pace, acceleration)
    return roll_up(df, APPLICANT, group).select(APPLICANT, *group.derived)


def h6_gaps(previous: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    names = {
        "min": "H6_PREV_MIN_APP_GAP_DAYS",
        "mean": "H6_PREV_MEAN_APP_GAP_DAYS",
        "std": "H6_PREV_APP_GAP_STD",
    }
    return gap_statistics(previous, APPLICANT, "DAYS_DECISION", names, hot_rows)


def h6_velocity(previous: DataFrame, bureau: DataFrame) -> DataFrame:
    parts = [
        velocity(
            previous, "DAYS_DECISION", "H6_PREV_APPS_PER_YEAR", "H6_PREV_APPLICATION_ACCELERATION"
        ),
        h6_gaps(previous),
        velocity(bureau, "DAYS_CREDIT", "H6_BUR_CREDITS_PER_YEAR"),
    ]
    return outer_join_features(parts, APPLICANT)


# --- all families -----------------------------------------------------------


def experimental_features(tables: dict[str, DataFrame], families: tuple[str, ...]) -> DataFrame:
    """The chosen families side by side; an applicant in any of them has a row."""
    bureau, balance = tables["bureau"], tables["bureau_balance"]
    previous, instalments = tables["previous_application"], tables["installments_payments"]
    pos, card = tables["POS_CASH_balance"], tables["credit_card_balance"]
    build = {
        "H1": lambda: h1_variance(instalments, card, pos),
        "H2": lambda: h2_trajectory(instalments, balance, bureau, pos, card),
        "H3": lambda: h3_recency(instalments, balance, bureau, pos, card),
        "H4": lambda: h4_untapped(bureau, previous),
        "H5": lambda: h5_credit_type(bureau),
        "H6": lambda: h6_velocity(previous, bureau),
    }
    return outer_join_features([build[h]() for h in families], APPLICANT)


def experimental_all(tables: dict[str, DataFrame]) -> DataFrame:
    return experimental_features(tables, tuple(FAMILIES))


def experimental_winning(tables: dict[str, DataFrame]) -> DataFrame:
    return experimental_features(tables, WINNING)
