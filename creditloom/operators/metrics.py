"""Exact ROC AUC, ROC points and threshold tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.operators.ordered import MOST_PARTS, prefix_totals
from creditloom.session import materialised
from creditloom.sources.schemas import LABEL

#: Distinct scores up to which one task may do the running sums.
WINDOW_SCORES = 2_000_000
#: Thresholds of the decision table: 0.05, 0.10, ..., 0.90.
THRESHOLDS = [0.05 + i * 0.05 for i in range(18)]

POSITIVES, NEGATIVES = "_pos", "_neg"


def rated(df: DataFrame, *scores: str) -> DataFrame:
    """``df``; a row without one of the scores stops the query, since no rank fits it."""
    lost = F.raise_error(F.lit(f"a row has no score ({', '.join(scores)})"))
    whole = reduce(and_, (F.col(s).isNotNull() & ~F.isnan(F.col(s).cast("double")) for s in scores))
    return df.where(F.when(whole, F.lit(True)).otherwise(lost.cast("boolean")))


def score_counts(df: DataFrame, score: str, label: str = LABEL, by: list[str] | None = None) -> DataFrame:
    """Positive and negative rows per distinct score; ties are merged here."""
    return df.groupBy(*(by or []), score).agg(
        F.count_if(F.col(label) == 1).alias(POSITIVES),
        F.count_if(F.col(label) == 0).alias(NEGATIVES),
    )


def _running(
    counts: DataFrame, by: list[str], order: Column, window_scores: int
) -> DataFrame:
    """Add ``_pos_upto`` and ``_neg_upto``, the inclusive running counts in ``order``.

    Up to ``window_scores`` distinct scores one window does; beyond that the
    scores are range-partitioned and each partition starts from its offset.
    """
    names = {f"{POSITIVES}_upto": POSITIVES, f"{NEGATIVES}_upto": NEGATIVES}
    counts = materialised(counts)  # counted, then read: grouped once
    n = counts.count()
    if n > window_scores:
        parts = min(MOST_PARTS, int(n // window_scores) + 1)
        return prefix_totals(counts, by, [order], names, parts)
    keys = [F.col(b) for b in by] or [F.lit(0)]
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return counts.withColumns({name: F.sum(source).over(upto) for name, source in names.items()})


def auc_exact(
    df: DataFrame,
    score: str,
    label: str = LABEL,
    by: list[str] | None = None,
    window_scores: int = WINDOW_SCORES,
) -> DataFrame:
    """Area under the ROC curve per group, tied scores counting half.

    Pairs are counted in decimal arithmetic: with 10^9 rows of each class a
    64-bit product would overflow.  A group with one class only has no AUC; a row
    without a score is an error.
    """
    return auc_of_counts(score_counts(rated(df, score), score, label, by), score, by, window_scores)


def auc_of_counts(
    counts: DataFrame, score: str, by: list[str] | None = None, window_scores: int = WINDOW_SCORES
) -> DataFrame:
    """:func:`auc_exact` from the :func:`score_counts` of the rows."""
    by = by or []
    upto = _running(counts, by, F.col(score).asc(), window_scores)
    wide = "decimal(38,0)"
    pairs = F.col(POSITIVES).cast("decimal(18,0)") * (
        (F.col(f"{NEGATIVES}_upto") * 2 - F.col(NEGATIVES)).cast("decimal(19,0)")
    )
    sums = upto.groupBy(*by).agg(
        F.sum(POSITIVES).alias("n_pos"),
        F.sum(NEGATIVES).alias("n_neg"),
        F.sum(pairs.cast(wide)).cast("double").alias("_twice"),
    )
    area = F.try_divide(
        "_twice", F.lit(2.0) * F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    )
    return sums.select(*by, area.alias("auc"), "n_pos", "n_neg")


def roc_points(
    df: DataFrame, score: str, label: str = LABEL, window_scores: int = WINDOW_SCORES
) -> DataFrame:
    """False and true positive rate at each distinct score used as threshold."""
    counts = score_counts(rated(df, score), score, label)
    sizes = counts.agg(F.struct(F.sum(POSITIVES).alias("p"), F.sum(NEGATIVES).alias("n"))).scalar()
    upto = _running(counts, [], F.col(score).desc(), window_scores)
    return upto.select(
        F.col(score).alias("threshold"),
        F.try_divide(F.col(f"{NEGATIVES}_upto"), sizes.getField("n")).alias("fpr"),
        F.try_divide(F.col(f"{POSITIVES}_upto"), sizes.getField("p")).alias("tpr"),
    )


def threshold_table(df: DataFrame, score: str, label: str = LABEL) -> DataFrame:
    """Decision quality at 18 thresholds; a score at or above one is a decline.

    Rows are counted once, by the number of thresholds they reach; each
    threshold then adds up at most 19 counts instead of looking at every row.
    """
    reached = F.lit(0)
    for t in THRESHOLDS:
        reached = reached + (F.col(score) >= F.lit(t)).cast("int")
    levels = rated(df, score).groupBy(reached.alias("_level")).agg(
        F.count_if(F.col(label) == 1).alias(POSITIVES),
        F.count_if(F.col(label) == 0).alias(NEGATIVES),
        F.count(F.lit(1)).alias("_n"),
    )
    steps = F.array(
        *(
            F.struct(F.lit(i + 1).alias("_step"), F.lit(round(t, 2)).alias("threshold"))
            for i, t in enumerate(THRESHOLDS)
        )
    )
    declined = F.col("_level") >= F.col("_step")
    cells = levels.select("*", F.inline(steps)).groupBy("threshold").agg(
        F.sum(F.when(declined, F.col(POSITIVES)).otherwise(0)).alias("tp"),
        F.sum(F.when(declined, F.col(NEGATIVES)).otherwise(0)).alias("fp"),
        F.sum(POSITIVES).alias("p"),
        F.sum(F.when(declined, F.col("_n")).otherwise(0)).alias("declined"),
        F.sum("_n").alias("n"),
    )

    def part(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))

    precision = part(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = part(F.col("tp"), F.col("p"))
    rates = cells.withColumns({"_precision": precision, "_recall": recall})
    f1 = part(2 * F.col("_precision") * F.col("_recall"), F.col("_precision") + F.col("_recall"))
    return rates.select(
        "threshold",
        F.round("_precision", 4).alias("precision"),
        F.round("_recall", 4).alias("recall"),
        F.round(f1, 4).alias("f1"),
        F.round((F.col("n") - F.col("declined")) / F.col("n"), 4).alias("approval_rate"),
        F.round(F.col("declined") / F.col("n"), 4).alias("decline_rate"),
        F.col("tp").alias("true_positives"),
        F.col("fp").alias("false_positives"),
    )


def threshold_lookup(table: DataFrame, wanted: tuple[float, ...] = (0.1, 0.2, 0.3, 0.5)) -> DataFrame:
    """Rows of the threshold table at given thresholds, matched as whole percent."""
    percent = F.round(F.col("threshold") * 100).cast("int")
    return table.where(percent.isin(*(round(w * 100) for w in wanted)))
