"""Choosing features by importance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.sources.schemas import LABEL


def correlation_importance(
    df: DataFrame, columns: list[str], label: str = LABEL, by: list[str] | None = None
) -> DataFrame:
    """Absolute correlation of each column with the label: a model-free importance.

    Rows are laid out as ``(column, value, label)`` and aggregated by column, with
    partial results combined in the map tasks.  Hundreds of correlations side by
    side would need an aggregation buffer of thousands of fields.  A constant
    column has no correlation and gets zero.  ``by`` adds grouping columns.
    """
    by = by or []
    y = F.col(label).cast("double")
    cells = F.array(
        *(
            F.struct(F.lit(i).alias("_which"), F.col(c).cast("double").alias("_x"))
            for i, c in enumerate(columns)
        )
    )
    long = df.select(*by, y.alias("_y"), F.inline(cells))
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    x, y = F.when(both, F.col("_x")), F.when(both, F.col("_y"))
    # corr() raises on a constant column in ANSI mode
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    size = F.coalesce(F.nanvl(F.abs(r), F.lit(0.0)), F.lit(0.0))
    feature = F.get(F.array(*map(F.lit, columns)), F.col("_which"))
    sizes = long.groupBy(*by, "_which").agg(size.alias("importance"))
    return sizes.select(*by, feature.alias("feature"), "importance")


def mean_importance(per_model: DataFrame) -> DataFrame:
    """Average importance of each feature over the fold models."""
    return per_model.groupBy("feature").agg(F.avg("importance").alias("importance"))


def top_features(importance: DataFrame, n: int = 30) -> DataFrame:
    """The ``n`` most important features."""
    return importance.orderBy(F.col("importance").desc(), "feature").limit(n)


def prune_features(importance: DataFrame, percent: float = 10.0) -> DataFrame:
    """Features above the given percentile of the positive importances.

    ``encoded`` marks target-encoded columns, which are chosen by their source.
    """
    positive = importance.where(F.col("importance") > 0)
    cut = positive.agg(F.percentile("importance", percent / 100)).scalar()
    kept = positive.where(F.col("importance") > cut)
    return kept.withColumn("encoded", F.col("feature").startswith("TE_"))


def importance_by_group(importance: DataFrame, prefixes: list[str], top: int = 5) -> DataFrame:
    """Per name prefix: total importance, features with any, and the ``top`` best of them."""
    group = F.lit("raw")
    for prefix in reversed(prefixes):
        group = F.when(F.col("feature").startswith(prefix), F.lit(prefix)).otherwise(group)
    grouped = importance.withColumn("prefix", group)
    # the importance table has one row per feature
    order = Window.partitionBy("prefix").orderBy(F.col("importance").desc(), "feature")
    totals = grouped.groupBy("prefix").agg(
        F.sum("importance").alias("total"), F.count_if(F.col("importance") > 0).alias("used")
    )
    best = grouped.withColumn("place", F.row_number().over(order)).where(
        (F.col("place") <= top) & (F.col("importance") > 0)
    )
    return totals.join(best, "prefix", "left")


def class_weights(df: DataFrame, positive: float | None = None, label: str = LABEL) -> DataFrame:
    """Add ``weight``: ``positive`` for label 1 and 1 otherwise, or balanced by class size."""
    if positive is not None:
        return df.withColumn("weight", F.when(F.col(label) == 1, positive).otherwise(1.0))
    sizes = df.agg(
        F.struct(F.count(label).alias("n"), F.sum(F.col(label).cast("double")).alias("p"))
    ).scalar()
    n, p = sizes.getField("n"), sizes.getField("p")
    balanced = F.when(F.col(label) == 1, n / (2 * p)).otherwise(n / (2 * (n - p)))
    return df.withColumn("weight", balanced)


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same ones for the same seed.

    They are the rows with the smallest hashes of their keys.  Counts per leading
    hash digits tell the bucket in which the ``n``-th row lies; that bucket alone is
    counted further, by its next digits.  So rows are chosen by a comparison and
    never brought into one task, however many are wanted.  Rows of one key have one
    hash: of those at the border as many are taken as are missing.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    border, missing = "", n
    while missing > 0 and len(border) < 32:
        inside = df.where(order.startswith(border)).groupBy(
            F.substring(order, len(border) + 1, _DIGITS).alias("digits")
        )
        counts = sorted(inside.count().collect())  # at most 16**_DIGITS rows
        if sum(c for _, c in counts) <= missing:
            return df if not border else df.where((order < border) | order.startswith(border))
        for digits, count in counts:
            if count > missing:
                border += digits
                break
            missing -= count
    below = df.where(order < border)
    return below if missing <= 0 else below.union(df.where(order.startswith(border)).limit(missing))


#: Hash digits counted at a time when a sample is drawn.
_DIGITS = 3
