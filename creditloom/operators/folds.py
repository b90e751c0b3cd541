"""Stratified folds and out-of-fold target encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.operators.lookup import is_small, lookup_join, small_side
from creditloom.session import materialised, written
from creditloom.sources.schemas import APPLICANT, LABEL

#: Text columns that are replaced by smoothed target means.
ENCODED = (
    "ORGANIZATION_TYPE",
    "OCCUPATION_TYPE",
    "NAME_INCOME_TYPE",
    "NAME_EDUCATION_TYPE",
    "NAME_HOUSING_TYPE",
    "NAME_FAMILY_STATUS",
)
SMOOTHING = 10.0
#: Hash digits that name a bucket: 16**3 buckets per class.
_DIGITS = 3


def shuffle_order(key: str, seed: int = 42) -> Column:
    """A reproducible pseudo-random sort value per key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def stratified_folds(
    df: DataFrame, k: int = 5, seed: int = 42, key: str = APPLICANT, label: str = LABEL
) -> DataFrame:
    """Add ``fold``: rows of each class, in shuffled order, dealt round robin.

    Rows without a label belong to no class and are left out.

    A window per class would put each class into one task.  Rows are numbered
    within the leading digits of their hash instead, from where the preceding
    buckets end; the hash spreads them evenly, and the bucket sizes are at most
    classes x 4096 rows.
    """
    mixed = df.withColumn("_order", shuffle_order(key, seed))
    mixed = mixed.withColumn("_bucket", F.substring("_order", 1, _DIGITS))
    sizes = mixed.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        label, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(label, "_bucket").orderBy("_order", key)
    numbered = mixed.withColumn("_number", F.row_number().over(inside))
    placed = numbered.join(small_side(written(starts)), [label, "_bucket"])
    fold = (F.col("_start") + F.col("_number") - 1) % k
    return placed.withColumn("fold", fold.cast("int")).drop("_order", "_bucket", "_start", "_number")


def present_encoded(df: DataFrame) -> list[str]:
    """The encoded text columns that ``df`` has."""
    return [c for c in ENCODED if c in df.columns]


def category_statistics(
    df: DataFrame, columns: list[str], label: str = LABEL, by: list[str] | None = None
) -> DataFrame:
    """Rows, label sum and label mean per category of each column, in one pass."""
    by = by or []
    cells = F.array(
        *(F.struct(F.lit(c).alias("column"), F.col(c).alias("category")) for c in columns)
    )
    long = df.select(*by, label, F.inline(cells))
    return long.groupBy(*by, "column", "category").agg(
        F.count(label).alias("cat_count"),
        F.sum(label).alias("cat_sum"),
        F.avg(label).alias("cat_mean"),
    )


def _smoothed(total: Column, count: Column, overall: Column) -> Column:
    return (total + overall * SMOOTHING) / (count + SMOOTHING)


def fold_encodings(df: DataFrame, columns: list[str], label: str = LABEL) -> DataFrame:
    """Smoothed means as model ``fold`` sees them, i.e. without the rows of that fold.

    Per category the rows outside a fold are the total minus the fold, so all
    models come from one aggregation.  Result: ``fold, column, category, value,
    overall``; ``overall`` is the mean of all rows outside the fold and stands
    in for unseen categories.
    """
    cells = category_statistics(df, columns, label, by=["fold"])
    counts = cells.groupBy("column", "category").agg(
        F.sum("cat_count").alias("all_count"), F.sum("cat_sum").alias("all_sum")
    )
    sizes = df.groupBy("fold").agg(F.count(label).alias("_n"), F.sum(label).alias("_s"))
    # k rows: each fold against the sum of all
    every = Window.partitionBy(F.lit(0))
    overall = sizes.select(
        "fold",
        ((F.sum("_s").over(every) - F.col("_s")) / (F.sum("_n").over(every) - F.col("_n"))).alias(
            "overall"
        ),
    )
    # every category meets every fold, also folds it does not occur in
    folds = overall.agg(F.collect_list(F.struct("fold", "overall"))).scalar()  # k entries
    grid = counts.select("*", F.inline(folds))
    rest = grid.join(cells, ["fold", "column", "category"], "left")
    seen = F.col("all_count") - F.coalesce("cat_count", F.lit(0))
    total = F.col("all_sum") - F.coalesce("cat_sum", F.lit(0))
    value = F.when(
        (seen > 0) & F.col("category").isNotNull(), _smoothed(total, seen, F.col("overall"))
    ).otherwise(F.col("overall"))
    return rest.select("fold", "column", "category", value.alias("value"), "overall")


def encode_folds(
    df: DataFrame, columns: list[str] | None = None, label: str = LABEL
) -> DataFrame:
    """Add ``TE_<column>`` to each row, from the rows outside its own fold."""
    encodings = materialised(fold_encodings(df, columns or present_encoded(df), label))
    return _encode(df, encodings, columns, True)


def encode_for_model(
    df: DataFrame, encodings: DataFrame, fold: int, columns: list[str]
) -> DataFrame:
    """``TE_<column>`` as model ``fold`` sees it, for training and held-out rows alike.

    ``encodings`` should be materialised: every fold and column reads it.
    """
    return _encode(df, encodings.where(F.col("fold") == fold).drop("fold"), columns, False)


def encode_every_fold(df: DataFrame, encodings: DataFrame, columns: list[str]) -> DataFrame:
    """``TE_<column>`` as an array over folds: its entry ``k`` is what model ``k`` sees.

    One lookup per column serves all models.  ``encodings`` should be materialised.
    """
    values = F.transform(F.array_sort(F.collect_list(F.struct("fold", "value"))), lambda x: x["value"])
    by_category = encodings.groupBy("column", "category").agg(values.alias("_values"))
    overall = encodings.groupBy("fold").agg(F.max("overall").alias("value"))
    unseen = overall.agg(values).scalar()  # one entry per fold
    small = is_small(encodings)
    out = df
    for name in columns:
        stats = by_category.where((F.col("column") == name) & F.col("category").isNotNull())
        stats = stats.select(F.col("category").alias(name), F.col("_values").alias(f"TE_{name}"))
        out = lookup_join(out, stats, [name], small)
        out = out.withColumn(f"TE_{name}", F.coalesce(f"TE_{name}", unseen))
    return out


def encode_full(
    train: DataFrame, rows: DataFrame, columns: list[str] | None = None, label: str = LABEL
) -> DataFrame:
    """``TE_<column>`` on ``rows`` from the whole training set, for scoring."""
    columns = columns or [c for c in present_encoded(train) if c in rows.columns]
    overall = train.agg(F.avg(label)).scalar()
    stats = category_statistics(train, columns, label)
    encodings = stats.select(
        "column",
        "category",
        _smoothed(F.col("cat_sum"), F.col("cat_count"), overall).alias("value"),
        overall.alias("overall"),
    )
    return _encode(rows, materialised(encodings), columns, False)


def _encode(
    df: DataFrame, encodings: DataFrame, columns: list[str] | None, by_fold: bool
) -> DataFrame:
    """Left join each column's encodings; unseen and null categories get the overall mean."""
    columns = columns or present_encoded(df)
    by = ["fold"] if by_fold else []
    small = is_small(encodings)
    overall = encodings.groupBy(*by).agg(F.max("overall").alias("_overall"))
    if by_fold:
        out = df.join(F.broadcast(overall), "fold", "left")  # one row per fold
    else:
        out = df.withColumn("_overall", overall.scalar())
    for name in columns:
        stats = encodings.where(
            (F.col("column") == name) & F.col("category").isNotNull()
        ).select(*by, F.col("category").alias(name), F.col("value").alias(f"TE_{name}"))
        out = lookup_join(out, stats, [*by, name], small)
        out = out.withColumn(f"TE_{name}", F.coalesce(f"TE_{name}", "_overall"))
    return out.drop("_overall")
