"""Order-dependent operators per key: ranks, halves, last rows, gaps.

A window per key puts all rows of that key into one task.  That is the right
plan for ordinary keys, but a key with a large part of the table would stall
the job.  Keys above ``hot_rows`` rows therefore leave the window: their rows
are range-partitioned by the full order, counted per partition and numbered
from the partition's offset, which gives the same ranks from many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.operators.lookup import small_side
from creditloom.session import materialised, written

#: Rows from which a key no longer goes through a single task.
HOT_ROWS = 1_000_000

#: Most range partitions for large keys; beyond it the partitions grow and spill.
MOST_PARTS = 10_000

RANK, SIZE, COPIES = "_before", "_size", "_copies"

#: In place of large keys: they are not known yet.
COUNT = "count"


#: Hash buckets in which keys are counted together first.
BUCKETS = 2**18


def _weight(df: DataFrame) -> Column:
    return F.sum(COPIES) if COPIES in df.columns else F.count(F.lit(1))


def most_rows(df: DataFrame, key: str) -> int:
    """A number that no key's rows exceed: the rows of the fullest hash bucket.

    A task sends at most ``BUCKETS`` counts, however many keys there are.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("_bucket")
    filled = df.where(F.col(key).isNotNull()).groupBy(bucket).agg(_weight(df).alias("_rows"))
    return filled.agg(F.max("_rows")).first()[0] or 0


def hot_keys(
    df: DataFrame, key: str, hot_rows: int = HOT_ROWS, sizes: DataFrame | None = None
) -> DataFrame | None:
    """Keys with at least ``hot_rows`` rows, or None when there is no such key.

    There are at most ``rows / hot_rows`` of them.  Where :func:`most_rows` leaves none,
    as a rule, no key is counted by itself.  The counting pass reads the
    key column alone and combines before its shuffle; its short result is
    checkpointed, so it is computed once.  ``sizes`` has the key and ``_rows``, where a
    cheaper plan than that of ``df`` counts them.
    """
    if sizes is None:
        if most_rows(df, key) < hot_rows:
            return None
        sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(_weight(df).alias("_rows"))
    found = sizes.where(F.col("_rows") >= hot_rows)
    if found.limit(1).count() == 0:
        return None
    return materialised(found)


def ranked(
    df: DataFrame, key: str, time: str, ties: list[str], hot_rows: int = HOT_ROWS,
    hot: DataFrame | str | None = COUNT,
) -> DataFrame:
    """Add the number of earlier rows (``_before``) and the group size (``_size``).

    Earlier means by ``time`` and then ``ties``; a row without a time has no
    rank but counts for the size.  ``_copies`` gives how many equal rows a row
    stands for (1 unless the input carries that column).  The ties must end in
    every column used later, so that rows left in a tie are interchangeable.
    ``hot`` is what :func:`hot_keys` found, if it was asked before.
    """
    df = df.where(F.col(key).isNotNull())
    if isinstance(hot, str):
        hot = hot_keys(df, key, hot_rows)
    if hot is None:
        return _ranked_by_window(df, key, time, ties)
    if COPIES not in df.columns:
        df = df.withColumn(COPIES, F.lit(1).cast("long"))
    names = small_side(hot.select(key))  # at most rows / hot_rows keys
    cold = _ranked_by_window(df.join(names, key, "left_anti"), key, time, ties)
    hot_total = hot.agg(F.sum("_rows")).first()[0]
    parts = min(MOST_PARTS, max(2, int(hot_total // hot_rows) + 1))
    large = _ranked_by_range(df.join(names, key, "left_semi"), key, time, ties, parts)
    return cold.unionByName(large)


def _order(time: str, ties: list[str]) -> list[Column]:
    return [F.col(time).asc_nulls_last(), *(F.col(t).asc_nulls_first() for t in ties)]


def _ranked_by_window(df: DataFrame, key: str, time: str, ties: list[str]) -> DataFrame:
    if COPIES not in df.columns:  # a column less to move and sort
        order = Window.partitionBy(key).orderBy(*_order(time, ties))
        return df.withColumns(
            {
                RANK: F.when(F.col(time).isNotNull(), (F.row_number().over(order) - 1).cast("long")),
                SIZE: F.count(F.lit(1)).over(Window.partitionBy(key)),
            }
        ).withColumn(COPIES, F.lit(1).cast("long"))
    running = Window.partitionBy(key).orderBy(*_order(time, ties)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    before = F.sum(COPIES).over(running) - F.col(COPIES)
    return df.withColumns(
        {
            RANK: F.when(F.col(time).isNotNull(), before),
            SIZE: F.sum(COPIES).over(Window.partitionBy(key)),
        }
    )


def _ranked_by_range(df: DataFrame, key: str, time: str, ties: list[str], parts: int) -> DataFrame:
    """The same two columns for large keys, none of which fits one task.

    Equal rows are told apart by a number, so that even a key of equal rows is
    cut into ranges; the rows are written with it before they are dealt out.
    """
    columns = [c for c in df.columns if c != COPIES]
    numbered = materialised(df.withColumn("_tie", F.monotonically_increasing_id()))
    order = [*_order(time, ties), F.col("_tie").asc()]
    spread = prefix_totals(numbered, [key], order, {RANK: COPIES}, parts)
    sizes = df.groupBy(key).agg(F.sum(COPIES).alias(SIZE))
    out = spread.join(F.broadcast(sizes), key)  # one row per large key
    before = F.col(RANK) - F.col(COPIES)
    return out.withColumn(RANK, F.when(F.col(time).isNotNull(), before)).select(
        *columns, COPIES, RANK, SIZE
    )


def prefix_totals(
    df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, str], parts: int
) -> DataFrame:
    """Inclusive running sums in ``order`` within ``keys``, without one task per key.

    Rows are range-partitioned by key and order.  The partition number is kept
    as a column and checkpointed, so it stays the same however often tasks are
    rerun.  Each partition is summed locally and shifted by the sums of the
    partitions before it, a table of at most ``parts`` rows more than keys.
    """
    placed = materialised(
        df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id())
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    blocks = placed.groupBy(*keys, "_part").agg(
        *(F.sum(source).alias(f"_block_{name}") for name, source in sums.items())
    )
    offsets = blocks.select(
        *keys,
        "_part",
        *(
            F.coalesce(F.sum(f"_block_{name}").over(earlier), F.lit(0)).alias(f"_shift_{name}")
            for name in sums
        ),
    )
    local = placed.withColumns({name: F.sum(src).over(inside) for name, src in sums.items()})
    joined = local.join(small_side(written(offsets)), [*keys, "_part"])
    moved = joined.withColumns({name: F.col(name) + F.col(f"_shift_{name}") for name in sums})
    return moved.drop("_part", *(f"_shift_{name}" for name in sums))


# --- operators built on ranks -----------------------------------------------

OLDER, RECENT = "_older", "_recent"


def split_halves(
    df: DataFrame,
    key: str,
    time: str,
    ties: list[str],
    min_records: int = 4,
    hot_rows: int = HOT_ROWS,
    hot: DataFrame | str | None = COUNT,
) -> DataFrame:
    """Put each row into the older or the recent half of its group.

    ``_older`` and ``_recent`` say how many of the copies a row stands for fall
    into each half; with an odd size the middle row is recent.  Groups below
    ``min_records`` rows are left out, as are rows without a time.
    """
    rows = ranked(df, key, time, ties, hot_rows, hot)
    rows = rows.where((F.col(SIZE) >= min_records) & F.col(RANK).isNotNull())
    half = F.floor(F.col(SIZE) / 2)
    older = F.least(F.greatest(half - F.col(RANK), F.lit(0)), F.col(COPIES))
    return rows.withColumn(OLDER, older).withColumn(RECENT, F.col(COPIES) - F.col(OLDER))


def half_mean(value: Column, half: str) -> Column:
    """Mean over one half, weighted by the copies in it; null values do not count."""
    copies = F.col(half).cast("double")
    held = F.when(value.isNotNull(), copies)
    return F.try_divide(F.sum(copies * value.cast("double")), F.sum(held))


def half_max(value: Column, half: str) -> Column:
    return F.max(F.when(F.col(half) > 0, value))


def compare_halves(
    halves: DataFrame, key: str, older: list[Column], recent: list[Column]
) -> DataFrame:
    """Both halves' statistics side by side, for groups that have both."""
    both = halves.groupBy(key).agg(
        F.sum(OLDER).alias("_n_older"), F.sum(RECENT).alias("_n_recent"), *older, *recent
    )
    return both.where((F.col("_n_older") > 0) & (F.col("_n_recent") > 0)).drop(
        "_n_older", "_n_recent"
    )


def last_rows(df: DataFrame, key: str, time: str, ties: list[str], count: int) -> DataFrame:
    """The latest ``count`` rows of each key, numbered ``rn`` from 1.

    Rows without a time come first.  Spark limits each map task's groups to
    ``count`` rows before the shuffle, so a large key sends few rows.
    """
    order = [F.col(time).desc_nulls_first(), *(F.col(t).asc_nulls_first() for t in ties)]
    number = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("rn", number).where(F.col("rn") <= count)


def gap_statistics(
    df: DataFrame, key: str, time: str, names: dict[str, str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Minimum, mean and deviation of the steps between consecutive times.

    ``names`` maps ``min``, ``mean`` and ``std`` to output columns.  Ordinary
    keys use ``lag``.  For a large key equal times are merged first: its gaps
    are the steps between distinct times, and zero for every repetition.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, time)
    hot = hot_keys(rows, key, hot_rows)
    if hot is None:
        return _gaps_by_lag(rows, key, time, names)
    large = small_side(hot.select(key))
    cold = _gaps_by_lag(rows.join(large, key, "left_anti"), key, time, names)
    merged = _gaps_by_time(rows.join(large, key, "left_semi"), key, time, names)
    return cold.unionByName(merged)


def with_gaps(df: DataFrame, key: str, time: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``gap``: step from the previous time of the same key, null for the first.

    A key of at least ``hot_rows`` rows is cut into ranges of time; the first
    row of a range takes the last time of the range before it.
    """
    hot = hot_keys(df, key, hot_rows)
    if hot is None:
        return _with_gaps_by_window(df, key, time)
    names = small_side(hot.select(key))  # at most rows / hot_rows keys
    cold = _with_gaps_by_window(df.join(names, key, "left_anti"), key, time)
    hot_total = hot.agg(F.sum("_rows")).first()[0]
    parts = min(MOST_PARTS, max(2, int(hot_total // hot_rows) + 1))
    large = _with_gaps_by_range(df.join(names, key, "left_semi"), key, time, parts)
    return cold.unionByName(large)


def _with_gaps_by_window(df: DataFrame, key: str, time: str) -> DataFrame:
    previous = F.lag(time, 1).over(Window.partitionBy(key).orderBy(F.col(time).asc_nulls_first()))
    return df.withColumn("gap", F.col(time) - previous)


def _with_gaps_by_range(df: DataFrame, key: str, time: str, parts: int) -> DataFrame:
    numbered = materialised(df.withColumn("_tie", F.monotonically_increasing_id()))
    order = [F.col(time).asc_nulls_first(), F.col("_tie").asc()]
    placed = materialised(
        numbered.repartitionByRange(parts, key, *order).withColumn("_part", F.spark_partition_id())
    )
    inside = Window.partitionBy(key, "_part").orderBy(*order)
    ends = placed.groupBy(key, "_part").agg(F.max(time).alias("_last"))
    before = ends.select(
        key, "_part", F.lag("_last").over(Window.partitionBy(key).orderBy("_part")).alias("_before")
    )
    joined = placed.join(small_side(written(before)), [key, "_part"])  # parts and keys at most
    first = F.row_number().over(inside) == 1
    previous = F.when(first, F.col("_before")).otherwise(F.lag(time).over(inside))
    return joined.withColumn("gap", F.col(time) - previous).select(*df.columns, "gap")


def _gaps_by_lag(rows: DataFrame, key: str, time: str, names: dict[str, str]) -> DataFrame:
    steps = _with_gaps_by_window(rows, key, time).where(F.col("gap").isNotNull())
    return steps.groupBy(key).agg(
        F.min("gap").alias(names["min"]),
        F.avg("gap").alias(names["mean"]),
        F.stddev_samp("gap").alias(names["std"]),
    )


def _gaps_by_time(rows: DataFrame, key: str, time: str, names: dict[str, str]) -> DataFrame:
    times = rows.groupBy(key, time).agg(F.count(F.lit(1)).alias("_times"))
    # whole-number offsets: one row per distinct day or month of the key
    steps = _with_gaps_by_window(times, key, time)
    zeros = F.sum(F.col("_times") - 1)
    gap = F.col("gap").cast("double")
    n, s = F.count("gap") + zeros, F.coalesce(F.sum(gap), F.lit(0.0))
    # deviation of the gaps, and of their mean from the zeros
    spread = F.coalesce(F.var_pop(gap), F.lit(0.0)) * F.count("gap")
    apart = F.try_divide(F.count("gap") * zeros, n) * F.pow(F.coalesce(F.avg(gap), F.lit(0.0)), 2)
    variance = F.try_divide(spread + F.coalesce(apart, F.lit(0.0)), n - 1)
    smallest = F.when(zeros > 0, F.lit(0)).otherwise(F.min("gap"))
    return steps.groupBy(key).agg(
        smallest.cast(rows.schema[time].dataType).alias(names["min"]),
        F.try_divide(s, n).alias(names["mean"]),
        F.sqrt(F.greatest(variance, F.lit(0.0))).alias(names["std"]),
        n.alias("_n"),
    ).where(F.col("_n") > 0).drop("_n")
