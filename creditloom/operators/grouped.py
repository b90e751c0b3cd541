"""Grouped passes: one aggregation per table, distinct counts on the side."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class FeatureGroup:
    """Features that one grouped pass over a table yields.

    ``rows`` are helper columns of the ungrouped table, ``aggregates`` aliased
    aggregate expressions, ``distinct`` names a column whose distinct values are
    counted, ``derived`` columns computed from the aggregates.
    """

    rows: dict[str, Column] = field(default_factory=dict)
    aggregates: list[Column] = field(default_factory=list)
    distinct: dict[str, str] = field(default_factory=dict)
    derived: dict[str, Column] = field(default_factory=dict)


def roll_up(df: DataFrame, key: str, *groups: FeatureGroup) -> DataFrame:
    """Compute several feature groups of one table in a single grouped pass.

    Spark combines within each map task before the shuffle, so a key holding a
    large part of the rows costs its task one partial row per mapper.
    """
    rows, aggregates, distinct, derived = {}, [], {}, {}
    for group in groups:
        rows |= group.rows
        aggregates += group.aggregates
        distinct |= group.distinct
        derived |= group.derived
    out = df.withColumns(rows).groupBy(key).agg(*aggregates)
    if distinct:
        out = out.join(distinct_counts(df, key, distinct), key, "left")
    return out.withColumns(derived)


def distinct_counts(df: DataFrame, key: str, named: dict[str, str]) -> DataFrame:
    """Distinct values per key for several columns, null counting as a value.

    Several ``count(DISTINCT ...)`` in a wide aggregation make Spark copy every
    row once per column and shuffle the full set of aggregation buffers for each
    copy.  Here only ``(key, column number, value)`` is copied and deduplicated,
    and the values of a large key spread over many tasks.
    """
    kinds = {df.schema[source].dataType for source in named.values()}
    shared = kinds.pop() if len(kinds) == 1 else T.StringType()  # text only for mixed types
    pairs = [
        F.struct(F.lit(i).alias("_which"), F.col(source).cast(shared).alias("_value"))
        for i, source in enumerate(named.values())
    ]
    seen = df.select(key, F.inline(F.array(*pairs))).distinct()
    counts = [F.count_if(F.col("_which") == i).alias(name) for i, name in enumerate(named)]
    return seen.groupBy(key).agg(*counts)


def count_values(df: DataFrame, column: str) -> DataFrame:
    """Frequency and share of each value, null included."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n")).scalar()  # one number, from the same grouping
    return counts.select(F.col(column).alias("value"), "n", (F.col("n") / whole).alias("share"))


def rows_per_key(df: DataFrame, key: str) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of the number of rows per key.

    Group sizes are first reduced to how often each size occurs, so the exact
    percentiles work on that short table, not on one value per key.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    often = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("times"))
    n, s = F.sum("times"), F.sum(F.col("size") * F.col("times"))
    mean = often.agg(s / n).scalar()  # one number
    apart = F.sum(F.pow(F.col("size") - mean, 2) * F.col("times"))
    variance = F.try_divide(apart, n - 1)
    quart = {q: F.percentile("size", p, F.col("times")) for q, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))}
    return often.agg(
        n.alias("keys"),
        (s / n).alias("mean"),
        F.sqrt(variance).alias("std"),
        F.min("size").alias("min"),
        *(expr.alias(name) for name, expr in quart.items()),
        F.max("size").alias("max"),
    )
