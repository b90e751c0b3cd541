"""Joins against tables that are usually, but not surely, small."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a lookup table is sent to every executor.
BROADCAST_ROWS = 500_000
#: Rows of one key that a task gets at most when the lookup is too large to broadcast.
KEY_ROWS = 1_000_000


def is_small(lookup: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> bool:
    """Whether the table has at most ``broadcast_rows`` rows; counts no further."""
    return lookup.limit(broadcast_rows + 1).count() <= broadcast_rows


def small_side(lookup: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table marked for broadcast if its rows were counted to be few, else as it is."""
    return F.broadcast(lookup) if is_small(lookup, broadcast_rows) else lookup


def lookup_join(
    rows: DataFrame, lookup: DataFrame, on: list[str], small: bool | None = None
) -> DataFrame:
    """Left join of many rows to a lookup with unique keys.

    Lookup keys such as categories are skewed: one of them may own a third of
    the rows.  A lookup of counted, small size is broadcast, so rows do not move.
    A larger one is joined on key and salt, with as many salts as the most
    frequent key needs for tasks of ``KEY_ROWS`` rows; the lookup is repeated once
    per salt.  ``small`` passes on a size check made before.
    """
    if is_small(lookup) if small is None else small:
        return rows.join(F.broadcast(lookup), on, "left")
    most = rows.groupBy(*on).count().agg(F.max("count")).first()[0] or 0
    salts = max(1, -(-most // KEY_ROWS))
    if salts == 1:
        return rows.join(lookup, on, "left")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"], "left").drop("_salt")


def join_features(base: DataFrame, features: list[DataFrame], key: str) -> DataFrame:
    """Left join feature tables with one row per key onto ``base``, one after the other.

    Each feature table comes out of a grouping on ``key`` and is already
    partitioned by it, so only ``base`` is shuffled, once for all joins.
    """
    return reduce(lambda left, right: left.join(right, key, "left"), features, base)


def outer_join_features(features: list[DataFrame], key: str) -> DataFrame:
    """Full outer join of feature tables with one row per key, all other columns distinct.

    The tables are put below each other with nulls for the columns they lack and
    grouped once: a chain of full joins would move the growing left side at every
    step.  Rows without a key become one row.
    """
    rows = reduce(lambda above, below: above.unionByName(below, allowMissingColumns=True), features)
    names = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(*(F.max(c).alias(c) for c in names))
