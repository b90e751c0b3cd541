"""Aggregate expressions.

Every statistic takes an optional row condition, so that what would be several
filtered copies of a table joined back together is one grouped pass.  A subset
without any row gives null, as the join would: minima, maxima and means do so
by themselves, counts and sums are guarded by ``subset``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditloom.functions.scalar import col


def _within(value: Column, where: Column | None) -> Column:
    return value if where is None else F.when(where, value)


def rows(where: Column | None = None) -> Column:
    return F.count(F.lit(1)) if where is None else F.count_if(where)


def mean(value: str | Column, where: Column | None = None) -> Column:
    return F.avg(_within(col(value), where))


def top(value: str | Column, where: Column | None = None) -> Column:
    return F.max(_within(col(value), where))


def low(value: str | Column, where: Column | None = None) -> Column:
    return F.min(_within(col(value), where))


def spread(value: str | Column, where: Column | None = None) -> Column:
    """Sample standard deviation; null for a single value."""
    return F.stddev_samp(_within(col(value), where))


def total(value: str | Column, where: Column | None = None) -> Column:
    """Sum that is zero, not null, when there is nothing to add."""
    return F.coalesce(F.sum(_within(col(value), where)), F.lit(0))


def share(condition: Column, where: Column | None = None) -> Column:
    """Part of the rows meeting ``condition``; rows where it is null do not count."""
    return F.avg(_within(condition.cast("double"), where))


_STATISTICS = {
    "MEAN": mean,
    "MAX": top,
    "MIN": low,
    "STD": spread,
    "TOTAL": total,
    "SUM": total,
}


def stats(prefix: str, value: str | Column, names: str, where: Column | None = None) -> list[Column]:
    """``stats("X", "AMT", "MEAN MAX")`` gives columns ``X_MEAN`` and ``X_MAX``."""
    return [_STATISTICS[n](value, where).alias(f"{prefix}_{n}") for n in names.split()]


def tally(source: str, labels: dict[str, str | list[str]], name: str = "{}") -> list[Column]:
    """One conditional row count per label of a text column."""
    out = []
    for short, wanted in labels.items():
        wanted = wanted if isinstance(wanted, list) else [wanted]
        out.append(F.count_if(F.col(source).isin(*wanted)).alias(name.format(short)))
    return out


def subset(where: Column, value: Column) -> Column:
    """``value`` if the group has any row in the subset, else null."""
    return F.when(F.count_if(where) > 0, value)
