"""Row-wise helpers.

Spark runs in ANSI mode, where a zero divisor raises; these helpers give null
instead.  ``greatest`` and ``least`` skip nulls, so clipping guards its input.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days in a year as the features count them.
YEAR = 365.25


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def filled(value: str | Column, default: float = 0.0) -> Column:
    return F.coalesce(col(value), F.lit(default))


def ratio(top: str | Column, bottom: str | Column) -> Column:
    """Quotient as double; null when the divisor is zero."""
    return F.try_divide(col(top).cast("double"), col(bottom).cast("double"))


def per(top: str | Column, bottom: str | Column) -> Column:
    """Ratio with the divisor shifted by one, the damped form most features use."""
    return ratio(top, col(bottom) + 1)


def years_back(days: str | Column) -> Column:
    """A negative day offset as positive years."""
    return col(days) / F.lit(-YEAR)


def nonzero(value: str | Column) -> Column:
    return F.nullif(col(value), F.lit(0))


def clipped(value: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounds that keep null null."""
    out = col(value)
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(col(value).isNotNull(), out)


def flag(condition: Column) -> Column:
    return condition.cast("int")


def missing(value: str | Column) -> Column:
    return flag(col(value).isNull())


def present(value: str | Column) -> Column:
    return flag(col(value).isNotNull())


def total_of(values: Iterable[Column]) -> Column:
    return reduce(add, values)


def filled_sum(names: Iterable[str]) -> Column:
    """Horizontal sum with null as zero; integers are widened before adding."""
    return total_of(F.coalesce(F.col(n).cast("long"), F.lit(0).cast("long")) for n in names)


def as_number(value: str | Column) -> Column:
    """Text to double; what does not parse is null."""
    return col(value).try_cast("double")
