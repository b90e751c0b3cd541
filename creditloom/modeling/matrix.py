"""Feature vectors for Spark ML, which takes no nulls."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame

VECTOR = "features"


def column_fills(df: DataFrame, columns: list[str], median: bool = False) -> dict[str, float]:
    """What replaces null in each column, from one aggregation.

    For trees a value below the column's minimum, so that "unknown" is its own
    branch; for linear models the (approximate) median.
    """
    statistic = "percentile_approx(cast(`{c}` as double), 0.5)" if median else "min(`{c}`)"
    row = df.selectExpr(
        *(f"cast({statistic.format(c=c)} as double) AS `{c}`" for c in columns)
    ).first()  # one number per column

    def fill(value: float | None) -> float:
        if median:
            return 0.0 if value is None else value
        return -1.0 if value is None else value - 1.0 - abs(value) * 0.1

    return {c: fill(row[c]) for c in columns}


def assembled(
    df: DataFrame, columns: list[str], fills: dict[str, float], name: str = VECTOR,
    before: list[str] | None = None,
) -> DataFrame:
    """Add the vector column ``name``; single precision, as the models use it.

    Vector columns ``before`` come first in it, as they are.
    """
    before = before or []
    kept = [c for c in df.columns if c not in columns and c not in before]
    values = (  # as SQL text: one call per column instead of a chain of them
        f"cast(cast(coalesce(nanvl(cast(`{c}` as double), null), {fills[c]!r}D) as float) as double)"
        f" AS `{c}`"
        for c in columns
    )
    vectors = VectorAssembler(inputCols=[*before, *columns], outputCol=name).transform(
        df.selectExpr(*(f"`{c}`" for c in [*kept, *before]), *values)
    )
    return vectors.select(*kept, name)
