"""Inputs and output form of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from creditloom.functions.rounding import grid
from creditloom.sources.mapped import mapped_table, written_detail
from creditloom.sources.schemas import TABLES


class Inputs:
    """The derived tables of one sample folder, by name.

    Queries that read the joined lines many times have them ``shared``: joined and
    written once instead of joined for every reader, as ``form`` tells ``written_detail``.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, shared: bool = False, **form):
        self._spark, self._dir = spark, sf_dir
        self._lines = written_detail(spark, sf_dir, **form) if shared else None

    def __getitem__(self, name: str) -> DataFrame:
        return mapped_table(self._spark, self._dir, name, self._lines)

    def all(self) -> dict[str, DataFrame]:
        return {name: self[name] for name in TABLES}


#: Whether queries return the form their results are compared in, or the operators' own values.
COMPARED = True


def published(df: DataFrame, *keys: str) -> DataFrame:
    """The form in which a result is compared: ``keys`` exact, all else to nine digits.

    Only comparisons need it; with ``COMPARED`` off the values stay as they are.
    Written as SQL text: one expression string per column is parsed in the JVM,
    where a chain of Column calls would cross into it dozens of times.
    """
    if not COMPARED:
        return df

    def form(field: T.StructField) -> str:
        c = f"`{field.name}`"
        if field.name not in keys:
            return f"{grid(f'cast({c} as double)')} AS {c}"
        return f"cast({c} as bigint) AS {c}" if isinstance(field.dataType, T.IntegralType) else c

    return df.selectExpr(*map(form, df.schema))


#: Score columns that stand for the out-of-fold predictions of four models.
SCORES = {
    "score_a": "1e0 - coalesce(EXT_SOURCE_2, 0.5e0)",
    "score_b": "coalesce(EXT_SOURCE_3, 0.5e0)",
    "score_c": "coalesce(EXT_SOURCE_1, 0.5e0)",
    "score_d": "(SK_ID_CURR * 7919 % 1000) / 1e3",
}


def with_scores(applicants: DataFrame) -> DataFrame:
    """Key, label and four scores in 0..1 derived from the applicant row."""
    texts = (f"{expr} AS {name}" for name, expr in SCORES.items())
    return applicants.selectExpr("SK_ID_CURR", "TARGET", *texts)
