"""Scans, type narrowing, cached builds and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.operators.profiling import column_profile, estimated_profile
from creditloom.sources.schemas import TABLES, column_type


def scan_table(
    spark: SparkSession, name: str, data_dir: str, infer: bool = False, lenient: bool = False
) -> DataFrame:
    """Lazy scan of ``name`` in ``data_dir``: parquet when present, else CSV with a header.

    CSV columns are read as text and cast by declared type, so ``-3648.0`` in an
    integer column is kept.  A value that is no number of its column's type
    (``oops``, or ``3.7`` in an integer column) stops the scan, unless
    ``lenient``: then it is null, and :func:`rejected_values` counts such values.
    ``infer`` lets Spark infer the types instead, at the price of one more pass.
    """
    parquet = _read(lambda: spark.read.parquet(f"{data_dir}/{name}.parquet"))
    if parquet is not None:
        return parquet
    text = _csv_text(spark, name, data_dir, infer)
    return text if infer else text.select([_typed(name, c, lenient) for c in text.columns])


def table_path(spark: SparkSession, name: str, data_dir: str) -> str:
    """The path :func:`scan_table` reads."""
    parquet = f"{data_dir}/{name}.parquet"
    return f"{data_dir}/{name}.csv" if _read(lambda: spark.read.parquet(parquet)) is None else parquet


def _csv_text(spark: SparkSession, name: str, data_dir: str, infer: bool = False) -> DataFrame:
    reader = spark.read.option("header", True).option("escape", '"')  # an empty text is null
    text = _read(lambda: reader.option("inferSchema", infer).csv(f"{data_dir}/{name}.csv"))
    if text is None:
        raise FileNotFoundError(f"no table {name} in {data_dir}")
    return text


def rejected_values(spark: SparkSession, name: str, data_dir: str) -> DataFrame:
    """``column`` and number ``n`` of CSV values that are not of their column's type."""
    text = _csv_text(spark, name, data_dir)
    counts = [
        F.struct(F.lit(c).alias("column"), F.count_if(_is_rejected(name, c)).alias("n"))
        for c in text.columns
    ]
    return text.agg(F.array(*counts).alias("_c")).select(F.inline("_c")).where("n > 0")


def load_table(spark: SparkSession, name: str, data_dir: str) -> DataFrame:
    """Scan ``name`` and give every column the narrowest type that holds it."""
    return narrow_types(scan_table(spark, name, data_dir))


#: One loader per input table: ``LOADERS["bureau"](spark, data_dir)``.
LOADERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: (lambda spark, data_dir, _name=name: load_table(spark, _name, data_dir))
    for name in TABLES
}


def partial_read(df: DataFrame, columns: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """Column subset and/or first rows; ``rows=0`` leaves the schema only."""
    out = df.select(*columns) if columns else df
    return out if rows is None else out.limit(rows)


# --- narrowing -------------------------------------------------------------

#: Integer types from narrow to wide with their closed ranges.
_INTEGER_RANGES = (
    (T.ByteType(), -(2**7), 2**7 - 1),
    (T.ShortType(), -(2**15), 2**15 - 1),
    (T.IntegerType(), -(2**31), 2**31 - 1),
)


def narrow_types(df: DataFrame) -> DataFrame:
    """Integers to the narrowest type holding min..max, doubles to float.

    One aggregate row (two numbers per integer column) decides the casts.
    Columns without any value keep their type.
    """
    whole = [f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)]
    bounds = {}
    if whole:
        bounds = df.agg(
            *(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in whole)
        ).first()

    def narrowed(field: T.StructField) -> Column:
        if isinstance(field.dataType, T.DoubleType):
            return F.col(field.name).cast("float")
        if field.name in whole and bounds[field.name]["lo"] is not None:
            lo, hi = bounds[field.name]
            for kind, least, most in _INTEGER_RANGES:
                if least <= lo and hi <= most:
                    return F.col(field.name).cast(kind)
        return F.col(field.name)

    return df.select([narrowed(f).alias(f.name) for f in df.schema])


def type_report(df: DataFrame, exact: bool = False) -> DataFrame:
    """What narrowing would do: one row per column.

    ``narrow_type`` is the chosen type; text whose distinct count is below half
    of the rows is reported as ``dictionary`` (parquet encodes it that way).  The
    counts are estimated in one aggregate unless ``exact``; the choice differs then
    only for columns within a few percent of that half.
    """
    fits = F.col("dtype")
    for kind, least, most in reversed(_INTEGER_RANGES):
        inside = (F.col("min") >= least) & (F.col("max") <= most)
        fits = F.when(inside, F.lit(kind.simpleString())).otherwise(fits)
    whole = F.col("dtype").isin("tinyint", "smallint", "int", "bigint")
    choice = (
        F.when(F.col("dtype") == "double", F.lit("float"))
        .when(whole & F.col("min").isNotNull(), fits)
        .when(
            (F.col("dtype") == "string") & (F.col("n_unique") < F.col("n_rows") * 0.5),
            F.lit("dictionary"),
        )
        .otherwise(F.col("dtype"))
    )
    profile = column_profile(df) if exact else estimated_profile(df)
    return profile.select("column", choice.alias("narrow_type"), "min", "max", "n_unique")


# --- cached builds and sinks ------------------------------------------------


def parquet_cache(
    spark: SparkSession,
    name: str,
    build: Callable[[], DataFrame],
    cache_dir: str,
    overwrite: bool = False,
) -> DataFrame:
    """Read ``cache_dir/name`` if it exists, else build, write and read it back.

    Reading back gives later stages a lineage that starts at the files.
    ``overwrite`` rebuilds, so a stale table is never reused by accident.
    """
    path = f"{cache_dir}/{name}.parquet"
    if not overwrite:
        found = _read(lambda: spark.read.parquet(path))
        if found is not None:
            return found
    write_parquet(build(), path)
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """CSV with a header: null is an empty field, an empty text a quoted one."""
    mode = "append" if append else "overwrite"
    writer = df.write.mode(mode).option("header", True).option("escape", '"')
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What :func:`write_csv` wrote; an empty field is null, a quoted one an empty text."""
    reader = spark.read.option("header", True).option("escape", '"')
    # by default "" reads as null; no text that a CSV file can hold is this character
    return reader.option("nullValue", "\u0000").schema(schema).csv(path)


def _read(attempt: Callable[[], DataFrame]) -> DataFrame | None:
    """The frame, or None when its path does not exist."""
    try:
        return attempt()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _converted(table: str, column: str) -> Column:
    """The column in its declared type, null where that cannot be."""
    kind = column_type(table, column)
    value = F.col(f"`{column}`")
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, (T.IntegerType, T.LongType)):
        exact = value.try_cast("decimal(38,6)")
        value = F.when(exact == F.floor(exact), exact)
    return value.try_cast(kind)


def _is_rejected(table: str, column: str) -> Column:
    value = F.col(f"`{column}`")
    return F.coalesce(value != "", F.lit(False)) & _converted(table, column).isNull()


def _typed(table: str, column: str, lenient: bool) -> Column:
    typed = _converted(table, column)
    if not lenient and not isinstance(column_type(table, column), T.StringType):
        told = F.concat(F.lit(f"{table}.{column} is not a number: "), F.col(f"`{column}`"))
        typed = F.when(_is_rejected(table, column), F.raise_error(told)).otherwise(typed)
    return typed.alias(column)
