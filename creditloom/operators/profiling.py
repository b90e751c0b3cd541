"""Column profiles, missing-value reports and table sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, nulls, distinct values (null is one), min, max, mean.

    The table is laid out as ``(column number, value)`` and counted by it, in one
    pass.  From the counted values everything follows, exact distinct counts
    included: a wide ``count(DISTINCT)`` would copy every row once per column, and
    here no column's values have to meet in one task.  A value stays in its own
    kind (text, whole number, real), as turning numbers into text costs more than
    the counting.  Minimum, maximum and mean are reported for numeric columns.
    """
    names = [f.name for f in df.schema]
    kinds = [f.dataType.simpleString() for f in df.schema]

    def cell(i: int, field: T.StructField) -> str:
        whole = isinstance(field.dataType, T.IntegralType)
        real = isinstance(field.dataType, (T.DoubleType, T.FloatType))
        parts = {"_text": not whole and not real, "_whole": whole, "_real": real}
        types = {"_text": "string", "_whole": "bigint", "_real": "double"}
        fields = ", ".join(
            f"'{n}', cast({f'`{field.name}`' if here else 'null'} as {types[n]})"
            for n, here in parts.items()
        )
        return f"named_struct('_which', {i}, {fields})"

    # as SQL text: one call for the whole table instead of a dozen per column
    laid_out = ", ".join(cell(i, f) for i, f in enumerate(df.schema))
    cells = df.selectExpr(f"inline(array({laid_out}))")
    counted = cells.groupBy("_which", "_text", "_whole", "_real").agg(
        F.count(F.lit(1)).alias("n")
    )
    decimals = [i for i, f in enumerate(df.schema) if isinstance(f.dataType, T.DecimalType)]
    text_number = F.when(F.col("_which").isin(decimals), F.col("_text").try_cast("double"))
    number = F.coalesce(F.col("_real"), F.col("_whole").cast("double"), text_number)
    values = counted.select(
        "_which", "n", number.alias("number"),
        (F.col("_text").isNull() & F.col("_whole").isNull() & F.col("_real").isNull()).alias("empty"),
    )
    numbers = F.sum(F.when(F.col("number").isNotNull(), F.col("n")))
    summary = values.groupBy("_which").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("empty"), F.col("n"))), F.lit(0)).alias("n_null"),
        F.count(F.lit(1)).alias("n_unique"),
        F.min("number").alias("min"),
        F.max("number").alias("max"),
        F.try_divide(F.sum(F.col("number") * F.col("n")), numbers).alias("mean"),
    )

    about = ", ".join(f"struct('{n}', '{k}')" for n, k in zip(names, kinds, strict=True))
    named = summary.withColumn("_about", F.expr(f"get(array({about}), _which)"))
    return named.select(
        F.col("_about.col1").alias("column"), F.col("_about.col2").alias("dtype"),
        "n_rows", "n_null", "n_unique", "min", "max", "mean",
    )


#: Two to this power are the registers of a distinct-count sketch.
SKETCH_BITS = 12
#: Relative standard error of a sketch of that size; three of them are rarely exceeded.
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def estimated_profile(df: DataFrame) -> DataFrame:
    """:func:`column_profile` with estimated distinct counts, by one plain aggregate.

    Each column has a mergeable sketch of 4 kB at most, filled in the map tasks; no
    value is shuffled.  ``n_unique`` is off by ``SKETCH_ERROR`` (1.6 %) as a rule,
    all else is exact.
    """
    # as SQL text, aggregates first: thousands of calls and one nested aggregate took
    # longer to plan than the tables to read
    aggregates, rows = ["count(1) AS n"], []
    for i, field in enumerate(df.schema):
        c = field.name.replace("`", "``")
        name = field.name.replace("\\", "\\\\").replace("'", "\\'")
        aggregates += [
            f"count(`{c}`) AS c{i}",
            f"hll_sketch_agg(xxhash64(`{c}`), {SKETCH_BITS}) FILTER (WHERE `{c}` IS NOT NULL) AS k{i}",
        ]
        bounds = ["cast(null AS double)"] * 3
        if isinstance(field.dataType, T.NumericType):
            aggregates += [f"{f}(cast(`{c}` AS double)) AS {f}{i}" for f in ("min", "max", "avg")]
            bounds = [f"min{i}", f"max{i}", f"avg{i}"]
        distinct = f"coalesce(hll_sketch_estimate(k{i}), 0) + if(c{i} < n, 1, 0)"
        values = (
            f"'{name}'", f"'{field.dataType.simpleString()}'", "n", f"n - c{i}", distinct, *bounds,
        )
        names = ("column", "dtype", "n_rows", "n_null", "n_unique", "min", "max", "mean")
        named = ", ".join(f"'{n}', {v}" for n, v in zip(names, values, strict=True))
        rows.append(f"named_struct({named})")
    once = df.selectExpr(*aggregates)
    return once.selectExpr(f"inline(array({', '.join(rows)}))")


def profile_table(df: DataFrame, name: str, exact: bool = True) -> DataFrame:
    """The column profile of a named table, with nulls as a percentage.

    Exact distinct counts lay out every cell of the table; without ``exact`` they
    are estimated in one aggregate.
    """
    share = (F.col("n_null") / F.col("n_rows") * 100).alias("null_pct")
    return (column_profile(df) if exact else estimated_profile(df)).select(
        F.lit(name).alias("table"), "column", "dtype", "n_rows", share, "n_unique",
        "min", "max", "mean",
    )


_PROFILE = (
    "table string, column string, dtype string, n_rows bigint, null_pct double, n_unique bigint,"
    " min double, max double, mean double"
)


def profile_all(tables: dict[str, DataFrame | None], exact: bool = True) -> DataFrame:
    """Profiles of all tables; a table that is missing (None) is one marked row."""
    spark = next(df for df in tables.values() if df is not None).sparkSession

    def profile(name: str, df: DataFrame | None) -> DataFrame:
        if df is not None:
            return profile_table(df, name, exact)
        empty = [None] * 6
        return spark.createDataFrame([(name, None, "file not found", *empty)], _PROFILE)

    return reduce(DataFrame.unionByName, (profile(n, df) for n, df in tables.items()))


def profile_markdown(profile: DataFrame, target_counts: DataFrame | None = None) -> str:
    """A report text from the (short) profile table."""
    lines = ["# Data profile", "", "One applicant (`SK_ID_CURR`) has many bureau credits"
             " (`SK_ID_BUREAU`), each with monthly balances, and many earlier loans"
             " (`SK_ID_PREV`), each with instalments and monthly snapshots.", ""]
    table = None
    for row in profile.orderBy("table", "column").toLocalIterator():
        if row["column"] is None:
            lines += [f"### {row['table']}", "", "*File not found*", ""]
            continue
        if row["table"] != table:
            table = row["table"]
            lines += [f"### {table}", f"- rows: {row['n_rows']:,}", "",
                      "| column | type | missing % | distinct | min | max | mean |",
                      "|---|---|---|---|---|---|---|"]
        cells = [row["column"], row["dtype"], f"{row['null_pct']:.1f}", f"{row['n_unique']:,}"]
        for name in ("min", "max", "mean"):
            cells.append("—" if row[name] is None else f"{row[name]:.2f}")
        lines.append("| " + " | ".join(cells) + " |")
    if target_counts is not None:
        lines += ["", "## Target"]
        for row in target_counts.orderBy("value").toLocalIterator():
            lines.append(f"- {row['value']}: {row['n']:,} ({row['share'] * 100:.1f}%)")
    return "\n".join(lines)


def table_overview(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of each table."""
    return reduce(
        DataFrame.unionByName,
        (
            df.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
            )
            for name, df in tables.items()
        ),
    )


def null_shares(df: DataFrame) -> DataFrame:
    """Percentage of nulls per column, from one aggregation pass."""
    shares = F.array(
        *(
            F.struct(
                F.lit(c).alias("column"),
                (F.avg(F.col(c).isNull().cast("double")) * 100).alias("null_pct"),
            )
            for c in df.columns
        )
    )
    return df.agg(shares.alias("_shares")).select(F.inline("_shares"))


def null_report(df: DataFrame, above: float = 50.0, limit: int = 10) -> DataFrame:
    """The columns with more than ``above`` percent nulls, worst first, ``limit`` of them."""
    worst = null_shares(df).where(F.col("null_pct") > above)
    return worst.orderBy(F.col("null_pct").desc(), "column").limit(limit)


def prefix_report(df: DataFrame, prefixes: list[str]) -> DataFrame:
    """Per name prefix: number of columns and their mean percentage of nulls."""
    group = F.lit("raw")
    for prefix in reversed(prefixes):
        group = F.when(F.col("column").startswith(prefix), F.lit(prefix)).otherwise(group)
    return null_shares(df).groupBy(group.alias("prefix")).agg(
        F.count(F.lit(1)).alias("n_columns"), F.avg("null_pct").alias("mean_null_pct")
    )
