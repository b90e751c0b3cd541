"""Written tables, joins behind a size check, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.session import scratch_dir

#: Most rows of ids and other short columns that are broadcast (some ten MB).
SMALL_ROWS = 500_000


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, survives lost executors."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def if_small(df: DataFrame, most: int = SMALL_ROWS, *lists: str) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` (short) rows, else as it is.

    The entries of its array columns ``lists`` count as rows.  For written tables:
    counting them reads only footers, or those columns.
    """
    entries = sum((F.coalesce(F.size(c), F.lit(0)) for c in lists), F.lit(1))
    count = df.agg(F.sum(entries)).first()[0] if lists else df.count()
    return F.broadcast(df) if (count or 0) <= most else df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the smallest node it is connected with, for all nodes of edges.

    Large-star and small-star steps in turn: every node hands its larger, then
    its smaller neighbours to the smallest of them, until nothing changes.  The
    edges are written after each round; groups are minima, combined before the
    shuffle, and joins may be split where a node has very many edges.
    """
    pairs = edges.select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    ).where("u > v").distinct()
    pairs, seen = written(pairs), None
    while True:
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(written(least), F.col("u") == F.col("w")).where("v > u")
        stars = large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        stars = written(stars)
        low = written(stars.groupBy("u").agg(F.min("v").alias("m")))
        low = low.withColumnRenamed("u", "w")
        small = stars.join(low, F.col("u") == F.col("w"))
        pairs = written(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select(F.col("w").alias("u"), F.col("m").alias("v")))
            .where("u > v")
            .distinct()
        )
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
