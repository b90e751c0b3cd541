"""Tables bucketed by key, kept as long as their inputs do not change."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raise it when a build changes what it computes: older tables are then stale.
BUILD = 1


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the files at ``paths``: names, sizes and times of their last change.

    The files are listed by Spark and not opened; one number is summed per path.
    """
    parts = [str(BUILD)]
    for path in paths:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        mark = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
        row = files.select(mark.alias("mark")).agg(F.count("*").alias("n"), F.sum("mark").alias("s")).first()
        parts.append(f"{path}:{row['n']}:{row['s']}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """``df`` at ``path`` in ``buckets`` files by ``key``, each sorted by it.

    Rows are dealt out by the same hash as shuffles use, so joins and groupings of
    such tables on ``key`` need no exchange.
    """
    name = f"bucketed_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key)
    writer = dealt.write.bucketBy(buckets, key).sortBy(key).option("compression", "zstd")
    writer.option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # external: the files stay


def read_bucketed(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """What :func:`write_bucketed` wrote; any session can read it.

    The table is registered under a name made of its path, since only tables
    of the catalog know their buckets.
    """
    schema = spark.read.parquet(path).schema
    name = f"bucketed_{hashlib.sha256(path.encode()).hexdigest()[:32]}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet"
        f" CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


def bucketed_cache(
    spark: SparkSession, name: str, build: Callable[[], DataFrame], cache_dir: str,
    mark: str, key: str, buckets: int,
) -> DataFrame:
    """The table ``name`` built from inputs with fingerprint ``mark``, bucketed by ``key``.

    Its folder is named by fingerprint and buckets, so a change of the inputs leads
    to a new build; a row in ``commits``, written last, tells a finished table from
    one whose driver was lost, which is built again elsewhere.
    """
    folder = f"{cache_dir}/{name}/{mark[:24]}-{buckets}"
    finished = _committed(spark, folder)
    if finished is None:
        finished = f"{folder}/{uuid.uuid4().hex}"
        write_bucketed(build(), finished, key, buckets)
        row = spark.createDataFrame([(finished,)], "path string")
        row.coalesce(1).write.mode("append").parquet(f"{folder}/commits")
    return read_bucketed(spark, finished, key, buckets)


def _committed(spark: SparkSession, folder: str) -> str | None:
    try:
        return spark.read.schema("path string").parquet(f"{folder}/commits").agg(F.min("path")).first()[0]
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
