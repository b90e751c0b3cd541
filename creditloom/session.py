"""Session construction and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.util import inheritable_thread_target


def build_session(cores: str = "*", partitions: int = 8, app: str = "creditloom") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder every executor can reach.

    It lies under ``spark.checkpoint.dir`` when the cluster names one.  Only
    where that is unset, as in local tests, is a temporary folder made and
    named to the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="creditloom-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/creditloom-{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """The frame computed once and read back from the shared checkpoint folder.

    Reliable checkpoints survive the loss of executors and end the lineage, so
    partition numbers and shared small tables are the same for every consumer.
    """
    scratch_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, *by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, read by column.

    Columns ``by`` of few values are its folders: reading one value opens no other's files.
    """
    path = scratch_dir(df.sparkSession)
    df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_threads(spark: SparkSession, tasks: list[Callable], width: int) -> list:
    """Run driver-side calls, each starting its own Spark jobs, ``width`` at a time."""
    inherited = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max_workers=max(1, width)) as pool:
        return [f.result() for f in [pool.submit(inherited(t)) for t in tasks]]
