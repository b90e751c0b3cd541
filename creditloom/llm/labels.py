"""Labelled rows for fitting classifiers: which ones, and how many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, of: int) -> Column:
    """Checksum of an id's text, modulo ``of``; decides what is held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(of))


def fit_rows(
    docs: DataFrame, labels: DataFrame, label: str, most: int, key: str, text: str
) -> DataFrame:
    """``key``, ``text`` and label ``y`` of the labelled documents, at most ``most`` of them.

    Beyond ``most`` labelled rows a part is drawn by a hash of the id, so the
    draw does not depend on order or partitioning.  The chosen label rows are
    bounded by ``most`` and thus broadcast; the documents stay where they are.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    known = known.select(F.col(key).alias("_key"), F.col(label).cast("double").alias("y"))
    count = known.count()
    if count > most:
        share = int(0.95 * most / count * 1_000_000)
        drawn = F.pmod(F.xxhash64(F.col("_key"), F.lit("fit")), F.lit(1_000_000)) < share
        known = known.where(drawn).limit(most)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.join(F.broadcast(known), F.col("key") == F.col("_key")).select("key", "text", "y")
