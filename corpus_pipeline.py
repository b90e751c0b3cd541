"""From raw documents to training tokens: stages that each keep or rewrite documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm import decontamination, near_duplicates, pieces, pii, toxicity
from creditloom.llm.labels import remainder
from creditloom.llm.queries import vocabulary
from creditloom.llm.tables import if_small, written
from creditloom.llm.text import table


def _free(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of one half or more are left out.

    The model learns from the labels outside the held-out fold.  A null or
    empty text has no toxic word and stays unless the labels make toxic texts
    the rule.  Rows are judged each for itself, repeated ones alike; ids may be
    null, they then have no label.  No documents give none.
    """
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    model, score = toxicity.fit(docs, labels), _free(docs, "toxicity")
    scored = toxicity.score(docs, model, name=score)
    return scored.where(F.col(score) < 0.5).select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id.

    Of rows of one id, or without any, the first stays; ids that are there come
    before null.  Texts without words are in no group: their rows stay.  Each row
    is judged by its own text, whatever other rows share its id.
    """
    number, gone = _free(docs, "row_number"), _free(docs, "gone")
    rows = near_duplicates.numbered(docs, number)
    found = near_duplicates.by_number(rows, number, "text").where("n_links > 0")
    found = found.select(F.col(number).alias("_row"), F.col("class").alias("_class"))
    ids = rows.select(F.col(number).alias("_row"), F.col("doc_id").alias("_id"))
    members = written(found.join(ids, "_row"))
    # the first of each group, by id, then by row
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), "_row")
    first = members.groupBy("_class").agg(F.min(order).alias("first")).select("first._row")
    dropped = members.select("_row").join(if_small(written(first)), "_row", "left_anti")
    dropped = if_small(written(dropped.withColumnRenamed("_row", gone)))
    kept = rows.join(dropped, F.col(number) == F.col(gone), "left_anti")
    return kept.select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a benchmark text makes up a twentieth or more are left out.

    Null and empty texts have no words and stay; rows are judged each for itself.
    """
    own = {c: _free(docs, f"own_{i}") for i, c in enumerate(docs.columns)}
    judged = decontamination.judged(  # its new columns would replace some of the same name
        docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items())),
        table(spark, sf_dir, "benchmark"), text=own["text"],
    )
    kept = judged.where(~F.col("contaminated"))
    return kept.select(*(F.col(n).alias(c) for c, n in own.items()))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it are replaced; ``n_chars`` follows the text.

    A null text stays null; equal rows change alike, each row is a document of
    its own where terms are counted.  ``n_chars`` of a text that stays is not touched.
    """
    before = _free(docs, "text_before")
    clean = pii.sanitise(docs.withColumn(before, F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col(before))
    length = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", length).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number, and the text they decode to.

    ``ids``, ``decoded`` and ``n_tokens`` replace columns of these names.  A null
    text is encoded like an empty one: no ids.  Every row is kept.
    """
    found = pieces.round_trip(docs, vocabulary())
    return found.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_copies),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("pieces", encoded),
]

#: The first stages fit a model and follow links, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
