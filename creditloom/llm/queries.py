"""The operators over the whole sample tables, in the columns the checks compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.text import table
from creditloom.session import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary():
    import public_tokenizers

    from creditloom.llm.pieces import Vocabulary

    return Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from creditloom.llm.pii import KINDS, base_only, find, listed, of_kind

    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"),
        *(of_kind(F.col("spans"), kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(listed(base_only(F.col("spans"))), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from creditloom.llm.pieces import round_trip

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, vocabulary()).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from creditloom.llm.decontamination import judged

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from creditloom.llm.labels import remainder
    from creditloom.llm.language import fit, predict

    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", "lang", (remainder("doc_id", 3) == 1).alias("held_out"))
    prototypes = fit(docs.where(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), prototypes).drop("text")


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from creditloom.llm.fingerprints import beside_next

    return beside_next(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_chars",
        F.sha2("edited_text", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from creditloom.llm.labels import remainder
    from creditloom.llm.quality import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2)
    scored = score(docs, fit(docs, labels)).drop("text")
    return scored.select(
        "doc_id",
        (remainder("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from creditloom.llm.labels import remainder
    from creditloom.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    scored = score(docs, fit(docs, labels)).drop("text")
    return scored.select(
        "doc_id",
        (remainder("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from creditloom.llm.html import extract

    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from creditloom.llm.warc import read_archive, write_archive

    pages = table(spark, sf_dir, "pages")
    path = scratch_dir(spark)
    write_archive(pages.select("page_id", "url", F.encode("html", "UTF-8").alias("payload")), path)
    return read_archive(spark, path).select(
        F.col("record_id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from creditloom.llm.near_duplicates import near_duplicates as join

    return join(table(spark, sf_dir, "documents"))


def resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from creditloom.llm.resampling import resample

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = resample(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from creditloom.llm.quantisation import compress

    return compress(table(spark, sf_dir, "embeddings"))[0]


def vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from creditloom.llm.vector_duplicates import near_duplicates as join

    return join(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_language": language,
    "op2_fingerprints": fingerprints,
    "op3_pii": pii,
    "op4_pieces": pieces,
    "op5_quality": quality,
    "op6_main_text": main_text,
    "op7_near_duplicates": near_duplicates,
    "op8_toxicity": toxicity,
    "op9_decontamination": decontamination,
    "op10_warc": warc,
    "op11_resampling": resampling,
    "op12_vector_codes": vector_codes,
    "op13_vector_duplicates": vector_duplicates,
}
