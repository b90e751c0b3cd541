"""A content-addressed web archive.

An archive is two tables.  ``payloads`` holds every distinct payload once under
its SHA-256.  ``headers`` holds the exact header bytes of every record and the
digest of its payload.  A record is put together again by joining the two, and
every payload is hashed anew when it is read.

Of records with equal payloads of some size, one is a ``response`` and the others
are ``revisit`` records that refer to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.text import mapped

#: Payloads below this size are always kept as responses.
LEAST_BYTES = 1000

DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def _line(name: str, value: Column) -> Column:
    """A header line, nothing if the value is null; line ends in values are escaped."""
    safe = F.regexp_replace(F.regexp_replace(value.cast("string"), "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(END)), F.lit(""))


def _urn(record_id: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), record_id.cast("string"), F.lit(">"))


def write_archive(
    records: DataFrame,
    path: str,
    record_id: str = "page_id",
    url: str = "url",
    payload: str = "payload",
    least_bytes: int = LEAST_BYTES,
    date: str = DATE,
) -> None:
    """Write ``records`` as an archive below ``path``; other columns are left out.

    A null payload counts as empty.  Of equal payloads of at least
    ``least_bytes`` the one with the largest id becomes the response; rows that
    repeat this id are responses too.  An empty table gives an empty archive.
    Digests and ids are grouped after a map-side reduction, so a payload that a
    third of the records share is one row per task; joins are left to adaptive
    splitting of large partitions, on tables that are written first.
    """
    spark = records.sparkSession
    body = F.coalesce(F.col(payload), F.lit(b""))
    full = records.select(
        F.col(record_id).alias("record_id"),
        F.col(url).alias("url"),
        F.sha2(body, 256).alias("digest"),
        F.sha1(body).alias("sha1"),
        F.octet_length(body).cast("long").alias("n_bytes"),
        body.alias("payload"),
    )
    # payloads: any of the equal ones, compared by digest and length
    full.groupBy("digest", "n_bytes").agg(F.first("payload").alias("payload")).write.parquet(
        f"{path}/payloads"
    )
    facts = full.drop("payload")
    large = facts.where(F.col("n_bytes") >= least_bytes)
    large.groupBy("digest").agg(
        F.max("record_id").alias("response_id"), F.count(F.lit(1)).alias("n")
    ).where("n > 1").write.parquet(f"{path}/shared")
    shared = spark.read.parquet(f"{path}/shared").select("digest", "response_id")
    joined = facts.join(shared, "digest", "left")
    revisit = F.coalesce(F.col("record_id") != F.col("response_id"), F.lit(False))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.col("n_bytes").cast("string"),
        F.lit(END + END),
    )
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n_bytes"))
    warc = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("record_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Refers-To", F.when(revisit, _urn(F.col("response_id")))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block),
        F.lit(END),
    )
    joined.select(
        "record_id",
        warc.cast("binary").alias("warc_header"),
        http.cast("binary").alias("http_header"),
        "digest",
    ).write.parquet(f"{path}/headers")


def field_of(header: Column, name: str) -> Column:
    """A field of a WARC header, null if it is not there."""
    value = F.regexp_extract(header.cast("string"), rf"\n{name}: ([^\r\n]*)\r\n", 1)
    return F.nullif(value, F.lit(""))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """All records: ``record_id``, ``warc_header``, ``http_header``, ``record_type``,
    ``target``, ``refers_to``, ``payload_digest`` as in the header, and the full
    ``payload``, also for revisits.

    Stops with an error if a stored payload does not give its digest or a
    record's payload is missing.
    """
    stored = spark.read.parquet(f"{path}/payloads")
    right = F.sha2("payload", 256) == F.col("digest")
    stored = stored.select(
        F.col("digest").alias("stored_digest"),
        F.when(right, F.col("payload"))
        .otherwise(F.raise_error(F.lit("a stored payload is damaged")))
        .alias("payload"),
    )
    headers = spark.read.parquet(f"{path}/headers")
    header = F.col("warc_header")
    found = headers.join(stored, F.col("digest") == F.col("stored_digest"), "left")
    missing = F.raise_error(F.lit("a record's payload is missing"))
    return found.select(
        "record_id",
        "warc_header",
        "http_header",
        field_of(header, "WARC-Type").alias("record_type"),
        field_of(header, "WARC-Target-URI").alias("target"),
        F.nullif(
            F.regexp_extract(field_of(header, "WARC-Refers-To"), "^<urn:record:(.*)>$", 1),
            F.lit(""),
        ).alias("refers_to"),
        F.regexp_replace(field_of(header, "WARC-Payload-Digest"), "^sha1:", "").alias(
            "payload_digest"
        ),
        F.when(F.col("stored_digest").isNotNull(), F.col("payload"))
        .otherwise(missing)
        .alias("payload"),
    )


def write_files(records: DataFrame, path: str, per_file: int = 100_000) -> None:
    """Records of :func:`read_archive` as plain WARC files: header, block, two line ends each."""
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    record = F.concat(F.col("warc_header"), F.col("http_header"), body)
    records.select(record.cast("string").alias("value")).write.option(
        "lineSep", END + END
    ).option("maxRecordsPerFile", per_file).text(path)


def split_records(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """WARC header and block of every record in a file's bytes."""
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", start) + 4
        header = data[start:end]
        lines = dict(x.split(b": ", 1) for x in header.split(b"\r\n")[1:] if b": " in x)
        at = end + int(lines[b"Content-Length"])
        yield header, data[end:at]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``warc_header`` and ``block`` of every record of the WARC files below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for header, block in split_records(content.as_py()):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([header], pa.binary()), pa.array([block], pa.binary())],
                        names=["warc_header", "block"],
                    )

    files = spark.read.format("binaryFile").load(path).select("content")
    return mapped(files, run, "warc_header binary, block binary")
