"""Small helpers the text operators share: words, batches and numbered columns."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes that belong to a word keep their (lower-cased) value, all others become a blank.
#: On UTF-8 this is the class ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)

#: Text bytes that one step of a task handles at a time.
STEP_BYTES = 4 << 20


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of a UTF-8 text."""
    return text.translate(WORD_BYTES).split()


def word_codes(words: list[bytes]) -> np.ndarray:
    """One 32-bit checksum per word, as uint64 for further mixing."""
    return np.fromiter(map(crc32, words), dtype=np.uint64, count=len(words))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def steps(
    batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(column).cast(pa.binary())
        offsets = np.frombuffer(sizes.buffers()[1], dtype=np.int32)
        offsets = offsets[sizes.offset : sizes.offset + batch.num_rows + 1].astype(np.int64)
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


#: Bytes of a batch that Spark hands to Python at once.  The batch exists in both
#: processes of a task and is kept by neither.
BATCH_BYTES = 4 << 20


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` over batches of bounded size."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


def with_fields(schema: T.StructType, fields: list[T.StructField]) -> T.StructType:
    """``schema`` with ``fields`` at its end; an input column of the same name gives way."""
    new = {f.name.lower() for f in fields}
    return T.StructType([f for f in schema.fields if f.name.lower() not in new] + fields)


def with_arrays(
    batch: pa.RecordBatch, arrays: dict[str, pa.Array]
) -> pa.RecordBatch:
    """The batch with ``arrays`` at its end, in the order of :func:`with_fields`."""
    new = {name.lower() for name in arrays}
    kept = [i for i, name in enumerate(batch.schema.names) if name.lower() not in new]
    return pa.RecordBatch.from_arrays(
        [batch.column(i) for i in kept] + list(arrays.values()),
        names=[batch.schema.names[i] for i in kept] + list(arrays),
    )


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
