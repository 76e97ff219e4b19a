"""What the operators share: stored intermediate tables, and pieces of Arrow batches that are bounded in bytes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gleaner.session import shared_folder

#: White space between words, as the characters of a Java, RE2 or Python class.
SPACE = r"\x20\x09-\x0D"

#: Bytes of text that a task works on at once; a longer text is worked on alone.
PIECE_BYTES = 2 << 20


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, and safe when executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_bytes(column: pa.Array) -> pa.Array:
    """Texts as large binary; null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    return column.fill_null("").cast(pa.large_binary())


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of large binary values in a row, and where each value begins and the last ends in them. Copies nothing."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that hold at most ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        texts = as_bytes(batch.column(batch.schema.get_field_index(column)))
        ends = byte_view(texts)[1].tolist()
        start = 0
        for row in range(1, len(texts) + 1):
            if row == len(texts) or ends[row + 1] - ends[start] > limit:
                yield batch.slice(start, row - start)
                start = row
