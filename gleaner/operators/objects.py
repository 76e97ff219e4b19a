"""The object table: raw content under a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.paths import content_type


def store_objects(files: DataFrame, stored_at: Column, content: str = "content") -> DataFrame:
    """Object rows for ``(file_id, file_path, content)`` rows."""
    return files.select(
        F.col("file_id").alias("object_key"),
        F.col(content).cast("binary").alias("content"),
        content_type(F.col("file_path")).alias("content_type"),
        F.octet_length(content).cast("bigint").alias("size"),
        stored_at.alias("stored_at"),
    )


def stat(objects: DataFrame, keys: DataFrame) -> DataFrame:
    """Metadata of the asked objects; content is never read."""
    return objects.select("object_key", "content_type", "size").join(
        keys.select("object_key").distinct(), "object_key", "left_semi"
    )


def exists(objects: DataFrame, keys: DataFrame) -> DataFrame:
    """``(object_key, present)`` for each asked key."""
    held = objects.select("object_key").distinct().withColumn("__held", F.lit(True))
    return keys.select("object_key").distinct().join(held, "object_key", "left").select(
        "object_key", F.coalesce("__held", F.lit(False)).alias("present")
    )


def read(objects: DataFrame, keys: DataFrame) -> DataFrame:
    """The asked objects with content."""
    return objects.join(keys.select("object_key").distinct(), "object_key", "left_semi")


def list_prefix(objects: DataFrame, prefix: str, columns: Sequence[str] = ("object_key", "size")) -> DataFrame:
    """Objects under a prefix; the predicate is pushed to the scan as ``StartsWith``."""
    return objects.filter(F.col("object_key").startswith(prefix)).select(*columns)


def delete(objects: DataFrame, keys: DataFrame) -> DataFrame:
    """What remains after deletion."""
    return objects.join(keys.select("object_key"), "object_key", "left_anti")
