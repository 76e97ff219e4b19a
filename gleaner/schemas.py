"""Table schemas, allowed values and keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from gleaner.functions.patterns import IOC_TYPES

# The states a registered file can be in.
SCAN_STATUSES = ("pending", "clean", "infected", "misc", "failed")

FILE_REGISTRY = T.StructType(
    [
        T.StructField("file_id", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("last_modified", T.TimestampType()),
        T.StructField("scan_status", T.StringType()),
        T.StructField("ioc_count", T.LongType()),
        T.StructField("object_key", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("processed_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

IOC_STORE = T.StructType(
    [
        T.StructField("ioc_value", T.StringType()),
        T.StructField("ioc_type", T.StringType()),
        T.StructField("source_file_id", T.StringType()),
        T.StructField("malware_family", T.StringType()),
        T.StructField("confidence", T.ShortType()),
        T.StructField("first_seen", T.TimestampType()),
        T.StructField("last_seen", T.TimestampType()),
        T.StructField("hit_count", T.LongType()),
        T.StructField("vector_id", T.LongType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)

API_KEYS = T.StructType(
    [
        T.StructField("key_hash", T.StringType()),
        T.StructField("key_name", T.StringType()),
        T.StructField("permissions", T.ArrayType(T.StringType())),
        T.StructField("rate_limit", T.LongType()),
        T.StructField("is_active", T.BooleanType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("last_used", T.TimestampType()),
    ]
)

QUERY_LOG = T.StructType(
    [
        T.StructField("query_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("api_key_hash", T.StringType()),
        T.StructField("endpoint", T.StringType()),
        T.StructField("iocs_queried", T.ArrayType(T.StringType())),
        T.StructField("iocs_found", T.ArrayType(T.StringType())),
        T.StructField("response_time_ms", T.LongType()),
        T.StructField("client_ip", T.StringType()),
    ]
)

OBJECTS = T.StructType(
    [
        T.StructField("object_key", T.StringType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("stored_at", T.TimestampType()),
    ]
)

VECTORS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("payload", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Versioned:
    """What makes a row current: of the rows with equal ``keys``, the one with the highest ``version``."""

    keys: tuple[str, ...]
    version: str
    schema: T.StructType


REGISTRY_TABLE = Versioned(("file_id",), "updated_at", FILE_REGISTRY)
IOC_TABLE = Versioned(("ioc_type", "ioc_value", "source_file_id"), "last_seen", IOC_STORE)
KEY_TABLE = Versioned(("key_hash",), "last_used", API_KEYS)
OBJECT_TABLE = Versioned(("object_key",), "stored_at", OBJECTS)

__all__ = [
    "API_KEYS", "FILE_REGISTRY", "IOC_STORE", "IOC_TABLE", "IOC_TYPES", "KEY_TABLE", "OBJECTS", "OBJECT_TABLE",
    "QUERY_LOG", "REGISTRY_TABLE", "SCAN_STATUSES", "VECTORS", "Versioned",
]
