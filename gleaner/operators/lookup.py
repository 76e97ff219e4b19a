"""Is an indicator known, and where was it seen: lookups and checks as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.paths import rfc3339
from gleaner.operators.versions import latest
from gleaner.schemas import IOC_TABLE

MAX_IOCS_PER_REQUEST = 1000


def lookup(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """Current rows of the wanted ``ioc_value``s. Sort on ``last_seen`` where the result is shown."""
    asked = wanted.select("ioc_value").distinct()
    hits = store.join(asked, "ioc_value", "left_semi")
    return latest(hits, IOC_TABLE.keys, IOC_TABLE.version)


def winners(store: DataFrame, pick: str = "oldest") -> DataFrame:
    """One current row per value: the oldest sighting (or the latest), ties by type and file.

    The aggregate is partial, so a value that occurs in a third of all files still sends one row per task.
    """
    if pick not in ("oldest", "latest"):
        raise ValueError(f"pick must be 'oldest' or 'latest', not {pick!r}")
    fields = ["last_seen", "ioc_type", "source_file_id", "malware_family", "confidence", "first_seen"]
    if pick == "oldest":
        chosen = F.min(F.struct(*fields))
    else:
        chosen = F.min_by(
            F.struct(*fields), F.struct(-F.unix_micros("last_seen"), F.col("ioc_type"), F.col("source_file_id"))
        )
    return store.groupBy("ioc_value").agg(chosen.alias("__hit"))


def explode_requests(requests: DataFrame, max_iocs: int | None = None) -> DataFrame:
    """``(request_id, position, ioc)``, order and duplicates kept; requests over ``max_iocs`` are refused whole."""
    if max_iocs is not None:
        requests = requests.filter(F.size("iocs") <= max_iocs)
    return requests.select("request_id", F.posexplode("iocs").alias("position", "ioc"))


def validate_requests(requests: DataFrame, max_iocs: int = MAX_IOCS_PER_REQUEST) -> DataFrame:
    n = F.coalesce(F.size("iocs"), F.lit(0))
    return requests.select(
        "request_id",
        n.cast("bigint").alias("n_iocs"),
        ((n > 0) & (n <= max_iocs)).alias("is_valid"),
        F.when(n <= 0, "No IOCs provided").when(n > max_iocs, "Too many IOCs").otherwise("").alias("error"),
    )


def parse_requests(lines: DataFrame, body: str = "body") -> DataFrame:
    """``lines`` with ``request_id`` and ``iocs`` from a JSON body, and ``error``: a body that is not one request is refused."""
    schema = "request_id string, iocs array<string>, __corrupt string"
    parsed = lines.withColumn("__request", F.from_json(body, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"}))
    broken = F.col("__request").isNull() | F.col("__request.__corrupt").isNotNull()
    return parsed.select(*(F.col(f"`{c}`") for c in lines.columns if c not in ("request_id", "iocs", "error")),
                         F.when(~broken, F.col("__request.request_id")).alias("request_id"), F.when(~broken, F.col("__request.iocs")).alias("iocs"),
                         F.when(broken, "Invalid request body").otherwise("").alias("error"))


def check(
    asked: DataFrame, store: DataFrame, pick: str = "oldest", normalize: bool = False, wanted: DataFrame | None = None
) -> DataFrame:
    """One verdict per ``(request_id, position, ioc)`` row.

    The store is reduced to the asked values before versions are resolved, so cost follows the requests. The winner
    side has one row per value; a value asked very often is a skewed probe side, which adaptive execution splits.
    ``wanted`` narrows what is looked up to fewer ``ioc_value``s than were asked.
    """
    asked = asked.withColumn("ioc_value", F.lower("ioc") if normalize else F.col("ioc"))
    known = winners(lookup(store, asked if wanted is None else wanted), pick)
    return asked.join(known, "ioc_value", "left").select(
        "request_id",
        "position",
        "ioc",
        F.col("__hit").isNotNull().alias("found"),
        F.col("__hit.ioc_type").alias("type"),
        F.col("__hit.source_file_id").alias("source_file_id"),
        F.col("__hit.malware_family").alias("malware_family"),
        F.col("__hit.confidence").alias("confidence"),
        rfc3339(F.col("__hit.first_seen")).alias("first_seen"),
    )


def provenance(store: DataFrame, registry: DataFrame) -> DataFrame:
    """Current indicators with the file each was found in."""
    current = latest(store, IOC_TABLE.keys, IOC_TABLE.version)
    files = latest(registry, ["file_id"], "updated_at").select(
        F.col("file_id").alias("source_file_id"), "file_path", "scan_status"
    )
    return current.join(files, "source_file_id").select(
        "ioc_type", "ioc_value", "source_file_id", "file_path", "scan_status", "confidence"
    )


def file_context(registry: DataFrame, objects: DataFrame, object_columns: tuple[str, ...]) -> DataFrame:
    """Latest registry row with its stored object; a row without an object key falls back to the file id.

    Only ``object_columns`` are read from the object table; leave ``content`` out unless it is wanted.
    """
    files = latest(registry, ["file_id"], "updated_at").withColumn(
        "__key", F.coalesce(F.nullif(F.col("object_key"), F.lit("")), F.col("file_id"))
    )
    stored = objects.select(F.col("object_key").alias("__key"), *object_columns)
    return (
        files.join(stored, "__key", "left")
        .select(
            "file_id", "file_path", "file_size", "last_modified", "ioc_count",
            F.col("__key").alias("object_key"), *object_columns,
        )
    )


def requests_by_key(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Request counts per API key name. The log is counted per hash first, so the join sees one row per key."""
    per_key = log.groupBy(F.col("api_key_hash").alias("key_hash")).agg(
        F.count("*").alias("requests"), F.sum("response_time_ms").alias("total_ms")
    )
    current = latest(keys, ["key_hash"], "last_used").select("key_hash", "key_name", "is_active")
    return current.join(per_key, "key_hash").select("key_hash", "key_name", "is_active", "requests", "total_ms")
