"""The registered queries: each operator over the whole given tables.

Times are returned as RFC 3339 text, so results compare equal whatever the reader's time zone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.paths import content_type, extension, has_extension, rfc3339
from gleaner.functions.patterns import WHOLE_IPV6_RULES, PatternRule
from gleaner.operators import audit, extract, fuzzy, lookup, objects, sketch, stats, vector_index, vectors, versions
from gleaner.plans.check import answer, bulk_check, gated_check
from gleaner.plans.ingest import changed_files, new_sightings, run_ingest, scanned_changes, unchanged_files, verdicts
from gleaner.schemas import IOC_TABLE, KEY_TABLE, REGISTRY_TABLE, SCAN_STATUSES
from gleaner.session import apply_settings, shared_folder, written
from gleaner.sources import corpus
from gleaner.sources.files import write_tree
from gleaner.sources.logs import log_table
from gleaner.sources.objects import object_store
from gleaner.sources.tables import bucketed_registry, ioc_table, registry_table
from gleaner.streaming import jobs

RUN_TS = datetime(2024, 6, 1)
RETENTION_AS_OF = datetime(2024, 2, 15)
AUDIT_WINDOW_SECONDS = 86_400
TOP_K = 10
FUZZY_DISTANCE = 2
CHUNK_BYTES = 1000
MAX_ASKED = 10

# Portable hashing, so that the SQL side can build and probe the same filter.
PORTABLE_SKETCH = sketch.SketchSize(hashing="md5")
#: The first layer of a filter that grows; small, so that it grows over the given tables.
FIRST_LAYER = sketch.SketchSize(capacity=1000, hashing="md5")
#: What is added to the files that change between two ingests of a tree.
ADDED_LINE = "\nchanged 203.0.113.77 and mailto:new@changed.example.org"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_settings(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__.removeprefix("q_")] = run
    return run


def _run_ts() -> Column:
    return F.lit(RUN_TS.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


def _as_text(df: DataFrame) -> DataFrame:
    return df.select(
        *(rfc3339(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "timestamp" else f.name for f in df.schema)
    )


def _registry_columns(df: DataFrame) -> DataFrame:
    return _as_text(df.select("file_id", "file_path", "file_size", "last_modified", "scan_status", "ioc_count",
                              "object_key", "error_message", "updated_at"))


def _store_columns(df: DataFrame) -> DataFrame:
    return _as_text(df.select("ioc_type", "ioc_value", "source_file_id", "malware_family", "confidence", "first_seen",
                              "last_seen"))


def _this_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows of a run over the changed files.

    The inputs are table rows that hold whole texts. Only those of changed files are scanned, where they lie. (A directory
    tree is listed and joined before it is read: ``run_ingest``.)
    """
    counted = scanned_changes(corpus.files(spark, sf_dir), corpus.registry(spark, sf_dir), lambda rows: extract.with_ioc_count(rows).drop("content"))
    return verdicts(counted, _run_ts())


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects stored by a first run: the files without indicators."""
    plain = extract.with_ioc_count(corpus.files(spark, sf_dir)).filter(F.col("ioc_count") == 0)
    return objects.store_objects(plain, _run_ts())


def _asked_values(seen: DataFrame) -> DataFrame:
    return lookup.explode_requests(corpus.requests_of(seen)).select(F.col("ioc").alias("ioc_value")).distinct()


# --- scans, sources, sinks -------------------------------------------------------------------------------------------


@query
def files_by_extension(spark, sf_dir):
    files = corpus.files(spark, sf_dir).filter(has_extension(F.col("file_path")))
    return files.select("file_path", extension(F.col("file_path")).alias("extension"), "file_size")


@query
def file_identity(spark, sf_dir):
    return corpus.files(spark, sf_dir).select("file_id", "file_path", "file_size", rfc3339(F.col("last_modified")).alias("last_modified"))


@query
def failed_files_again(spark, sf_dir):
    """Files whose last run failed are changed, also at an equal modification time."""
    registry = corpus.registry(spark, sf_dir)
    failed = registry.withColumn("scan_status", F.when(F.col("file_size") % 5 == 0, "failed").otherwise(F.col("scan_status")))
    return changed_files(corpus.files(spark, sf_dir).drop("content"), failed).select("file_id", "file_path")


@query
def registry_upsert(spark, sf_dir):
    merged = versions.upsert(
        corpus.registry(spark, sf_dir), _this_run(spark, sf_dir), REGISTRY_TABLE.keys, REGISTRY_TABLE.version
    )
    return _registry_columns(merged)


@query
def ioc_load(spark, sf_dir):
    """Write a run's indicators partitioned by type and read them back."""
    stored = ioc_table(spark, f"{shared_folder(spark)}/load-{uuid.uuid4().hex}")
    stored.append(new_sightings(corpus.found(spark, sf_dir), stored.all_versions(), _run_ts()))
    return _store_columns(stored.all_versions())


@query
def misc_objects(spark, sf_dir):
    return _objects(spark, sf_dir).select("object_key", "content_type", "size", F.md5("content").alias("content_md5"))


@query
def object_read(spark, sf_dir):
    asked = corpus.files(spark, sf_dir).filter(F.col("state") == "known").select(F.col("file_id").alias("object_key"))
    return objects.read(_objects(spark, sf_dir), asked).select("object_key", F.md5("content").alias("content_md5"))


@query
def object_stat(spark, sf_dir):
    asked = corpus.files(spark, sf_dir).filter(F.col("state") == "known").select(F.col("file_id").alias("object_key"))
    return objects.stat(_objects(spark, sf_dir), asked)


@query
def object_exists(spark, sf_dir):
    asked = corpus.files(spark, sf_dir).select(F.col("file_id").alias("object_key"))
    return objects.exists(_objects(spark, sf_dir), asked)


@query
def object_list_prefix(spark, sf_dir):
    return objects.list_prefix(_objects(spark, sf_dir), "a")


def _stored_objects(spark: SparkSession, sf_dir: str):
    """An object table in chunks that holds the files without indicators."""
    store = object_store(spark, _fresh(spark, "objects"), CHUNK_BYTES)
    plain = extract.with_ioc_count(corpus.files(spark, sf_dir)).filter(F.col("ioc_count") == 0)
    store.put(plain.select(F.col("file_id").alias("object_key"), "file_path", "content"), _run_ts())
    return store


@query
def object_delete(spark, sf_dir):
    """Objects deleted from a stored table, which is read back."""
    store = _stored_objects(spark, sf_dir)
    store.delete(corpus.files(spark, sf_dir).filter(F.col("state") == "touched").select(F.col("file_id").alias("object_key")))
    return store.manifest().select("object_key", "size")


@query
def object_read_range(spark, sf_dir):
    """Bytes 500 to 1700 of stored objects, over the border of two chunks."""
    asked = corpus.files(spark, sf_dir).filter(F.col("state") == "known").select(
        F.col("file_id").alias("object_key"), F.lit(500).cast("long").alias("first"), F.lit(1200).cast("long").alias("length"))
    parts = _stored_objects(spark, sf_dir).read_range(asked)
    whole = parts.groupBy("object_key").agg(F.sort_array(F.collect_list(F.struct("start", F.hex("content").alias("digits")))).alias("parts"))
    digits = F.concat_ws("", "parts.digits")
    return whole.select("object_key", (F.length(digits) / 2).cast("long").alias("n_bytes"), F.md5(digits).alias("hex_md5"))


@query
def tree_ingest(spark, sf_dir):
    """All files written to a tree, ingested by the batch job and by the stream, some changed, and both run again."""
    folder = _fresh(spark, "tree")
    root, batch, stream = (f"{folder}/{name}" for name in ("files", "batch", "stream"))
    files = corpus.files(spark, sf_dir)

    def both() -> None:
        run_ingest(spark, root, batch, RUN_TS)
        jobs.ingest_tree(spark, root, stream, f"{stream}/checkpoint", run_ts=_run_ts).awaitTermination()

    write_tree(files, root)
    both()
    touched = files.filter(F.col("state") == "touched")
    write_tree(touched.withColumns({"content": F.concat("content", F.lit(ADDED_LINE)), "last_modified": F.col("last_modified") + F.expr("INTERVAL 1 HOUR")}), root)
    both()

    def rows(tables: str, name: str) -> DataFrame:
        versions_of = registry_table(spark, tables).all_versions().groupBy("file_id").agg(F.count(F.lit(1)).alias("runs"))
        current = registry_table(spark, tables).current().join(versions_of, "file_id")
        path = F.substring_index("file_path", f"/{folder.rpartition('/')[2]}/files/", -1)
        return current.select(F.lit(name).alias("job"), path.alias("file_path"), "scan_status", "ioc_count", "runs")

    return rows(batch, "batch").union(rows(stream, "stream"))


@query
def query_log_retained(spark, sf_dir):
    kept = versions.retained(corpus.query_log(spark, sf_dir), "timestamp", RETENTION_AS_OF)
    return _as_text(kept.select("query_id", "timestamp", "api_key_hash", "endpoint"))


@query
def query_log_append(spark, sf_dir):
    """The log appended to in two runs, the second without ids of its own."""
    log, rows = log_table(spark, _fresh(spark, "log")), corpus.query_log(spark, sf_dir)
    odd = F.col("query_id").cast("long") % 2 == 1
    log.append(rows.filter(~odd))
    log.append(rows.filter(odd).drop("query_id"))
    ids = log.read().groupBy("query_id").agg(F.count(F.lit(1)).alias("rows_of_id"))
    stored = log.read().join(ids, "query_id").select(F.length("query_id").alias("id_length"), "rows_of_id", "timestamp", "api_key_hash", "endpoint", "day")
    return _as_text(stored)


@query
def query_log_compacted(spark, sf_dir):
    """The stored log after old days were dropped."""
    log = log_table(spark, _fresh(spark, "log"))
    log.append(corpus.query_log(spark, sf_dir))
    log.retain(RETENTION_AS_OF)
    return _as_text(log.read().select("query_id", "timestamp", "api_key_hash", "endpoint", "day"))


@query
def active_keys(spark, sf_dir):
    current = versions.latest(corpus.api_keys(spark, sf_dir), KEY_TABLE.keys, KEY_TABLE.version)
    return _as_text(current.filter("is_active").select("key_hash", "key_name", "rate_limit", "last_used"))


# --- extraction ------------------------------------------------------------------------------------------------------


def _one_type(ioc_type: str, **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return corpus.found(spark, sf_dir, types=[ioc_type], **options).select("file_id", "ioc_value")

    return run


for _type in extract.IOC_TYPES:
    _fn = _one_type(_type)
    _fn.__name__ = f"ioc_{_type}"
    query(_fn)


@query
def ioc_ipv4_public(spark, sf_dir):
    return _one_type("ipv4", exclude_private_ips=True)(spark, sf_dir)


@query
def ioc_domain_filtered(spark, sf_dir):
    return _one_type("domain", exclude_placeholder_domains=True)(spark, sf_dir)


@query
def ioc_ipv6_whole(spark, sf_dir):
    """IPv6 addresses with the rule that returns a compressed one whole."""
    return corpus.found(spark, sf_dir, types=["ipv6"], rules=WHOLE_IPV6_RULES).select("file_id", "ioc_value")


#: A rule of a user: percentages, which no mark of an indicator announces, so the whole text is searched.
PERCENT_PATTERN = "[0-9]+(?:\\.[0-9]+)?%"


@query
def ioc_custom_rule(spark, sf_dir):
    rule = PatternRule("percent", lambda text: F.regexp_extract_all(text, F.lit(PERCENT_PATTERN), F.lit(0)), gate="%", candidates_only=False)
    return corpus.found(spark, sf_dir, rules=(rule,))


@query
def ioc_scan_all(spark, sf_dir):
    return corpus.found(spark, sf_dir)


@query
def ioc_scan_map(spark, sf_dir):
    """The scan result as one map per file, reported by its types and number of values."""
    scanned = extract.with_scan_result(corpus.files(spark, sf_dir))
    return scanned.select(
        "file_id",
        F.array_join(F.array_sort(F.map_keys("iocs")), " ").alias("types"),
        F.size(F.flatten(F.map_values("iocs"))).cast("bigint").alias("ioc_count"),
    )


@query
def ioc_scan_subset(spark, sf_dir):
    return corpus.found(spark, sf_dir, types=["ipv4", "sha1", "email"])


@query
def ioc_count_per_file(spark, sf_dir):
    return extract.with_ioc_count(corpus.files(spark, sf_dir)).select("file_id", "ioc_count")


@query
def ioc_rows_enriched(spark, sf_dir):
    rows = extract.enrich(corpus.found(spark, sf_dir), RUN_TS)
    return _as_text(rows.select("ioc_type", "ioc_value", "source_file_id", "malware_family", "confidence", "first_seen",
                                "last_seen", "hit_count"))


@query
def q_content_type(spark, sf_dir):
    return corpus.files(spark, sf_dir).select("file_path", content_type(F.col("file_path")).alias("content_type"))


@query
def enum_violations(spark, sf_dir):
    status = F.when(F.col("state") == "new", "pending").otherwise(F.col("state"))
    rows = corpus.files(spark, sf_dir).select("file_id", status.alias("scan_status"))
    return extract.type_violations(rows, "scan_status", SCAN_STATUSES)


# --- predicates and routing ------------------------------------------------------------------------------------------


@query
def q_changed_files(spark, sf_dir):
    return changed_files(corpus.files(spark, sf_dir).drop("content"), corpus.registry(spark, sf_dir)).select("file_id", "file_path")


@query
def changed_files_bucketed(spark, sf_dir):
    """The changed files by a registry in buckets, which is not shuffled."""
    registry = bucketed_registry(spark, _fresh(spark, "registry"))
    registry.append(corpus.registry(spark, sf_dir))
    return changed_files(corpus.files(spark, sf_dir).drop("content"), registry.all_versions()).select("file_id", "file_path")


@query
def skipped_files(spark, sf_dir):
    return unchanged_files(corpus.files(spark, sf_dir).drop("content"), corpus.registry(spark, sf_dir)).select("file_id", "file_path")


@query
def file_verdicts(spark, sf_dir):
    return _this_run(spark, sf_dir).select("file_id", "scan_status", "ioc_count", "object_key", "error_message")


@query
def check_request_valid(spark, sf_dir):
    return lookup.validate_requests(corpus.requests(spark, sf_dir), max_iocs=10)


# --- joins -----------------------------------------------------------------------------------------------------------


@query
def ioc_lookup(spark, sf_dir):
    seen = corpus.extracted(spark, sf_dir)
    return _store_columns(lookup.lookup(corpus.ioc_store_of(seen), _asked_values(seen))).orderBy(
        F.desc("last_seen"), "ioc_type", "ioc_value", "source_file_id"
    )


def _verdict_columns(df: DataFrame) -> DataFrame:
    """Confidence as text: a missing one is then the same empty value in every reader."""
    return df.withColumn("confidence", F.col("confidence").cast("string"))


@query
def ioc_check(spark, sf_dir):
    seen = corpus.extracted(spark, sf_dir)
    return _verdict_columns(bulk_check(corpus.requests_of(seen), corpus.ioc_store_of(seen)))


@query
def ioc_check_latest(spark, sf_dir):
    seen = corpus.extracted(spark, sf_dir)
    return _verdict_columns(bulk_check(corpus.requests_of(seen), corpus.ioc_store_of(seen), pick="latest", normalize=True))


@query
def check_answers(spark, sf_dir):
    """Verdicts, and a row with the reason for each request that is refused."""
    seen = corpus.extracted(spark, sf_dir)
    rows = answer(corpus.requests_of(seen), corpus.ioc_store_of(seen), max_iocs=MAX_ASKED)
    return rows.select("request_id", "position", "ioc", "found", "type", "source_file_id", "error")


@query
def check_requests_json(spark, sf_dir):
    """Requests as lines of JSON, every fifth cut off."""
    asked = corpus.requests(spark, sf_dir).join(corpus.files(spark, sf_dir).select(F.col("file_id").alias("request_id"), "file_size"), "request_id")
    body = F.to_json(F.struct("request_id", "iocs"))
    lines = asked.select(F.col("request_id").alias("line_id"), F.when(F.col("file_size") % 5 == 0, F.substring(body, 1, 90)).otherwise(body).alias("body"))
    parsed = lookup.parse_requests(lines)
    return parsed.select("line_id", F.coalesce(F.size("iocs"), F.lit(0)).cast("bigint").alias("n_iocs"), "error")


@query
def ioc_check_bloom(spark, sf_dir):
    seen = corpus.extracted(spark, sf_dir)
    store, size = corpus.ioc_store_of(seen), sketch.SketchSize()
    gate = sketch.build(store, "ioc_value", size)
    return _verdict_columns(gated_check(corpus.requests_of(seen), store, gate, size))


@query
def file_context(spark, sf_dir):
    merged = corpus.registry(spark, sf_dir).unionByName(_this_run(spark, sf_dir))
    context = lookup.file_context(merged, _objects(spark, sf_dir), ("content_type", "size"))
    return _as_text(context.withColumn("size", F.col("size").cast("string")))


@query
def ioc_provenance(spark, sf_dir):
    return lookup.provenance(corpus.ioc_store(spark, sf_dir), corpus.registry(spark, sf_dir))


@query
def requests_by_key(spark, sf_dir):
    return lookup.requests_by_key(corpus.query_log(spark, sf_dir), corpus.api_keys(spark, sf_dir))


# --- aggregations ----------------------------------------------------------------------------------------------------


@query
def ioc_stats_by_type(spark, sf_dir):
    return stats.ioc_stats(corpus.ioc_store(spark, sf_dir))


@query
def file_stats_by_status(spark, sf_dir):
    return stats.file_stats(corpus.registry(spark, sf_dir))


def _daily(rows: DataFrame) -> DataFrame:
    return rows.select("ioc_type", F.date_format("date", "yyyy-MM-dd").alias("date"), "count")


@query
def ioc_daily(spark, sf_dir):
    """Two partial counts, as two runs would write them, summed again."""
    store = corpus.ioc_store(spark, sf_dir)
    first, again = F.col("malware_family") == "Unknown", F.col("malware_family") == "Rescan"
    partials = stats.daily_counts(store.filter(first)).unionByName(stats.daily_counts(store.filter(again)))
    return _daily(stats.merge_daily(partials))


@query
def ioc_daily_live(spark, sf_dir):
    return _daily(stats.daily_counts(corpus.ioc_store(spark, sf_dir), live=True))


@query
def ingest_summary(spark, sf_dir):
    skipped = unchanged_files(corpus.files(spark, sf_dir).select("file_id", "last_modified"), corpus.registry(spark, sf_dir))
    return stats.run_summary(_this_run(spark, sf_dir), skipped)


@query
def run_counters(spark, sf_dir):
    seen = written(scanned_changes(corpus.files(spark, sf_dir), corpus.registry(spark, sf_dir), lambda rows: extract.with_scan_result(rows).drop("content")), "seen")
    counted = seen.withColumn("ioc_count", F.size(F.flatten(F.map_values("iocs"))).cast("bigint"))
    return stats.labelled_counters(verdicts(counted, _run_ts()), extract.explode_result(seen, ["file_id"]))


@query
def check_summary(spark, sf_dir):
    return stats.check_summary(ioc_check(spark, sf_dir))


@query
def system_stats(spark, sf_dir):
    store = corpus.ioc_store(spark, sf_dir)
    info = sketch.info(sketch.build(store, "ioc_value", PORTABLE_SKETCH), store, "ioc_value", PORTABLE_SKETCH)
    return stats.system_stats(store, corpus.registry(spark, sf_dir), info)


@query
def request_counters(spark, sf_dir):
    return stats.request_counters(corpus.query_log(spark, sf_dir))


@query
def latency_histogram(spark, sf_dir):
    rows = stats.histogram(
        corpus.query_log(spark, sf_dir), F.col("response_seconds"), stats.HISTOGRAM_EDGES["api_latency_seconds"],
        by=["endpoint", "method"],
    )
    return rows.withColumn("sum_value", F.round("sum_value", 3))


@query
def file_size_histogram(spark, sf_dir):
    counts = ioc_count_per_file(spark, sf_dir)
    return stats.histogram(counts, F.col("ioc_count"), stats.HISTOGRAM_EDGES["batch_insert_size"])


@query
def file_time_histogram(spark, sf_dir):
    """Processing times by status; a stand-in column, a microsecond per byte, so that SQL can check it."""
    rows = corpus.registry(spark, sf_dir)
    seconds = F.col("file_size") / F.lit(1_000_000.0)
    return stats.histogram(rows, seconds, stats.HISTOGRAM_EDGES["file_processing_seconds"], by=["scan_status"]).withColumn("sum_value", F.round("sum_value", 3))


@query
def insert_time_histogram(spark, sf_dir):
    """Times of batch inserts, a batch per file and a millisecond per indicator."""
    seconds = F.col("ioc_count") / F.lit(1000.0)
    return stats.histogram(ioc_count_per_file(spark, sf_dir), seconds, stats.HISTOGRAM_EDGES["batch_insert_seconds"]).withColumn("sum_value", F.round("sum_value", 3))


@query
def query_time_histogram(spark, sf_dir):
    rows = stats.histogram(corpus.query_log(spark, sf_dir), F.col("response_seconds"), stats.HISTOGRAM_EDGES["query_seconds"])
    return rows.withColumn("sum_value", F.round("sum_value", 3))


@query
def api_totals(spark, sf_dir):
    return stats.api_totals(corpus.query_log(spark, sf_dir)).withColumn(
        "average_latency_ms", F.round("average_latency_ms", 6)
    )


@query
def ioc_hit_count(spark, sf_dir):
    seen = corpus.extracted(spark, sf_dir)
    rows = stats.hit_counts(corpus.ioc_store_of(seen), corpus.check_log_of(seen))
    return rows.select("ioc_type", "ioc_value", "source_file_id", "hit_count")


# --- latest versions and windows -------------------------------------------------------------------------------------


@query
def registry_latest(spark, sf_dir):
    return _registry_columns(
        versions.latest(corpus.registry(spark, sf_dir), REGISTRY_TABLE.keys, REGISTRY_TABLE.version)
    )


@query
def ioc_latest(spark, sf_dir):
    return _store_columns(versions.latest(corpus.ioc_store(spark, sf_dir), IOC_TABLE.keys, IOC_TABLE.version))


@query
def keys_latest(spark, sf_dir):
    current = versions.latest(corpus.api_keys(spark, sf_dir), KEY_TABLE.keys, KEY_TABLE.version)
    return _as_text(current.select("key_hash", "key_name", "rate_limit", "is_active", "last_used"))


@query
def file_metadata(spark, sf_dir):
    """Registry rows of the files that have indicators."""
    asked = corpus.found(spark, sf_dir).select("file_id")
    return _registry_columns(
        versions.point_lookup(corpus.registry(spark, sf_dir), asked, REGISTRY_TABLE.keys, REGISTRY_TABLE.version)
    )


def _limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.latest(corpus.api_keys(spark, sf_dir), KEY_TABLE.keys, KEY_TABLE.version)


@query
def rate_limit_audit(spark, sf_dir):
    return _as_text(
        audit.aligned_windows(
            corpus.query_log(spark, sf_dir), "api_key_hash", "timestamp", _limits(spark, sf_dir), AUDIT_WINDOW_SECONDS
        )
    )


@query
def rate_limit_anchored(spark, sf_dir):
    return _as_text(
        audit.anchored_windows(
            corpus.query_log(spark, sf_dir), "api_key_hash", "timestamp", _limits(spark, sf_dir), AUDIT_WINDOW_SECONDS
        )
    )


# --- membership filter -----------------------------------------------------------------------------------------------


@query
def bloom_build(spark, sf_dir):
    return sketch.build(corpus.ioc_store(spark, sf_dir), "ioc_value", PORTABLE_SKETCH)


@query
def bloom_extend(spark, sf_dir):
    store = corpus.ioc_store(spark, sf_dir)
    hashes = F.col("ioc_type").isin("md5", "sha1", "sha256")
    first = sketch.build(store.filter(hashes), "ioc_value", PORTABLE_SKETCH)
    return sketch.extend(first, sketch.build(store.filter(~hashes), "ioc_value", PORTABLE_SKETCH))


@query
def bloom_probe(spark, sf_dir):
    seen = corpus.extracted(spark, sf_dir)
    gate = sketch.build(corpus.ioc_store_of(seen), "ioc_value", PORTABLE_SKETCH)
    return sketch.probe(_asked_values(seen), "ioc_value", gate, PORTABLE_SKETCH)


@query
def bloom_info(spark, sf_dir):
    store = corpus.ioc_store(spark, sf_dir)
    gate = sketch.build(store, "ioc_value", PORTABLE_SKETCH)
    return sketch.info(gate, store, "ioc_value", PORTABLE_SKETCH)


def _grown(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return sketch.grow(None, None, corpus.ioc_store(spark, sf_dir), "ioc_value", FIRST_LAYER)


@query
def bloom_grow(spark, sf_dir):
    return _grown(spark, sf_dir)[0]


@query
def bloom_grow_info(spark, sf_dir):
    series, items = _grown(spark, sf_dir)
    return sketch.series_info(series, items, FIRST_LAYER)


@query
def gate_stats(spark, sf_dir):
    return stats.gate_stats(bloom_probe(spark, sf_dir))


# --- vectors and fuzzy names -----------------------------------------------------------------------------------------


@query
def vector_dim_violations(spark, sf_dir):
    """Vectors cut to 60 numbers plus their label, checked against the collection's 64."""
    cut = F.slice("vector", F.lit(1), F.col("payload").cast("int") + 60)
    return vectors.dimension_violations(corpus.vectors(spark, sf_dir).withColumn("vector", cut), 64)


@query
def vector_upsert(spark, sf_dir):
    """Re-sent vectors of three labels replace the stored ones."""
    stored = corpus.vectors(spark, sf_dir).withColumn("version", F.lit(1))
    sent = stored.filter(F.col("payload").isin("1", "3", "5")).withColumns(
        {"vector": F.reverse("vector"), "version": F.lit(2)}
    )
    merged = vectors.upsert(stored, sent, "version")
    return merged.select("id", "payload", "version", F.get("vector", F.lit(0)).cast("double").alias("first_number"))


@query
def vector_topk(spark, sf_dir):
    return vectors.top_k(corpus.vectors(spark, sf_dir), corpus.label_centres(spark, sf_dir), TOP_K)


@query
def vector_topk_filtered(spark, sf_dir):
    """The nearest rows whose payload says an even shard and a label under 5."""
    payload = F.to_json(F.struct(F.col("payload").cast("int").alias("label"), F.struct((F.col("id") % 4).alias("shard")).alias("at")))
    stored = vectors.with_payload(corpus.vectors(spark, sf_dir).withColumn("payload", payload))
    chosen = stored.filter((vectors.payload_value("$.label", "int") < 5) & (vectors.payload_value("$.at.shard", "bigint") % 2 == 0))
    return vectors.top_k(chosen, corpus.label_centres(spark, sf_dir), TOP_K)


@query
def vector_topk_many(spark, sf_dir):
    """One row in twenty as a query against all rows, through the index, with the share of the exact result that was found."""
    stored = corpus.vectors(spark, sf_dir)
    asked = stored.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    found = vector_index.top_k_many(stored, asked, TOP_K)
    return found.join(vector_index.recall(found, vectors.top_k(stored, asked, TOP_K)), "query_id")


@query
def fuzzy_search(spark, sf_dir):
    """Indicator domains near the hosts of pages."""
    domains = corpus.found(spark, sf_dir, types=["domain"]).select(F.col("ioc_value").alias("name"))
    hosts = corpus.table(spark, sf_dir, "pages").select(F.lower(F.split_part("url", F.lit("/"), F.lit(3))).alias("name"))
    return fuzzy.search(hosts.filter("name <> ''"), domains, "name", FUZZY_DISTANCE)


@query
def fuzzy_domain(spark, sf_dir):
    domains = corpus.found(spark, sf_dir, types=["domain"]).select(F.col("ioc_value").alias("name"))
    return fuzzy.similar_pairs(domains, "name", FUZZY_DISTANCE)


# --- streams: each runs over the present input to its end ------------------------------------------------------------


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _file_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All families of files as one stream."""
    of = lambda name: corpus.stream(spark, sf_dir, name)
    return (
        corpus.document_files(of("documents")).unionByName(corpus.manifest_files(of("documents")))
        .unionByName(corpus.page_files(of("pages"))).unionByName(corpus.conversation_files(of("conversations")))
    )


@query
def stream_ingest(spark, sf_dir):
    folder = _fresh(spark, "ingest")
    jobs.ingest_files(_file_stream(spark, sf_dir), folder, f"{folder}/checkpoint", _run_ts).awaitTermination()
    rows = registry_table(spark, folder).current()
    return rows.select("file_id", "file_path", "scan_status", "ioc_count", "object_key")


@query
def stream_daily(spark, sf_dir):
    folder = _fresh(spark, "daily")
    found = extract.scan(_file_stream(spark, sf_dir), ["file_id", "last_modified"])
    sightings = found.select("ioc_type", F.col("last_modified").alias("first_seen"))
    jobs.daily_counts(sightings, f"{folder}/counts", f"{folder}/checkpoint").awaitTermination()
    return _daily(jobs.current_daily_counts(spark, f"{folder}/counts"))


@query
def stream_distinct(spark, sf_dir):
    """Files scanned line by line: a value that occurs on several lines of a file comes out once."""
    folder = _fresh(spark, "distinct")
    lines = _file_stream(spark, sf_dir).select(
        "file_id", "last_modified", F.explode(F.split("content", "\n")).alias("content")
    )
    found = extract.scan(lines, ["file_id", "last_modified"])
    jobs.distinct_sightings(found, f"{folder}/seen", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/seen").select("file_id", "ioc_type", "ioc_value")


@query
def stream_rate_limit(spark, sf_dir):
    folder = _fresh(spark, "windows")
    log = corpus.as_query_log(corpus.stream(spark, sf_dir, "events"))
    jobs.audit_windows(
        log, "api_key_hash", "timestamp", f"{folder}/windows", f"{folder}/checkpoint", AUDIT_WINDOW_SECONDS
    ).awaitTermination()
    windows = jobs.current_windows(spark, f"{folder}/windows")
    return windows.select(
        "key_hash", rfc3339(F.timestamp_seconds("window_start")).alias("window_start"), "requests"
    )


@query
def stream_check(spark, sf_dir):
    folder = _fresh(spark, "check")
    asked = extract.scan(_file_stream(spark, sf_dir), ["file_id"]).select(
        F.col("file_id").alias("request_id"), F.col("ioc_value").alias("ioc")
    )
    jobs.check_stream(
        asked, corpus.ioc_store(spark, sf_dir), f"{folder}/verdicts", f"{folder}/checkpoint"
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/verdicts").select("request_id", "ioc", "found", "type", "source_file_id")
