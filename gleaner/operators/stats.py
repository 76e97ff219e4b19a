"""Counts, summaries and histograms over the tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.versions import latest
from gleaner.schemas import IOC_TABLE, REGISTRY_TABLE

# --- fixed values: histogram edges in seconds (or rows) --------------------------------------------------------------

HISTOGRAM_EDGES = {
    "file_processing_seconds": (0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1, 5, 10),
    "batch_insert_seconds": (0.01, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5),
    "batch_insert_size": (10, 50, 100, 250, 500, 1000, 2500, 5000),
    "api_latency_seconds": (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1),
    "query_seconds": (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5),
}

# ---------------------------------------------------------------------------------------------------------------------


def ioc_stats(store: DataFrame) -> DataFrame:
    """Current indicators per type."""
    return latest(store, IOC_TABLE.keys, IOC_TABLE.version).groupBy("ioc_type").agg(F.count("*").alias("cnt"))


def file_stats(registry: DataFrame) -> DataFrame:
    """Current files per status."""
    current = latest(registry, REGISTRY_TABLE.keys, REGISTRY_TABLE.version)
    return current.groupBy("scan_status").agg(F.count("*").alias("cnt"))


def daily_counts(store: DataFrame, live: bool = False) -> DataFrame:
    """Rows per type and first-seen day: as inserted (every version), or ``live`` (current versions only)."""
    rows = latest(store, IOC_TABLE.keys, IOC_TABLE.version) if live else store
    return rows.groupBy("ioc_type", F.to_date("first_seen").alias("date")).agg(F.count("*").alias("count"))


def merge_daily(partials: DataFrame) -> DataFrame:
    """Sum partial daily counts, as written by incremental runs."""
    return partials.groupBy("ioc_type", "date").agg(F.sum("count").alias("count"))


def run_summary(verdicts: DataFrame, skipped: DataFrame) -> DataFrame:
    """Totals of one ingest run as one row. ``verdicts`` has one row per processed or failed file."""
    done = F.col("scan_status") != "failed"
    processed = verdicts.agg(
        F.count_if(done).alias("files_processed"),
        F.count_if(~done).alias("files_failed"),
        F.coalesce(F.sum("ioc_count"), F.lit(0)).alias("iocs_extracted"),
        F.coalesce(F.sum(F.when(done, F.col("file_size"))), F.lit(0)).alias("bytes_processed"),
    ).withColumn("__one", F.lit(1))
    left_out = skipped.agg(F.count("*").alias("files_skipped")).withColumn("__one", F.lit(1))
    return processed.join(left_out, "__one").select(
        "files_processed", "files_skipped", "files_failed", "iocs_extracted", "bytes_processed"
    )


def check_summary(verdicts: DataFrame) -> DataFrame:
    """Total, found and not found per request."""
    return verdicts.groupBy("request_id").agg(
        F.count("*").alias("total"),
        F.count_if("found").alias("found"),
        F.count_if(~F.col("found")).alias("not_found"),
    )


def system_stats(store: DataFrame, registry: DataFrame, sketch_info: DataFrame) -> DataFrame:
    """Indicator, file and filter statistics as ``(section, key, value)`` rows."""
    filters = sketch_info.select(
        F.inline(
            F.array(
                *(
                    F.struct(F.lit(name).alias("key"), F.col(name).cast("bigint").alias("value"))
                    for name in ("capacity", "size_bytes", "items_inserted")
                )
            )
        )
    )
    sections = {
        "ioc_stats": ioc_stats(store).select(F.col("ioc_type").alias("key"), F.col("cnt").alias("value")),
        "file_stats": file_stats(registry).select(F.col("scan_status").alias("key"), F.col("cnt").alias("value")),
        "bloom_filter_info": filters,
    }
    parts = [rows.select(F.lit(name).alias("section"), "key", "value") for name, rows in sections.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def request_counters(requests: DataFrame) -> DataFrame:
    """Requests by endpoint, method and outcome; a status code of 400 or more is an error."""
    outcome = F.when(F.col("status_code") >= 400, "error").otherwise("success")
    return requests.groupBy("endpoint", "method", outcome.alias("status")).agg(F.count("*").alias("requests"))


def labelled_counters(verdicts: DataFrame, found: DataFrame) -> DataFrame:
    """Run counters as ``(counter, label, value)``: files by status and indicators by type."""
    files = verdicts.groupBy(F.col("scan_status").alias("label")).agg(F.count("*").alias("value"))
    iocs = found.groupBy(F.col("ioc_type").alias("label")).agg(F.count("*").alias("value"))
    return files.select(F.lit("files_processed").alias("counter"), "label", "value").unionByName(
        iocs.select(F.lit("iocs_extracted").alias("counter"), "label", "value")
    )


def histogram(rows: DataFrame, value: Column, edges: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Cumulative fixed-bucket histogram: one aggregation, then ``(by, le, bucket_count, total, sum_value)`` rows."""
    observed = rows.select(*by, value.cast("double").alias("__v"))
    counts = observed.groupBy(*by).agg(
        *(F.count_if(F.col("__v") <= F.lit(float(edge))).alias(f"__b{i}") for i, edge in enumerate(edges)),
        F.count("__v").alias("total"),
        F.sum("__v").alias("sum_value"),
    )
    buckets = F.array(
        *(
            F.struct(F.lit(f"{float(edge):g}").alias("le"), F.col(f"__b{i}").alias("bucket_count"))
            for i, edge in enumerate(edges)
        ),
        F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("bucket_count")),
    )
    return counts.select(*by, F.inline(buckets), "total", "sum_value")


def gate_stats(probed: DataFrame) -> DataFrame:
    """Filter hits and misses over the probed values."""
    return probed.agg(
        F.count("*").alias("total"),
        F.count_if("maybe_present").alias("bloom_hits"),
        F.count_if(~F.col("maybe_present")).alias("bloom_misses"),
    )


def api_totals(log: DataFrame) -> DataFrame:
    """Requests and mean latency over the log."""
    return log.agg(F.count("*").alias("total_requests"), F.avg("response_time_ms").alias("average_latency_ms"))


def hit_counts(store: DataFrame, log: DataFrame) -> DataFrame:
    """Current indicators with the number of times each value was found by a query.

    Hits are counted per value before the join, so a value asked by everybody is one row there.
    """
    hits = (
        log.select(F.explode("iocs_found").alias("ioc_value")).groupBy("ioc_value").agg(F.count("*").alias("__hits"))
    )
    current = latest(store, IOC_TABLE.keys, IOC_TABLE.version)
    return current.join(hits, "ioc_value", "left").withColumn(
        "hit_count", F.coalesce("__hits", F.lit(0)).cast("bigint")
    ).drop("__hits").select(*store.columns)
