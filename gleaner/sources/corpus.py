"""The given tables presented as the inputs of the engine: files with content, request logs, keys, vectors.

Four families of files, each a function of a table's rows:

* ``documents``: one text file each;
* a manifest log per document, holding digests and addresses computed from its text (the only source of MD5, SHA-256
  and IPv6 values, and of values the rules must drop);
* ``pages``: one HTML file each, the URL on its first line;
* ``conversations``: one note per turn.

``state`` says what an earlier run knew of a file: ``known`` (unchanged since), ``touched`` (changed since) or ``new``.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.paths import file_id
from gleaner.operators.extract import explode_result, scan, spread, with_scan_result
from gleaner.session import written

BASE_TIME = "2024-01-01 00:00:00"


# What is cached here and below are plans, not data: they are built, and footers and splits looked at, once per session.
@lru_cache(maxsize=64)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=64)
def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with texts to scan: a small one is spread over all cores first."""
    return spread(table(spark, sf_dir, name))


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, whether it is one file or a folder of them.

    A stream takes a single file only as what a pattern finds; this one finds just the table.
    """
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{{{name}.parquet}}")


def _minutes(n: Column) -> Column:
    return F.timestamp_seconds(F.unix_seconds(F.lit(BASE_TIME).cast("timestamp")) + n * 60)


def _state(label: Column, known: str, touched: str) -> Column:
    return F.when(label == known, "known").when(label == touched, "touched").otherwise("new")


def _file(path: Column, content: Column, number: Column, state: Column) -> list[Column]:
    return [
        file_id(path).alias("file_id"),
        path.alias("file_path"),
        F.octet_length(content).cast("bigint").alias("file_size"),
        _minutes(number).alias("last_modified"),
        content.alias("content"),
        state.alias("state"),
    ]


def document_files(documents: DataFrame) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".txt")))
    return documents.select(
        *_file(path, F.col("text"), F.col("doc_id"), _state(F.col("lang"), "en", "fr"))
    )


def manifest_files(documents: DataFrame) -> DataFrame:
    docs = documents.select(
        "doc_id", "lang", "source", "n_chars", F.md5("text").alias("h"), F.sha2("text", 256).alias("g")
    )
    groups = [F.substring("h", 4 * i + 1, 4) for i in range(8)]
    content = F.concat_ws(
        "\n",
        F.concat("doc_id", F.lit(" md5="), F.when(F.col("lang") == "fr", F.upper("h")).otherwise(F.col("h")),
                 F.lit(" sha256="), "g", F.lit(" "), "g"),
        F.concat(F.lit("peer "), F.concat_ws(":", *groups), F.lit(" next "), groups[0], F.lit("::"), groups[1],
                 F.lit(" mapped ::ffff:"), groups[2], F.lit(":"), groups[3]),
        F.concat(F.lit("from 10.0.1."), F.col("n_chars") % 250, F.lit(" via 203.0.113."), F.col("n_chars") % 256,
                 F.lit(" not 192.168.001."), F.col("n_chars") % 100),
        F.lit(f"null {'f' * 32} {'0' * 40} {'F' * 64}"),
        F.concat(F.lit("GET (https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"), "doc_id",
                 F.lit("?h="), F.substring("h", 1, 8), F.lit("). host TEST.com mail Ops@"), "source",
                 F.lit(".example.org,")),
    )
    path = F.concat(F.lit("manifests/"), "source", F.lit("/"), "doc_id",
                    F.when(F.col("lang") == "de", ".LOG").otherwise(".log"))
    return docs.select(*_file(path, content, F.col("doc_id"), _state(F.col("lang"), "fr", "en")))


def page_files(pages: DataFrame) -> DataFrame:
    path = F.concat(F.lit("pages/"), "page_id", F.lit(".html"))
    content = F.concat("url", F.lit("\n"), "html")
    scheme = F.substring_index("url", ":", 1)
    return pages.select(*_file(path, content, F.col("page_id"), _state(scheme, "https", "http")))


def conversation_files(conversations: DataFrame) -> DataFrame:
    path = F.concat(F.lit("chats/"), "conv_id", F.lit("/"), "turn",
                    F.when(F.col("role") == "assistant", ".md").otherwise(".yaml"))
    return conversations.select(
        *_file(path, F.col("text"), F.col("conv_id"), _state(F.col("role"), "assistant", "system"))
    )


@lru_cache(maxsize=16)
def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file_id, file_path, file_size, last_modified, content, state)`` over all families."""
    documents = texts(spark, sf_dir, "documents")
    return (
        document_files(documents)
        .unionByName(manifest_files(documents))
        .unionByName(page_files(texts(spark, sf_dir, "pages")))
        .unionByName(conversation_files(texts(spark, sf_dir, "conversations")))
    )


def found(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """``(file_id, ioc_type, ioc_value)`` over all files."""
    return scan(files(spark, sf_dir), ["file_id"], **options)


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file_id, last_modified, state, iocs)`` of all files, worked out once and stored: for queries that use it several times."""
    return written(with_scan_result(files(spark, sf_dir)).select("file_id", "last_modified", "state", "iocs"), "extracted")


@lru_cache(maxsize=16)
def ioc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicator rows of an earlier run, all versions: ``known`` files were seen again a day later."""
    return _store_rows(scan(files(spark, sf_dir), ["file_id", "last_modified", "state"]))


def ioc_store_of(seen: DataFrame) -> DataFrame:
    """As ``ioc_store``, from the stored extraction."""
    return _store_rows(explode_result(seen, ["file_id", "last_modified", "state"]))


def _store_rows(seen: DataFrame) -> DataFrame:
    versions = seen.withColumn(
        "version", F.explode(F.when(F.col("state") == "known", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    )
    again = F.col("version") == 1
    seen_at = F.col("last_modified") + F.make_interval(days=F.col("version"))
    return versions.select(
        "ioc_value",
        "ioc_type",
        F.col("file_id").alias("source_file_id"),
        F.when(again, "Rescan").otherwise("Unknown").alias("malware_family"),
        F.when(again, 80).otherwise(50).cast("smallint").alias("confidence"),
        seen_at.alias("first_seen"),
        seen_at.alias("last_seen"),
        F.lit(0).cast("bigint").alias("hit_count"),
        F.lit(None).cast("bigint").alias("vector_id"),
        F.array().cast("array<string>").alias("tags"),
    )


@lru_cache(maxsize=16)
def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows of earlier runs, all versions.

    A ``known`` file was pending and is now done, at its present modification time; a ``touched`` file failed an hour
    before its present one; a ``new`` file has no row.
    """
    listed = files(spark, sf_dir).drop("content").filter(F.col("state") != "new")
    known = F.col("state") == "known"
    large = F.col("file_size") > 1000
    runs = F.when(known, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = listed.withColumn("run", F.explode(runs))
    done = F.col("run") == 2
    stamp = F.timestamp_seconds(
        F.unix_seconds(F.lit(BASE_TIME).cast("timestamp")) + F.when(done, 60 * 86400).otherwise(31 * 86400)
    )
    modified = F.when(known, F.col("last_modified")).otherwise(F.col("last_modified") - F.expr("INTERVAL 1 HOUR"))
    status = (
        F.when(~known, "failed").when(~done, "pending").when(large, "infected").otherwise("misc")
    )
    return rows.select(
        "file_id",
        "file_path",
        "file_size",
        modified.alias("last_modified"),
        status.alias("scan_status"),
        F.when(done & large, F.floor(F.col("file_size") / 1000)).otherwise(0).cast("bigint").alias("ioc_count"),
        F.when(done & ~large, F.col("file_id")).otherwise("").alias("object_key"),
        F.when(~known, "read error").otherwise("").alias("error_message"),
        stamp.alias("processed_at"),
        stamp.alias("updated_at"),
    )


def _values_per_file(seen: DataFrame) -> DataFrame:
    """``(file_id, v)``: the sorted distinct values of each file, without a shuffle."""
    return seen.select("file_id", F.array_sort(F.array_distinct(F.flatten(F.map_values("iocs")))).alias("v"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_of(with_scan_result(files(spark, sf_dir)))


def requests_of(seen: DataFrame) -> DataFrame:
    """``(request_id, iocs)``: per file its values, the same upper-cased, the first one again, and an absent one.

    A file without values asks for the absent one only.
    """
    return _values_per_file(seen).select(
        F.col("file_id").alias("request_id"),
        F.concat(
            "v", F.transform("v", lambda x: F.upper(x)), F.slice("v", 1, 1), F.array(F.concat(F.lit("absent-"), "file_id"))
        ).alias("iocs"),
    )


def check_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_log_of(with_scan_result(files(spark, sf_dir)))


def check_log_of(seen: DataFrame) -> DataFrame:
    """``(query_id, iocs_queried, iocs_found)``: per file its values were asked for, the first one twice."""
    return _values_per_file(seen).select(
        F.col("file_id").alias("query_id"),
        F.concat("v", F.slice("v", 1, 1), F.array(F.concat(F.lit("absent-"), "file_id"))).alias("iocs_queried"),
        F.concat("v", F.slice("v", 1, 1)).alias("iocs_found"),
    )


@lru_cache(maxsize=16)
def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log: one row per event."""
    return as_query_log(table(spark, sf_dir, "events"))


def as_query_log(events: DataFrame) -> DataFrame:
    event = F.col("event_type")
    endpoint = F.when(event == "view", "/context").when(event == "signup", "/stats").otherwise("/check")
    return events.select(
        F.col("event_id").cast("string").alias("query_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.sha2(F.col("user_id").cast("string"), 256).alias("api_key_hash"),
        endpoint.alias("endpoint"),
        F.when(endpoint == "/check", "POST").otherwise("GET").alias("method"),
        F.when(event == "error", 500).otherwise(200).alias("status_code"),
        F.round(F.col("value") * 10).cast("bigint").alias("response_time_ms"),
        (F.round(F.col("value") * 10) / 1000).alias("response_seconds"),
    )


@lru_cache(maxsize=16)
def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API-key rows, all versions: every event of a user touches the key; an error leaves it inactive."""
    return table(spark, sf_dir, "events").select(
        F.sha2(F.col("user_id").cast("string"), 256).alias("key_hash"),
        F.concat(F.lit("user-"), "user_id").alias("key_name"),
        F.array(F.lit("read")).alias("permissions"),
        F.when(F.col("event_type") == "purchase", 2).otherwise(1).cast("bigint").alias("rate_limit"),
        (F.col("event_type") != "error").alias("is_active"),
        F.lit(BASE_TIME).cast("timestamp").alias("created_at"),
        F.col("ts").cast("timestamp").alias("last_used"),
    )


@lru_cache(maxsize=16)
def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("payload")
    )


def label_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, vector)``: the mean vector of each label, used as query vectors."""
    each = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = each.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("m")).select(
        F.col("label").cast("bigint").alias("query_id"), F.col("m.x").alias("vector")
    )
