"""Stored tables: appended versions under one folder, a current view, and compaction into a new folder."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.versions import latest
from gleaner.schemas import IOC_TABLE, OBJECT_TABLE, REGISTRY_TABLE, Versioned
from gleaner.session import brief_shuffles, shared_folder

#: Of stored tables: digests and ids are letters of 16 kinds, which this codec halves.
CODEC = "zstd"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Passing:
    """Tables in the shared folder that a job writes, reads again, and removes when it is done."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def folder(self, name: str) -> str:
        self.paths.append(f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}")
        return self.paths[-1]

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = self.folder(name)
        df.write.option("compression", CODEC).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Passing]:
    """Tables that are removed at the end. What is shuffled meanwhile is removed as soon as its table is written."""
    kept = Passing(spark)
    try:
        with brief_shuffles(spark):
            yield kept
    finally:
        for path in kept.paths:
            remove_folder(spark, path)


class StoredTable:
    """Parquet rows under ``path``. Writers only append; readers resolve versions."""

    def __init__(self, spark: SparkSession, path: str, kind: Versioned, partition_by: Sequence[str] = (),
                 sort_by: Sequence[str] = (), bloom_on: str | None = None):
        self.spark, self.path, self.kind = spark, path, kind
        self.partition_by, self.sort_by, self.bloom_on = tuple(partition_by), tuple(sort_by), bloom_on

    def _write(self, rows: DataFrame, path: str, mode: str) -> None:
        rows = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.kind.schema))
        if self.partition_by and mode == "append":
            # A few well-sized files per partition value instead of one per task; a large value is split.
            rows = rows.hint("rebalance", *self.partition_by)
        if self.sort_by:
            rows = rows.sortWithinPartitions(*self.partition_by, *self.sort_by)
        writer = rows.write.mode(mode).option("compression", CODEC)
        if self.partition_by:
            writer = writer.partitionBy(*self.partition_by)
        if self.bloom_on:
            writer = writer.option(f"parquet.bloom.filter.enabled#{self.bloom_on}", "true")
        writer.parquet(path)

    def append(self, rows: DataFrame) -> None:
        self._write(rows, self.path, "append")

    def all_versions(self) -> DataFrame:
        """Every row written so far; empty before the first append."""
        try:
            rows = self.spark.read.schema(self.kind.schema).parquet(self.path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], self.kind.schema)
        return rows.select(*(f.name for f in self.kind.schema))

    def current(self) -> DataFrame:
        return latest(self.all_versions(), self.kind.keys, self.kind.version)

    def rewrite(self, rows: DataFrame) -> None:
        """Replace all rows. They are written beside the table first, so they may come from it."""
        kept = f"{self.path}-{uuid.uuid4().hex}"
        self._write(rows, kept, "errorifexists")
        written = self.spark.read.schema(self.kind.schema).parquet(kept)
        self._write(written, self.path, "overwrite")
        remove_folder(self.spark, kept)

    def compact(self, path: str) -> StoredTable:
        """Write current rows to a new folder, range-partitioned by key so that lookups skip row groups.

        The folder being read is left alone; switch readers to the returned table.
        """
        ordered = self.current().repartitionByRange(*self.kind.keys)
        other = StoredTable(self.spark, path, self.kind, self.partition_by, self.sort_by or self.kind.keys, self.bloom_on)
        other._write(ordered, path, "errorifexists")
        return other


def registry_table(spark: SparkSession, root: str) -> StoredTable:
    return StoredTable(spark, f"{root}/file_registry", REGISTRY_TABLE)


def ioc_table(spark: SparkSession, root: str) -> StoredTable:
    return StoredTable(spark, f"{root}/ioc_store", IOC_TABLE, ["ioc_type"], ["ioc_value"], "ioc_value")


def object_table(spark: SparkSession, root: str) -> StoredTable:
    return StoredTable(spark, f"{root}/objects", OBJECT_TABLE)


class BucketedTable(StoredTable):
    """A table in buckets by its keys, sorted in each. What is joined or grouped by the keys is not shuffled on this side.

    Buckets are known to the catalog only, so a session names the table once; the rows are those under ``path``.
    """

    def __init__(self, spark: SparkSession, path: str, kind: Versioned, buckets: int = 64):
        super().__init__(spark, path, kind)
        self.buckets, self.name = buckets, f"bucketed_{hashlib.md5(path.encode()).hexdigest()}"

    def _named(self) -> str:
        if not self.spark.catalog.tableExists(self.name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.kind.schema)
            keys, place = ", ".join(self.kind.keys), self.path.replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        return self.name

    def append(self, rows: DataFrame) -> None:
        rows = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.kind.schema))
        name, keys = self._named(), self.kind.keys
        dealt = rows.repartition(self.buckets, *keys).sortWithinPartitions(*keys)  # one file per bucket
        dealt.write.mode("append").format("parquet").bucketBy(self.buckets, *keys).sortBy(*keys).saveAsTable(name)

    def all_versions(self) -> DataFrame:
        return self.spark.table(self._named())


def bucketed_registry(spark: SparkSession, root: str, buckets: int = 64) -> BucketedTable:
    return BucketedTable(spark, f"{root}/file_registry_bucketed", REGISTRY_TABLE, buckets)
