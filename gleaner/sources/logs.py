"""The request log as a stored table in a folder per day: appended to, read by time, and shortened by whole days."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.schemas import QUERY_LOG
from gleaner.sources.tables import remove_folder

DAY = "day"


class LogTable:
    """Rows of ``QUERY_LOG`` under ``path``, in folders by the UTC day of ``timestamp``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, rows: DataFrame) -> None:
        """Add rows; missing columns are null, and a row without ``query_id`` gets a random one (UUID)."""
        known = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in QUERY_LOG]
        named = rows.select(*known).withColumns({"query_id": F.coalesce("query_id", F.expr("uuid()")), DAY: F.date_format("timestamp", "yyyy-MM-dd")})
        # A few well-sized files a day instead of one per task; a busy day is split.
        named.hint("rebalance", DAY).write.mode("append").partitionBy(DAY).parquet(self.path)

    def read(self) -> DataFrame:
        """All rows and their ``day``; empty before the first append."""
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in QUERY_LOG) + f", {DAY} string"
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def between(self, start: datetime, end: datetime) -> DataFrame:
        """Rows from ``start`` on and before ``end``; other days' folders are not read."""
        days = F.col(DAY).between(f"{start:%Y-%m-%d}", f"{end:%Y-%m-%d}")
        return self.read().filter(days & (F.col("timestamp") >= F.lit(start)) & (F.col("timestamp") < F.lit(end)))

    def retain(self, as_of: datetime, days: int = 30) -> tuple[list[str], list[str]]:
        """Remove rows that are ``days`` old or older at ``as_of`` (UTC).

        Folders of earlier days go as they are, the border day's is written anew, younger ones are left alone; days are
        returned as those that went and those that were rewritten. Rows without a time stay.
        """
        start = as_of - timedelta(days=days)
        border = f"{start:%Y-%m-%d}"
        held = sorted(r[DAY] for r in self.read().select(DAY).distinct().collect() if r[DAY] is not None)  # a row per day
        gone, rewritten = [d for d in held if d < border], []
        if border in held:
            kept = self.read().filter((F.col(DAY) == border) & (F.col("timestamp") > F.lit(start)))
            scratch = f"{self.path}-{uuid.uuid4().hex}"
            kept.write.partitionBy(DAY).parquet(scratch)
            young = self.spark.read.schema(self.read().schema).parquet(scratch)
            if young.isEmpty():
                gone.append(border)
            else:
                rewritten.append(border)
                young.hint("rebalance", DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(self.path)
            remove_folder(self.spark, scratch)
        for day in gone:
            remove_folder(self.spark, f"{self.path}/{DAY}={day}")
        return gone, rewritten


def log_table(spark: SparkSession, root: str) -> LogTable:
    return LogTable(spark, f"{root}/query_log")
