"""Session settings the jobs rely on. Sizes follow the cluster; nothing here is tuned to one machine."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # Timestamps are formatted and truncated in UTC throughout.
    "spark.sql.session.timeZone": "UTC",
    # Partition counts are chosen at run time from shuffle sizes; hot join partitions are split.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def build_session(app_name: str = "gleaner", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **extra}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> None:
    """Set the run-time settings on a session somebody else made."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    ship_package(spark)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver was started. Done once per application."""
    context = spark.sparkContext
    if getattr(context, "_gleaner_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="gleaner-")) / "gleaner.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._gleaner_shipped = True


#: By session: the setting that ``brief_shuffles`` puts back, and how many are inside.
_BRIEF: dict[str, tuple[str, int]] = {}
_BRIEF_LOCK = threading.Lock()


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs in here are removed when it is done, not when the driver happens to collect its garbage."""
    name, session = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", spark._jsparkSession.sessionUUID()
    with _BRIEF_LOCK:  # a job and a stream of a session may be in here at once
        before, inside = _BRIEF.get(session, (spark.conf.get(name, "false"), 0))
        _BRIEF[session] = before, inside + 1
        spark.conf.set(name, "true")
    try:
        yield
    finally:
        with _BRIEF_LOCK:
            before, inside = _BRIEF.pop(session)
            if inside > 1:
                _BRIEF[session] = before, inside - 1
            else:
                spark.conf.set(name, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach, as named by the cluster in ``spark.checkpoint.dir``.

    Only a session whose executors are threads of the driver (``local``) may leave it unset: it gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="gleaner-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Write rows to the shared folder and read them back: worked out once, however often they are used."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
