"""Versioned rows: append versions, read the latest, delete by key, drop the expired."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """One row per key: the highest ``version``, ties broken by the remaining columns in order.

    ``max`` of a struct is a partial aggregate, so each task sends at most one row per key, however often a key was
    written, and the result does not depend on row order. When only keys are read, Catalyst drops the struct.
    """
    rest = [c for c in rows.columns if c not in keys and c != version]
    newest = F.max(F.struct(version, *rest)).alias("__newest")
    return (
        rows.groupBy(*keys)
        .agg(newest)
        .select(*(F.col(c) if c in keys else F.col(f"__newest.{c}").alias(c) for c in rows.columns))
    )


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The latest rows after ``changes`` (same columns) have been appended."""
    return latest(current.unionByName(changes.select(*current.columns)), keys, version)


def point_lookup(rows: DataFrame, wanted: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Latest rows of the wanted keys; only those rows reach the aggregation."""
    return latest(rows.join(wanted.select(*keys).distinct(), list(keys), "left_semi"), keys, version)


def without_keys(rows: DataFrame, removed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(removed.select(*keys), list(keys), "left_anti")


def retained(rows: DataFrame, time: str, as_of: datetime, days: int = 30) -> DataFrame:
    """Rows younger than ``days`` at ``as_of``: a plain comparison, so it prunes partitions and row groups."""
    start = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
    return rows.filter(F.col(time) > start)
