"""Indicator extraction: text rows in, ``(key columns, ioc_type, ioc_value)`` rows out."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.patterns import (
    DEFAULT_RULES,
    IOC_TYPES,
    PatternRule,
    candidate_tokens,
    is_placeholder_domain,
    is_private_ipv4,
)

_CANDIDATES = "__candidates"


def spread(texts: DataFrame) -> DataFrame:
    """Spread a small input over all cores.

    A scan gets fewer splits than there are cores only when it is smaller than ``spark.sql.files.openCostInBytes``
    (4 MB) per core, so what is shuffled here is bounded by that. A larger input is returned as it is.
    """
    cores = texts.sparkSession.sparkContext.defaultParallelism
    return texts.repartition(cores) if texts.rdd.getNumPartitions() < cores else texts


def _active(rules: Sequence[PatternRule], types: Iterable[str] | None) -> list[PatternRule]:
    wanted = None if types is None else set(types)
    return [rule for rule in rules if wanted is None or rule.ioc_type in wanted]


def _prepared(
    texts: DataFrame, keep: Sequence[str], text: str, rules: Sequence[PatternRule]
) -> tuple[DataFrame, dict[str, Column]]:
    """``texts`` with the inputs the rules share, each computed once, and an array of values per indicator type.

    First the candidate tokens, then what several rules prepare from them: two projections, which Catalyst keeps apart
    because each is used more than once.
    """
    reduced = texts.select(*dict.fromkeys([*keep, text]), candidate_tokens(F.col(text)).alias(_CANDIDATES))
    shared = {rule.prepare: f"__shared_{n}" for n, rule in enumerate(rules) if rule.prepare is not None}
    reduced = reduced.select("*", *(prepare(F.col(_CANDIDATES)).alias(name) for prepare, name in shared.items()))

    def values(rule: PatternRule) -> Column:
        base = F.col(_CANDIDATES) if rule.candidates_only else F.col(text)
        return rule.values(base if rule.prepare is None else F.col(shared[rule.prepare]), base)

    return reduced, {rule.ioc_type: values(rule) for rule in rules}


def scan(
    texts: DataFrame,
    keys: Sequence[str],
    text: str = "content",
    types: Iterable[str] | None = None,
    exclude_private_ips: bool = False,
    exclude_placeholder_domains: bool = False,
    whole_keys: bool = True,
    mark_keys: bool = False,
    rules: Sequence[PatternRule] = DEFAULT_RULES,
) -> DataFrame:
    """Scan ``text`` for all rules in one pass.

    ``whole_keys`` says that each key has one row (a whole file per row), so removing duplicates inside the row is
    enough and nothing is shuffled. With one row per line pass ``False``: values are then also made distinct over the
    rows of a key, with partial aggregation before the shuffle. ``mark_keys`` adds a row with empty type and value for
    every row read, so that keys without indicators are known without reading the texts again.
    """
    reduced, values = _prepared(texts, keys, text, _active(rules, types))
    if mark_keys:
        values[""] = F.array(F.lit(""))
    per_type = F.array(
        *(F.struct(F.lit(name).alias("ioc_type"), array.alias("values")) for name, array in values.items())
    )
    found = reduced.select(*keys, F.inline(per_type)).select(
        *keys, "ioc_type", F.explode("values").alias("ioc_value")
    )
    if exclude_private_ips:
        found = found.filter((F.col("ioc_type") != "ipv4") | ~is_private_ipv4(F.col("ioc_value")))
    if exclude_placeholder_domains:
        found = found.filter((F.col("ioc_type") != "domain") | ~is_placeholder_domain(F.col("ioc_value")))
    return found if whole_keys else found.dropDuplicates([*keys, "ioc_type", "ioc_value"])


def with_ioc_count(
    files: DataFrame, text: str = "content", rules: Sequence[PatternRule] = DEFAULT_RULES
) -> DataFrame:
    """``files`` (one whole file per row) with ``ioc_count``; routing by it needs no join and no shuffle.

    The count comes out of a generator, so that a filter on it is not pushed down and evaluated a second time.
    """
    reduced, values = _prepared(files, files.columns, text, rules)
    total = sum((F.size(array) for array in values.values()), F.lit(0)).cast("bigint")
    return reduced.select(*files.columns, F.inline(F.array(F.struct(total.alias("ioc_count")))))


def with_scan_result(
    files: DataFrame, text: str = "content", rules: Sequence[PatternRule] = DEFAULT_RULES
) -> DataFrame:
    """``files`` (one whole file per row) with ``iocs``: a map from type to its distinct values, empty types left out."""
    reduced, values = _prepared(files, files.columns, text, rules)
    by_type = F.map_from_arrays(F.array(*(F.lit(name) for name in values)), F.array(*values.values()))
    found = F.map_filter(by_type, lambda _, array: F.size(array) > 0)
    return reduced.select(*files.columns, F.inline(F.array(F.struct(found.alias("iocs")))))


def explode_result(scanned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, ioc_type, ioc_value)`` rows of ``with_scan_result``'s map."""
    by_type = scanned.select(*keys, F.explode("iocs").alias("ioc_type", "values"))
    return by_type.select(*keys, "ioc_type", F.explode("values").alias("ioc_value"))


def count_per_file(files: DataFrame, found: DataFrame) -> DataFrame:
    """``(file_id, ioc_count)`` for every file, zero included."""
    counts = found.groupBy("file_id").agg(F.count("*").alias("ioc_count"))
    return files.select("file_id").join(counts, "file_id", "left").select(
        "file_id", F.coalesce("ioc_count", F.lit(0).cast("bigint")).alias("ioc_count")
    )


def enrich(found: DataFrame, seen_at: Column | datetime, key: str = "file_id") -> DataFrame:
    """Indicator rows with the defaults of a first sighting at ``seen_at``."""
    when = F.date_trunc("second", seen_at if isinstance(seen_at, Column) else F.lit(seen_at).cast("timestamp"))
    return found.select(
        "ioc_value",
        "ioc_type",
        F.col(key).alias("source_file_id"),
        F.lit("Unknown").alias("malware_family"),
        F.lit(50).cast("smallint").alias("confidence"),
        when.alias("first_seen"),
        when.alias("last_seen"),
        F.lit(0).cast("bigint").alias("hit_count"),
        F.lit(None).cast("bigint").alias("vector_id"),
        F.array().cast("array<string>").alias("tags"),
    )


def type_violations(rows: DataFrame, column: str, allowed: Sequence[str] = IOC_TYPES) -> DataFrame:
    """Rows whose ``column`` is outside the allowed set (null included)."""
    return rows.filter(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))
