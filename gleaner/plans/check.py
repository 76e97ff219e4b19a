"""The bulk check job: requests in, verdicts out, with or without the membership filter in front."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.lookup import MAX_IOCS_PER_REQUEST, check, explode_requests, validate_requests
from gleaner.operators.sketch import SketchSize, probe


def bulk_check(
    requests: DataFrame, store: DataFrame, pick: str = "oldest", normalize: bool = False, max_iocs: int | None = None
) -> DataFrame:
    return check(explode_requests(requests, max_iocs), store, pick, normalize)


def gated_check(
    requests: DataFrame, store: DataFrame, sketch: DataFrame, size: SketchSize, pick: str = "oldest",
    max_iocs: int | None = None,
) -> DataFrame:
    """The same verdicts as ``bulk_check``; values the filter rules out never reach the store join."""
    asked = explode_requests(requests, max_iocs)
    values = probe(asked.select(F.col("ioc").alias("ioc_value")).distinct(), "ioc_value", sketch, size)
    possible = values.filter("maybe_present").select("ioc_value")
    return check(asked, store, pick, wanted=possible)


def answer(requests: DataFrame, store: DataFrame, pick: str = "oldest", normalize: bool = False, max_iocs: int = MAX_IOCS_PER_REQUEST) -> DataFrame:
    """The verdicts of ``bulk_check`` with an empty ``error``, and one row with the reason for each refused request.

    Nobody is left without an answer: a request is refused if it has no values, or more than ``max_iocs``, or an ``error``
    of its own (see ``lookup.parse_requests``).
    """
    own = F.col("error") if "error" in requests.columns else F.lit("")
    told = requests.select("request_id", "iocs", own.alias("__error"))
    fine = F.col("__error") == ""
    verdicts = bulk_check(told.filter(fine & (F.coalesce(F.size("iocs"), F.lit(0)) > 0)).drop("__error"), store, pick, normalize, max_iocs)
    refused = validate_requests(told.filter(fine), max_iocs).filter("not is_valid").select("request_id", "error")
    refused = refused.union(told.filter(~fine).select("request_id", "__error"))
    return verdicts.withColumn("error", F.lit("")).unionByName(refused, allowMissingColumns=True)
