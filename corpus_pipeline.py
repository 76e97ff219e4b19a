"""From raw documents to packed sequences: five stages, each written to the shared folder and read again by the next.

Rows with null ids or repeated ids go through; a stage's verdict is about the row's text, so that rows without an id do not
share one. Extra columns of ``documents`` are carried to the last stage.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontam, pii, quality, simhash
from gleaner.llm.common import stored
from gleaner.llm.queries import packed
from gleaner.session import ship_package

#: Texts with benchmark items up to which every task gets their digests: 64 bytes each.
BROADCAST_LEAKS = 200_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the standard policy keeps."""
    rows = quality.apply_policy(quality.ledger(docs, carry=True), quality.STANDARD)
    return rows.filter("kept").select("row.*")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    key = "__text_sha256"
    keyed = docs.withColumn(key, F.sha2(F.coalesce("text", F.lit("")), 256))
    found = decontam.contained_items(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id=key)
    leaks = stored(found.select(F.col("doc_id").alias(key)).distinct(), "leaks")
    few = leaks.count() <= BROADCAST_LEAKS
    return keyed.join(F.broadcast(leaks) if few else leaks, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; ``n_chars`` follows the text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packed(docs)


def _shipped(stage):
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality_rules", _shipped(quality_rules)),
    ("simhash_near_dedup", _shipped(simhash_near_dedup)),
    ("benchmark_decontamination", _shipped(benchmark_decontamination)),
    ("pii", _shipped(pii_redaction)),
    ("packing", _shipped(packing)),
]

#: Hashing, components and tokens are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
