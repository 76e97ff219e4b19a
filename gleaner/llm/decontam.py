"""Benchmark decontamination: items of a test set that lie, whole or nearly so, inside documents.

A document is far longer than an item, so similarity says little; what counts is containment, the share of an item's
distinct five-word shingles that the document has. Items are put in size classes (powers of two). An item's sketch is its
bottom-k MinHash: the k shingles with the least hashes, k following from the upper size of its class so that an item of n
shingles with at least ``ceil(0.8 n)`` of them in a document shares at least ``k - (n - ceil(0.8 n)) >= 1`` of its sketch.
That minimum is the candidate filter, so no item is missed; candidates are then verified by exact shingle containment.

Documents are read once: their shingles meet the index of items (sketch and other shingles, told apart by a flag), and
only those that meet an item leave the task. The index is broadcast if it is shown to be small, else met by a shuffle.

Defined results: case is ignored; a text of fewer than five words is one shingle, its words; texts without words (null,
empty) contain nothing and are found nowhere; rows that share a ``doc_id`` (null included) count as one document, rows that
share an ``item_id`` as one item; empty tables give empty tables. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import stored
from gleaner.llm.quality import words_of

SHINGLE = 5
CONTAINMENT_PERCENT = 80
#: Index rows up to which every task gets the index whole: 32 bytes each.
BROADCAST_ROWS = 500_000


def shingles(texts: DataFrame, key: str, text: str, name: str, size: int = SHINGLE) -> DataFrame:
    """``(name, n_windows, shingle)``, one row per window of words. Hashing is left to generated code, row by row."""
    words = texts.select(F.col(key).alias(name), words_of(F.lower(F.col(text))).alias("words")).filter(F.size("words") > 0)
    placed = words.select(name, "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))).alias("at"))
    window = [F.get("words", F.col("at") + k) for k in range(size)]  # places beyond a short text are null and hash to nothing
    return placed.select(name, F.greatest(F.size("words") - size + 1, F.lit(1)).alias("n_windows"), F.xxhash64(*window).alias("shingle"))


def _needed(n: Column, percent: int) -> Column:
    return F.floor((n * percent + 99) / 100).cast("long")


def item_index(items: DataFrame, percent: int = CONTAINMENT_PERCENT, size: int = SHINGLE, id_column: str = "item_id",
               text_column: str = "text") -> DataFrame:
    """One row per item and distinct shingle: its size class, the shingles that must be shared, and whether it is in the sketch."""
    each = shingles(items, id_column, text_column, "item_id", size).select("item_id", "shingle").distinct()
    counted = each.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"), F.sort_array(F.collect_list("shingle")).alias("all"))
    size_class = F.floor(F.log2("n_item")).cast("int")
    sized = counted.withColumn("size_class", size_class).withColumn("need", _needed(F.col("n_item"), percent))
    upper = F.pow(F.lit(2.0), F.col("size_class") + 1).cast("long") - 1
    sketch = F.least(F.col("n_item"), upper - _needed(upper, percent) + 1)
    sized = sized.withColumn("sketch", sketch).withColumn("least_hits", F.greatest(F.lit(1), F.col("sketch") - (F.col("n_item") - F.col("need"))))
    return sized.select("item_id", "n_item", "size_class", "need", "least_hits", "sketch", F.posexplode("all").alias("rank", "shingle")) \
        .select("item_id", "n_item", "size_class", "need", "least_hits", (F.col("rank") < F.col("sketch")).alias("in_sketch"), "shingle")


def contained_items(docs: DataFrame, items: DataFrame, percent: int = CONTAINMENT_PERCENT, size: int = SHINGLE,
                    doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, size_class, n_item, n_shared, containment)`` of every item that a document contains."""
    index = stored(item_index(items, percent, size, item_id, item_text), "items")
    rows = index.count()
    seen = shingles(docs, doc_id, doc_text, "doc_id", size)
    met = seen.join(F.broadcast(index) if rows <= BROADCAST_ROWS else index, "shingle").filter("n_windows >= need")
    key = ["doc_id", "item_id", "size_class", "n_item", "need", "least_hits"]
    once = stored(met.select(*key, "in_sketch", "shingle").distinct(), "met")
    candidates = once.filter("in_sketch").groupBy(*key).agg(F.count(F.lit(1)).alias("hits")).filter("hits >= least_hits")
    pairs = candidates.select(F.col("doc_id").alias("d"), F.col("item_id").alias("i"))
    held = once.join(pairs, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("item_id").eqNullSafe(F.col("i")), "left_semi")
    shared = held.groupBy("doc_id", "item_id", "size_class", "n_item", "need").agg(F.count(F.lit(1)).alias("n_shared"))
    return shared.filter("n_shared >= need").select("doc_id", "item_id", "size_class", "n_item", "n_shared",
                                                     (F.col("n_shared") / F.col("n_item")).alias("containment"))
