"""Connected components of an edge table, by rounds of joins and grouping (large-star and small-star).

Nothing is held by the driver but a count per round; rounds are stored in the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import stored


def _stars(edges: DataFrame, keep_larger: bool) -> DataFrame:
    """Tie each node's neighbours (all larger ones, or all smaller ones and itself) to the smallest of them."""
    if keep_larger:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (u, v)``: root is the smallest node that can be reached.

    Loops and repeated edges do no harm. Both steps keep which nodes hang together, and end in stars.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    pairs, before = stored(pairs, "edges"), None
    while not pairs.isEmpty():
        pairs = stored(_stars(_stars(pairs, True), False), "edges")
        now = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
