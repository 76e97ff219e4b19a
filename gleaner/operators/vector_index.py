"""Top-k for many query vectors through locality-sensitive buckets.

Random planes through the origin cut space into buckets: a vector's bucket has a bit per plane, the side it lies on. A query
looks into the buckets that a near vector most likely fell into: its own first, then those across the planes it is nearest
to, in order of the summed squared distances to the planes crossed. Within the buckets candidates are ranked exactly.

Vectors move once, to their bucket; queries move to each bucket they look into. A bucket that holds many vectors or is asked
by many queries is cut into a grid of blocks, so neither side of a cell is large. The share of the exact result that is found
is measured by ``recall``; ``vectors.top_k`` stays the exact way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.vectors import Ranker, _matrix, ranked

#: Vectors that a bucket holds on average, and the most planes.
BUCKET_ROWS, MOST_PLANES = 1000, 14
#: Buckets that a query looks into.
PROBES = 40
#: Vectors and queries of a cell.
CELL_ROWS, CELL_QUERIES = 16_384, 2048
#: Planes nearest to a query that it may look across.
CROSSED = 10


def planes(dimensions: int, count: int, seed: int = 42) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(count, dimensions))


def buckets(units: np.ndarray, normals: np.ndarray) -> np.ndarray:
    return ((units @ normals.T > 0) << np.arange(len(normals))).sum(axis=1)


def probes(units: np.ndarray, normals: np.ndarray, count: int) -> np.ndarray:
    """The buckets each query looks into, likeliest first; a row per query."""
    side = units @ normals.T
    own = ((side > 0) << np.arange(len(normals))).sum(axis=1)
    some = min(len(normals), CROSSED)
    near = np.argsort(np.abs(side), axis=1, kind="stable")[:, :some]
    costs = np.take_along_axis(side ** 2, near, 1)
    sets = (np.arange(1 << some)[:, None] >> np.arange(some)[None, :]) & 1
    count = min(count, len(sets))
    order = np.argsort(costs @ sets.T, axis=1, kind="stable")[:, :count]
    flips = (sets[order] << near[:, None, :]).sum(axis=2)
    return own[:, None] ^ flips


def top_k_many(vectors: DataFrame, queries: DataFrame, k: int, probe: int = PROBES, bucket_rows: int = BUCKET_ROWS,
               cell_rows: int = CELL_ROWS, cell_queries: int = CELL_QUERIES) -> DataFrame:
    """``(query_id, rank, id, score)``: nearly the k most similar vectors of each query.

    ``vectors`` is ``(id, vector)``, ``queries`` ``(query_id, vector)``. Vectors of another dimension than the first query's,
    by id, are no candidates, and such queries find nothing. With no more than ``bucket_rows`` vectors the result is exact.
    """
    spark = vectors.sparkSession
    first = queries.filter("vector is not null").agg(F.min_by(F.size("vector"), "query_id").alias("size")).first()["size"]
    if first is None:
        return spark.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    fits = F.size("vector") == first
    held, asked = vectors.select("id", "vector").filter(fits), queries.select("query_id", "vector").filter(fits)
    count = int(min(MOST_PLANES, max(0, np.ceil(np.log2(max(1, held.count()) / bucket_rows)))))
    normals = planes(first, count)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(bucket=buckets(_matrix(pdf["vector"]), normals).astype(np.int64))

    def looking(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at:at + 256]
                where = probes(_matrix(part["vector"]), normals, probe).astype(np.int64)
                yield part.loc[part.index.repeat(where.shape[1])].assign(bucket=where.ravel())

    rows = held.mapInPandas(placed, "id bigint, vector array<float>, bucket bigint")
    looked = asked.mapInPandas(looking, "query_id bigint, vector array<float>, bucket bigint")
    # A row per bucket, 2 ** MOST_PLANES at most.
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / cell_rows).alias("parts"))
    wanted = looked.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / cell_queries).alias("groups"))
    grid = F.broadcast(sizes.join(wanted, "bucket"))
    each = lambda name: F.explode(F.expr(f"sequence(0L, {name} - 1)"))
    left = looked.join(grid, "bucket").select("bucket", each("parts").alias("part"), F.pmod(F.xxhash64("query_id"), "groups").alias("grp"),
                                              F.lit(0).alias("kind"), F.col("query_id").alias("id"), "vector")
    right = rows.join(grid, "bucket").select("bucket", F.pmod(F.xxhash64("id"), "parts").alias("part"), each("groups").alias("grp"),
                                             F.lit(1).alias("kind"), "id", "vector")
    cells = left.union(right).withColumn("cell", F.xxhash64("bucket", "part", "grp"))
    cells = cells.select("cell", "kind", "id", "vector").repartition("cell").sortWithinPartitions("cell", "kind")

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, asking, best = None, [], None
        for pdf in batches:
            if not len(pdf):
                continue
            cells_of, kinds = pdf["cell"].to_numpy(), pdf["kind"].to_numpy()
            new = (cells_of[1:] != cells_of[:-1]) | (kinds[1:] != kinds[:-1])
            starts = [0, *(np.flatnonzero(new) + 1).tolist(), len(pdf)]
            for i, j in zip(starts[:-1], starts[1:]):
                part = pdf.iloc[i:j]
                if part["cell"].iat[0] != cell:
                    if best is not None:
                        yield from best.found()
                    cell, asking, best = part["cell"].iat[0], [], None
                if not part["kind"].iat[0]:
                    asking.append(part)
                    continue
                if best is None and asking:
                    both = pd.concat(asking)
                    best = Ranker(both["id"].to_numpy(), _matrix(both["vector"]), k)
                if best is not None:
                    best.show(part["id"].to_numpy(), _matrix(part["vector"]))
        if best is not None:
            yield from best.found()

    return ranked(cells.mapInPandas(met, "query_id bigint, id bigint, score double"), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``(query_id, recall)``: the share of each query's exact rows that was found."""
    hit = found.select("query_id", "id", F.lit(True).alias("hit"))
    return exact.join(hit, ["query_id", "id"], "left").groupBy("query_id").agg(F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0)).alias("recall"))
