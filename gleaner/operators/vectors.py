"""Vector collections: dimension check, upsert, exact top-k by cosine similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.versions import latest

# Query vectors are sent to every task up to this many numbers (16 MB as doubles); beyond it both sides are cut into
# blocks that meet in a join.
BROADCAST_NUMBERS = 2_000_000
_QUERIES_PER_BLOCK = 4096


def dimension_violations(vectors: DataFrame, dimensions: int) -> DataFrame:
    """Vectors that do not have the collection's size."""
    size = F.coalesce(F.size("vector"), F.lit(-1))
    return vectors.filter(size != dimensions).select("id", size.cast("bigint").alias("dimensions"))


def upsert(current: DataFrame, changes: DataFrame, version: str) -> DataFrame:
    """One row per id after the changes."""
    return latest(current.unionByName(changes), ["id"], version)


def with_payload(vectors: DataFrame, column: str = "payload") -> DataFrame:
    """JSON payloads as variants; null where the text is no JSON."""
    return vectors.withColumn(column, F.try_parse_json(column))


def payload_value(path: str, kind: str, column: str = "payload") -> Column:
    """What stands at a path of a variant payload, null if it is not there or not of that kind: for filters before a search."""
    return F.try_variant_get(column, path, kind)


def _matrix(column: pd.Series) -> np.ndarray:
    """Vectors of one dimension as rows of length one, or zero."""
    rows = np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 0))
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


class Ranker:
    """The k best of all vectors shown for each query, ties by id; what it holds does not grow with the vectors."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, block: int = 256):
        self.query_ids, self.queries, self.k, self.block = query_ids, queries, k, block
        self.ids = np.full((len(query_ids), k), np.iinfo(np.int64).max)
        self.scores = np.full((len(query_ids), k), -np.inf)

    def show(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        for at in range(0, len(self.query_ids), self.block):
            part = slice(at, at + self.block)
            scores = np.round(self.queries[part] @ matrix.T, 6)
            if scores.shape[1] > self.k:
                last = np.partition(scores, -self.k, axis=1)[:, -self.k]
                rows, columns = np.nonzero(scores >= np.maximum(last, self.scores[part, -1])[:, None])
            else:
                rows, columns = np.divmod(np.arange(scores.size), max(1, scores.shape[1]))
            held = np.repeat(np.arange(scores.shape[0]), self.k)
            row = np.concatenate((held, rows))
            id_, score = np.concatenate((self.ids[part].ravel(), ids[columns])), np.concatenate((self.scores[part].ravel(), scores[rows, columns]))
            order = np.lexsort((id_, -score, row))
            row, id_, score = row[order], id_[order], score[order]
            first = np.searchsorted(row, np.arange(scores.shape[0]))
            best = (first[:, None] + np.arange(self.k)[None, :]).ravel()
            self.ids[part], self.scores[part] = id_[best].reshape(-1, self.k), score[best].reshape(-1, self.k)

    def found(self) -> Iterator[pd.DataFrame]:
        for at in range(0, len(self.query_ids), 4096):
            rows, places = np.nonzero(np.isfinite(self.scores[at:at + 4096]))
            yield pd.DataFrame({"query_id": self.query_ids[at + rows], "id": self.ids[at + rows, places], "score": self.scores[at + rows, places]})


_CANDIDATE_SCHEMA = "query_id bigint, id bigint, score double"


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, id, score)``: the k most similar vectors of each query, exactly.

    Each task keeps its own k best per query, so only those are shuffled to the final ranking. ``queries`` is
    ``(query_id, vector)``. Few queries go to every task; many are cut into blocks (see ``_grid``).
    """
    sized = queries.select("query_id", "vector").agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("numbers")
    ).first()
    if sized["n"] == 0:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    if sized["numbers"] <= BROADCAST_NUMBERS:
        candidates = _broadcast_scan(vectors, queries, k)
    else:
        candidates = _grid(vectors, queries, k, -(-sized["n"] // _QUERIES_PER_BLOCK))
    return ranked(candidates, k)


def ranked(candidates: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, id, score)`` of the best candidates."""
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    found = candidates.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "id", "score")


def _broadcast_scan(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    rows = queries.select("query_id", "vector").toPandas()  # size checked by the caller
    sent = vectors.sparkSession.sparkContext.broadcast((rows["query_id"].to_numpy(), _matrix(rows["vector"])))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Ranker(*sent.value, k)
        for pdf in batches:
            if len(pdf):
                best.show(pdf["id"].to_numpy(), _matrix(pdf["vector"]))
        yield from best.found()

    return vectors.select("id", "vector").mapInPandas(scan, _CANDIDATE_SCHEMA)


def _grid(vectors: DataFrame, queries: DataFrame, k: int, query_blocks: int) -> DataFrame:
    """Cells of query block by vector block; every pair of blocks meets in one cell of bounded size."""
    vector_blocks = max(1, vectors.count() // 100_000)
    left = queries.select(
        "query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).alias("qb"),
        F.explode(F.expr(f"sequence(0L, {vector_blocks - 1}L)")).alias("vb"),
    )
    right = vectors.select(
        "id", "vector", F.pmod(F.xxhash64("id"), F.lit(vector_blocks)).alias("vb"),
        F.explode(F.expr(f"sequence(0L, {query_blocks - 1}L)")).alias("qb"),
    )

    def cell(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        best = Ranker(asked["query_id"].to_numpy(), _matrix(asked["vector"]), k)
        best.show(held["id"].to_numpy(), _matrix(held["vector"]))
        return pd.concat(best.found())

    return left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(cell, _CANDIDATE_SCHEMA)
