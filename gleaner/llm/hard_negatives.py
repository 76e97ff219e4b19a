"""Hard negatives: for anchors and their positives, the most similar rows of other labels that are not too similar.

Anchors are clustered, and every cluster has one list of candidates, sorted once by an upper bound of what a candidate can
score with any member: a member lies within the cluster's angle of its centre, so a candidate of norm c at a larger angle
scores at most c times the cosine of the difference, for each unit of the member's norm. Members walk the list together and
leave it when the bound certifies that nothing further on can enter what they look for. The list is walked where the rows
lie: a task sorts its own share for each cluster, keeps each member's best, and only those are shuffled and ranked.

There are two searches. The first finds an anchor's positives, its best rows of the same label; the second, between a share
``low`` and a share ``high`` of each positive's score, the best rows of other labels. Before each, a search over one row of
``SEED_SHARE`` tells a score that the last of the best surely reaches: the walk is cut there, and less is shuffled. Anchors
are sent to the tasks in groups of at most ``GROUP_BYTES``, one search after the other.

A component x counts as floor(scale x); a score is the exact inner product of these numbers.

Defined results: a row without id, label or vector, or with a null or non-finite component, takes no part; nor does one with
components so large that scores pass 64 bits (each below sqrt(2**62 / dimensions) in magnitude does). Rows that repeat an id
are rows of their own: each can be an anchor, and each the other's positive; equal scores stand by id. Rows of different
dimensions have no score with each other; an empty vector scores 0 with another. An empty table, one without anchors, and
anchors without positives give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import stored

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative scores between these hundredths of the positive's score.
LOW, HIGH = 30, 90
#: Anchors of a search, in bytes of their components as doubles.
GROUP_BYTES = 16 << 20
#: Anchors that cluster centres are fitted on, the most centres, and the most members of a block of a cluster.
FIT_ROWS, CENTRES, MEMBERS = 4096, 128, 256
#: Candidates that members meet at once while they walk.
STEP = 512
SEED_SHARE = 16

LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
FOUND = "anchor bigint, slot int, row bigint, id bigint, score bigint"


def _matrix(vectors: list[np.ndarray], scale: float) -> np.ndarray:
    return np.floor(np.stack(vectors).astype(np.float64) * scale)


def _units(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return np.divide(matrix, norms[:, None], out=np.zeros_like(matrix), where=norms[:, None] > 0), norms


def centres(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Directions that the sample gathers around: k-means on the sphere, from evenly spaced rows."""
    units = _units(sample)[0]
    found = units[np.linspace(0, len(units) - 1, count).astype(np.int64)]
    for _ in range(rounds):
        nearest = np.argmax(units @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, units)
        found, norms = _units(sums)
        found[norms == 0] = units[np.flatnonzero(norms == 0) % len(units)]
    return found


class Block:
    """Members of a cluster: rows of the anchor arrays, their vectors, and the cone they lie in."""

    def __init__(self, rows: np.ndarray, matrix: np.ndarray):
        self.rows, self.matrix = rows, matrix
        units, self.norms = _units(matrix)
        self.centre = _units(units.sum(axis=0)[None])[0][0]
        self.angle = float(np.arccos(np.clip(units @ self.centre, -1, 1)).max())
        self.largest = float(np.abs(matrix).max()) if matrix.size else 0.0

    def bounds(self, units: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """What a candidate scores at most with any member, for each unit of the member's norm."""
        beyond = np.arccos(np.clip(units @ self.centre, -1, 1)) - self.angle
        # Widened a little, for the rounding of angles.
        return norms * np.minimum(1, np.where(beyond > 0, np.cos(np.minimum(beyond, np.pi)), 1) + 1e-7) + 1e-6

    def scores(self, members: np.ndarray, candidates: np.ndarray, largest: float) -> np.ndarray:
        a = self.matrix[members]
        if self.largest * largest * max(1, a.shape[1]) < 2.0 ** 53:
            return (a @ candidates.T).astype(np.int64)
        return a.astype(np.int64) @ candidates.T.astype(np.int64)


class Anchors:
    """A group of anchors in blocks, and for each anchor and slot the range of scores looked for."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, vectors: list[np.ndarray], scale: float, centre_of: dict[int, np.ndarray]):
        self.rows, self.labels, self.blocks = rows, labels, {}
        sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            matrix = _matrix([vectors[i] for i in at], scale)
            nearest = np.argmax(_units(matrix)[0] @ centre_of[size].T, axis=1)
            order = np.argsort(nearest, kind="stable")
            cuts = np.flatnonzero(np.diff(nearest[order])) + 1
            parts = [p[k:k + MEMBERS] for p in np.split(order, cuts) for k in range(0, len(p), MEMBERS)]
            self.blocks[size] = [Block(at[p], matrix[p]) for p in parts]


class _Best:
    """The best finds of each member of a block and slot so far, by score and then id."""

    def __init__(self, low: np.ndarray, keep: int):
        self.low, self.keep = low.copy(), keep
        self.best = np.zeros((5, 0), np.int64)  # member, slot, id, score, row
        self.new: list[np.ndarray] = []
        self.size = 0

    def add(self, *columns: np.ndarray) -> None:
        self.new.append(np.stack(columns))
        self.size += len(columns[0])

    def cut(self, least: int = 0) -> np.ndarray:
        """If there are ``least`` new finds, drop all but the best; what the last of them has is the least score from now on."""
        if not self.size or self.size < least:
            return self.best
        found = np.concatenate([self.best, *self.new], axis=1)
        member, slot, id_, score, row = found
        # Scores are turned by their bits, so that the least of all can be turned, too.
        found = found[:, np.lexsort((row, id_, ~score, slot, member))]
        key = found[0] * self.low.shape[1] + found[1]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        rank = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        last = found[:, rank == self.keep - 1]
        np.maximum.at(self.low, (last[0], last[1]), last[3])
        self.best, self.new, self.size = found[:, rank < self.keep], [], 0
        return self.best


def _search(sent, same_label: bool, keep: int, scale: float):
    """Each anchor's and slot's best ``keep`` rows of ``(row, id, label, vector)`` within the slot's range."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, low, high = sent.value
        best = {size: [_Best(low[block.rows], keep) for block in blocks] for size, blocks in anchors.blocks.items()}

        def walk(block: Block, best: _Best, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, units: np.ndarray, norms: np.ndarray) -> None:
            top, own_rows, own_labels = high[block.rows], anchors.rows[block.rows], anchors.labels[block.rows]
            asked = low[block.rows] <= top
            largest = float(np.abs(matrix).max()) if matrix.size else 0.0
            bounds = block.bounds(units, norms)
            order = np.argsort(-bounds)
            at, step = 0, 32
            while at < len(order):
                floor = np.where(asked, best.low, MOST).min(axis=1)
                of = np.flatnonzero(bounds[order[at]] * block.norms + 1 >= floor)
                if not len(of):
                    break
                some = order[at:at + step]
                at, step = at + step, STEP
                scores = block.scores(of, matrix[some], largest)
                same = own_labels[of][:, None] == labels[some][None, :]
                wanted = same & (own_rows[of][:, None] != rows[some][None, :]) if same_label else ~same
                for slot in range(low.shape[1]):
                    i, j = np.nonzero(wanted & (scores >= best.low[of, slot][:, None]) & (scores <= top[of, slot][:, None]))
                    if len(i):
                        best.add(of[i], np.full(len(i), slot), ids[some[j]], scores[i, j], rows[some[j]])
                best.cut(best.best.shape[1] // 2)

        for batch in batches:
            rows, ids, labels = (batch.column(k).to_numpy() for k in range(3))
            vectors = [np.asarray(v) for v in batch.column(3).to_numpy(zero_copy_only=False)]
            sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
            for size, blocks in anchors.blocks.items():
                at = np.flatnonzero(sizes == size)
                if not len(at):
                    continue
                matrix = _matrix([vectors[i] for i in at], scale)
                units, norms = _units(matrix)
                for block, found in zip(blocks, best[size]):
                    walk(block, found, rows[at], ids[at], labels[at], matrix, units, norms)
        for size, blocks in anchors.blocks.items():
            for block, found in zip(blocks, best[size]):
                member, slot, id_, score, row = found.cut()
                if len(member):
                    yield pa.RecordBatch.from_arrays([pa.array(anchors.rows[block.rows[member]]), pa.array(slot.astype(np.int32)), pa.array(row), pa.array(id_), pa.array(score)],
                                                     names=["anchor", "slot", "row", "id", "score"])

    return task


def _ranked(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc("id"), F.asc("row"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def _best_of(rows: DataFrame, anchors: Anchors, low: np.ndarray, high: np.ndarray, same_label: bool, keep: int, scale: float) -> DataFrame:
    """Ranked finds of all rows. First, a share of the rows tells what score the last of the best reaches."""
    context = rows.sparkSession.sparkContext
    place = {int(r): i for i, r in enumerate(anchors.rows)}
    share = rows.filter(F.pmod(F.xxhash64("row"), F.lit(SEED_SHARE)) == 0)
    seeds = _ranked(share.mapInArrow(_search(context.broadcast((anchors, low, high)), same_label, keep, scale), FOUND), keep)
    surely = low.copy()
    for r in seeds.filter(F.col("rank") == keep).select("anchor", "slot", "score").toLocalIterator():
        surely[place[r["anchor"]], r["slot"]] = r["score"]
    return _ranked(rows.mapInArrow(_search(context.broadcast((anchors, surely, high)), same_label, keep, scale), FOUND), keep)


def usable(rows: DataFrame, id_column: str, label_column: str, vector_column: str, scale: float = SCALE) -> DataFrame:
    """``(row, id, label, vector)`` of the rows that take part, numbered."""
    vector = F.col(vector_column)
    fits = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) * scale < F.sqrt(F.lit(2.0 ** 62) / F.greatest(F.size(vector), F.lit(1))) - 1, F.lit(False)))
    kept = rows.filter(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & vector.isNotNull() & fits)
    return kept.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"), vector.alias("vector"))


def mine(rows: DataFrame, anchors_if, id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding", scale: float = SCALE,
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``anchors_if(id)`` is a condition on the id column. Of each anchor, the first ``positives`` other rows of its label; of
    each of those, the first ``negatives`` rows of other labels whose score is between ``low`` and ``high`` hundredths of the
    positive's. Labels are whole numbers.
    """
    spark = rows.sparkSession
    all_rows = stored(usable(rows, id_column, label_column, vector_column, scale), "vectors")
    chosen = all_rows.filter(anchors_if(F.col("id")))
    total = chosen.agg(F.coalesce(F.sum(F.size("vector") + 4), F.lit(0)).alias("numbers"), F.count(F.lit(1)).alias("n")).first()
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    out = spark.createDataFrame([], schema)
    if not total["n"]:
        return out
    groups = -(-8 * total["numbers"] // group_bytes)
    fitted: dict[int, list[np.ndarray]] = {}
    sample = chosen.orderBy(F.xxhash64("row")).limit(max(1, min(FIT_ROWS, group_bytes // max(8, 8 * total["numbers"] // total["n"]))))
    for r in sample.select("vector").toLocalIterator():
        fitted.setdefault(len(r["vector"]), []).append(np.array(r["vector"], np.float64))
    for group in range(groups):
        part = chosen.filter(F.pmod(F.xxhash64("row", F.lit(7)), F.lit(groups)) == group).toArrow()
        if not part.num_rows:
            continue
        vectors = [np.asarray(v) for v in part.column("vector").to_pandas()]
        for v in vectors:
            fitted.setdefault(len(v), [np.asarray(v, np.float64)])
        centre_of = {size: centres(_matrix(some, scale), min(CENTRES, math.isqrt(len(some) - 1) + 1)) for size, some in fitted.items()}
        anchors = Anchors(part.column("row").to_numpy(), part.column("label").to_numpy(), vectors, scale, centre_of)
        ids = dict(zip(part.column("row").to_pylist(), part.column("id").to_pylist()))
        n = len(vectors)
        near = stored(_best_of(all_rows, anchors, np.full((n, 1), LEAST), np.full((n, 1), MOST), True, positives, scale), "positives")
        # Without a positive in a slot, no score is looked for: the range is empty.
        floor, top = np.full((n, positives), MOST), np.full((n, positives), LEAST)
        place = {row: i for i, row in enumerate(ids)}
        for r in near.select("anchor", "rank", "score").toLocalIterator():
            i, slot = place[r["anchor"]], r["rank"] - 1
            floor[i, slot], top[i, slot] = -(-low * r["score"] // 100), high * r["score"] // 100
        hard = _best_of(all_rows, anchors, floor, top, False, negatives, scale)
        pairs = near.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        named = chosen.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
        found = hard.join(pairs, ["anchor", "slot"]).join(named, "anchor").select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = stored(found, "negatives") if groups == 1 else out.union(stored(found, "negatives"))
    return out
