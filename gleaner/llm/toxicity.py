"""Toxicity by compression distance: which of two dictionaries, of toxic or of ordinary text, shortens a window more.

A window is a word without case and outer marks. Both dictionaries are Zstandard dictionaries of raw content, trained on the
labelled documents that are not held out: the toxic one holds, most telling last, every word that toxic documents have
significantly (log-likelihood ratio over document counts) and markedly (odds ratio) more often, the ordinary one the most
common words of the others, in proportion. The odds ratio does not change with the number of documents: on more of them,
words that are only a little more frequent in toxic ones become significant, but are not taken.
A window is compressed with each, before a fixed tail that both dictionaries hold (Zstandard does not search the last bytes
of an input). What counts is the *cell* of a window: by how much the toxic dictionary is better, what is left of the window
then, and its length.

Two thirds of the training documents make the dictionaries, one third calibrates: how much more often toxic documents have a
window of a cell gives the cell's log ratio, the two largest of a document add up, and a logistic curve turns the sum into
the score. All of it is counted by Spark over all training rows; the driver gets the telling words and ``ORDINARY_SHARE``
times as many bytes of ordinary ones, a count per cell, and a count per step of the sum.

Defined results: null and empty texts have no windows and get the score of a document without telling ones; without labels
of both kinds all scores are the share of toxic labels, or 0; rows that repeat an id are scored each for itself; a null id is
not held out and never labelled; null labels are not used. Of the labels, only ``toxic`` is read, for training only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import as_bytes, pieces, stored

#: Bytes of the ordinary dictionary: at least so many, and so many for each byte of the toxic one.
ORDINARY_BYTES = 16384
ORDINARY_SHARE = 8
#: Log-likelihood ratio that a word must reach: chance alone gives that once in about two million words.
SIGNIFICANT = 25.0
#: Odds ratio that a word must reach, half a document added to each count.
MARKED = 10.0
THRESHOLD = 0.3
MARKS = ".,;:!?\"'()#*$%&|<>[]{}"
TAIL = b"<<0123456789abcdefghijklmnopqrstuv>>"
SHORTEST = 4
#: Windows that a worker remembers the cells of.
REMEMBERED = 300_000
STEPS_PER_UNIT = 4
#: Training labels up to which every task gets them all.
BROADCAST_LABELS = 500_000


@lru_cache(maxsize=4)
def _compressor(content: bytes):
    params = zstandard.ZstdCompressionParameters.from_level(
        6, source_size=128, dict_size=max(1 << 16, len(content)), min_match=3, strategy=zstandard.STRATEGY_LAZY,
        write_content_size=False, write_checksum=False, write_dict_id=False)
    pack = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content + TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
    nothing = len(pack.compress(TAIL))
    return lambda window: len(pack.compress(window + TAIL)) - nothing


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    ratios: dict[tuple[int, int, int], float] = field(default_factory=dict)
    slope: float = 0.0
    offset: float = -np.inf

    def probability(self, total: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-(self.slope * total + self.offset)))


class Cells:
    """Cells of windows, each worked out once."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.by_toxic, self.by_ordinary, self.known = _compressor(toxic), _compressor(ordinary), {}

    def of(self, text: bytes) -> list[tuple[int, int, int]]:
        out = []
        for word in text.split():
            cell = self.known.get(word, False)
            if cell is False:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                cell = self.known[word] = self.work_out(word)
            if cell:
                out.append(cell)
        return out

    def work_out(self, word: bytes) -> tuple[int, int, int] | None:
        plain = window_of(word)
        if len(plain) < SHORTEST:
            return None
        window = f" {plain} ".encode()
        left = self.by_toxic(window)
        gain = self.by_ordinary(window) - left
        return (min(gain, 8), min(left, 8), min(len(plain), 12)) if gain > 0 else None


def window_of(word: bytes) -> str:
    return word.decode().lower().strip(MARKS)


def _top_two(cells: list[tuple[int, int, int]], ratios: dict) -> float:
    best = sorted((ratios.get(cell, 0.0) for cell in cells), reverse=True)[:2]
    return max(0.0, sum(x for x in best if x > 0))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _document_counts(rows: DataFrame) -> DataFrame:
    """``(word, t, o)``: toxic and other documents of ``rows (text, toxic)`` that have the word."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(counts: Counter) -> pa.RecordBatch:
            words, labels = zip(*counts)
            return pa.RecordBatch.from_arrays([pa.array(words), pa.array(labels, pa.int32()), pa.array(counts.values(), pa.int64())], names=["word", "toxic", "n"])

        counts: Counter = Counter()
        for batch in pieces(batches, "text"):
            for text, toxic in zip(as_bytes(batch.column(0)).to_pylist(), batch.column(1).to_pylist()):
                counts.update((w, toxic) for w in {window_of(w) for w in text.split()} if len(w) >= SHORTEST)
            if len(counts) > REMEMBERED:
                yield emit(counts)
                counts.clear()
        if counts:
            yield emit(counts)

    n = F.col("n")
    return rows.select("text", "toxic").mapInArrow(task, "word string, toxic int, n bigint").groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, n).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(n)).alias("o"))


def _content(words: list[str], limit: int | None = None) -> bytes:
    """Words of a dictionary, the first ones nearest to its end, up to ``limit`` bytes if there is one."""
    out, size = [], 0
    for word in words:
        size += len(b := f" {word}".encode())
        if limit is not None and size > limit:
            break
        out.append(b)
    return b"".join(reversed(out)) + b" "


def _dictionaries(rows: DataFrame, n_toxic: int, n_other: int) -> tuple[bytes, bytes]:
    counts = stored(_document_counts(rows), "words")
    t, o, n = F.col("t"), F.col("o"), n_toxic + n_other
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    ratio = 2 * (part(t, (t + o) * n_toxic / n) + part(o, (t + o) * n_other / n))
    more = t * n_other > o * n_toxic
    odds = (t + 0.5) * (n_other - o + 0.5) / ((n_toxic - t + 0.5) * (o + 0.5))
    telling = counts.filter(more & (ratio > SIGNIFICANT) & (odds >= MARKED)).orderBy(F.desc(ratio), "word").collect()
    toxic = _content([r.word for r in telling])
    room = max(ORDINARY_BYTES, ORDINARY_SHARE * len(toxic))
    common = counts.filter(~more & (o >= 3)).orderBy(F.desc("o"), "word").limit(room // SHORTEST).collect()
    return toxic, _content([r.word for r in common], room)


def _cell_counts(rows: DataFrame, model: Model) -> dict[tuple[int, int, int], tuple[int, int]]:
    """Documents that have a window of each cell: toxic, other."""
    toxic, ordinary = model.toxic, model.ordinary

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, counts = Cells(toxic, ordinary), Counter()
        for batch in pieces(batches, "text"):
            for text, label in zip(as_bytes(batch.column(0)).to_pylist(), batch.column(1).to_pylist()):
                counts.update((*cell, label) for cell in set(cells.of(text)))
        if counts:
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in zip(*counts)), pa.array(counts.values(), pa.int64())], names=["a", "b", "c", "toxic", "n"])

    found = rows.select("text", "toxic").mapInArrow(task, "a int, b int, c int, toxic int, n bigint").groupBy("a", "b", "c", "toxic").agg(F.sum("n").alias("n")).collect()
    out: dict = {}
    for r in found:
        t, o = out.get((r.a, r.b, r.c), (0, 0))
        out[r.a, r.b, r.c] = (t + r.n, o) if r.toxic == 1 else (t, o + r.n)
    return out


def _totals(rows: DataFrame, model: Model, *carried: str) -> DataFrame:
    """``carried`` columns and ``total``, the two largest log ratios of each text added up."""
    toxic, ordinary, ratios = model.toxic, model.ordinary, model.ratios

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(toxic, ordinary)
        for batch in pieces(batches, "text"):
            totals = [_top_two(cells.of(t), ratios) for t in as_bytes(batch.column(len(carried))).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(carried)], pa.array(totals, pa.float64())], names=[*carried, "total"])

    narrow = rows.select(*carried, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"{c} {narrow.schema[c].dataType.simpleString()}" for c in carried)
    return narrow.mapInArrow(task, f"{schema}, total double")


def _curve(x: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a weak pull to zero."""
    slope, offset = 0.0, float(np.log((toxic.sum() + 0.5) / (n.sum() - toxic.sum() + 0.5)))
    features = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ (slope, offset), -30, 30)))
        gradient = features.T @ (toxic - n * p) - 1e-3 * np.array([slope, offset])
        curvature = (features * (n * p * (1 - p))[:, None]).T @ features + 1e-3 * np.eye(2)
        step = np.clip(np.linalg.solve(curvature, gradient), -2, 2)
        slope, offset = slope + step[0], offset + step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(slope), float(offset)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """From ``docs (doc_id, text)`` and ``labels (doc_id, toxic)``; rows that are held out are not used."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id")))
    few = known.count() <= BROADCAST_LABELS
    fold = F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 4) % 3 == 0
    rows = docs.join(F.broadcast(known) if few else known, "doc_id").select("text", "toxic", fold.alias("calibrates"))
    rows = stored(rows, "labelled")
    size = {(r.calibrates, r.toxic == 1): r["count"] for r in rows.groupBy("calibrates", F.col("toxic").eqNullSafe(1).cast("int").alias("toxic")).count().collect()}
    numbers = [size.get((c, t), 0) for c in (False, True) for t in (True, False)]
    if not all(numbers):
        share = (numbers[0] + numbers[2]) / max(1, sum(numbers))
        return Model(offset=float(np.log(share / (1 - share))) if 0 < share < 1 else (np.inf if share else -np.inf))
    model = Model(*_dictionaries(rows.filter("not calibrates"), numbers[0], numbers[1]))
    calibrating = rows.filter("calibrates")
    for cell, (t, o) in _cell_counts(calibrating, model).items():
        model.ratios[cell] = float(np.log((t + 0.5) / (numbers[2] + 1)) - np.log((o + 0.5) / (numbers[3] + 1)))
    steps = _totals(calibrating, model, "toxic").groupBy(F.round(F.col("total") * STEPS_PER_UNIT).alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")).collect()
    table = np.array(sorted((r.step / STEPS_PER_UNIT, r.n, r.toxic) for r in steps), float)
    model.slope, model.offset = _curve(*table.T)
    return model


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    model = train(rows, labels)
    total = F.col("total")
    if np.isfinite(model.offset):
        value = 1 / (1 + F.exp(-(F.lit(model.slope) * total + F.lit(model.offset))))
    else:
        value = F.lit(1.0 if model.offset > 0 else 0.0)
    return _totals(rows, model, "doc_id").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), value.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
