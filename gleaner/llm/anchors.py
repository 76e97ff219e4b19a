"""Anchors: places of a sequence that any two equal stretches of a given length have in common.

Every stretch of ``length`` symbols holds ``length - k + 1`` grams of ``k`` symbols; its anchor is where the least gram hash
stands. Equal stretches have equal anchors at equal offsets, so only grams that are anchors, and of those only the ones
that more than one text has (``shared_anchors``), can lie in a stretch that repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import as_bytes, pieces

MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * MIX
    return values ^ (values >> np.uint64(29))


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each run of ``width`` values, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = pick(out[:-step], out[step:])
        done += step
    return out


def minimizers(grams: np.ndarray, window: int) -> np.ndarray:
    """Places that hold the least hash of some run of ``window`` grams; none if there are fewer grams."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    least = _sliding(grams, window, np.minimum)
    padded = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
    return np.nonzero(_sliding(padded, window, np.maximum) == grams)[0]


Finder = Callable[[bytes], tuple[np.ndarray, np.ndarray]]


def shared_anchors(texts: DataFrame, finder: Finder, repeats_within: bool) -> DataFrame:
    """``(h, tag, at)`` of anchors whose gram stands in more than one text, and perhaps some others.

    ``texts`` has ``tag`` (hash of the text) and ``text``; ``finder`` gives gram hashes and places of a text's anchors. A
    task emits equal texts once. Rows are dealt by ranges of (hash, tag), so that a gram which a third of all texts share
    is spread over many tasks; groups at the edge of a range count as shared. ``repeats_within`` also keeps grams that
    stand twice in one text.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in pieces(batches, "text"):
            found = []
            for tag, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)).to_pylist()):
                key = xxhash.xxh3_128_digest(text)
                if key not in seen:
                    seen.add(key)
                    h, at = finder(text)
                    found.append((h.view(np.int64), np.full(len(h), tag, np.int64), at.astype(np.int32)))
            if found:
                columns = [np.concatenate(c) for c in zip(*found)]
                for start in range(0, len(columns[0]), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[start:start + 100_000]) for c in columns], names=["h", "tag", "at"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # rows of the last hash, while they show one text only
        known: int | None = None  # the last hash, once it is known to be shared
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            h, tag, at = (table.column(k).to_numpy() for k in range(3))
            starts = np.concatenate(([0], np.nonzero(h[1:] != h[:-1])[0] + 1))
            ends = np.concatenate((starts[1:], [len(h)]))
            shared = tag[starts] != tag[ends - 1]
            if repeats_within:
                shared |= ends - starts > 1
            if h[0] == known or first:
                shared[0] = True
            first = False
            known = int(h[-1]) if shared[-1] else None
            rows = np.repeat(shared, ends - starts)
            held = None if shared[-1] else table.slice(starts[-1])
            yield pa.RecordBatch.from_arrays([pa.array(c[rows]) for c in (h, tag, at)], names=["h", "tag", "at"])
        if held is not None:
            yield from held.combine_chunks().to_batches()

    rows = texts.select("tag", F.col("text").cast("string").alias("text")).mapInArrow(emit, "h bigint, tag bigint, at int")
    return rows.repartitionByRange("h", "tag").sortWithinPartitions("h", "tag").mapInArrow(keep, "h bigint, tag bigint, at int")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, as disjoint ones in order; touching ones become one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1])) if len(starts) else np.zeros(0, bool)
    return starts[new], ends[np.concatenate((new[1:], [True]))] if len(starts) else ends


def merged_spans(spans: DataFrame, key: str) -> DataFrame:
    """``(key, spans)`` of ``spans (key, first, end)``: the union of a key's spans, as disjoint ones in order.

    Each context gives spans of its own, many of which overlap; what is sent to the texts is their union.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows in batch.column(1).to_pylist():
                a, b = merged(np.array([r["first"] for r in rows]), np.array([r["end"] for r in rows]))
                out.append([{"first": x, "end": y} for x, y in zip(a.tolist(), b.tolist())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))], names=[key, "spans"])

    kind = spans.schema[key].dataType.simpleString()
    collected = spans.groupBy(key).agg(F.collect_set(F.struct("first", "end")).alias("spans"))
    return collected.mapInArrow(task, f"{key} {kind}, spans array<struct<first:int,end:int>>")
