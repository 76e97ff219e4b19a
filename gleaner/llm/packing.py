"""Packing: token sequences of a fixed length, filled by best-fit decreasing.

Documents are tokenized and packed where they are read: a task fills groups of about ``GROUP_TOKENS`` tokens, so nothing is
shuffled and memory does not grow with the input; a group wastes at most a few half-empty sequences. A document longer than
a sequence is first cut into full ones; what is left, longest first, goes into the tightest open sequence that has room. A
segment tree over remaining capacities (0 to the sequence length) finds it.

A text is split at ASCII white space and a distinct piece is encoded once while a task remembers it. That is exact for tokenizers that
drop white space and never join what stands on both sides of it, as ``word_bpe_49k.json`` does; for others set ``split=False``.

Defined results: null counts as the empty text, which is the end id alone; rows that repeat an id are packed each for
itself; null ids are carried along; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import as_bytes, pieces

LENGTH = 2048
END_ID = 1
GROUP_TOKENS = 4 << 20
#: Bytes of pieces of text and their ids that a task remembers, twice over; ``ENTRY`` bytes go with each.
REMEMBERED_BYTES = 64 << 20
ENTRY = 170
#: Bits of a sequence id that count sequences within a partition.
SEQUENCE_BITS = 40


class Capacities:
    """Open sequences by remaining capacity; a segment tree tells which capacities have one."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.any = bytearray(2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        node = capacity + self.size
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The tightest open sequence that has room for ``least``: its capacity and number."""
        node = least + self.size
        if not self.any[node]:
            while node > 1 and (node & 1 or not self.any[node + 1]):  # climb until a subtree to the right has one
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.any[2 * node] else 2 * node + 1
        capacity = node - self.size
        sequence = self.open[capacity].pop()
        if not self.open[capacity]:
            while node and not (node < self.size and (self.any[2 * node] or self.any[2 * node + 1])):
                self.any[node] = 0
                node >>= 1
        return capacity, sequence


def best_fit_decreasing(lengths: list[int], length: int = LENGTH) -> tuple[list[int], list[int], int]:
    """For pieces of at most ``length``: the sequence and offset of each, and how many sequences there are."""
    tree, sequences, offsets, n = Capacities(length), [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i]) if lengths[i] < length else None
        capacity, sequences[i] = found or (length, n)
        n += found is None
        offsets[i] = length - capacity
        if capacity > lengths[i]:
            tree.add(capacity - lengths[i], sequences[i])
    return sequences, offsets, n


class Remembered:
    """Ids of pieces met lately, in two generations: when the young one is full, the old one is forgotten. Bounded in bytes, but for one batch."""

    def __init__(self, limit: int = REMEMBERED_BYTES):
        self.limit, self.size = limit, 0
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def add(self, found: dict[bytes, bytes]) -> None:
        self.size += sum(map(len, found)) + sum(map(len, found.values())) + ENTRY * len(found)
        self.young.update(found)

    def missing(self, words: set[bytes]) -> list[bytes]:
        """Who must be added; the others stay at least until the next call."""
        if self.size > self.limit:
            self.old, self.young, self.size = (self.young, {}, 0) if self.size < 2 * self.limit else ({}, {}, 0)
        absent, old = words.difference(self.young), self.old
        self.add({w: old[w] for w in absent if w in old})
        return [w for w in absent if w not in old]


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _encoder(path: str, split: bool) -> Callable[[list[bytes]], list[bytes]]:
    """Texts to their ids as little-endian unsigned 32-bit numbers. What it remembers goes with it, at the task's end."""
    tokenizer = _tokenizer(path)
    remembered = Remembered()

    def ids(texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_of_words(words: list[str]) -> list[bytes]:
        """As ``ids``, in one go: a token belongs to the word in which it begins."""
        found = tokenizer.encode("\n".join(words), add_special_tokens=False)
        begins = np.cumsum([0, *(len(w) + 1 for w in words)])
        of = np.searchsorted(begins, np.fromiter((start for start, _ in found.offsets), np.int64, len(found)), "right") - 1
        if (of[1:] < of[:-1]).any():
            return ids(words)
        raw, ends = np.array(found.ids, "<u4").tobytes(), (4 * np.searchsorted(of, np.arange(len(words) + 1))).tolist()
        return [raw[i:j] for i, j in zip(ends, ends[1:])]

    def encode(texts: list[bytes]) -> list[bytes]:
        if not split:
            return ids([t.decode() for t in texts])
        words = [t.split() for t in texts]
        new = remembered.missing(set().union(*words))
        for at in range(0, len(new), 10_000):
            part = new[at:at + 10_000]
            remembered.add(dict(zip(part, ids_of_words([w.decode() for w in part]))))
        return [b"".join(map(remembered.young.__getitem__, w)) for w in words]

    return encode


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS,
         split: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: ``doc_id``, ``start`` (its document's ids before it), ``length``, ``ids`` (little-endian unsigned 32-bit),
    ``doc_tokens``, ``sequence_id`` and ``offset`` in that sequence. Pieces of a sequence lie gapless from 0; it is padded to ``length``."""
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(tokenizer_path, split), np.array([end_id], "<u4").tobytes()
        number = TaskContext.get().partitionId() << SEQUENCE_BITS

        def emit(ids_of: pa.Array, tokens: list[bytes]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows, starts, lengths = [], [], []
            for row, ids in enumerate(tokens):
                n = len(ids) // 4
                for start in range(0, n, length):
                    rows.append(row), starts.append(start), lengths.append(min(length, n - start))
            sequences, offsets, n = best_fit_decreasing(lengths, length)
            for at in range(0, len(rows), 2000):
                part = slice(at, at + 2000)
                cut = [tokens[r][4 * s:4 * (s + k)] for r, s, k in zip(rows[part], starts[part], lengths[part])]
                yield pa.RecordBatch.from_arrays(
                    [ids_of.take(pa.array(rows[part])), pa.array(starts[part], pa.int64()), pa.array(lengths[part], pa.int64()),
                     pa.array(cut, pa.binary()), pa.array([len(tokens[r]) // 4 for r in rows[part]], pa.int64()),
                     pa.array([number + s for s in sequences[part]], pa.int64()), pa.array(offsets[part], pa.int64())],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            number += n

        held_ids, held, size = [], [], 0
        for batch in pieces(batches, "text"):
            tokens = [ids + end for ids in encode(as_bytes(batch.column(1)).to_pylist())]
            held_ids.append(batch.column(0))
            held += tokens
            size += sum(map(len, tokens)) // 4
            if size >= group_tokens:
                yield from emit(pa.concat_arrays(held_ids), held)
                held_ids, held, size = [], [], 0
        if held:
            yield from emit(pa.concat_arrays(held_ids), held)

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(task, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
