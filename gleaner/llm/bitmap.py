"""Bitmaps of hashes for the tasks: a bounded broadcast that may let others through, and loses none."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each hash, and in all: 16 MB.
BITS_EACH, MOST_BITS = 16, 1 << 27
#: Bits of a map that one row carries.
ROW_BITS = 1 << 13


class BitMap:
    """Hashes that are in it, by their highest bits; others may seem to be."""

    def __init__(self, data: np.ndarray, shift: int):
        self.data, self.shift = data, np.uint64(shift)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = (h >> self.shift).astype(np.int64)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def bit_map(hashes: DataFrame, count: int, most_bits: int = MOST_BITS) -> BitMap:
    """The map of about ``count`` rows ``(h bigint)``. The driver gets rows of ``ROW_BITS`` bits, ``most_bits`` in all."""
    bits = min(most_bits, max(ROW_BITS, 1 << (BITS_EACH * count - 1).bit_length()))
    shift = 64 - bits.bit_length() + 1

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for places in batch.column(1).to_pylist():
                one = np.zeros(ROW_BITS, np.uint8)
                one[places] = 1
                out.append(np.packbits(one, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["row", "bits"])

    at = F.shiftrightunsigned("h", shift)
    placed = hashes.select(F.floor(at / ROW_BITS).cast("long").alias("row"), (at % ROW_BITS).cast("int").alias("bit"))
    rows = placed.groupBy("row").agg(F.collect_set("bit").alias("bits")).mapInArrow(packed, "row bigint, bits binary")
    data = np.zeros(bits // 8, np.uint8)
    for row in rows.toLocalIterator():
        start = row["row"] * ROW_BITS // 8
        data[start:start + ROW_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return BitMap(data, shift)
