"""A membership filter kept as a table: split into 256-bit blocks of eight 32-bit words.

Each value belongs to one block and sets one bit in each of its words (a split-block Bloom filter), so building is one
``bit_or`` aggregation over one row per value, and probing is one equi-join per value. The table can be written,
extended by union and re-aggregation, and read by later jobs; it is never collected.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
WORD_BITS = 32
WORD_COLUMNS = tuple(f"w{i}" for i in range(WORDS))

# The reference's defaults.
DEFAULT_CAPACITY = 10_000_000
DEFAULT_ERROR_RATE = 0.001

# Rows of a filter that probes get by broadcast, at most: 19 MB.
BROADCAST_BLOCKS = 1 << 18

# Values fall unevenly into blocks; this much more room keeps the real rate at the asked one.
_HEADROOM = 1.25


@dataclass(frozen=True)
class SketchSize:
    """Filter size. ``hashing`` is ``xxhash64``, or ``md5`` for a table other engines must probe too."""

    capacity: int = DEFAULT_CAPACITY
    error_rate: float = DEFAULT_ERROR_RATE
    hashing: str = "xxhash64"

    @property
    def blocks(self) -> int:
        bits = -WORDS * self.capacity / math.log(1 - self.error_rate ** (1 / WORDS))
        return max(1, math.ceil(bits * _HEADROOM / (WORDS * WORD_BITS)))

    @property
    def bits(self) -> int:
        return self.blocks * WORDS * WORD_BITS


def _hashes(value: Column, hashing: str) -> tuple[Column, Column]:
    """Two independent non-negative hashes of at least 40 bits."""
    if hashing == "xxhash64":
        mask = F.lit((1 << 60) - 1)
        return F.xxhash64(value).bitwiseAND(mask), F.xxhash64(value, F.lit("bits")).bitwiseAND(mask)
    if hashing == "md5":
        digest = F.md5(value)
        return (
            F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"),
            F.conv(F.substring(digest, 16, 15), 16, 10).cast("bigint"),
        )
    raise ValueError(f"unknown hashing {hashing!r}")


def _placed(values: DataFrame, column: str, size: SketchSize, blocks: Column | None = None) -> DataFrame:
    """Adds the block of each value, of ``blocks`` if they are not the size's, and the eight one-bit words it sets there."""
    place, bits = _hashes(F.col(column), size.hashing)
    hashed = values.withColumns({"block": F.pmod(place, F.lit(size.blocks) if blocks is None else blocks), "__bits": bits})
    return hashed.withColumns(
        {
            f"__{word}": F.expr(f"shiftleft(1L, cast(shiftright(__bits, {5 * i}) & 31 as int))")
            for i, word in enumerate(WORD_COLUMNS)
        }
    ).drop("__bits")


def build(values: DataFrame, column: str, size: SketchSize) -> DataFrame:
    """``(block, w0..w7)`` for the values in ``column``; duplicates are harmless."""
    placed = _placed(values.select(column).filter(F.col(column).isNotNull()), column, size)
    return placed.groupBy("block").agg(*(F.bit_or(f"__{word}").alias(word) for word in WORD_COLUMNS))


def extend(sketch: DataFrame, more: DataFrame) -> DataFrame:
    """The union of two filters of equal size."""
    return sketch.unionByName(more).groupBy("block").agg(*(F.bit_or(word).alias(word) for word in WORD_COLUMNS))


def probe(values: DataFrame, column: str, sketch: DataFrame, size: SketchSize) -> DataFrame:
    """``values`` with ``maybe_present``: false means certainly absent."""
    kept = values.columns
    hit = F.lit(True)
    for word in WORD_COLUMNS:
        hit = hit & (F.col(word).bitwiseAND(F.col(f"__{word}")) != 0)
    # A filter has at most ``blocks`` rows of 72 bytes; a small one is sent to the values, which then stay where they are.
    held = F.broadcast(sketch) if size.blocks <= BROADCAST_BLOCKS else sketch
    return (
        _placed(values, column, size)
        .join(held, "block", "left")
        .select(*kept, F.coalesce(hit, F.lit(False)).alias("maybe_present"))
    )


def info(sketch: DataFrame, items: DataFrame, column: str, size: SketchSize) -> DataFrame:
    """Capacity, size, distinct items inserted and fill of a filter, as one row."""
    set_bits = sum((F.bit_count(word) for word in WORD_COLUMNS), F.lit(0))
    fill = sketch.agg(F.coalesce(F.sum(set_bits), F.lit(0)).cast("bigint").alias("bits_set"))
    inserted = items.select(column).distinct().agg(F.count("*").alias("items_inserted"))
    # Two one-row aggregates side by side.
    both = fill.withColumn("__one", F.lit(1)).join(inserted.withColumn("__one", F.lit(1)), "__one")
    return both.select(
        F.lit(size.capacity).cast("bigint").alias("capacity"),
        F.lit(size.bits // 8).cast("bigint").alias("size_bytes"),
        "items_inserted",
        "bits_set",
        F.round(F.col("bits_set") / F.lit(size.bits), 6).alias("fill_ratio"),
    )


# --- filters that grow -----------------------------------------------------------------------------------------------
#
# A series of layers: each has twice the capacity of the one before and half its error, so the errors of all together stay
# under the asked rate. A table ``(layer, block, w0..w7)`` holds the bits; ``(layer, items)`` tells how full the layers are.


def layer_size(first: SketchSize, layer: int) -> SketchSize:
    return SketchSize(first.capacity << layer, first.error_rate / 2 ** (layer + 1), first.hashing)


def _by_layer(values: dict[int, int]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x).cast("bigint") for pair in values.items() for x in pair)), F.col("layer").cast("bigint"))


def _layered(rows: DataFrame, column: str, first: SketchSize, layers: list[int]) -> DataFrame:
    """Rows with a ``layer``, with the block and the bits of their value there."""
    blocks = {layer: layer_size(first, layer).blocks for layer in layers}
    return _placed(rows.withColumn("__blocks", _by_layer(blocks)), column, first, F.col("__blocks")).drop("__blocks")


def grow(series: DataFrame | None, items: DataFrame | None, values: DataFrame, column: str, first: SketchSize) -> tuple[DataFrame, DataFrame]:
    """``series`` and ``items`` after ``values`` have been added; ``None`` for both begins a series.

    Values that may already be there are not added again. The last layer is filled up, then the next is opened, and so on;
    which value goes where is decided by its hash, so a layer holds its capacity give or take its square root, a few times over.
    """
    new = values.select(column).filter(F.col(column).isNotNull()).distinct()
    filled = {r["layer"]: r["items"] for r in items.collect()} if items is not None else {}  # a row per layer
    if series is not None and filled:
        new = probe_series(new, column, series, first, sorted(filled)).filter(~F.col("maybe_present")).select(column)
    count, layer, bounds, total = new.count(), max(filled, default=0), {}, 0
    while total < count:
        room = layer_size(first, layer).capacity - filled.get(layer, 0)
        if room > 0:
            total = min(count, total + room)
            bounds[layer] = total
        layer += 1
    if not bounds:
        empty = values.sparkSession.createDataFrame([], "layer bigint, items bigint")
        return (series if series is not None else _no_bits(values)), (items if items is not None else empty)
    part, _ = _hashes(F.concat(F.lit("layer"), F.col(column)), first.hashing)
    share = F.pmod(part, F.lit(1 << 30)) * F.lit(count).cast("decimal(20,0)")
    which = F.lit(max(bounds))
    for layer, upto in sorted(bounds.items(), reverse=True):
        which = F.when(share < F.lit(upto << 30).cast("decimal(38,0)"), layer).otherwise(which)
    rows = new.withColumn("layer", which.cast("bigint"))
    added = _layered(rows, column, first, sorted(bounds)).groupBy("layer", "block").agg(*(F.bit_or(f"__{word}").alias(word) for word in WORD_COLUMNS))
    counted = rows.groupBy("layer").agg(F.count(F.lit(1)).alias("items"))
    if series is not None:
        added = series.unionByName(added).groupBy("layer", "block").agg(*(F.bit_or(word).alias(word) for word in WORD_COLUMNS))
    if items is not None:
        counted = items.unionByName(counted).groupBy("layer").agg(F.sum("items").alias("items"))
    return added, counted


def _no_bits(values: DataFrame) -> DataFrame:
    return values.sparkSession.createDataFrame([], "layer bigint, block bigint, " + ", ".join(f"{w} bigint" for w in WORD_COLUMNS))


def probe_series(values: DataFrame, column: str, series: DataFrame, first: SketchSize, layers: list[int]) -> DataFrame:
    """Distinct ``values`` with ``maybe_present``: one join asks all ``layers``."""
    kept = values.columns
    asked = values.distinct().withColumn("layer", F.explode(F.array(*(F.lit(layer).cast("bigint") for layer in layers))))
    hit = F.lit(True)
    for word in WORD_COLUMNS:
        hit = hit & (F.col(word).bitwiseAND(F.col(f"__{word}")) != 0)
    met = _layered(asked, column, first, layers).join(series, ["layer", "block"], "left")
    return met.groupBy(*kept).agg(F.max(F.coalesce(hit, F.lit(False))).alias("maybe_present"))


def series_info(series: DataFrame, items: DataFrame, first: SketchSize) -> DataFrame:
    """Capacity, size, items, bits set and expansions of a series, as one row."""
    layers = sorted(r["layer"] for r in items.select("layer").collect())  # a row per layer
    sizes = [layer_size(first, layer) for layer in layers] or [layer_size(first, 0)]
    set_bits = sum((F.bit_count(word) for word in WORD_COLUMNS), F.lit(0))
    fill = series.agg(F.coalesce(F.sum(set_bits), F.lit(0)).cast("bigint").alias("bits_set")).withColumn("__one", F.lit(1))
    held = items.agg(F.coalesce(F.sum("items"), F.lit(0)).cast("bigint").alias("items_inserted")).withColumn("__one", F.lit(1))
    return fill.join(held, "__one").select(
        F.lit(sum(s.capacity for s in sizes)).cast("bigint").alias("capacity"), F.lit(sum(s.bits for s in sizes) // 8).cast("bigint").alias("size_bytes"),
        "items_inserted", "bits_set", F.lit(max(0, len(layers) - 1)).cast("bigint").alias("expansions"))
