"""Near duplicates by SimHash: 64-bit fingerprints that differ in few bits, found through shared positional bytes.

Eight bytes make a fingerprint. Two that differ in at most three bits differ in at most three bytes, so they share at
least five bytes at their places. An inverted index on single bytes has only 2,048 lists, each of which grows with the
corpus; here its keys are *sets of four places* with the bytes there. The fourteen sets of ``PLACES`` are such that the
complement of one of them holds any three given places: whatever three bytes differ, one list has both fingerprints.
Within a list the shared positional bytes of a pair are tallied, pairs that reach the minimum are kept, and their bits
compared. Only distinct fingerprints are indexed, so copies cost nothing here. A list longer than ``BLOCK`` is cut into
blocks that meet two by two in tasks of their own; a task gives the ties of its links (a forest), never all pairs.

Defined results: null and empty texts have fingerprint zero and are linked like any other; rows that repeat a ``doc_id``
are separate rows; a null ``doc_id`` never names a component unless no other id can be reached; empty tables give empty
tables. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gleaner.llm.common import as_bytes, pieces, stored
from gleaner.llm.components import components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
BLOCK = 4096
#: Numbers of rows that go, up to which every task gets them all: 8 bytes each.
BROADCAST_ROWS = 2_000_000
#: Shingles whose bits are counted at once.
STEP = 1 << 14


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is set if it is set in over half the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    ends = ends[min(shingle, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends.tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        part = hashes[at:at + STEP].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text_column: str = "text", shingle: int = SHINGLE, seed: int = SEED, name: str = "fp") -> DataFrame:
    """All rows and columns of ``docs`` and the 64 bits of each row's fingerprint as a signed long."""
    place = docs.columns.index(text_column)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_column):
            texts = as_bytes(batch.column(place)).to_pylist()
            fps = np.fromiter((fingerprint(t, shingle, seed) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield batch.append_column(name, pa.array(fps))

    return docs.mapInArrow(task, StructType([*docs.schema.fields, StructField(name, LongType())]))


#: Steiner system S(3, 4, 8) on the byte places: any three places lie in exactly one set, whose complement is a set too.
#: Rule: four places belong together if their numbers cancel out under exclusive or.
PLACES = tuple(s for s in combinations(range(8), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0)


def _mask(places: tuple[int, ...]) -> int:
    value = sum(0xFF << (8 * p) for p in places)
    return value - (1 << 64) if value >= 1 << 63 else value


def _ties(left: np.ndarray, right: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links between two blocks: tally shared positional bytes, keep who reach the minimum, compare bits."""
    found = []
    least = 8 - max_bits
    for at in range(0, len(left), 256):
        x = left[at:at + 256, None] ^ right[None, :]
        tally = sum(((x >> np.uint64(8 * p)) & np.uint64(0xFF)) == 0 for p in range(8)) if least > 4 else np.full(x.shape, 8)
        i, j = np.nonzero(tally >= least)
        close = np.bitwise_count(x[i, j]) <= max_bits
        found.append((i[close] + at, j[close]))
    return found


def _forest(values: np.ndarray, block: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ties ``(node, root)`` of the links within a group. Of a pair of blocks, only links across are looked for, unless it is one block."""
    sides = [values[block == b] for b in np.unique(block)]
    left, right = sides[0], sides[-1]
    nodes = np.unique(values)
    u, v = [], []
    for i, j in _ties(left, right, max_bits):
        u.append(np.searchsorted(nodes, left[i]))
        v.append(np.searchsorted(nodes, right[j]))
    u, v = np.concatenate(u), np.concatenate(v)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        after = label.copy()
        np.minimum.at(after, u, low)
        np.minimum.at(after, v, low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    tied = label != np.arange(len(nodes))
    return nodes[tied].view(np.int64), nodes[label[tied]].view(np.int64)


def links(distinct: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Ties ``(u, v)`` between the distinct fingerprints ``(fp)``: who is linked within ``max_bits`` is tied, directly or over others."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the index guarantees links of at most three bits")
    keys = [F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_mask(p))).alias("key")) for k, p in enumerate(PLACES)]
    postings = distinct.select("fp", F.inline(F.array(*keys)))
    long = postings.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = postings.join(long, ["k", "key"]).withColumn("blocks", F.ceil(F.col("n") / block))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    met = held.withColumn("own", own).select(
        "k", "key", "fp", "own",
        F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("other"),
    ).select("k", "key", "fp", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    dealt = met.select(F.xxhash64("k", "key", "a", "b").alias("g"), "k", "key", "a", "b", "own", "fp")
    dealt = dealt.repartition("g").sortWithinPartitions("g", "k", "key", "a", "b")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def groups(table: pa.Table, last: bool) -> Iterator[pa.Table]:
            nonlocal rest
            same = np.ones(max(0, len(table) - 1), bool)
            for name in ("k", "key", "a", "b"):
                values = table.column(name).to_numpy()
                same &= values[1:] == values[:-1]
            cuts = [0, *(np.nonzero(~same)[0] + 1).tolist()]
            ends = [*cuts[1:], len(table)] if last else cuts[1:]
            for start, end in zip(cuts, ends):
                if end - start > 1:
                    yield table.slice(start, end - start)
            rest = None if last else table.slice(cuts[-1])

        def ties(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            u, v = [], []
            for group in groups(table, last):
                across = group.column("a")[0].as_py() != group.column("b")[0].as_py()
                own = group.column("own").to_numpy()
                if across and own.min() == own.max():
                    continue
                x, y = _forest(group.column("fp").to_numpy().view(np.uint64), own, max_bits)
                u.append(x), v.append(y)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
            if len(table):
                yield from ties(table, False)
        if rest is not None and len(rest):
            yield from ties(rest, True)

    return dealt.mapInArrow(task, "u bigint, v bigint").distinct()


def _components(prints: DataFrame, max_bits: int, block: int) -> DataFrame:
    """``(fp, root, component_id)`` of each distinct fingerprint of ``(doc_id, fp)``."""
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(classes.select("fp"), max_bits, block))
    placed = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE, seed: int = SEED, block: int = BLOCK,
                    id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)``: component_id is the smallest doc_id that can be reached over links, itself included."""
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    prints = stored(fingerprints(narrow, "text", shingle, seed).select("doc_id", "fp"), "fingerprints")
    return prints.join(_components(prints, max_bits, block), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE, seed: int = SEED, block: int = BLOCK,
                id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component one row with its smallest id stays (null is last).

    Rows are numbered when they are stored with their fingerprints, so who goes is found out from numbers alone. Texts are
    met with these numbers where they lie, unless there are too many to send.
    """
    fp, row = "__fp", "__row"
    prints = stored(fingerprints(docs, text_column, shingle, seed, fp).withColumn(row, F.monotonically_increasing_id()), "fingerprints")
    narrow = prints.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(fp).alias("fp"), F.col(row).alias("row"))
    placed = narrow.join(_components(narrow.select("doc_id", "fp"), max_bits, block).select("fp", "root"), "fp")
    first = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("n"))
    gone = placed.join(first.filter("n > 1").select("root", F.col("first.row").alias("stays")), "root").filter("row <> stays")
    gone = stored(gone.select(F.col("row").alias(row)), "near-duplicates")
    few = gone.count() <= BROADCAST_ROWS
    return prints.join(F.broadcast(gone) if few else gone, row, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def hex_digits(fp: str) -> Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
