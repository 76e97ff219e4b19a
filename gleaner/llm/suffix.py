"""Substring deduplication over bytes: strings of a given length that stand anywhere else, in any text or the same one.

Shards of the corpus are sorted by external induced sorting (``induced``): equal strings are neighbours in the suffix array.
So that equal strings are in one shard, a shard is made of *contexts*: around each anchor (``anchors``) that stands more
than once, the bytes of all strings that hold it, dealt by the anchor's hash. Equal contexts are one text with two places;
equal documents are one document with two places, of which every byte goes.

An anchor that stands in more than ``HOT`` places would make a shard that no task should hold. Its contexts are cut first to
what they have in common with any other one (``_common_spans``), by two sorts that are spread over all tasks.

Defined results: null counts as empty; texts shorter than the length lose nothing; rows count by their text alone, so ids
may be null or repeat, and equal rows are two places; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.anchors import merged, merged_spans, minimizers, mixed, shared_anchors
from gleaner.llm.common import as_bytes, pieces, stored
from gleaner.llm.induced import IN_MEMORY, suffix_array

LENGTH = 400
GRAM = 100
BASE = np.uint64(0x5851F42D4C957F2D)
#: Places of an anchor above which its contexts are cut to what is common before they are sorted.
HOT = 2_000
#: Bytes of a shard, above which it is closed.
SHARD_BYTES = 6 << 20
BROADCAST_SPANS = 1_000_000


_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 to base^(n-1), modulo 2^64."""
    factors = np.full(n, base, np.uint64)
    factors[:1] = 1
    return np.cumprod(factors)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` bytes."""
    n = len(data)
    if n < size:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(BASE, n), out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * _powers(_INVERSE, n - size + 1))


def _byte_anchors(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    if len(text) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = gram_hashes(np.frombuffer(text, np.uint8), gram)
    at = minimizers(grams, length - gram + 1)
    return grams[at], at


def _same_as_before(text: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Whether the strings of ``length`` at each place and at the place before it are equal. Hashes propose, bytes decide."""
    same = np.zeros(len(places), bool)
    hashes = gram_hashes(text, length)[places]
    pairs = np.nonzero(hashes[1:] == hashes[:-1])[0] + 1
    windows = np.lib.stride_tricks.sliding_window_view(text, length)
    for at in range(0, len(pairs), 4096):
        part = pairs[at:at + 4096]
        same[part] = (windows[places[part]] == windows[places[part - 1]]).all(axis=1)
    return same


def sort_shard(contexts: list[bytes], origin: np.ndarray, place: np.ndarray, twice: np.ndarray, length: int,
               in_memory: int = IN_MEMORY) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of different contexts: the parts of it under strings that stand in two places.

    ``origin`` and ``place`` say where a context begins (a text's number and an offset), ``twice`` whether it also begins
    elsewhere. A string that two overlapping contexts of a text share is in one place.
    """
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    text = np.frombuffer(b"\xff".join(contexts) + b"\xff", np.uint8) + np.uint8(1)  # 0xff is in no UTF-8; it becomes 0
    begins = np.cumsum(sizes + 1) - sizes - 1
    order = suffix_array(text, in_memory)
    which = np.repeat(np.arange(len(contexts), dtype=np.int32), sizes + 1)
    left = (begins + sizes)[which] - np.arange(len(text)) >= length
    order = order[left[order]]
    if not len(order):
        return [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(contexts)
    runs = np.nonzero(~_same_as_before(text, order, length))[0]
    of = which[order]
    where = (origin[of].astype(np.int64) << 40) + place[of] + order - begins[of]
    more = (np.minimum.reduceat(where, runs) != np.maximum.reduceat(where, runs)) | np.maximum.reduceat(twice[of], runs)
    hit = order[np.repeat(more, np.diff(np.concatenate((runs, [len(order)]))))].astype(np.int64)
    hit.sort()
    cuts = np.searchsorted(hit, np.concatenate((begins, [len(text)])))
    return [merged(hit[a:b] - begin, hit[a:b] - begin + length) for a, b, begin in zip(cuts[:-1], cuts[1:], begins)]


SPANS = "array<struct<first:int,end:int>>"
CONTEXT = "h bigint, digest binary, class binary, first int, left int, copied boolean, content binary"


def _digest(content: bytes, left: int) -> bytes:
    return xxhash.xxh3_128_digest(content + left.to_bytes(4, "little"))


def _search(length: int, shard_bytes: int, in_memory: int):
    """Task over contexts in order of (h, digest), a content among equal ones first: ``(digest, class, first, end)``."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: list[list[tuple[bytes, int]]] = []  # of each context held: where it begins
        digests: list[bytes] = []
        contents: list[bytes] = []
        copied: list[bool] = []
        size, last = 0, None

        def close() -> Iterator[pa.RecordBatch]:
            number: dict[bytes, int] = {}
            origin = np.fromiter((number.setdefault(p[0][0], len(number)) for p in places), np.int64, len(places))
            place = np.fromiter((p[0][1] for p in places), np.int64, len(places))
            twice = np.fromiter((c or len(set(p)) > 1 for c, p in zip(copied, places)), bool, len(places))
            out: tuple[list, ...] = ([], [], [], [])
            for digest, held, (a, b) in zip(digests, places, sort_shard(contents, origin, place, twice, length, in_memory)):
                for key, first in set(held) if len(a) else ():
                    for start, end in zip(a.tolist(), b.tolist()):
                        for column, value in zip(out, (digest, key, first + start, first + end)):
                            column.append(value)
            for held in (places, digests, contents, copied):
                held.clear()
            kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32())
            for at in range(0, len(out[0]), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at:at + 20_000], k) for c, k in zip(out, kinds)], names=["digest", "class", "first", "end"])

        for batch in batches:
            for h, digest, key, first, _, copy, content in zip(*(column.to_pylist() for column in batch.columns)):
                if h != last and size >= shard_bytes:
                    yield from close()
                    size = 0
                if h != last or not digests or digest != digests[-1]:
                    digests.append(digest), contents.append(content), copied.append(copy), places.append([])
                    size += len(content) + 1
                last = h
                places[-1].append((key, first))
                copied[-1] |= copy
        if digests:
            yield from close()

    return task


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(digest, common)`` of rows ``(h, digest, part)`` in order of (h, part): bytes in common with a neighbour of the same h.

    Rows at the edge of a range may have neighbours elsewhere and count as wholly common.
    """
    def shared(a: bytes, b: bytes) -> int:
        n = min(len(a), len(b))
        if a[:n] == b[:n]:
            return n
        return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))

    held: tuple | None = None  # h, digest, part, common with the row before
    for batch in batches:
        out: list[tuple[bytes, int]] = []
        for h, digest, part in zip(*(column.to_pylist() for column in batch.columns)):
            if held is None:
                held = (h, digest, part, len(part))
                continue
            common = shared(held[2], part) if held[0] == h else 0
            out.append((held[1], max(held[3], common)))
            held = (h, digest, part, common)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.binary()), pa.array([n for _, n in out], pa.int32())], names=["digest", "common"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held[1]], pa.binary()), pa.array([len(held[2])], pa.int32())], names=["digest", "common"])


def _window_spans(contexts: DataFrame, length: int) -> DataFrame:
    """``(digest, a, b)`` of different contexts, however many an anchor has: their strings are counted by digest, over all tasks."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["digest", "a", "w", "place", "copied"], (pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.bool_())
        for batch in batches:
            out: tuple[list, ...] = tuple([] for _ in names)
            for digest, key, first, copied, content in zip(*(column.to_pylist() for column in batch.columns)):
                for a in range(len(content) - length + 1):
                    place = xxhash.xxh3_64_intdigest(key + (first + a).to_bytes(4, "little")) - (1 << 63)
                    for column, value in zip(out, (digest, a, xxhash.xxh3_128_digest(content[a:a + length]), place, copied)):
                        column.append(value)
                if len(out[0]) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
                    out = tuple([] for _ in names)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    windows = contexts.select("digest", "class", "first", "copied", "content").mapInArrow(task, "digest binary, a int, w binary, place bigint, copied boolean")
    counted = windows.groupBy("w").agg(F.min("place").alias("low"), F.max("place").alias("high"), F.max("copied").alias("copied"))
    repeated = stored(counted.filter(F.col("copied") | (F.col("low") != F.col("high"))).select("w"), "windows")
    return windows.select("digest", "a", "w").join(repeated, "w").select("digest", "a", (F.col("a") + length).alias("b"))


def _common_spans(rows: DataFrame, search, length: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Spans from contexts of common anchors.

    Equal contexts are made one. What follows the anchor's begin is then sorted, over all tasks, and what goes before it read
    backwards likewise: neighbours in such an order tell how far a context has its bytes in common with any other one. Cut to
    that, most contexts of a common passage are equal, or too short to hold a string; the few others are searched. Where
    they are more than a shard for one anchor, their strings are counted instead (``_window_spans``). A place of a context gives
    one row at most.
    """
    each = rows.groupBy("h", "digest").agg(F.min(F.xxhash64("class", "first")).alias("low"), F.max(F.xxhash64("class", "first")).alias("high"),
                                           F.max("copied").alias("copied"), F.first("left").alias("left"), F.first("class").alias("class"),
                                           F.first("first").alias("first"), F.first("content", ignorenulls=True).alias("content"))
    each = stored(each.withColumn("copied", F.col("copied") | (F.col("low") != F.col("high"))).drop("low", "high"), "contexts")

    def sides(forward: bool):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = [c[left:] if forward else c[:left][::-1] for left, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.binary())], names=["h", "digest", "part"])

        parts = each.select("h", "digest", "left", "content").mapInArrow(task, "h bigint, digest binary, part binary")
        return parts.repartitionByRange("h", "part").sortWithinPartitions("h", "part").mapInArrow(_neighbours, "digest binary, common int")

    after = sides(True).withColumnRenamed("common", "after")
    before = sides(False).withColumnRenamed("common", "before")
    whole = F.col("copied")
    bounds = each.join(after, "digest").join(before, "digest").select(
        "h", "digest", "class", "first", "left", "copied", "content", F.when(whole, 0).otherwise(F.col("left") - F.col("before")).alias("start"),
        F.when(whole, F.octet_length("content")).otherwise(F.col("left") + F.col("after")).alias("stop"))
    bounds = bounds.filter(F.col("stop") - F.col("start") >= length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, digest, key, first, left, copied, content, start, stop = (column.to_pylist() for column in batch.columns)
            parts = [c[a:b] for c, a, b in zip(content, start, stop)]
            begin = [x - a for x, a in zip(left, start)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([_digest(p, x) for p, x in zip(parts, begin)], pa.binary()), batch.column(2), pa.array([x + a for x, a in zip(first, start)], pa.int32()),
                 pa.array(begin, pa.int32()), batch.column(5), pa.array(parts, pa.binary()), batch.column(1), pa.array(start, pa.int32())],
                names=["h", "digest", "class", "first", "left", "copied", "content", "of", "start"])

    short = stored(bounds.mapInArrow(cut, CONTEXT + ", of binary, start int"), "cut")
    # Of equal cut contexts at most two places are kept: one place, or several.
    few = short.groupBy("h", "digest").agg(F.min(F.xxhash64("class", "first")).alias("low"), F.max(F.xxhash64("class", "first")).alias("high"), F.max("copied").alias("copied"),
                                           F.first("class").alias("class"), F.first("first").alias("first"), F.first("left").alias("left"), F.first("content").alias("content"))
    few = few.select("h", "digest", "class", "first", "left", (F.col("copied") | (F.col("low") != F.col("high"))).alias("copied"), "content")
    few = stored(few, "different")
    large = stored(few.groupBy("h").agg(F.sum(F.octet_length("content")).alias("bytes")).filter(F.col("bytes") > shard_bytes).select("h"), "large")
    small = few.join(large, "h", "left_anti")
    found = small.repartition("h").sortWithinPartitions("h", "digest").mapInArrow(search, "digest binary, class binary, first int, end int")
    relative = found.join(few.select("digest", F.col("first").alias("begin")), "digest").select(
        "digest", (F.col("first") - F.col("begin")).alias("a"), (F.col("end") - F.col("begin")).alias("b"))
    if not large.isEmpty():
        relative = relative.union(_window_spans(few.join(large, "h", "left_semi"), length))
    # Every string of a context holds its anchor, so what is found in a context is one span.
    each_once = relative.groupBy("digest").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    shifted = each_once.join(short.select("digest", "of", "start"), "digest").select(F.col("of").alias("digest"), (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))
    placed = rows.select("digest", "class", F.col("first").alias("place")).join(shifted, "digest")
    return placed.select("class", (F.col("place") + F.col("a")).alias("first"), (F.col("place") + F.col("b")).alias("end"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, shard_bytes: int = SHARD_BYTES,
                   in_memory: int = IN_MEMORY) -> DataFrame:
    """``(class, spans)`` of texts that lose bytes; spans is null if the text stands in two rows.

    ``docs`` has doc_id, text, ``class`` (digest of the text) and ``tag`` (hash of the text).
    """
    side = length - gram
    classes = docs.groupBy("class").agg(F.min("doc_id").alias("least"), F.first("tag").alias("tag"), (F.count(F.lit(1)) > 1).alias("copied"))
    classes = stored(classes, "classes")

    def finder(text: bytes) -> tuple[np.ndarray, np.ndarray]:
        return _byte_anchors(text, length, gram)

    shared = stored(shared_anchors(docs.select("tag", "text"), finder, True), "anchors")
    often = stored(shared.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("h", F.lit(True).alias("hot")), "hot")
    any_hot = not often.isEmpty()
    marked = shared.join(often, "h", "left") if any_hot else shared.withColumn("hot", F.lit(None).cast("boolean"))
    places = marked.groupBy("tag").agg(F.collect_set(F.struct("at", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("places"))
    wanted = classes.join(places, "tag").select(F.col("least").alias("of"), F.col("class").alias("in"), "copied", "places")
    texts = docs.join(wanted, (F.col("class") == F.col("in")) & F.col("doc_id").eqNullSafe(F.col("of"))).select("class", "text", "places", "copied")

    def contexts(hot_ones: bool):
        """Contexts of common anchors, or of the others. The bytes of a context leave a task once."""
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[bytes] = set()
            names = ["h", "digest", "class", "first", "left", "copied", "content"]
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            for batch in pieces(batches, "text"):
                out: tuple[list, ...] = tuple([] for _ in names)
                for key, text, places, copied in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    wanted_at = sorted(p["at"] for p in places if p["hot"] == hot_ones)
                    if not wanted_at:
                        continue
                    hashes, ats = _byte_anchors(text, length, gram)
                    chosen = np.isin(ats, wanted_at)
                    for h, at in zip(hashes[chosen].view(np.int64).tolist(), ats[chosen].tolist()):
                        first = max(0, at - side)
                        content = text[first:at + length]
                        digest = _digest(content, at - first)
                        new = digest not in seen
                        seen.add(digest)
                        for column, value in zip(out, (h, digest, key, first, at - first, copied, content if new else None)):
                            column.append(value)
                    if len(out[0]) >= 4000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
                        out = tuple([] for _ in names)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

        return task

    search = _search(length, shard_bytes, in_memory)
    cold = texts.mapInArrow(contexts(False), CONTEXT).repartition("h").sortWithinPartitions("h", "digest", F.col("content").isNull())
    spans = cold.mapInArrow(search, "digest binary, class binary, first int, end int").drop("digest")
    if any_hot:
        common = texts.filter(F.exists("places", lambda p: p["hot"])).mapInArrow(contexts(True), CONTEXT)
        spans = spans.union(_common_spans(stored(common, "common"), search, length, shard_bytes))
    partial = merged_spans(spans, "class").join(classes.filter("not copied"), "class").select("class", F.col("spans").cast(SPANS).alias("spans"))
    return partial.union(classes.filter("copied").select("class", F.lit(None).cast(SPANS)))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, shard_bytes: int = SHARD_BYTES,
                   in_memory: int = IN_MEMORY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)``: kept holds the bytes that stay (which may cut a character in two)."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_column).alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("class"), F.xxhash64(text).alias("tag"))
    verdicts = stored(repeated_spans(keyed, length, gram, hot, shard_bytes, in_memory), "verdicts").withColumn("hit", F.lit(True))
    spans = verdicts.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size(F.coalesce("spans", F.array()))), F.lit(0))).first()[0]
    rows = keyed.drop("tag").join(F.broadcast(verdicts) if spans <= BROADCAST_SPANS else verdicts, "class", "left")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sizes, removed, runs, kept = [], [], [], []
            for text, spans, hit in zip(as_bytes(batch.column(1)).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                gone = [(0, len(text))] if hit and spans is None and len(text) >= length else []
                if spans:
                    gone = list(zip(*(x.tolist() for x in merged(np.array([s["first"] for s in spans]), np.array([s["end"] for s in spans])))))
                edges = [0, *(x for span in gone for x in span), len(text)]
                sizes.append(len(text)), runs.append(len(gone)), removed.append(sum(b - a for a, b in gone))
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (sizes, removed, runs)), pa.array(kept, pa.binary())],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "spans", "hit").mapInArrow(task, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
