"""Substring deduplication over words: stretches of words that an earlier document has too.

Shards of the corpus are indexed by FM-indexes (``fm_index``), and documents are searched backwards in them: from the right
end of a window, word by word, as long as the range of suffixes still holds a document with a smaller id. What matches over
the whole length is reported as an interval. To search a document in the shards that can match it only, shards are made of
*contexts*: around each anchor (``anchors``) that several texts share, the words of all windows that hold it. Contexts are
dealt by the anchor's hash, so a window and its equals are in one shard, whatever the corpus' size.

Of equal documents only the one with the smallest id is searched; the others are removed whole. An anchor with more than
``HOT`` occurrences would make a shard that no task should hold: its equal contexts are made one, and windows of what is
left are counted in a grouped aggregation instead of being searched, with partial aggregates before the shuffle.

Defined results: null and empty texts have no words; documents with a null id lose nothing and make others lose nothing;
rows that repeat an id are one document to each other; an empty table gives an empty table. Other columns are not read.
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
from gleaner.llm.fm_index import FMIndex

WINDOW = 13
GRAM = 5
#: Occurrences of an anchor above which its windows are aggregated, not indexed.
HOT = 2_000
#: Words of a shard, above which it is closed.
SHARD_WORDS = 1 << 18
#: Verdicts up to which every task gets them all, in intervals of 16 bytes.
BROADCAST_SPANS = 1_000_000


def _word_anchors(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(words)
    if n < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    grams = hashes[:n - gram + 1]
    for k in range(1, gram):
        grams = mixed(grams) + hashes[k:n - gram + 1 + k]
    grams = mixed(grams)
    at = minimizers(grams, window - gram + 1)
    return grams[at], at


def search_shard(contexts: list[tuple[bytes, int, int]], window: int, gram: int) -> list[np.ndarray]:
    """For each context (words, words before its anchor, document): which of its windows a smaller document has.

    Equal contexts are one text, owned by their smallest document: the others have all its windows twice.
    """
    owner: dict[tuple[bytes, int], int] = {}
    for words, left, doc in contexts:
        owner[words, left] = min(doc, owner.get((words, left), doc))
    keys = list(owner)
    number: dict[bytes, int] = {}
    texts = [np.fromiter((number.setdefault(w, len(number) + 1) for w in words.split(b" ")), np.int64) for words, _ in keys]
    owners = np.unique(np.fromiter(owner.values(), np.int64, len(keys)), return_inverse=True)[1]
    starts = [np.arange(min(left, len(text) - window) + 1) for (_, left), text in zip(keys, texts)]
    counts = np.fromiter(map(len, starts), np.int64, len(keys))
    which = np.repeat(np.arange(len(keys)), counts)
    index = FMIndex(texts, owners, len(number))
    flat = np.concatenate(texts)
    place = np.concatenate(([0], np.cumsum([len(t) for t in texts])))[which] + np.concatenate(starts)
    active, low, high = np.arange(len(which)), np.zeros(len(which), np.int64), np.full(len(which), index.n, np.int64)
    for back in range(window - 1, -1, -1):
        low, high = index.extend(flat[place[active] + back], low, high)
        earlier = index.least_owner(low, high) < owners[which[active]]
        active, low, high = active[earlier], low[earlier], high[earlier]
        if not len(active):
            break
    hit = np.zeros(len(which), bool)
    hit[active] = True
    found = dict(zip(keys, np.split(hit, np.cumsum(counts)[:-1])))
    return [found[words, left] if doc == owner[words, left] else np.ones(len(found[words, left]), bool) for words, left, doc in contexts]


def _spans(docs: list[int], firsts: list[int], hits: list[np.ndarray], window: int) -> Iterator[pa.RecordBatch]:
    """Intervals of words under hit windows."""
    out = ([], [], [])
    for doc, first, hit in zip(docs, firsts, hits):
        if hit.any():
            starts = np.nonzero(hit)[0] + first
            a, b = merged(starts, starts + window)
            out[0].append(np.full(len(a), doc, np.int64)), out[1].append(a), out[2].append(b)
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t)) for c, t in zip(out, (np.int64, np.int32, np.int32))], names=["doc_id", "first", "end"])


def _common_spans(contexts: DataFrame, window: int) -> DataFrame:
    """``(doc_id, first, end)`` for contexts of common anchors. Equal contexts are one first; then windows are counted."""
    each = contexts.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("left").alias("left"), F.first("words", ignorenulls=True).alias("words"))
    each = stored(each, "contexts")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, digests, owners, offsets = [], [], [], []
            for digest, least, left, text in zip(*(column.to_pylist() for column in batch.columns)):
                words = text.split(b" ")
                for offset in range(min(left, len(words) - window) + 1):
                    keys.append(xxhash.xxh3_128_digest(b" ".join(words[offset:offset + window])))
                    digests.append(digest), owners.append(least), offsets.append(offset)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.binary()), pa.array(owners, pa.int64()), pa.array(offsets, pa.int32())],
                                             names=["w", "digest", "least", "offset"])

    windows = each.mapInArrow(task, "w binary, digest binary, least bigint, offset int")
    twice = windows.groupBy("w").agg(F.min("least").alias("low"), F.max("least").alias("high")).filter("low < high").select("w", "low")
    earlier = windows.join(twice, "w").filter("low < least").groupBy("digest").agg(F.collect_list("offset").alias("offsets"))
    known = each.select("digest", "least", (F.size(F.split(F.col("words").cast("string"), " ")) - window).alias("room")).join(earlier, "digest", "left")
    members = contexts.select("digest", "doc_id", "first", "left").join(known, "digest")
    whole = F.array(F.struct(F.col("first").alias("first"), (F.col("first") + F.least("left", "room") + window).alias("end")))
    some = F.transform("offsets", lambda o: F.struct((F.col("first") + o).alias("first"), (F.col("first") + o + window).alias("end")))
    return members.select("doc_id", F.inline(F.when(F.col("doc_id") > F.col("least"), whole).otherwise(some)))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(doc_id, class, spans)`` of documents that lose words; spans is null if the whole document equals an earlier one.

    ``docs`` has doc_id (long), text, ``class`` (digest of the text) and ``tag`` (hash of the text).
    """
    side = window - gram
    known = docs.filter("doc_id is not null")
    classes = known.groupBy("class").agg(F.min("doc_id").alias("least"), F.first("tag").alias("tag"))
    classes = stored(classes, "classes")

    def finder(text: bytes) -> tuple[np.ndarray, np.ndarray]:
        return _word_anchors(text.split(), window, gram)

    shared = stored(shared_anchors(known, finder, False), "anchors")
    often = stored(shared.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("h", F.lit(True).alias("hot")), "hot")
    any_hot = not often.isEmpty()
    marked = shared.join(often, "h", "left") if any_hot else shared.withColumn("hot", F.lit(None).cast("boolean"))
    places = marked.groupBy("tag").agg(F.collect_set(F.struct("at", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("places"))
    wanted = classes.join(places, "tag").select(F.col("least").alias("doc_id"), "class", "places")
    texts = known.join(wanted, ["doc_id", "class"]).select("doc_id", "text", "places")

    def contexts(hot_ones: bool):
        """Contexts of common anchors, or of the others. Words of a common context leave a task once."""
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[bytes] = set()
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            for batch in pieces(batches, "text"):
                out: tuple[list, ...] = tuple([] for _ in kinds)
                for doc, text, places in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)).to_pylist(), batch.column(2).to_pylist()):
                    ats = sorted(p["at"] for p in places if p["hot"] == hot_ones)
                    if not ats:
                        continue
                    words = text.split()
                    grams, found = _word_anchors(words, window, gram)
                    chosen = np.isin(found, ats)
                    for h, at in zip(grams[chosen].view(np.int64).tolist(), found[chosen].tolist()):
                        first = max(0, at - side)
                        content = b" ".join(words[first:at + window])
                        digest = xxhash.xxh3_128_digest(b"%d " % (at - first) + content) if hot_ones else None
                        for column, value in zip(out, (h, doc, first, at - first, None if digest in seen else content, digest)):
                            column.append(value)
                        if hot_ones:
                            seen.add(digest)
                for start in range(0, len(out[0]), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[start:start + 20_000], k) for c, k in zip(out, kinds)],
                                                     names=["h", "doc_id", "first", "left", "words", "digest"])

        return task

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def close() -> Iterator[pa.RecordBatch]:
            hits = search_shard([(r[3], r[2], r[0]) for r in held], window, gram)
            yield from _spans([r[0] for r in held], [r[1] for r in held], hits, window)
            held.clear()

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for h, *row in zip(*columns):
                if h != last and size >= shard_words:
                    yield from close()
                    size = 0
                last = h
                held.append(tuple(row))
                size += window + side
        if held:
            yield from close()

    columns = "h bigint, doc_id bigint, first int, left int, words binary, digest binary"
    cold = texts.mapInArrow(contexts(False), columns).drop("digest").repartition("h").sortWithinPartitions("h")
    spans = cold.mapInArrow(search, "doc_id bigint, first int, end int")
    if any_hot:
        common = texts.filter(F.exists("places", lambda p: p["hot"])).mapInArrow(contexts(True), columns)
        spans = spans.union(_common_spans(stored(common, "common"), window))

    partial = merged_spans(spans, "doc_id")
    partial = classes.join(partial, F.col("least") == F.col("doc_id")).select("doc_id", "class", "spans")
    copies = known.select("doc_id", "class").distinct().join(classes, "class").filter("doc_id > least")
    return partial.union(copies.select("doc_id", "class", F.lit(None).cast(partial.schema["spans"].dataType)))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard_words: int = SHARD_WORDS,
                   id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``: kept holds the words that stay, joined by one space."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("class"), F.xxhash64(text).alias("tag"))
    verdicts = stored(repeated_spans(keyed, window, gram, hot, shard_words), "verdicts").withColumn("hit", F.lit(True))
    spans = verdicts.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size(F.coalesce("spans", F.array()))), F.lit(0))).first()[0]
    rows = keyed.drop("tag").join(F.broadcast(verdicts) if spans <= BROADCAST_SPANS else verdicts, ["doc_id", "class"], "left")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            counts, removed, kept = [], [], []
            for text, spans, hit in zip(as_bytes(batch.column(1)).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = text.split()
                stay = np.ones(len(words), bool)
                if hit and spans is None and len(words) >= window:
                    stay[:] = False
                for span in spans or ():
                    stay[span["first"]:span["end"]] = False
                counts.append(len(words)), removed.append(len(words) - int(stay.sum()))
                kept.append(b" ".join(words if stay.all() else [words[i] for i in np.nonzero(stay)[0].tolist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                                             names=["doc_id", "n_words", "n_removed", "kept"])

    return rows.select("doc_id", "text", "spans", "hit").mapInArrow(task, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
